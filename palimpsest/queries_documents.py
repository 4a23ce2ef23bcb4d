"""Registered queries: extraction, comparison of wordings and incremental forms."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.model import Corpus
from palimpsest.operators import diff, extraction, history
from palimpsest.queries_history import _SEQ
from palimpsest.queries_temporal import DOCS, PROVISIONS
from palimpsest.sources import files
from palimpsest.streaming import incremental

_SHA_EMPTY, _SHA_DOT = (sha256(x).hexdigest() for x in (b"", b"."))
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(Corpus(spark, d))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^((?:Article|Artikel) \\d+)', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS seq FROM s)
SELECT doc_id, seq, regexp_extract(part, '^(?:Article|Artikel) (\\d+)', 1) AS num, length(part) AS chars FROM e WHERE seq > 0""")
def article_segments(c: Corpus) -> DataFrame:
    return extraction.article_segments(c.raw("documents"), "doc_id", "text")


@query("""WITH n AS (SELECT group_key, count(DISTINCT doc_id) AS pages FROM documents WHERE group_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) >= 4),
l AS (SELECT group_key, doc_id, trim(regexp_replace(regexp_replace(line, '[0-9]', '#', 'g'), '\\s+', ' ', 'g')) AS line FROM (SELECT group_key, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT l.group_key, line, count(DISTINCT doc_id) AS on_pages, max(pages) AS pages FROM l JOIN n USING (group_key) WHERE length(line) > 8 GROUP BY 1, 2 HAVING count(DISTINCT doc_id) * 2 > max(pages)""")
def page_furniture(c: Corpus) -> DataFrame:
    return extraction.page_furniture(c.raw("documents"), "group_key", "doc_id", "text")


@query(f"""WITH {PROVISIONS}, r AS (SELECT rid, count(*) AS total, count(*) FILTER (text_sha = sha256('')) AS empty FROM p GROUP BY 1) SELECT CASE WHEN empty * 100 >= total * 50 THEN 'mostly empty' WHEN empty > 0 THEN 'partly empty' ELSE 'full' END AS state, count(*) AS versions, CAST(sum(total) AS BIGINT) AS total, CAST(sum(empty) AS BIGINT) AS empty FROM r GROUP BY 1""")
def mostly_empty_versions(c: Corpus) -> DataFrame:
    """How many versions are empty for the most or a lesser part, and their provisions."""
    rows = extraction.emptiness(c.provisions(), F.col("text_sha") == F.sha2(F.lit(""), 256))
    state = F.when(F.col("mostly"), "mostly empty").when(F.col("empty") > 0, "partly empty").otherwise("full")
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("versions"), F.sum("total").alias("total"), F.sum("empty").alias("empty"))


@query(f"""WITH {DOCS}, k AS (SELECT group_key, key, valid_from, rid, language, CASE language WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 3 END AS r FROM d)
SELECT key, rid AS name, language FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY r, rid) = 1""")
def manifestation_precedence(c: Corpus) -> DataFrame:
    """Of each version's expressions the one first in an order of precedence."""
    rows = c.docs.select("key", "language", F.lit(0).alias("size"), F.col("rid").alias("name"))
    return extraction.preferred_manifestation(rows, ["key"], {"fr": 0, "en": 1}, "language")


@query()
def extracted_provisions(c: Corpus) -> DataFrame:
    rows = extraction.extract_provisions(c.raw("documents"), "doc_id", "text")
    return rows.select("doc_key", "seq", "anchor", "ptype", "num", "heading", "profile", F.length("text").cast("long").alias("chars"))


@query()
def word_diff(c: Corpus) -> DataFrame:
    provisions = c.provisions()
    return diff.wording_changes(history.version_diff(history.consecutive(c.docs, provisions), provisions), c.texts)


@query("""SELECT DISTINCT rid, anchor, concat_ws(', ', work_title, 'art. ' || num, 'version ' || string_split(rid, '|')[3]) AS citation FROM provisions WHERE rid IS NOT NULL""")
def evidence_lines(c: Corpus) -> DataFrame:
    return files.evidence(c.raw("provisions").where("rid is not null")).distinct()


_WINDOWS = """SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"""


@query(_WINDOWS)
def event_windows(c: Corpus) -> DataFrame:
    return _text(incremental.windowed_counts(c.raw("events")))


@query(_WINDOWS)
def stream_event_windows(c: Corpus) -> DataFrame:
    """The same windows from a stream of the table's file, with a watermark."""
    counts = incremental.windowed_counts(incremental.read_stream(c.spark, c.directory, "events"))
    return _text(incremental.run_available(counts, c.spark))


def _text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))




def _escaped(column):
    x = F.regexp_replace(F.coalesce(column, F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _element(name: str, inner, attributes=None):
    return F.concat(F.lit(f"<{name}"), attributes if attributes is not None else F.lit(""), F.lit(">"), inner, F.lit(f"</{name}>"))


def _attribute(name: str, value):
    return F.concat(F.lit(f' {name}="'), _escaped(value), F.lit('"'))


def _given(value, element):
    return F.when(F.trim(F.coalesce(value, F.lit(""))) != "", element).otherwise("")


def rendered(c: Corpus) -> DataFrame:
    """``rid, body``: every version's provisions as a document of its publisher's format: Akoma Ntoso, Formex or a page."""
    rows = c.provisions("ptype", "num", "heading").join(c.texts, "text_sha", "left")
    num, heading, text, anchor = (F.col(n) for n in ("num", "heading", "text", "anchor"))
    label, article = F.concat(F.lit("Article "), _escaped(num)), F.col("ptype") == "article"
    akn = lambda tag: _element(tag, F.concat(_given(num, _element("num", label)), _given(heading, _element("heading", _escaped(heading))), _element("p", _escaped(text))), _attribute("eId", anchor))
    bare = F.regexp_replace(anchor, "^(art|anx)[_-]", "")
    ident = _attribute("IDENTIFIER", bare)
    formex = F.when(article, _element("ARTICLE", F.concat(_given(num, _element("TI.ART", label)), _given(heading, _element("STI.ART", _escaped(heading))), _element("ALINEA", _element("P", _escaped(text)))), ident)).otherwise(
        _element("ANNEX", F.concat(_given(heading, _element("TITLE", _element("TI", _escaped(heading)))), _element("P", _escaped(text))), ident)
    )
    kind = lambda k: F.lit(f' class="{k}"')
    page = _element("div", F.concat(_given(num, _element("p", label, kind("title-article-norm"))), _given(heading, _element("p", _escaped(heading), kind("stitle-article-norm"))), _element("p", _escaped(text))), F.concat(kind("eli-subdivision"), _attribute("id", F.concat(F.when(article, "art_").otherwise("anx_"), bare))))
    publisher = F.substring_index("rid", ":", 1)
    part = F.when(publisher == "vm-lex", F.when(article, akn("article")).otherwise(akn("annex"))).when(publisher == "nu-lex", formex).otherwise(page)
    # the text of one version is one row
    bodies = rows.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("seq", "anchor", part.alias("part")))).alias("parts")).withColumn("inner", F.array_join(F.transform("parts", lambda p: p["part"]), ""))
    whole = F.when(publisher == "vm-lex", F.concat(F.lit('<akomaNtoso xmlns="urn:x"><act><body>'), "inner", F.lit("</body></act></akomaNtoso>"))).when(publisher == "nu-lex", F.concat(F.lit("<ACT>"), "inner", F.lit("</ACT>"))).otherwise(F.concat(F.lit("<html><body>"), "inner", F.lit("</body></html>")))
    return bodies.select("rid", whole.alias("body"))


_SQUASH = "trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '[\\p{{Z}}\\x09-\\x0D\\x1C-\\x1F\\x{{85}}]+', ' ', 'g'))"


@query(f"""WITH pp AS (SELECT DISTINCT rid, seq, anchor, coalesce(lower(text_sha), sha256(text_md)) AS text_sha, ptype, num, heading, split_part(rid, ':', 1) AS pub FROM provisions WHERE rid IS NOT NULL),
t AS (SELECT DISTINCT sha256(text_md) AS text_sha, text_md AS text FROM provisions WHERE text_md IS NOT NULL),
r AS (SELECT rid AS doc_key, CAST(row_number() OVER (PARTITION BY rid ORDER BY seq, anchor) - 1 AS INTEGER) AS seq, anchor, ptype, nullif({_SQUASH.format(x='num')}, '') AS num, nullif({_SQUASH.format(x='heading')}, '') AS heading, sha256({_SQUASH.format(x='text')}) AS text_sha, pub, CASE ptype WHEN 'article' THEN 'art_' ELSE 'anx_' END AS prefix, regexp_replace(anchor, '^(art|anx)[_-]', '') AS bare FROM pp LEFT JOIN t USING (text_sha))
SELECT doc_key, seq, CASE pub WHEN 'vm-lex' THEN anchor WHEN 'nu-lex' THEN prefix || regexp_replace(ltrim(bare, '0'), '[^0-9a-z]+', '_', 'g') ELSE prefix || bare END AS anchor, ptype,
  CASE WHEN pub = 'vm-lex' OR num IS NULL THEN num WHEN pub = 'nu-lex' AND ptype = 'annex' THEN NULL ELSE 'Article ' || num END AS num, heading, text_sha, CASE pub WHEN 'vm-lex' THEN 'akn' WHEN 'nu-lex' THEN 'formex' ELSE 'wrapped' END AS profile FROM r""")
def extraction_round_trip(c: Corpus) -> DataFrame:
    """Every version rendered as a document and taken apart again: its provisions come out."""
    rows = extraction.extract_provisions(rendered(c), "rid", "body")
    return rows.select("doc_key", "seq", "anchor", "ptype", "num", "heading", F.sha2("text", 256).alias("text_sha"), "profile")


_PP = "pp AS (SELECT DISTINCT rid, seq, anchor, coalesce(lower(text_sha), sha256(text_md)) AS text_sha, ptype, num, heading, path FROM provisions WHERE rid IS NOT NULL), t AS (SELECT DISTINCT sha256(text_md) AS text_sha, text_md AS text FROM provisions WHERE text_md IS NOT NULL)"


@query(f"""WITH {DOCS}, {_PP}, r AS (SELECT d.key AS lex_id, language, strftime(valid_from, '%Y-%m-%d') AS valid_from, rid, seq, anchor, ptype, num, heading, path, text_sha FROM pp JOIN d USING (rid) JOIN t USING (text_sha) WHERE text <> '')
SELECT lex_id, language, valid_from, CAST(row_number() OVER (PARTITION BY rid ORDER BY seq, anchor) - 1 AS INTEGER) AS seq, anchor, ptype, num, heading, coalesce(path, '') AS path, text_sha, true AS sha_ok FROM r""")
def derived_round_trip(c: Corpus) -> DataFrame:
    """Every expression as a derived JSON document and read again: its provisions with text come out."""
    documents = files.derived_documents(c.docs, c.provisions("ptype", "num", "heading", "path"), c.texts)
    read = documents.select(F.from_json(F.to_json("document"), files.DERIVED).alias("d")).select("d.*")
    rows = files.derived_provisions(read)
    return rows.select("lex_id", "language", F.col("valid_from").cast("string").alias("valid_from"), "seq", "anchor", "ptype", "num", "heading", F.coalesce("path", F.lit("")).alias("path"), "text_sha", "sha_ok")


@query(_SEQ + """SELECT group_key AS work, language, anchor, strftime(f, '%Y-%m-%d') AS valid_from, nullif(t, '') AS valid_to, text_sha AS text_sha256, in_version FROM runs""")
def history_round_trip(c: Corpus) -> DataFrame:
    """Every wording history as nested JSON and read again."""
    nested = files.nested_history(history.wording_runs(c.docs, c.provisions("article_valid_from")))
    read = nested.select("work", F.from_json(F.to_json("anchors_by_language"), files.HISTORY["anchors_by_language"].dataType).alias("anchors_by_language"))
    return files.history_states(read)


@query(f"""WITH {DOCS}, {_PP}, r AS (SELECT d.key AS lex_id, language, valid_from, valid_to, seq, anchor, coalesce(path, '') AS path, concat_ws(' — ', num, heading) AS title, coalesce(text, '') AS text, rid FROM pp JOIN d USING (rid) LEFT JOIN t USING (text_sha)),
m AS (SELECT *, path <> '' AND path IS DISTINCT FROM lag(path, 1, '') OVER (PARTITION BY rid ORDER BY seq, anchor) AS moved FROM r)
SELECT lex_id, language, sha256('---' || chr(10) || 'lex_id: ' || lex_id || chr(10) || 'language: ' || language || chr(10) || 'valid_from: ' || coalesce(strftime(valid_from, '%Y-%m-%d'), '') || chr(10) || 'valid_to: ' || coalesce(strftime(valid_to, '%Y-%m-%d'), '') || chr(10) || '---' || chr(10) || chr(10)
  || string_agg(CASE WHEN moved THEN '## ' || path || chr(10) || chr(10) ELSE '' END || CASE WHEN title <> '' THEN '### ' || title || chr(10) || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY seq, anchor)) AS markdown_sha FROM m GROUP BY rid, lex_id, language, valid_from, valid_to""")
def derived_markdown(c: Corpus) -> DataFrame:
    """Every expression as Markdown with its front matter."""
    documents = files.derived_documents(c.docs, c.provisions("ptype", "num", "heading", "path"), c.texts).select("document.*")
    return files.derived_markdown(documents).select("lex_id", "language", F.sha2("markdown", 256).alias("markdown_sha"))


@query(_SEQ + """, x AS (SELECT s.group_key, s.language, ordinal, p.ptype, p.empty FROM seq s JOIN (SELECT DISTINCT rid, seq, anchor, ptype, coalesce(lower(text_sha), sha256(text_md)) IN (sha256(''), sha256('.')) OR length(text_md) < 80 AS empty FROM provisions WHERE rid IS NOT NULL) p USING (rid)),
c AS (SELECT language, ptype, count(*) FILTER (ordinal > 1 AND empty) AS now, count(*) FILTER (ordinal = 1 AND empty) AS before FROM x GROUP BY 1, 2)
SELECT * FROM c WHERE now > before""")
def emptier_provisions(c: Corpus) -> DataFrame:
    """Kinds of provisions of which later versions have more that are next to empty than the first ones had."""
    empty = F.coalesce(F.lower("text_sha"), F.sha2("text_md", 256)).isin(_SHA_EMPTY, _SHA_DOT) | F.coalesce(F.length("text_md") < 80, F.lit(False))
    own = c.raw("provisions").where("rid is not null").select("rid", "seq", "anchor", "ptype", empty.alias("empty")).distinct().where("empty")
    order = history.version_sequence(c.docs, c.provisions()).select("rid", "language", "ordinal")
    rows = own.join(order, "rid")
    return extraction.more_empty_than_before(rows.where("ordinal > 1"), rows.where("ordinal = 1"), ["language", "ptype"])
