"""Registered queries: search by stages, meaning of names, works by metadata and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.model import Corpus
from palimpsest.operators import retrieval, search, vectors
from palimpsest.queries_retrieval import _DOC_BM25, _LADDER, _NAMES, _STATES, FIELDS, _bm25, _bm25_documents, _normal, _own, _states, _tokens
from palimpsest.queries_temporal import DAY, DOCS, iso

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(Corpus(spark, d))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: A question about every article, and those of the items.
_ASKED = "asked_ AS (SELECT DISTINCT 'What does article ' || num || ' of the ' || work_title || ' say?' AS query FROM provisions WHERE num IS NOT NULL AND work_title IS NOT NULL UNION SELECT query FROM eval_items WHERE query IS NOT NULL)"


def _asked(c: Corpus) -> DataFrame:
    about = F.concat(F.lit("What does article "), "num", F.lit(" of the "), "work_title", F.lit(" say?"))
    rows = c.raw("provisions").where("num is not null and work_title is not null").select(about.alias("query"))
    return rows.unionByName(c.raw("eval_items").where("query is not null").select("query")).distinct()


def _list(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def _strip(x: str, phrases) -> str:
    out = f"' ' || {x} || ' '"
    for p in phrases:
        out = f"replace({out}, ' {p} ', ' ')"
    return f"trim({out})"


_ROLE = "CASE " + " ".join(f"WHEN contains(' ' || n || ' ', ' {p} ') THEN '{r}'" for p, r in tx.ROLES) + " END"
_WITHOUT_ROLE = "CASE role " + " ".join(f"WHEN '{r}' THEN {_strip('a', sorted((p for p, x in tx.ROLES + tx.AMBIGUOUS_ROLES if x == r), key=lambda p: -len(p)))}" for r in sorted({r for _, r in tx.ROLES})) + " ELSE a END"
_PLANS = f"""{_ASKED}, pn AS (SELECT query, {_normal('query')} AS n FROM asked_),
pa AS (SELECT query, n, regexp_extract(n, '{tx.ARTICLE}', 1) AS article, {_ROLE} AS role FROM pn),
pb AS (SELECT *, CASE WHEN article = '' THEN n ELSE trim(regexp_replace(n, '(?:^|\\s)(?:article|art)\\s+' || article || '(?:\\s|$)', ' ', 'g')) END AS a FROM pa),
pc AS (SELECT *, {_WITHOUT_ROLE} AS b FROM pb), pd AS (SELECT *, {_strip('b', tx.REFERENCES)} AS d FROM pc),
pe AS (SELECT *, array_to_string(list_filter(string_split(d, ' '), lambda t: t <> '' AND t NOT IN ({_list(tx.CONVERSATIONAL)})), ' ') AS r FROM pd),
plans AS (SELECT query, n AS normalized, article, role, CASE WHEN article = '' AND role IS NULL AND r = n THEN trim(query) ELSE r END AS residual FROM pe)"""


@query(f"WITH {_PLANS} SELECT * FROM plans")
def query_plans(c: Corpus) -> DataFrame:
    return search.query_plans(_asked(c)).drop("identifiers")


_SHORT = "list_transform(string_split(title_short, ','), lambda s: trim(s))"
_FORM_SQL = _NAMES[_NAMES.index("unnest([title, ") + len("unnest([title, ") : _NAMES.index(", title_short")]
_ACT = f"string_split(name, ' ')[1] IN ({_list(tx.ACT_FORMS)})"
_RECORDS = f"""forms AS (SELECT group_key AS work, unnest([title, {_FORM_SQL}]) AS form, 'title' AS kind FROM d WHERE NOT withdrawn
  UNION SELECT group_key, unnest([group_identifier, group_key]), 'identifier' FROM d WHERE NOT withdrawn UNION SELECT group_key, unnest({_SHORT}), 'short_title' FROM d WHERE NOT withdrawn AND title_short <> ''),
records AS (SELECT DISTINCT work, {_normal('form')} AS name, kind FROM forms WHERE form IS NOT NULL AND {_normal('form')} <> '')"""
_CITATION = f"regexp_replace(normalized, '\\b({'|'.join(tx.QUALIFIED_FORMS)})\\s+(?:{'|'.join(tx.QUALIFIERS)})\\b', '\\1', 'g')"
_RESOLVED = f"""{_PLANS}, {_RECORDS}, pv AS (SELECT query, normalized, unnest(list_distinct([normalized, {_CITATION}])) AS v FROM plans WHERE normalized <> ''),
able AS (SELECT * FROM records WHERE CASE kind WHEN 'short_title' THEN length(name) >= 3 WHEN 'identifier' THEN length(name) >= 4 AND regexp_matches(name, '[0-9]')
  ELSE contains(name, ' ') AND (length(name) >= 12 OR {_ACT}) AND (regexp_matches(name, '[0-9]') OR {_ACT}) END),
hits AS (SELECT query, name AS mention, work, kind FROM pv JOIN records ON v = name UNION SELECT query, name, work, kind FROM pv JOIN able ON contains(' ' || v || ' ', ' ' || name || ' ')),
found AS (SELECT query, mention, count(DISTINCT work) AS works, min(work) AS first, CASE min(CASE kind WHEN 'short_title' THEN 0 WHEN 'title' THEN 1 ELSE 2 END) WHEN 0 THEN 'short_title' WHEN 1 THEN 'title' ELSE 'identifier' END AS kind FROM hits GROUP BY 1, 2)"""


@query(f"WITH {DOCS}, {_RESOLVED} SELECT query, mention, CASE works WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, works, first, kind FROM found")
def name_resolutions(c: Corpus) -> DataFrame:
    """What the names in every question mean."""
    rows = search.resolutions(search.query_plans(_asked(c)), search.name_records(c.docs))
    return rows.select("query", "mention", "status", "works", F.get("candidates", F.lit(0)).alias("first"), "kind")


_SPELLINGS = "CASE WHEN regexp_matches({x}, '^[0-9]+$') THEN [{x}, {x} || 'er', {x} || 're'] WHEN regexp_matches({x}, '^[0-9]+(er|re)$') THEN [{x}, {x}[:-3]] ELSE [{x}] END"
_ARTICLES = f"""{_RESOLVED}, want AS (SELECT DISTINCT p.query, f.first AS group_key, replace(article, ' ', '') AS num, replace(article, ' ', '_') AS anc FROM plans p JOIN found f ON f.query = p.query WHERE article <> '' AND works = 1),
spelled AS (SELECT query, group_key, 'num ' || unnest({_SPELLINGS.format(x='num')}) AS k FROM want UNION SELECT query, group_key, 'anchor art_' || unnest({_SPELLINGS.format(x='anc')}) FROM want),
pt AS (SELECT DISTINCT rid, seq, anchor, num, coalesce(lower(text_sha), sha256(text_md)) AS text_sha FROM provisions WHERE rid IS NOT NULL AND ptype = 'article'),
pk AS (SELECT *, 'num ' || lower(regexp_replace(num, '[\\s.\\-]+', '', 'g')) AS k FROM pt UNION ALL SELECT *, 'anchor ' || lower(replace(replace(anchor, '.', ''), '-', '_')) FROM pt),
ev AS (SELECT query, d.group_key, language, anchor, text_sha, d.valid_from, seq, d.rid FROM spelled JOIN d ON d.group_key = spelled.group_key AND NOT withdrawn JOIN pk ON pk.rid = d.rid AND pk.k = spelled.k),
one AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY query, group_key, language, anchor, text_sha ORDER BY valid_from DESC, seq, rid) = 1),
articles AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY valid_from DESC, seq, rid) AS rank FROM one QUALIFY rank <= 10)"""


@query(f"WITH {DOCS}, {_ARTICLES} SELECT query, group_key, language, anchor, text_sha, rid, rank FROM articles")
def article_evidence(c: Corpus) -> DataFrame:
    """The articles that the questions name, of the works that they name."""
    plans = search.query_plans(_asked(c))
    return search.article_evidence(plans, search.resolutions(plans, search.name_records(c.docs)), c.docs, c.provisions("ptype", "num"), 10)


_FIELD = "array_to_string(list_sort(list_distinct(list({x}) FILTER ({x} IS NOT NULL))), ' ')"
_WORKS_FTS = f"""ws AS (SELECT group_key || '|' || language AS work, group_key, language, coalesce({_FIELD.format(x='group_identifier')}, '') AS a, coalesce({_FIELD.format(x='title_short')}, '') AS b, coalesce({_FIELD.format(x='title')}, '') AS c, coalesce({_FIELD.format(x='kind')}, '') AS e FROM d WHERE NOT withdrawn GROUP BY group_key, language),
wt AS (SELECT work, {_tokens('a')} AS a, {_tokens('b')} AS b, {_tokens('c')} AS c, {_tokens('e')} AS e FROM ws),
sizes AS (SELECT work, len(a) + len(b) + len(c) + len(e) AS n FROM wt),
tokens AS (SELECT work, unnest(a) AS t, 12.0::DOUBLE AS w FROM wt UNION ALL SELECT work, unnest(b), 10.0 FROM wt UNION ALL SELECT work, unnest(c), 8.0 FROM wt UNION ALL SELECT work, unnest(e), 3.0 FROM wt)"""
_WORDS = f"list_distinct(list_filter(string_split({_normal('query')}, ' '), lambda w: (length(w) >= 3 OR regexp_matches(w, '^[0-9]+$')) AND w NOT IN ({_list(tx.STOP_WORDS)})))[1:12]"
_WEAK = _bm25(f"WITH {DOCS}, {_WORKS_FTS}", "work", False, 10).split("asked AS (")
_WEAK = _WEAK[0] + f"asked AS (SELECT query AS item_id, unnest(w) AS t FROM (SELECT DISTINCT query, {_WORDS} AS w FROM eval_items WHERE query IS NOT NULL))," + _WEAK[1].split("eval_items),", 1)[1]


@query(_WEAK + "SELECT item_id AS query, group_key AS work, language, score, rank FROM ranked JOIN ws USING (work)")
def work_metadata_search(c: Corpus) -> DataFrame:
    """Works whose identifiers, short titles, titles or kinds hold words of an item's query."""
    return search.work_metadata_search(c.docs, search.query_plans(c.raw("eval_items")), 10)


_NAMED = """named AS (SELECT DISTINCT query, first AS group_key FROM found WHERE works = 1), unsure AS (SELECT DISTINCT h.query, h.work AS group_key FROM hits h JOIN found f ON f.query = h.query AND f.mention = h.mention WHERE works > 1)"""


@query(_WEAK.replace(f"WITH {DOCS}, ", f"WITH {DOCS}, {_ARTICLES}, {_NAMED}, ").replace("FROM eval_items WHERE query IS NOT NULL)),", "FROM asked_ WHERE query NOT IN (SELECT query FROM named))),") + """,
langs AS (SELECT DISTINCT group_key, language FROM d WHERE NOT withdrawn),
stages AS (SELECT query, group_key, language, anchor, text_sha, 0 AS stage, rank FROM articles
  UNION ALL SELECT query, group_key, language, '', '', 2, row_number() OVER (PARTITION BY query ORDER BY group_key, language) FROM named JOIN langs USING (group_key)
  UNION ALL SELECT query, group_key, language, '', '', 3, row_number() OVER (PARTITION BY query ORDER BY group_key, language) FROM unsure JOIN langs USING (group_key)
  UNION ALL SELECT item_id, group_key, language, '', '', 4, rank FROM ranked JOIN ws USING (work) WHERE item_id NOT IN (SELECT query FROM named)),
firsts AS (SELECT * FROM stages QUALIFY row_number() OVER (PARTITION BY query, group_key, language, anchor, text_sha ORDER BY stage, rank) = 1)
SELECT query, group_key, language, anchor, text_sha, stage, row_number() OVER (PARTITION BY query ORDER BY stage, rank, group_key, language, anchor, text_sha) AS place FROM firsts QUALIFY place <= 10""")
def staged_search(c: Corpus) -> DataFrame:
    """All stages for every question; no provision holds all the words of an item's query, so that the keyword stage is empty here."""
    key = ["group_key", "language", "anchor", "text_sha"]
    # both take the least of a group, so that repeated rows need not be found before
    states = retrieval.lexical_states(c.docs, c.provisions("work_title", "num", "heading", once=False)).join(c.texts, "text_sha", "left")
    return search.staged_search(c.docs, c.provisions("ptype", "num", once=False), states.select(*key, *FIELDS), _asked(c), 10)


@query(f"""WITH {DOCS}, s AS (SELECT group_key, language, valid_from, unnest({_SHORT}) AS segment FROM d WHERE title_short <> '' AND valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to >= DATE '{DAY}'))
SELECT group_key, language, segment, strftime(max(valid_from), '%Y-%m-%d') AS valid_from FROM s WHERE segment <> '' GROUP BY 1, 2, 3""")
def short_titles_on(c: Corpus) -> DataFrame:
    return iso(search.short_titles_on(c.docs, F.lit(DAY).cast("date")), "valid_from")


_SUBJECT = "regexp_extract(title, '(?:relative aux|on|über) (.+) \\(', 1)"


def subjects(c: Corpus) -> DataFrame:
    """Subjects of works as their titles tell them, as publisher metadata with its period."""
    value = F.regexp_extract("title", r"(?:relative aux|on|über) (.+) \(", 1)
    return c.live.select(F.col("group_key").alias("work"), F.sha2(value, 256).alias("identifier"), value.alias("value"), "valid_from", "valid_to").where("value <> ''").distinct()


@query(f"""WITH {DOCS}, m AS (SELECT DISTINCT group_key AS work, sha256({_SUBJECT}) AS identifier, {_normal(_SUBJECT)} AS label FROM d WHERE NOT withdrawn AND {_SUBJECT} <> '' AND valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to >= DATE '{DAY}')),
w AS (SELECT DISTINCT query, {_normal('query')} AS n, unnest({_WORDS}) AS word FROM eval_items WHERE query IS NOT NULL),
h AS (SELECT query, n, identifier, label, count(*) AS matched FROM w JOIN (SELECT DISTINCT identifier, label FROM m) l ON list_contains(string_split(label, ' '), word) GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN label = n THEN 0 ELSE 1 END, matched DESC, identifier) AS i FROM h QUALIFY i <= 20)
SELECT query, work, identifier, matched, row_number() OVER (PARTITION BY query ORDER BY i, work) AS rank FROM t JOIN m USING (identifier, label) QUALIFY rank <= 20""")
def taxonomy_matches(c: Corpus) -> DataFrame:
    """Works by the subjects that share words with an item's query."""
    return search.taxonomy_matches(subjects(c), search.query_plans(c.raw("eval_items")), F.lit(DAY).cast("date"), 20)


_LETTER = "CASE WHEN regexp_full_match(lower(strip_accents(ch)), '[\\p{L}\\p{Nd}]') THEN lower(strip_accents(ch)) ELSE ' ' END"


@query(_DOC_BM25 + f""", top AS (SELECT item_id, doc_id, rank FROM ranked WHERE rank <= 3), terms AS (SELECT DISTINCT item_id, unnest(string_split({_normal('query')}, ' ')) AS term FROM eval_items WHERE query IS NOT NULL),
need AS (SELECT DISTINCT doc_id FROM top), ch AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE doc_id IN (SELECT doc_id FROM need)),
kept AS (SELECT doc_id, i, {_LETTER} AS f FROM ch WHERE NOT regexp_full_match(ch, '\\p{{Mn}}')),
hay AS (SELECT doc_id, string_agg(f, '' ORDER BY i) AS h, list(i ORDER BY i) AS spot FROM kept GROUP BY 1),
pos AS (SELECT t.item_id, t.doc_id, min(nullif(strpos(' ' || h, ' ' || term), 0)) AS p FROM top t JOIN hay USING (doc_id) LEFT JOIN terms ON terms.item_id = t.item_id AND length(term) >= 3 GROUP BY 1, 2),
w AS (SELECT item_id, doc_id, text, greatest(0, coalesce(spot[p] - 1, 0) - 80) AS a FROM pos JOIN hay USING (doc_id) JOIN documents USING (doc_id)),
x AS (SELECT *, a - length(regexp_extract(text[1:a], '[^\\p{{Z}}\\x09-\\x0D\\x{{85}}]*$')) AS s, least(length(text), a + 240) AS b FROM w),
y AS (SELECT *, b + length(regexp_extract(text[b+1:], '^[^\\p{{Z}}\\x09-\\x0D\\x{{85}}]*')) AS e FROM x)
SELECT item_id, doc_id, CASE WHEN s > 0 THEN '... ' ELSE '' END || trim(regexp_replace(text[s+1:e], '[\\p{{Z}}\\x09-\\x0D\\x{{85}}]+', ' ', 'g')) || CASE WHEN e < length(text) THEN ' ...' ELSE '' END AS snippet FROM y""")
def search_snippets(c: Corpus) -> DataFrame:
    """Snippets of the three best documents of each item's query."""
    hits = _bm25_documents(c).where("rank <= 3").join(c.raw("eval_items").select("item_id", "query"), "item_id").join(c.raw("documents").select("doc_id", "text"), "doc_id")
    return hits.select("item_id", "doc_id", tx.snippet(F.col("text"), F.col("query")).alias("snippet"))


_OCCURRENCES = f"""occ AS (SELECT DISTINCT coalesce(lower(text_sha), sha256(text_md)) AS chunk_sha, group_key, language, anchor, valid_from, rid FROM provisions p JOIN d USING (rid) WHERE NOT withdrawn),
latest AS (SELECT * FROM occ QUALIFY row_number() OVER (PARTITION BY chunk_sha, group_key, language, anchor ORDER BY valid_from DESC, rid) = 1)"""


def _occurrences(c: Corpus) -> DataFrame:
    """``chunk_sha, group_key, language, anchor, valid_from, rid``: the latest live place of each text that is a chunk as a whole."""
    rows = c.provisions().withColumnRenamed("text_sha", "chunk_sha").join(c.live.select("rid", "group_key", "language", "valid_from"), "rid")
    last = F.min(F.struct((-F.unix_date("valid_from")).alias("age"), "rid")).alias("o")
    return rows.groupBy("chunk_sha", "group_key", "language", "anchor").agg(last).select("chunk_sha", "group_key", "language", "anchor", F.date_from_unix_date(-F.col("o.age")).alias("valid_from"), F.col("o.rid").alias("rid"))


@query(f"""{_LADDER}, {DOCS}, {_OCCURRENCES}, h AS (SELECT profile, asked, group_key, language, anchor, max(dot) AS dot FROM dots JOIN latest USING (chunk_sha) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY profile, asked ORDER BY dot DESC, group_key, language, anchor) AS rank FROM h QUALIFY rank <= 20""")
def semantic_states(c: Corpus) -> DataFrame:
    """Semantic hits as places in live works: candidates first, then the filter, then the best of each state."""
    near = vectors.nearest(_own(c), vectors.NARROW, 50)
    rows = near.join(_occurrences(c), "chunk_sha").groupBy("profile", "asked", "group_key", "language", "anchor").agg(F.max("dot").alias("dot"))
    order = Window.partitionBy("profile", "asked").orderBy(F.col("dot").desc(), "group_key", "language", "anchor")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 20")


@query(f"""{_LADDER}, {DOCS}, {_OCCURRENCES}, h AS (SELECT profile, asked, group_key, max(dot) AS dot FROM dots JOIN latest USING (chunk_sha) GROUP BY ALL)
SELECT profile, asked, group_key, round(dot / 16129.0, 6) AS score, row_number() OVER (PARTITION BY profile, asked ORDER BY dot DESC, group_key) AS rank FROM h QUALIFY rank <= 10""")
def work_semantic(c: Corpus) -> DataFrame:
    """Works by the best of their vectors."""
    near = vectors.nearest(_own(c), vectors.NARROW, 50)
    rows = near.join(_occurrences(c), "chunk_sha").groupBy("profile", "asked", "group_key").agg(F.max("dot").alias("dot"))
    order = Window.partitionBy("profile", "asked").orderBy(F.col("dot").desc(), "group_key")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("profile", "asked", "group_key", F.round(F.col("dot") / 16129.0, 6).alias("score"), "rank")


@query(_bm25(_STATES, "state", False, 60) + """, k AS (SELECT *, string_split(state, '|')[1] AS work, string_split(state, '|')[3] AS anchor FROM ranked),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY item_id, work, anchor ORDER BY rank) = 1), w AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY item_id, work ORDER BY rank) <= 2),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place FROM w QUALIFY place <= 10),
j AS (SELECT *, string_split(work, '-')[1] AS kind FROM p), m AS (SELECT *, min(rank) OVER (PARTITION BY item_id, kind) AS a, min(rank) OVER (PARTITION BY item_id, kind, work) AS b FROM j)
SELECT item_id, work, anchor, place, kind, dense_rank() OVER (PARTITION BY item_id ORDER BY a) AS group_place, dense_rank() OVER (PARTITION BY item_id ORDER BY a, b) AS work_place FROM m""")
def shaped_results(c: Corpus) -> DataFrame:
    """Each anchor of a work once, two of a work at most, and the hits under their work under its form."""
    hits = retrieval.bm25(_states(c), c.raw("eval_items"), ["state"], FIELDS, "item_id", "query", False, 60)
    parts = F.split("state", "\\|")
    rows = search.shaped(hits.withColumns({"work": parts[0], "anchor": parts[2]}), "item_id", "work", "anchor", 10)
    rows = search.grouped(rows.withColumn("kind", F.substring_index("work", "-", 1)), "item_id", "kind", "work")
    return rows.select("item_id", "work", "anchor", "place", "kind", "group_place", "work_place")
