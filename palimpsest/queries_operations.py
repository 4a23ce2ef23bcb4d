"""Registered queries: the ten read operations and the cases of the text functions, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.model import Corpus
from palimpsest.operators import citations as cite
from palimpsest.plans.operations import Envelope, Operations
from palimpsest.plans.rules import within_budget
from palimpsest.queries_history import _CITED, _OBS, _SEQ
from palimpsest.queries_temporal import DAY, DOCS, FIRST, LAST, PROVISIONS, iso

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(Corpus(spark, d))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _answer(envelope: Envelope, *columns) -> DataFrame:
    return envelope.rows.select(F.lit(envelope.status).alias("status"), *columns)


#: The work that the operations are asked about: the first of several versions, a day each, without wrong ends, with text.
_PICK = f"""pick AS (SELECT min(group_key) AS w FROM (SELECT group_key FROM d GROUP BY 1 HAVING count(DISTINCT key) >= 3 AND count(DISTINCT key) = count(DISTINCT valid_from) AND count(DISTINCT language) = 1 AND bool_and(valid_to IS NULL OR valid_to >= valid_from) AND bool_and(NOT withdrawn AND coalesce(text_public, false)) AND bool_and(rid IN (SELECT rid FROM p)))),
days AS (SELECT min(valid_from) AS a, max(valid_from) AS b, arg_min(rid, valid_from) AS ra, arg_max(rid, valid_from) AS rb FROM d WHERE group_key = (SELECT w FROM pick))"""


def _pick(c: Corpus) -> dict:
    held = c.provisions().select("rid").distinct().withColumn("held", F.lit(True))
    rows = c.docs.join(held, "rid", "left").groupBy("group_key").agg(
        F.countDistinct("key").alias("keys"), F.countDistinct("valid_from").alias("days"), F.countDistinct("language").alias("languages"), F.min("valid_from").cast("string").alias("first"), F.max("valid_from").cast("string").alias("last"),
        F.bool_and((F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("valid_from"))) & ~F.col("withdrawn") & F.coalesce("text_public", F.lit(False)) & F.coalesce("held", F.lit(False))).alias("sound"),
    )
    return rows.where("keys >= 3 and keys = days and languages = 1 and sound").orderBy("group_key").first().asDict()


@query(f"WITH {DOCS}, {PROVISIONS}, {_PICK} SELECT 'ok' AS status, rid, seq, anchor, text_sha FROM p WHERE rid = (SELECT rb FROM days)")
def op_as_of(c: Corpus) -> DataFrame:
    work = _pick(c)
    return _answer(Operations(c).call("as_of", work=work["group_key"], date=work["last"], mode="outline"), "rid", "seq", "anchor", "text_sha").distinct()


@query(f"WITH {DOCS}, {PROVISIONS}, {_PICK} SELECT 'ok' AS status, key, strftime(valid_from, '%Y-%m-%d') AS valid_from, count(*) AS n_expressions FROM d WHERE group_key = (SELECT w FROM pick) GROUP BY ALL")
def op_timeline(c: Corpus) -> DataFrame:
    rows = _answer(Operations(c).call("timeline", work=_pick(c)["group_key"], limit=200), "key", "valid_from", "n_expressions")
    return iso(rows, "valid_from")


@query(f"""WITH {DOCS}, e AS (SELECT * FROM d WHERE NOT withdrawn AND valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to >= DATE '{DAY}')), m AS (SELECT group_key, max(valid_from) AS valid_from FROM e GROUP BY 1 ORDER BY 1 LIMIT 50 OFFSET 5)
SELECT DISTINCT 'ok' AS status, group_key, key, strftime(valid_from, '%Y-%m-%d') AS valid_from FROM e JOIN m USING (group_key, valid_from)""")
def op_in_force_on(c: Corpus) -> DataFrame:
    return iso(_answer(Operations(c).call("in_force_on", date=DAY, limit=50, offset=5), "group_key", "key", "valid_from").distinct(), "valid_from")


@query(f"""WITH {DOCS}, {PROVISIONS}, {_PICK}, x AS (SELECT DISTINCT anchor, text_sha FROM p WHERE rid = (SELECT ra FROM days)), y AS (SELECT DISTINCT anchor, text_sha FROM p WHERE rid = (SELECT rb FROM days))
SELECT 'ok' AS status, coalesce(x.anchor, y.anchor) AS anchor, CASE WHEN x.text_sha IS NULL THEN 'only_to' WHEN y.text_sha IS NULL THEN 'only_from' WHEN x.text_sha = y.text_sha THEN 'equal' ELSE 'changed' END AS state FROM x FULL JOIN y ON x.anchor = y.anchor""")
def op_diff(c: Corpus) -> DataFrame:
    work = _pick(c)
    return _answer(Operations(c).call("diff", work=work["group_key"], from_date=work["first"], to_date=work["last"]), "anchor", "state")


@query(_SEQ + f""", {_PICK}, one AS (SELECT min(anchor) AS x FROM runs WHERE group_key = (SELECT w FROM pick))
SELECT 'ok' AS status, anchor, strftime(f, '%Y-%m-%d') AS valid_from, nullif(t, '') AS valid_to, text_sha, versions FROM runs WHERE group_key = (SELECT w FROM pick) AND anchor = (SELECT x FROM one)""")
def op_article_history(c: Corpus) -> DataFrame:
    work = _pick(c)["group_key"]
    anchor = c.provisions().join(c.docs.where(F.col("group_key") == work).select("rid"), "rid").agg(F.min("anchor")).first()[0]
    rows = _answer(Operations(c).call("article_history", work=work, anchor=anchor), "anchor", "valid_from", "valid_to", "text_sha", "versions")
    return iso(rows, "valid_from", "valid_to")


@query(f"""WITH {_OBS}, k AS (SELECT chain FROM o GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT 'ok' AS status, obs_id, language, sha256, row_number() OVER (PARTITION BY language, expr_valid_from ORDER BY observed_from, obs_id) AS step FROM o WHERE chain = (SELECT chain FROM k)""")
def op_provenance(c: Corpus) -> DataFrame:
    """Of the version that was observed most often."""
    most = c.observations.groupBy(F.lower(F.trim("key")).alias("chain")).count().orderBy(F.col("count").desc(), "chain").first()["chain"]
    return _answer(Operations(c).call("provenance", lex_id=f" {most.upper()} "), "obs_id", "language", "sha256", F.col("step").cast("long").alias("step"))


@query(f"""WITH {DOCS}, c AS (SELECT min(collection) AS c FROM docs) SELECT 'ok' AS status, count(DISTINCT group_key) AS works, count(*) AS expressions, count(DISTINCT key) AS versions, count(DISTINCT CASE WHEN text_public THEN key END) AS text_versions FROM d WHERE NOT withdrawn AND collection = (SELECT c FROM c)""")
def op_coverage(c: Corpus) -> DataFrame:
    publisher = c.raw("docs").agg(F.min("collection")).first()[0]
    return _answer(Operations(c).call("coverage", publisher=publisher.upper()), "works", "expressions", "versions", "text_versions")


@query(f"""WITH {_CITED}, {DOCS}, {PROVISIONS}, s AS (SELECT cited_slug FROM r JOIN d USING (rid) WHERE cited_slug IS NOT NULL AND NOT withdrawn GROUP BY 1 ORDER BY count(DISTINCT group_key) DESC, 1 LIMIT 1),
hh AS (SELECT DISTINCT rid, anchor FROM r WHERE cited_slug = (SELECT cited_slug FROM s)), n AS (SELECT DISTINCT rid, anchor, num FROM provisions WHERE rid IS NOT NULL),
f AS (SELECT DISTINCT group_key, key, valid_from, hh.anchor, num FROM hh JOIN d USING (rid) LEFT JOIN n ON n.rid = hh.rid AND n.anchor = hh.anchor WHERE NOT withdrawn)
SELECT 'ok' AS status, group_key, key, strftime(valid_from, '%Y-%m-%d') AS valid_from, anchor, num FROM f QUALIFY row_number() OVER (ORDER BY valid_from DESC, group_key, anchor, key, num) <= 100""")
def op_cited_by(c: Corpus) -> DataFrame:
    work = cite.most_cited(c.citations, c.docs, 1).first()["cited_slug"]
    return iso(_answer(Operations(c).call("cited_by", work=work, limit=100), "group_key", "key", "valid_from", "anchor", "num"), "valid_from")


@query(f"""WITH {DOCS}, m AS (SELECT group_key, count(DISTINCT key) AS versions, max(valid_from) AS l FROM d WHERE NOT withdrawn AND valid_from BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY 1)
SELECT 'ok' AS status, group_key, versions, strftime(l, '%Y-%m-%d') AS last_change FROM m ORDER BY versions DESC, l DESC, group_key LIMIT 30""")
def op_changes_in_period(c: Corpus) -> DataFrame:
    envelope = Operations(c).call("changes_in_period", **{"from": FIRST, "to": LAST, "order": "by_churn", "limit": 30})
    return iso(_answer(envelope, "group_key", "versions", "last_change"), "last_change")


@query(f"""WITH {DOCS}, {PROVISIONS}, {_PICK}, t AS (SELECT DISTINCT group_key, title FROM d WHERE group_key = (SELECT w FROM pick) AND title IS NOT NULL), x AS (SELECT d.group_key, language, anchor, text_sha, valid_from, seq, rid FROM d JOIN (SELECT DISTINCT rid, seq, anchor, num, coalesce(lower(text_sha), sha256(text_md)) AS text_sha FROM provisions WHERE ptype = 'article') q USING (rid)
  WHERE group_key = (SELECT w FROM pick) AND NOT withdrawn AND (num IN ('2', '2er', '2re') OR anchor IN ('art_2', 'art_2er', 'art_2re'))),
o AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY language, anchor, text_sha ORDER BY valid_from DESC, seq, rid) = 1), r AS (SELECT *, row_number() OVER (ORDER BY valid_from DESC, seq, rid) AS rank FROM o),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY rank) = 1), u AS (SELECT group_key, language, anchor, text_sha, 0 AS stage, rank FROM b UNION ALL SELECT group_key, language, '', '', 2, 1000 + row_number() OVER (ORDER BY language) FROM (SELECT DISTINCT group_key, language FROM d WHERE group_key = (SELECT w FROM pick)) QUALIFY row_number() OVER (ORDER BY language) = 1)
SELECT 'ok' AS status, group_key, language, anchor, text_sha, stage, row_number() OVER (ORDER BY rank) AS place FROM u QUALIFY place <= 2""")
def op_search(c: Corpus) -> DataFrame:
    """An article of a work that is named by its title."""
    work = _pick(c)["group_key"]
    title = c.docs.where((F.col("group_key") == work) & F.col("title").isNotNull()).agg(F.min("title")).first()[0]
    return _answer(Operations(c).call("search", query=f"Article 2 {title}", fuzzy=False), "group_key", "language", "anchor", "text_sha", "stage", "place")


@query(f"""WITH RECURSIVE {PROVISIONS}, t AS (SELECT DISTINCT sha256(text_md) AS text_sha, length(text_md) AS size FROM provisions WHERE text_md IS NOT NULL),
o AS (SELECT rid, seq, anchor, coalesce(size, 0) AS size, row_number() OVER (PARTITION BY rid ORDER BY seq, anchor) AS i FROM p LEFT JOIN t USING (text_sha)),
w(rid, i, seq, anchor, l, fits) AS (SELECT rid, i, seq, anchor, CASE WHEN size <= 600 THEN 600 - size ELSE 600 END, size <= 600 FROM o WHERE i = 1
  UNION ALL SELECT o.rid, o.i, o.seq, o.anchor, CASE WHEN size <= l THEN l - size ELSE l END, size <= l FROM w JOIN o ON o.rid = w.rid AND o.i = w.i + 1)
SELECT rid, seq, anchor, fits FROM w""")
def text_budgets(c: Corpus) -> DataFrame:
    """Which provisions of each version fit an answer of 600 characters, in order and without stopping at a long one."""
    rows = c.provisions().join(c.texts.select("text_sha", F.length("text").alias("size")), "text_sha", "left")
    return within_budget(rows, "rid", ["seq", "anchor"], "size", 600)


#: Inputs of the text functions and what is expected of them.
CASES = [
    ("name_forms", "Version consolidée applicable au 31/10/2002 : Loi du 5 avril 1993 relative au secteur financier", ["Version consolidée applicable au 31/10/2002 : Loi du 5 avril 1993 relative au secteur financier", "Loi du 5 avril 1993 relative au secteur financier"]),
    ("name_forms", "Loi du 5 avril 1993", ["Loi du 5 avril 1993"]),
    ("normalize", "Réglement grând-ducal", "reglement grand ducal"),
    ("normalize", "C.R.R.", "crr"),
    ("normalize_citation", "Loi modifiée du 12 novembre 2004 relative", "loi du 12 novembre 2004 relative"),
    ("normalize_citation", "la version modifiée du texte", "la version modifiee du texte"),
    ("is_act_form", "Code du travail", "true"),
    ("is_act_form", "Reporting obligations", "false"),
    ("cites_by_date", "la loi modifiée du 12 novembre 2004", "true"),
    ("cites_by_date", "the amended law of 5 April 1993", "true"),
    ("cites_by_date", "the law amended of 5 April 1993", "true"),
    ("cites_by_date", "règlement grand-ducal du 1er août 2001", "true"),
    ("cites_by_date", "which laws in force on 1 June 2024", "false"),
    ("follows_amending_clause", "regulation 575 2013 and amending", "true"),
    ("follows_amending_clause", "amending regulation eu no", "false"),
    ("short_titles", "DORA, AIFM ,DORA", ["AIFM", "DORA"]),
    ("short_titles", "DORA,,AIFM", []),
    ("article_number", "What does Article L. 121-1 bis say", "l 121 1 bis"),
    ("article_number", "art 42ter of the code", ""),
    ("article_number", "Article 1er", "1er"),
    ("article_number", "particle 5", ""),
    ("ordinal_spellings", "1", ["1", "1er", "1re"]),
    ("ordinal_spellings", "1re", ["1re", "1"]),
    ("ordinal_spellings", "108quater", ["108quater"]),
    ("exact_identifiers", "see CELEX 32016R0679, 32016r0679 and 11957E/TXT, ECLI:EU:C:2020:559", ["32016R0679", "11957E/TXT", "ECLI:EU:C:2020:559"]),
    ("exact_identifiers", "no x32016R0679", []),
    ("exact_identifier", " celex 32016R0679 ", "32016R0679"),
    ("exact_identifier", "about 32016R0679", None),
    ("role_of", "the implementing regulation of", "implementing"),
    ("role_of", "what is implementing", None),
    ("role_of", "règlement délégué", "delegated"),
    ("residual", "What does Article 5 of the same law say about delegated act stamp duty?", "of say stamp duty"),
    ("residual", "Find the provisions that describe the responsibilities of the keeper of records", "keeper of records"),
    ("same_word", "L’œuvre — «x»", "l'oeuvre - \"x\""),
    ("iso_date", "2020-02-29", "2020-02-29"),
    ("iso_date", "2020-2-9", None),
    ("iso_date", "2021-02-29", None),
    ("version_coordinate", "p:w:2020-01-01--ab", "2020-01-01--ab"),
    ("facet_label", "rural_leases", "Rural Leases"),
    ("canonical_work", "eu-lex:32016R0679", "32016r0679"),
    ("canonical_work", "vm-lex:loi-1990-01-01-a1:1990-01-01--ab", "loi-1990-01-01-a1"),
    ("canonical_work", "loi-1990-01-01-a1", "loi-1990-01-01-a1"),
    ("slug", "Été 2020 : l'essai", "ete-2020-l-essai"),
    ("article_key", " 1 er.-A", "1era"),
    ("collapse", "  a \t b\r\n c ", "a b c"),
    ("fold", "DÉJÀ Œuvre ǅ", "deja œuvre ǆ"),
]
_PLAIN = {"article_number", "role_of", "residual", "normalize_citation", "is_act_form"}


def _applied(name: str, column):
    n = tx.normalize(column) if name in _PLAIN else column
    out = tx.residual(n, tx.role_of(n)) if name == "residual" else getattr(tx, name)(n)
    return F.to_json(out) if name in ("name_forms", "short_titles", "ordinal_spellings", "exact_identifiers") else out.cast("string")


def _literal(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({_literal(f)}, {_literal(x)}, {_literal(json.dumps(y, ensure_ascii=False, separators=(',', ':')) if isinstance(y, list) else y)})" for f, x, y in CASES) + ") t(function, input, output)")
def function_cases(c: Corpus) -> DataFrame:
    """The text functions on cases with known answers; what is expected stands in the SQL."""
    rows = c.spark.createDataFrame([(f, x) for f, x, _ in CASES], "function string, input string")
    out = F.lit(None).cast("string")
    for name in sorted({f for f, _, _ in CASES}):
        out = F.when(F.col("function") == name, _applied(name, F.col("input"))).otherwise(out)
    return rows.withColumn("output", out)
