"""Registered queries: point-in-time reads and aggregates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.model import Corpus, FilterSet, overlaps
from palimpsest.operators import rollups, temporal

DAY, FIRST, LAST = "2015-06-30", "2014-01-01", "2016-12-31"

#: The cleaned docs of ``Corpus.docs`` in SQL.
DOCS = """d AS (SELECT * REPLACE (CASE WHEN valid_to < DATE '9999-12-31' THEN valid_to END AS valid_to, coalesce(withdrawn, false) AS withdrawn)
  FROM docs WHERE rid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rid ORDER BY observed_from DESC) = 1)"""
PROVISIONS = "p AS (SELECT DISTINCT rid, seq, anchor, coalesce(lower(text_sha), sha256(text_md)) AS text_sha FROM provisions WHERE rid IS NOT NULL)"
_IN = f"valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to >= DATE '{DAY}')"
_CHANGES = f"""WITH {DOCS}, {PROVISIONS},
moved AS (SELECT group_key, count(DISTINCT key) AS versions, min(valid_from) AS f, max(valid_from) AS l, max(kind) AS kind FROM d
          WHERE NOT withdrawn AND valid_from BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY group_key),
base AS (SELECT m.*, (SELECT count(DISTINCT key) FROM d WHERE d.group_key = m.group_key) AS versions_total,
           (SELECT max(valid_from) FROM d WHERE d.group_key = m.group_key AND d.valid_from < m.f) AS b FROM moved m),
titles AS (SELECT group_key, coalesce(title_short, title) AS title FROM d QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY valid_from DESC, key DESC, language DESC) = 1)
"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(Corpus(spark, d))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def iso(df: DataFrame, *dates: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in dates})


@query(f"""WITH {DOCS}, e AS (SELECT * FROM d WHERE NOT withdrawn AND {_IN}),
m AS (SELECT group_key, max(valid_from) AS valid_from FROM e GROUP BY 1),
c AS (SELECT e.*, row_number() OVER (PARTITION BY key ORDER BY language, rid) AS n FROM e JOIN m USING (group_key, valid_from))
SELECT group_key, key, strftime(valid_from, '%Y-%m-%d') AS valid_from, language, rid, title, count(*) OVER (PARTITION BY group_key) AS choices FROM c WHERE n = 1""")
def in_force_on(c: Corpus) -> DataFrame:
    return iso(temporal.in_force_on(c.docs, DAY), "valid_from")


@query(f"""WITH {DOCS}, e AS (SELECT * FROM d WHERE NOT withdrawn AND kind NOT IN ('LOI') AND {_IN} OR kind IS NULL AND NOT withdrawn AND {_IN}),
m AS (SELECT group_key, max(valid_from) AS valid_from FROM e GROUP BY 1),
s AS (SELECT e.* FROM e JOIN m USING (group_key, valid_from)),
c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN language = 'de' THEN 0 ELSE 1 END, language, rid) AS n FROM s WHERE group_key IN (SELECT group_key FROM s WHERE language = 'de'))
SELECT group_key, key, strftime(valid_from, '%Y-%m-%d') AS valid_from, language, rid, count(*) OVER (PARTITION BY group_key) AS choices FROM c WHERE n = 1""")
def in_force_filtered(c: Corpus) -> DataFrame:
    filters = FilterSet(kind="!LOI", language="de")
    return iso(temporal.in_force_on(c.docs, DAY, filters, ("valid_from", "language", "rid")), "valid_from")


@query(f"""WITH {DOCS}, e AS (SELECT * FROM d WHERE NOT withdrawn AND {_IN}), m AS (SELECT group_key, max(valid_from) AS valid_from FROM e GROUP BY 1)
SELECT group_key, strftime(valid_from, '%Y-%m-%d') AS valid_from, count(DISTINCT key) AS choices FROM e JOIN m USING (group_key, valid_from) GROUP BY 1, 2 HAVING count(DISTINCT key) > 1""")
def in_force_ambiguous(c: Corpus) -> DataFrame:
    rows = temporal.in_force_on(c.docs, DAY, columns=("valid_from", "language", "rid")).where("choices > 1")
    return iso(rows.select("group_key", "valid_from", "choices").distinct(), "valid_from")


@query(f"""WITH {DOCS}, e AS (SELECT * FROM d WHERE {_IN}), m AS (SELECT group_key, max(valid_from) AS valid_from FROM e GROUP BY 1),
n AS (SELECT group_key, language, count(*) AS n FROM d GROUP BY 1, 2),
c AS (SELECT e.*, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN e.language = 'fr' THEN 0 ELSE 1 END, n.n DESC, e.language, rid) AS r FROM e JOIN m USING (group_key, valid_from) JOIN n ON n.group_key = e.group_key AND n.language = e.language)
SELECT group_key, key, strftime(valid_from, '%Y-%m-%d') AS valid_from, language, rid, withdrawn FROM c WHERE r = 1""")
def effective_on_language(c: Corpus) -> DataFrame:
    return iso(temporal.effective_on(c.docs, DAY, "fr"), "valid_from")


@query(f"""WITH {DOCS}, w AS (SELECT group_key, key, valid_from FROM d WHERE NOT withdrawn AND {_IN})
SELECT group_key, strftime(max(valid_from), '%Y-%m-%d') AS valid_from, count(DISTINCT key) AS containing FROM w GROUP BY 1""")
def as_of_work(c: Corpus) -> DataFrame:
    """The state of every work on one day: its latest start and how many versions contain the day."""
    rows = c.live.where(temporal.contains(DAY))
    return iso(rows.groupBy("group_key").agg(F.max("valid_from").alias("valid_from"), F.countDistinct("key").alias("containing")), "valid_from")


@query(f"""WITH {DOCS}, q AS (SELECT DISTINCT cited_slug AS group_key, CAST(observed_from AS DATE) - 3650 AS on_date FROM citations WHERE cited_slug IS NOT NULL AND observed_from IS NOT NULL)
SELECT q.group_key, strftime(on_date, '%Y-%m-%d') AS on_date, strftime(max(d.valid_from), '%Y-%m-%d') AS valid_from FROM q
LEFT JOIN d ON d.group_key = q.group_key AND NOT withdrawn AND d.valid_from <= on_date AND (valid_to IS NULL OR valid_to >= on_date) GROUP BY 1, 2""")
def as_of_many_dates(c: Corpus) -> DataFrame:
    """For every cited work and day (ten years before it was cited) the state then in force."""
    probes = c.raw("citations").select(F.col("cited_slug").alias("group_key"), F.date_sub(F.col("observed_from").cast("date"), 3650).alias("on_date"))
    return iso(temporal.as_of_join(probes, c.docs), "on_date", "valid_from")


@query(f"""WITH {DOCS} SELECT group_key, key, strftime(valid_from, '%Y-%m-%d') AS valid_from, count(*) AS n_expressions, string_agg(language, ',' ORDER BY language) AS languages, bool_or(withdrawn) AS withdrawn FROM d GROUP BY 1, 2, 3""")
def timeline_versions(c: Corpus) -> DataFrame:
    rows = temporal.timeline(c.docs)
    return iso(rows.select("group_key", "key", "valid_from", "n_expressions", F.array_join(F.transform("expressions", lambda e: e["language"]), ",").alias("languages"), "withdrawn"), "valid_from")


@query(f"""WITH {DOCS}, v AS (SELECT DISTINCT group_key, valid_from FROM d)
SELECT group_key, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(lead(valid_from) OVER (PARTITION BY group_key ORDER BY valid_from) - 1, '%Y-%m-%d') AS derived_to FROM v""")
def interval_derivation(c: Corpus) -> DataFrame:
    return iso(temporal.derived_ends(c.docs), "valid_from", "derived_to")


@query(f"""WITH {DOCS}, s AS (SELECT group_key, min(valid_from) AS a, max(valid_from) AS b FROM d GROUP BY 1)
SELECT DISTINCT group_key, key, CASE WHEN b > a THEN round(100.0 * (valid_from - a) / (b - a), 2) ELSE 0 END AS position FROM d JOIN s USING (group_key)""")
def version_rail(c: Corpus) -> DataFrame:
    return temporal.rail_positions(c.docs)


@query(f"""WITH {DOCS} SELECT language, count(*) AS expressions, count(DISTINCT group_key) AS works FROM d
WHERE valid_from <= DATE '{LAST}' AND (valid_to IS NULL OR valid_to >= DATE '{FIRST}') AND NOT withdrawn GROUP BY 1""")
def overlap_window(c: Corpus) -> DataFrame:
    return c.live.where(overlaps(FIRST, LAST)).groupBy("language").agg(F.count(F.lit(1)).alias("expressions"), F.countDistinct("group_key").alias("works"))


@query(_CHANGES + """, ends AS (SELECT group_key, 'a' AS side, coalesce(b, f) AS on_date FROM base UNION ALL SELECT group_key, 'b', l FROM base),
state AS (SELECT e.group_key, e.side, (SELECT min(x.rid) FROM d x WHERE NOT x.withdrawn AND x.group_key = e.group_key AND x.valid_from = max(d.valid_from)) AS rid FROM ends e
          JOIN d ON d.group_key = e.group_key AND NOT d.withdrawn AND d.valid_from <= e.on_date AND (d.valid_to IS NULL OR d.valid_to >= e.on_date) GROUP BY 1, 2),
digest AS (SELECT rid, sha256(string_agg(w, '' ORDER BY b)) AS w FROM (SELECT rid, seq // 1024 AS b, sha256(string_agg(text_sha, '' ORDER BY seq)) AS w FROM p GROUP BY 1, 2) GROUP BY 1),
sides AS (SELECT group_key, max(CASE WHEN side = 'a' THEN w END) AS wa, max(CASE WHEN side = 'b' THEN w END) AS wb FROM state LEFT JOIN digest USING (rid) GROUP BY 1)
SELECT group_key, versions, strftime(f, '%Y-%m-%d') AS first_change, strftime(l, '%Y-%m-%d') AS last_change, strftime(b, '%Y-%m-%d') AS baseline, kind, versions_total, title,
  CASE WHEN wa IS NULL AND wb IS NULL THEN 0 WHEN wa IS NULL OR wb IS NULL THEN 2 WHEN wa = wb THEN 1 ELSE 2 END AS distinct_texts, wa IS NOT NULL AND wb IS NOT NULL AS text_comparable
FROM base JOIN titles USING (group_key) LEFT JOIN sides USING (group_key)""")
def changes_in_period(c: Corpus) -> DataFrame:
    rows = rollups.wording_comparison(rollups.changes_in_period(c.docs, FIRST, LAST), c.docs, c.provisions())
    return iso(rows, "first_change", "last_change", "baseline")


def _ranked(c: Corpus, order: list) -> DataFrame:
    rows = rollups.page(rollups.changes_in_period(c.docs, FIRST, LAST), order, 20)
    return iso(rows.select("group_key", "versions", "last_change", "baseline"), "last_change", "baseline")


_PAGE = "SELECT group_key, versions, strftime(l, '%Y-%m-%d') AS last_change, strftime(b, '%Y-%m-%d') AS baseline FROM base ORDER BY {} LIMIT 20"


@query(_CHANGES + _PAGE.format("versions DESC, l DESC, group_key"))
def changes_by_churn(c: Corpus) -> DataFrame:
    return _ranked(c, [F.col("versions").desc(), F.col("last_change").desc(), F.col("group_key")])


@query(_CHANGES + _PAGE.format("l DESC, versions DESC, group_key"))
def changes_by_date(c: Corpus) -> DataFrame:
    return _ranked(c, [F.col("last_change").desc(), F.col("versions").desc(), F.col("group_key")])


@query(f"WITH {DOCS} SELECT count(DISTINCT group_key) AS works, count(DISTINCT key) AS versions FROM d WHERE NOT withdrawn AND valid_from BETWEEN DATE '{FIRST}' AND DATE '{LAST}'")
def change_totals(c: Corpus) -> DataFrame:
    return rollups.change_totals(c.docs, FIRST, LAST)


@query(f"WITH {DOCS} SELECT count(DISTINCT group_key) AS works FROM d WHERE NOT withdrawn")
def population_total(c: Corpus) -> DataFrame:
    return rollups.population(c.docs)


def _known(column: str) -> str:
    return f"arg_max({column}, (valid_from, key, language)) FILTER ({column} IS NOT NULL AND {column} <> '') AS {column}"


@query(f"""WITH {DOCS} SELECT group_key, arg_max(collection, (valid_from, key, language)) AS collection, {_known('title')}, {_known('title_short')}, {_known('kind')},
count(DISTINCT key) AS versions, count(DISTINCT CASE WHEN text_public THEN key END) AS text_versions, strftime(min(valid_from), '%Y-%m-%d') AS first_from, strftime(max(valid_from), '%Y-%m-%d') AS last_from,
bool_or(coalesce(text_public, false)) AS has_text, strftime(max(observed_from), '%Y-%m-%d %H:%M:%S') AS last_observed FROM d WHERE NOT withdrawn GROUP BY 1""")
def catalogue_newest_nonblank(c: Corpus) -> DataFrame:
    rows = rollups.catalogue(c.docs)
    return iso(rows.withColumn("last_observed", F.date_format("last_observed", "yyyy-MM-dd HH:mm:ss")), "first_from", "last_from")


def _catalogue_page(order: str, sql: str):
    @query(f"""WITH {DOCS}, a AS (SELECT group_key, count(DISTINCT key) AS versions, min(valid_from) AS f, max(valid_from) AS l FROM d WHERE NOT withdrawn GROUP BY 1)
SELECT group_key, versions, strftime(f, '%Y-%m-%d') AS first_from, strftime(l, '%Y-%m-%d') AS last_from FROM a ORDER BY {sql}, group_key LIMIT 50 OFFSET 10""")
    def run(c: Corpus) -> DataFrame:
        rows = rollups.page(rollups.catalogue(c.docs), rollups.ORDERS[order](), 50, 10)
        return iso(rows.select("group_key", "versions", "first_from", "last_from"), "first_from", "last_from")

    QUERIES[f"catalogue_{order}"], ORACLES[f"catalogue_{order}"] = QUERIES.pop("run"), ORACLES.pop("run")


for _order, _sql in (("name", "1"), ("most_versions", "versions DESC"), ("most_recent", "l DESC"), ("oldest", "f")):
    _catalogue_page(_order, _sql)


@query(f"""WITH {DOCS}, k AS (SELECT DISTINCT group_key FROM d WHERE kind = 'LOI' AND NOT withdrawn)
SELECT group_key, count(DISTINCT key) AS versions, bool_or(coalesce(text_public, false)) AS has_text FROM d WHERE NOT withdrawn AND group_key IN (SELECT group_key FROM k) GROUP BY 1 HAVING bool_or(coalesce(text_public, false))""")
def catalogue_kind_with_text(c: Corpus) -> DataFrame:
    return rollups.catalogue(c.docs, FilterSet(kind="LOI"), has_text=True).select("group_key", "versions", "has_text")


@query(f"""WITH {DOCS} SELECT count(DISTINCT group_key) AS works, count(*) AS expressions, count(DISTINCT key) AS versions, strftime(min(valid_from), '%Y-%m-%d') AS first_from, strftime(max(valid_from), '%Y-%m-%d') AS last_from,
CAST(sum(CASE WHEN text_public THEN 1 ELSE 0 END) AS BIGINT) AS with_text, count(DISTINCT CASE WHEN text_public THEN key END) AS text_versions FROM d WHERE NOT withdrawn""")
def coverage(c: Corpus) -> DataFrame:
    return rollups.coverage(c.docs)


def _coverage_by(column: str, name: str):
    @query(f"""WITH {DOCS} SELECT {column}, count(DISTINCT group_key) AS works, count(*) AS expressions, count(DISTINCT key) AS versions, count(DISTINCT CASE WHEN text_public THEN key END) AS text_versions FROM d WHERE NOT withdrawn GROUP BY 1""")
    def run(c: Corpus) -> DataFrame:
        return rollups.coverage_by(c.docs, column)

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


for _column, _name in (("kind", "coverage_kinds"), ("language", "coverage_languages"), ("valid_time_source", "coverage_time_sources"), ("collection", "coverage_collections")):
    _coverage_by(_column, _name)


@query(f"WITH {DOCS} SELECT group_key, count(DISTINCT language) AS languages FROM d WHERE NOT withdrawn GROUP BY 1 HAVING count(DISTINCT language) > 1")
def multilingual_works(c: Corpus) -> DataFrame:
    return rollups.multilingual_works(c.docs)


@query(f"""WITH {DOCS}, n AS (SELECT group_key, language, count(DISTINCT key) AS n FROM d GROUP BY 1, 2)
SELECT group_key, language, n FROM n QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY n DESC, language) = 1""")
def preferred_language(c: Corpus) -> DataFrame:
    return rollups.usual_language(c.docs)


@query(f"""WITH {DOCS}, l AS (SELECT * FROM d WHERE NOT withdrawn)
SELECT facet, value, count(DISTINCT group_key) AS works FROM (SELECT group_key, 'kind' AS facet, kind AS value FROM l UNION ALL SELECT group_key, 'language', language FROM l UNION ALL SELECT group_key, 'collection', collection FROM l)
WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2""")
def search_facets(c: Corpus) -> DataFrame:
    return rollups.facets(c.docs, ("kind", "language", "collection"))


@query(f"""WITH {DOCS}, n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY group_key, language ORDER BY valid_from DESC, key DESC) = 1),
t AS (SELECT DISTINCT group_key, language, unnest([title, title_short]) AS t FROM d), a AS (SELECT group_key, language, string_agg(t, '|' ORDER BY t) AS titles, count(t) AS n_titles FROM t WHERE t IS NOT NULL GROUP BY 1, 2)
SELECT n.group_key, n.language, strftime(valid_from, '%Y-%m-%d') AS valid_from, title, kind, group_identifier, coalesce(titles, '') AS titles, coalesce(n_titles, 0) AS n_titles FROM n LEFT JOIN a ON a.group_key = n.group_key AND a.language = n.language""")
def work_records(c: Corpus) -> DataFrame:
    return rollups.work_records(c.docs)


@query(f"WITH {DOCS} SELECT collection, group_key, key, strftime(max(observed_from), '%Y-%m-%d %H:%M:%S') AS last_observed FROM d WHERE NOT withdrawn GROUP BY 1, 2, 3")
def sitemap(c: Corpus) -> DataFrame:
    return rollups.sitemap(c.docs)


@query(f"""WITH {DOCS} SELECT collection, count(DISTINCT group_key) AS works, count(DISTINCT key) AS versions, count(DISTINCT kind) AS kinds, count(DISTINCT language) AS languages, strftime(min(valid_from), '%Y-%m-%d') AS first_from,
strftime(max(valid_from), '%Y-%m-%d') AS last_from, CAST(sum(CASE WHEN text_public THEN 1 ELSE 0 END) AS BIGINT) AS with_text, CAST(sum(CASE WHEN text_public THEN 0 ELSE 1 END) AS BIGINT) AS without_text FROM d WHERE NOT withdrawn GROUP BY 1""")
def build_manifest(c: Corpus) -> DataFrame:
    return rollups.manifest(c.docs)


@query(f"""WITH {DOCS}, h AS (SELECT collection, count(DISTINCT key) AS held FROM d WHERE NOT withdrawn GROUP BY 1), e AS (SELECT collection, count(DISTINCT key) AS expected FROM docs GROUP BY 1)
SELECT e.collection, expected, held, CASE WHEN held IS NULL THEN 'unavailable' WHEN held < expected THEN 'incomplete' WHEN held > expected THEN 'overfull' ELSE 'complete' END AS status FROM e LEFT JOIN h USING (collection)""")
def build_inventory(c: Corpus) -> DataFrame:
    found = c.live.groupBy("collection").agg(F.countDistinct("key").alias("held"))
    expected = c.raw("docs").groupBy("collection").agg(F.countDistinct("key").alias("expected"))
    return rollups.build_status(found, expected)
