"""Registered queries of the general data problems, with their SQL where it can be written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import intervals, orphans, snapshots
from palimpsest.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.spans_as_text(intervals.version_spans(table(spark, d, "docs")))


def p1_summary(spark: SparkSession, d: str) -> DataFrame:
    spans = intervals.version_spans(table(spark, d, "docs"))
    days = F.datediff("span_to", "span_from") + 1
    return spans.groupBy("language", "span_kind").agg(F.count(F.lit(1)).alias("spans"), F.sum(days).alias("closed_days"), F.max(days).alias("longest"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.provision_changes(table(spark, d, "provisions"))


def p2_summary(spark: SparkSession, d: str) -> DataFrame:
    found = snapshots.provision_changes(table(spark, d, "provisions"))
    return found.groupBy("change_kind").agg(F.count(F.lit(1)).alias("cases"), F.countDistinct("rid").alias("snapshots"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "docs"), table(spark, d, "citations"), table(spark, d, "obs_history"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


_SPANS = """
WITH rows AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY observed_from DESC) = 1),
cur AS (SELECT group_key, language, valid_from AS f, coalesce(valid_to, DATE '9999-12-31') AS t FROM rows
        WHERE NOT coalesce(withdrawn, false) AND coalesce(valid_to, DATE '9999-12-31') >= valid_from),
reach AS (SELECT *, max(t) OVER (PARTITION BY group_key, language ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM cur),
marked AS (SELECT *, sum(CASE WHEN r IS NULL OR f - r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY group_key, language ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS island FROM reach),
periods AS (SELECT group_key, language, min(f) AS f, max(t) AS t FROM marked GROUP BY group_key, language, island),
nexts AS (SELECT *, lead(f) OVER (PARTITION BY group_key, language ORDER BY f) AS n FROM periods),
spans AS (SELECT group_key, language, 'period' AS span_kind, f, t FROM nexts
          UNION ALL SELECT group_key, language, 'gap', t + 1, n - 1 FROM nexts WHERE n IS NOT NULL)
"""

_CHANGES = """
WITH rows AS (SELECT DISTINCT rid, anchor, coalesce(lower(text_sha), sha256(text_md)) AS sha FROM provisions WHERE rid IS NOT NULL),
snaps AS (SELECT DISTINCT rid, split_part(split_part(rid, '|', 1), ':', 2) AS g, split_part(rid, '|', 2) AS l, split_part(rid, '|', 1) AS k FROM rows),
pairs AS (SELECT rid, lag(rid) OVER (PARTITION BY g, l ORDER BY k, rid) AS prev FROM snaps),
now AS (SELECT p.rid, r.anchor, r.sha FROM pairs p JOIN rows r USING (rid) WHERE prev IS NOT NULL),
old AS (SELECT p.rid, r.anchor, r.sha FROM pairs p JOIN rows r ON r.rid = p.prev),
cases AS (SELECT coalesce(now.rid, old.rid) AS rid, coalesce(now.anchor, old.anchor) AS anchor,
            CASE WHEN old.rid IS NULL THEN 'added' WHEN now.rid IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
          FROM now FULL JOIN old ON now.rid = old.rid AND now.anchor = old.anchor
          WHERE old.rid IS NULL OR now.rid IS NULL OR now.sha IS DISTINCT FROM old.sha)
"""

_ORPHANS = """
WITH seen AS (SELECT rid, min(observed_from) AS first, arg_max(coalesce(withdrawn, false), observed_from) AS gone FROM docs GROUP BY rid),
held AS (SELECT DISTINCT lower(d.key) AS k, lower(d.collection) AS c, lower(d.group_key) AS g, strftime(d.valid_from, '%Y%m%d') AS day, s.first
         FROM docs d JOIN seen s USING (rid) WHERE NOT s.gone),
parents AS (SELECT 'version|' || k AS p, min(first) AS first FROM held GROUP BY 1
            UNION ALL SELECT 'named|' || c || ':' || g, min(first) FROM held GROUP BY 1
            UNION ALL SELECT 'work|' || g, min(first) FROM held GROUP BY 1
            UNION ALL SELECT 'day|' || g || '|' || day, min(first) FROM held GROUP BY 1),
tidy AS (SELECT citation_id, observed_from, lower(trim(regexp_replace(href, '[?#].*$', '', 's'), ' \t\r\n')) AS r FROM citations),
cited AS (SELECT citation_id, observed_from, r, list_filter(string_split(split_part(r, '/eli/', 2), '/'), lambda s: s <> '')[3:] AS s FROM tidy
          WHERE contains(r, '/eli/') OR (contains(r, ':') AND split_part(r, ':', 1) IN (SELECT lower(collection) FROM docs))),
refs AS (SELECT 'citations' AS ref_table, citation_id AS ref_id, observed_from AS ref_at,
           CASE WHEN NOT contains(r, '/eli/') AND len(string_split(r, ':')) > 2 THEN 'version|' || r
                WHEN NOT contains(r, '/eli/') THEN 'named|' || r
                WHEN list_contains(s, 'consolide') THEN 'day|' || array_to_string(s[:list_position(s, 'consolide') - 1], '-') || '|' || s[list_position(s, 'consolide') + 1]
                ELSE 'work|' || array_to_string(list_filter(s, lambda x: x <> 'jo'), '-') END AS p FROM cited
         UNION ALL SELECT 'obs_history', obs_id, observed_from, 'version|' || lower(trim(key, ' \t\r\n')) FROM obs_history),
cases AS (SELECT DISTINCT ref_table, ref_id, strftime(ref_at, '%Y-%m') AS ref_period FROM refs LEFT JOIN parents USING (p) WHERE first IS NULL OR first > ref_at)
"""

QUERIES = {"p1_found": p1_found, "p1_summary": p1_summary, "p2_found": p2_found, "p2_summary": p2_summary, "p5_found": p5_found, "p5_report": p5_report}

ORACLES = {
    "p1_found": _SPANS
    + """SELECT group_key, language, span_kind, strftime(f, '%Y-%m-%d') AS span_from,
           CASE WHEN t = DATE '9999-12-31' THEN 'open' ELSE strftime(t, '%Y-%m-%d') END AS span_to FROM spans""",
    "p1_summary": _SPANS
    + """SELECT language, span_kind, count(*) AS spans, CAST(sum(CASE WHEN t < DATE '9999-12-31' THEN t - f + 1 END) AS BIGINT) AS closed_days,
           CAST(max(CASE WHEN t < DATE '9999-12-31' THEN t - f + 1 END) AS INTEGER) AS longest FROM spans GROUP BY 1, 2""",
    "p2_found": _CHANGES + "SELECT rid, anchor, change_kind FROM cases",
    "p2_summary": _CHANGES + "SELECT change_kind, count(*) AS cases, count(DISTINCT rid) AS snapshots FROM cases GROUP BY 1",
    "p5_found": _ORPHANS + "SELECT ref_table, ref_id, ref_period FROM cases",
    "p5_report": _ORPHANS + "SELECT ref_table, ref_period, count(*) AS orphans FROM cases GROUP BY 1, 2",
}
