"""Registered queries: wording histories, citations and corpus maintenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.model import Corpus
from palimpsest.operators import citations as cite
from palimpsest.operators import history, scd
from palimpsest.queries_temporal import DOCS, PROVISIONS, iso

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(Corpus(spark, d))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_SEQ = f"""WITH {DOCS}, {PROVISIONS}, pa AS (SELECT DISTINCT rid, anchor, coalesce(lower(text_sha), sha256(text_md)) AS text_sha, article_valid_from FROM provisions WHERE rid IS NOT NULL),
seq AS (SELECT group_key, language, rid, key, valid_from, valid_to, row_number() OVER (PARTITION BY group_key, language ORDER BY key, rid) AS ordinal FROM d WHERE rid IN (SELECT rid FROM p)),
steps AS (SELECT s.*, anchor, text_sha, article_valid_from FROM seq s JOIN pa USING (rid)),
lagged AS (SELECT *, CASE WHEN lag(ordinal) OVER w = ordinal - 1 AND lag(text_sha) OVER w IS NOT DISTINCT FROM text_sha THEN 0 ELSE 1 END AS b FROM steps WINDOW w AS (PARTITION BY group_key, language, anchor ORDER BY ordinal)),
marked AS (SELECT *, sum(b) OVER (PARTITION BY group_key, language, anchor ORDER BY ordinal) AS run FROM lagged),
runs AS (SELECT group_key, language, anchor, arg_min(valid_from, ordinal) AS f, arg_max(coalesce(strftime(valid_to, '%Y-%m-%d'), ''), ordinal) AS t, min(text_sha) AS text_sha, arg_min(key, ordinal) AS in_version,
           nullif(arg_min(coalesce(strftime(article_valid_from, '%Y-%m-%d'), ''), ordinal), '') AS a, count(*) AS versions FROM marked GROUP BY group_key, language, anchor, run)
"""


@query(_SEQ + """SELECT group_key, language, anchor, strftime(f, '%Y-%m-%d') AS valid_from, nullif(t, '') AS valid_to, text_sha, in_version, a AS article_valid_from, coalesce(a <> strftime(f, '%Y-%m-%d'), false) AS validity_conflict, versions FROM runs""")
def provision_history_runs(c: Corpus) -> DataFrame:
    return iso(history.wording_runs(c.docs, c.provisions("article_valid_from")), "valid_from", "valid_to", "article_valid_from")


@query(_SEQ + """SELECT language, count(*) AS states, CAST(sum(CASE WHEN a <> strftime(f, '%Y-%m-%d') THEN 1 ELSE 0 END) AS BIGINT) AS conflicts, max(versions) AS longest FROM runs GROUP BY 1""")
def validity_conflicts(c: Corpus) -> DataFrame:
    runs = history.wording_runs(c.docs, c.provisions("article_valid_from"))
    return runs.groupBy("language").agg(F.count(F.lit(1)).alias("states"), F.sum(F.col("validity_conflict").cast("long")).alias("conflicts"), F.max("versions").alias("longest"))


_EVENTS = _SEQ + """, a AS (SELECT DISTINCT group_key, language, ordinal, anchor, text_sha FROM steps),
later AS (SELECT group_key, language, ordinal, key FROM seq WHERE ordinal > 1),
now AS (SELECT a.*, l.key FROM a JOIN later l USING (group_key, language, ordinal)),
old AS (SELECT a.group_key, a.language, a.ordinal + 1 AS ordinal, anchor, text_sha, l.key FROM a JOIN later l ON l.group_key = a.group_key AND l.language = a.language AND l.ordinal = a.ordinal + 1),
ch AS (SELECT 'inserted' AS e, * FROM now ANTI JOIN old USING (group_key, language, ordinal, anchor) UNION ALL SELECT 'removed', * FROM old ANTI JOIN now USING (group_key, language, ordinal, anchor)),
bt AS (SELECT group_key, language, ordinal, key, text_sha, max(CASE WHEN e = 'removed' THEN anchor END) AS from_anchor, max(CASE WHEN e = 'inserted' THEN anchor END) AS to_anchor FROM ch
       GROUP BY ALL HAVING count(*) FILTER (e = 'removed') = 1 AND count(*) FILTER (e = 'inserted') = 1)
"""


@query(_EVENTS + """SELECT group_key, language, key AS at_version, 'renumbered' AS etype, from_anchor, to_anchor, CAST(NULL AS VARCHAR) AS anchor, text_sha FROM bt
UNION ALL SELECT group_key, language, key, e, NULL, NULL, anchor, NULL FROM ch ANTI JOIN bt USING (group_key, language, ordinal, text_sha)""")
def anchor_events(c: Corpus) -> DataFrame:
    return history.anchor_events(c.docs, c.provisions())


_DIFF = _SEQ + """, pairs AS (SELECT lag(rid) OVER (PARTITION BY group_key, language ORDER BY ordinal) AS from_rid, rid AS to_rid FROM seq),
diff AS (SELECT coalesce(x.from_rid, y.from_rid) AS from_rid, coalesce(x.to_rid, y.to_rid) AS to_rid, coalesce(x.anchor, y.anchor) AS anchor, x.text_sha AS from_sha, y.text_sha AS to_sha,
           CASE WHEN x.text_sha IS NULL THEN 'only_to' WHEN y.text_sha IS NULL THEN 'only_from' WHEN x.text_sha = y.text_sha THEN 'equal' ELSE 'changed' END AS state
         FROM (SELECT from_rid, to_rid, anchor, text_sha FROM pairs JOIN (SELECT DISTINCT rid, anchor, text_sha FROM p) q ON q.rid = from_rid) x
         FULL JOIN (SELECT from_rid, to_rid, anchor, text_sha FROM pairs JOIN (SELECT DISTINCT rid, anchor, text_sha FROM p) q ON q.rid = to_rid WHERE from_rid IS NOT NULL) y
         ON x.to_rid = y.to_rid AND x.anchor = y.anchor)
"""


@query(_DIFF + "SELECT from_rid, to_rid, anchor, from_sha, to_sha, state FROM diff")
def version_diff(c: Corpus) -> DataFrame:
    provisions = c.provisions()
    return history.version_diff(history.consecutive(c.docs, provisions), provisions)


@query(_DIFF + """, n AS (SELECT from_rid, to_rid, count(*) FILTER (state IN ('equal', 'changed')) AS shared, count(*) FILTER (state <> 'only_to') AS a, count(*) FILTER (state <> 'only_from') AS b, count(*) FILTER (state = 'changed') AS changed FROM diff GROUP BY 1, 2)
SELECT from_rid, to_rid, shared, changed, coalesce(round(shared / least(a, b), 6), 0) AS continuity, coalesce(round(shared / least(a, b), 6) >= 0.5, false) AS comparable FROM n""")
def anchor_continuity(c: Corpus) -> DataFrame:
    provisions = c.provisions()
    return history.continuity(history.version_diff(history.consecutive(c.docs, provisions), provisions))


@query(f"""WITH {PROVISIONS}, h AS (SELECT sha256(concat_ws(chr(31), coalesce(rid, chr(0)), coalesce(CAST(seq AS VARCHAR), chr(0)), coalesce(anchor, chr(0)), coalesce(text_sha, chr(0)))) AS h FROM p)
SELECT count(*) AS rows, CAST(sum(CAST(CAST('0x' || left(h, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM h""")
def content_digest(c: Corpus) -> DataFrame:
    return history.table_digest(c.provisions(), ["rid", "seq", "anchor", "text_sha"])


@query(f"""WITH {PROVISIONS} SELECT rid, sha256(string_agg(w, '' ORDER BY b)) AS wording FROM (SELECT rid, seq // 1024 AS b, sha256(string_agg(text_sha, '' ORDER BY seq, text_sha)) AS w FROM p WHERE rid IN (SELECT rid FROM docs) GROUP BY 1, 2) GROUP BY 1""")
def wording_digests(c: Corpus) -> DataFrame:
    from palimpsest.operators.rollups import wording_digests as digests

    return digests(c.docs, c.provisions())


@query("""WITH pp AS (SELECT DISTINCT rid, seq, anchor, coalesce(lower(text_sha), sha256(text_md)) AS text_sha, num, heading, path FROM provisions WHERE rid IS NOT NULL),
t AS (SELECT DISTINCT sha256(text_md) AS text_sha, text_md AS text FROM provisions WHERE text_md IS NOT NULL),
r AS (SELECT rid, seq, anchor, coalesce(path, '') AS path, concat_ws(' — ', num, heading) AS title, coalesce(text, '') AS text FROM pp LEFT JOIN t USING (text_sha)),
m AS (SELECT *, path <> '' AND path IS DISTINCT FROM lag(path) OVER (PARTITION BY rid ORDER BY seq, anchor) AS moved FROM r)
SELECT rid, length(b) AS chars, sha256(b) AS body_sha FROM (SELECT rid, string_agg(CASE WHEN moved THEN '## ' || path || chr(10) || chr(10) ELSE '' END || CASE WHEN title <> '' THEN '### ' || title || chr(10) || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY seq, anchor) AS b FROM m GROUP BY rid)""")
def document_bodies(c: Corpus) -> DataFrame:
    bodies = history.document_bodies(c.provisions("num", "heading", "path"), c.texts)
    return bodies.select("rid", F.length("body").cast("long").alias("chars"), F.sha2("body", 256).alias("body_sha"))


_CITES = "c AS (SELECT * FROM citations QUALIFY row_number() OVER (PARTITION BY citation_id ORDER BY observed_from) = 1)"


@query(f"WITH {_CITES} SELECT rid, count(*) AS edges, count(DISTINCT cited_slug) AS targets, count(DISTINCT href) AS hrefs FROM c GROUP BY 1")
def citations_of(c: Corpus) -> DataFrame:
    return cite.citations_of(c.citations)


#: The citations with the work that the href means, else the stored slug.
_CITED = _CITES + """, h AS (SELECT *, lower(trim(regexp_replace(href, '[?#].*$', '', 's'))) AS h FROM c),
sg AS (SELECT *, CASE WHEN contains(h, '/eli/') THEN list_filter(string_split(string_split(h, '/eli/')[-1], '/'), lambda x: x <> '')[3:] END AS s FROM h),
r AS (SELECT rid, anchor, coalesce(nullif(array_to_string(list_filter(CASE WHEN list_contains(s, 'consolide') THEN s[:list_position(s, 'consolide') - 1] ELSE s END, lambda x: x <> 'jo'), '-'), ''),
  CASE WHEN contains(h, ':') AND string_split(h, ':')[1] IN (SELECT lower(trim(collection)) FROM docs WHERE trim(collection) <> '') THEN nullif(trim(string_split(h, ':')[2]), '') END, lower(cited_slug)) AS cited_slug FROM sg)"""


@query(f"""WITH {_CITED}, {DOCS}, e AS (SELECT DISTINCT rid, anchor, cited_slug FROM r WHERE cited_slug IS NOT NULL), n AS (SELECT DISTINCT rid, anchor, num FROM provisions WHERE rid IS NOT NULL)
SELECT DISTINCT cited_slug, group_key, key, strftime(valid_from, '%Y-%m-%d') AS valid_from, e.anchor, num FROM e JOIN d USING (rid) LEFT JOIN n ON n.rid = e.rid AND n.anchor = e.anchor WHERE NOT withdrawn""")
def cited_by(c: Corpus) -> DataFrame:
    return iso(cite.cited_by(c.citations, c.docs, c.provisions("num")), "valid_from")


@query(f"WITH {_CITED}, {DOCS} SELECT cited_slug, count(DISTINCT group_key) AS works FROM r JOIN d USING (rid) WHERE cited_slug IS NOT NULL AND NOT withdrawn GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def most_cited(c: Corpus) -> DataFrame:
    return cite.most_cited(c.citations, c.docs, 50)


@query(f"""WITH {_CITES}, t AS (SELECT citation_id, cited_slug, lower(trim(regexp_replace(href, '[?#].*$', '', 's'))) AS h FROM c),
s AS (SELECT citation_id, cited_slug, CASE WHEN contains(h, '/eli/') THEN list_filter(string_split(string_split(h, '/eli/')[-1], '/'), lambda x: x <> '')[3:] END AS s FROM t),
k AS (SELECT citation_id, coalesce(nullif(array_to_string(list_filter(CASE WHEN list_contains(s, 'consolide') THEN s[:list_position(s, 'consolide') - 1] ELSE s END, lambda x: x <> 'jo'), '-'), ''), lower(cited_slug)) AS slug FROM s),
w AS (SELECT DISTINCT lower(group_key) AS g FROM docs WHERE rid IS NOT NULL),
u AS (SELECT DISTINCT slug FROM k WHERE slug IS NOT NULL),
b AS (SELECT slug, arg_max(g, length(g)) AS target FROM u JOIN w ON slug = g OR starts_with(slug, g || '-') GROUP BY 1)
SELECT citation_id, slug, target, CASE WHEN target IS NULL THEN 'none' WHEN target = slug THEN 'exact' ELSE 'prefix' END AS matched FROM k LEFT JOIN b USING (slug) WHERE slug IS NOT NULL""")
def citation_alias(c: Corpus) -> DataFrame:
    return cite.citation_targets(c.citations, c.docs)


@query(f"""WITH {_CITED}, {DOCS}, e AS (SELECT DISTINCT d.group_key AS source, cited_slug AS target FROM r JOIN d USING (rid)), s AS (SELECT DISTINCT group_key AS node FROM d WHERE kind = 'LOI')
SELECT node FROM (SELECT target AS node FROM e WHERE source IN (SELECT node FROM s) UNION SELECT source FROM e WHERE target IN (SELECT node FROM s)) WHERE node IS NOT NULL AND node NOT IN (SELECT node FROM s)""")
def citation_closure(c: Corpus) -> DataFrame:
    edges = cite.resolved(c.citations, c.docs).join(c.docs.select("rid", F.col("group_key").alias("source")), "rid").select("source", F.col("cited_slug").alias("target")).distinct()
    return cite.closure(edges, c.docs.where("kind = 'LOI'").select("group_key"))


_OBS = "o AS (SELECT *, lower(trim(key)) AS chain FROM obs_history QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY observed_from) = 1)"


@query(f"""WITH {_OBS} SELECT obs_id, chain, language, strftime(expr_valid_from, '%Y-%m-%d') AS expr_valid_from, sha256, strftime(observed_from, '%Y-%m-%d %H:%M:%S') AS observed_from,
row_number() OVER w AS step, strftime(coalesce(lead(observed_from) OVER w, observed_to), '%Y-%m-%d %H:%M:%S') AS ended, lag(sha256) OVER w IS DISTINCT FROM sha256 AS changed FROM o
WINDOW w AS (PARTITION BY chain, language, expr_valid_from ORDER BY observed_from, obs_id)""")
def observation_chain(c: Corpus) -> DataFrame:
    rows = scd.observation_chain(c.observations)
    return iso(rows.withColumn("step", F.col("step").cast("long")), "expr_valid_from", "observed_from", "ended")


@query("""WITH r AS (SELECT DISTINCT rid, observed_from, coalesce(withdrawn, false) AS withdrawn FROM docs WHERE rid IS NOT NULL),
s AS (SELECT *, lag(withdrawn) OVER (PARTITION BY rid ORDER BY observed_from, withdrawn) AS b FROM r)
SELECT rid, count(*) AS sightings, count(*) FILTER (withdrawn AND NOT coalesce(b, false)) AS tombstones, count(*) FILTER (NOT withdrawn AND coalesce(b, false)) AS resighteds, arg_max(withdrawn, observed_from) AS withdrawn FROM s GROUP BY 1""")
def withdrawn_lifecycle(c: Corpus) -> DataFrame:
    return scd.lifecycle(c.raw("docs"))


_T0, _T1 = "2024-06-30 00:00:00", "2025-06-30 00:00:00"
_RECONCILE = f"""WITH held AS (SELECT * REPLACE (coalesce(withdrawn, false) AS withdrawn) FROM docs WHERE rid IS NOT NULL AND observed_from <= TIMESTAMP '{_T0}' QUALIFY row_number() OVER (PARTITION BY rid ORDER BY observed_from DESC) = 1),
seen AS (SELECT * FROM (SELECT * REPLACE (coalesce(withdrawn, false) AS withdrawn) FROM docs WHERE rid IS NOT NULL AND observed_from <= TIMESTAMP '{_T1}' QUALIFY row_number() OVER (PARTITION BY rid ORDER BY observed_from DESC) = 1) WHERE NOT withdrawn),
j AS (SELECT coalesce(h.rid, s.rid) AS rid, h.rid AS hr, s.rid AS sr, h.withdrawn AS gone, h.valid_to AS ovt,
  CASE WHEN h.rid IS NOT NULL AND s.rid IS NOT NULL THEN concat_ws(',', CASE WHEN h.valid_to IS DISTINCT FROM s.valid_to THEN 'valid_to' END, CASE WHEN h.title IS DISTINCT FROM s.title THEN 'title' END,
    CASE WHEN h.kind IS DISTINCT FROM s.kind THEN 'kind' END, CASE WHEN h.record_sha IS DISTINCT FROM s.record_sha THEN 'record_sha' END) END AS f FROM held h FULL JOIN seen s ON h.rid = s.rid)
SELECT rid, CASE WHEN hr IS NULL THEN 'first_seen' WHEN sr IS NULL AND gone THEN 'still_withdrawn' WHEN sr IS NULL THEN 'tombstoned' WHEN gone THEN 'resighted' WHEN f = '' THEN 'unchanged'
  WHEN f = 'valid_to' AND ovt IS NULL THEN 'interval_closed' ELSE 'revised' END AS action, coalesce(f, '') AS fields FROM j"""
_FIELDS = ["valid_to", "title", "kind", "record_sha"]


def _held_and_seen(c: Corpus) -> tuple[DataFrame, DataFrame]:
    return scd.state_at(c.raw("docs"), _T0), scd.state_at(c.raw("docs"), _T1).where("not withdrawn")


@query(_RECONCILE)
def scd_reconcile(c: Corpus) -> DataFrame:
    """What the state at a later moment means for the state held a year before."""
    return scd.reconcile(*_held_and_seen(c), _FIELDS)


@query(f"SELECT action, count(*) AS n FROM ({_RECONCILE}) GROUP BY 1")
def scd_actions(c: Corpus) -> DataFrame:
    return scd.reconcile(*_held_and_seen(c), _FIELDS).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CASE WHEN action IN ('still_withdrawn', 'tombstoned') THEN 'still_withdrawn' ELSE 'unchanged' END AS action, count(*) AS n FROM ({_RECONCILE}) GROUP BY 1")
def scd_replay(c: Corpus) -> DataFrame:
    """Reconciling once more after the events are appended: nothing is left to do."""
    held, seen = _held_and_seen(c)
    events = scd.apply_actions(held, seen, scd.reconcile(held, seen, _FIELDS), _T1)
    after = scd.state_at(held.select(*events.columns).unionByName(events), _T1)
    return scd.reconcile(after, seen, _FIELDS).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rid FROM (" + _RECONCILE.replace(f"observed_from <= TIMESTAMP '{_T1}'", f"observed_from > TIMESTAMP '{_T0}' AND observed_from <= TIMESTAMP '{_T1}'") + ") WHERE action = 'tombstoned'")
def tombstones(c: Corpus) -> DataFrame:
    """What was held and has not been observed in the year after."""
    raw = c.raw("docs")
    seen = scd.state_at(raw.where(F.col("observed_from") > F.lit(_T0).cast("timestamp")), _T1).where("not withdrawn")
    return scd.reconcile(scd.state_at(raw, _T0), seen, _FIELDS).where("action = 'tombstoned'").select("rid")


@query(f"""WITH {PROVISIONS} SELECT text_sha, count(*) AS provisions FROM p WHERE text_sha NOT IN (SELECT sha256(text_md) FROM provisions WHERE text_md IS NOT NULL) OR text_sha IS NULL GROUP BY 1""")
def body_backfill(c: Corpus) -> DataFrame:
    return scd.body_backfill(c.provisions(), c.texts)


@query(f"""WITH {DOCS}, {PROVISIONS} SELECT 'rid is key, language and start' AS rule, count(*) AS violations FROM d WHERE rid <> concat_ws('|', key, language, strftime(valid_from, '%Y-%m-%d'))
UNION ALL SELECT 'key is canonical', count(*) FROM d WHERE NOT regexp_full_match(key, '[^:|]+:[^:|]+:\\d{{4}}-\\d{{2}}-\\d{{2}}--[0-9a-f]{{64}}')
UNION ALL SELECT 'key carries its start', count(*) FROM d WHERE left(string_split(key, ':')[-1], 10) <> strftime(valid_from, '%Y-%m-%d')
UNION ALL SELECT 'one row per version and language', count(*) FROM (SELECT key, language FROM d GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'end is not before start', count(*) FROM d WHERE valid_to < valid_from
UNION ALL SELECT 'one value per observation', count(*) FROM (SELECT rid, observed_from FROM docs GROUP BY ALL HAVING count(DISTINCT (valid_to, withdrawn, record_sha)) > 1)
UNION ALL SELECT 'provisions have a version', count(DISTINCT rid) FROM p WHERE rid NOT IN (SELECT rid FROM d)
UNION ALL SELECT 'citations have a version', count(DISTINCT rid) FROM citations WHERE rid NOT IN (SELECT rid FROM d)
UNION ALL SELECT 'public text has provisions', count(*) FROM d WHERE text_public AND NOT withdrawn AND rid NOT IN (SELECT rid FROM p)""")
def corpus_integrity(c: Corpus) -> DataFrame:
    return scd.integrity(c.raw("docs"), c.docs, c.provisions(), c.citations)


@query(f"""WITH {DOCS}, h AS (SELECT * REPLACE (coalesce(withdrawn, false) AS withdrawn) FROM docs WHERE rid IS NOT NULL AND observed_from <= TIMESTAMP '{_T0}' QUALIFY row_number() OVER (PARTITION BY rid ORDER BY observed_from DESC) = 1),
n AS (SELECT group_key, language, valid_from, count(*) AS candidates FROM d WHERE NOT withdrawn GROUP BY 1, 2, 3)
SELECT rid, coalesce(candidates, 0) AS candidates FROM h LEFT JOIN n ON n.group_key = h.group_key AND n.language = h.language AND n.valid_from = h.valid_from WHERE NOT withdrawn AND coalesce(candidates, 0) <> 1""")
def migration_unmatched(c: Corpus) -> DataFrame:
    return scd.unmatched_states(scd.state_at(c.raw("docs"), _T0), c.live)


@query("""WITH p AS (SELECT DISTINCT profile FROM embedding_cache WHERE profile IS NOT NULL), k AS (SELECT DISTINCT chunk_sha FROM semantic_chunks WHERE chunk_sha IS NOT NULL)
SELECT p.profile, k.chunk_sha FROM p, k ANTI JOIN (SELECT profile, chunk_sha FROM embedding_cache WHERE record IS NOT NULL) h ON h.profile = p.profile AND h.chunk_sha = k.chunk_sha""")
def embedding_cache_misses(c: Corpus) -> DataFrame:
    return scd.cache_misses(c.raw("semantic_chunks"), c.raw("embedding_cache"))
