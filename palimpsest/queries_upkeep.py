"""Registered queries: filters, publisher codes and metadata, scopes, gates, additions and the read operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.model import Corpus, FilterSet, apply_filters, overlong
from palimpsest.operators import citations as cite
from palimpsest.operators import history, search, upkeep
from palimpsest.queries_history import _CITED, _EVENTS, _SEQ
from palimpsest.queries_search import _RESOLVED, _SUBJECT, _asked, subjects
from palimpsest.queries_temporal import DAY, DOCS, PROVISIONS, iso

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(Corpus(spark, d))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: What the publishers' codes of this corpus stand for.
CODES = {
    "LOI": {"act_form": "law", "binding_status": "binding", "hierarchy": "primary", "role": "basic"},
    "GES": {"act_form": "law", "binding_status": "binding", "hierarchy": "primary", "role": "basic"},
    "RGD": {"act_form": "regulation", "binding_status": "binding", "hierarchy": "secondary", "role": "implementing"},
    "VO": {"act_form": "regulation", "binding_status": "binding", "hierarchy": "secondary", "role": "implementing"},
    "REG": {"act_form": "regulation", "binding_status": "binding", "hierarchy": "primary", "role": "basic"},
    "DIR": {"act_form": "directive", "binding_status": "as to the result", "hierarchy": "primary", "role": "basic"},
    "DEC": {"act_form": "decision", "binding_status": "binding", "hierarchy": "secondary", "role": "delegated"},
    "AMIN": {"act_form": "order", "binding_status": "binding", "hierarchy": "tertiary", "role": "delegated"},
}


def _case(attribute: str) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v[attribute]}'" for k, v in CODES.items()) + " END"


_CODED = f"{DOCS}, t AS (SELECT d.*, {_case('act_form')} AS act_form, {_case('binding_status')} AS binding_status, {_case('hierarchy')} AS hierarchy, {_case('role')} AS role, collection || '|' || coalesce({_SUBJECT}, '') AS domains FROM d)"


def _coded(c: Corpus) -> DataFrame:
    subject = F.coalesce(F.regexp_extract("title", r"(?:relative aux|on|über) (.+) \(", 1), F.lit(""))
    return upkeep.coded(c.docs, "kind", CODES).withColumn("domains", F.concat_ws("|", "collection", subject))


@query(f"WITH {_CODED} SELECT kind, act_form, binding_status, hierarchy, role, count(*) AS expressions FROM t GROUP BY ALL")
def publisher_codes(c: Corpus) -> DataFrame:
    return _coded(c).groupBy("kind", "act_form", "binding_status", "hierarchy", "role").agg(F.count(F.lit(1)).alias("expressions"))


_ARMS = {
    "hierarchy": (FilterSet(hierarchy="secondary"), "hierarchy = 'secondary'"),
    "act_form": (FilterSet(act_form="law"), "act_form = 'law'"),
    "binding_status": (FilterSet(binding_status="as to the result"), "binding_status = 'as to the result'"),
    "domain": (FilterSet(domain="vm-lex"), "contains('|' || domains || '|', '|vm-lex|')"),
    "document_role": (FilterSet(document_role="implementing"), "role = 'implementing'"),
    "metadata_identifier": (FilterSet(metadata_identifier="rural leases"), "rid IN (SELECT rid FROM t WHERE NOT withdrawn AND (group_key, language, valid_from) IN (SELECT (group_key, language, valid_from) FROM t WHERE contains(domains, '|rural leases')))"),
    "all": (FilterSet(act_form="regulation", hierarchy="secondary", document_role="implementing", language="fr", as_of=DAY), f"role = 'implementing' AND act_form = 'regulation' AND hierarchy = 'secondary' AND language = 'fr' AND valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to >= DATE '{DAY}')"),
}


@query(f"WITH {_CODED} " + " UNION ALL ".join(f"SELECT '{name}' AS arm, rid FROM t WHERE NOT withdrawn AND {sql}" for name, (_, sql) in _ARMS.items()))
def filter_arms(c: Corpus) -> DataFrame:
    """What each filter lets through."""
    rows = _coded(c)
    roles = rows.select("rid", "role")
    metadata = rows.where(F.contains("domains", F.lit("|rural leases"))).select("group_key", "language", "valid_from", F.lit("rural leases").alias("identifier"), F.lit(False).alias("citation_identity"))
    out = None
    for name, (filters, _) in _ARMS.items():
        part = apply_filters(rows, filters, roles, metadata).select(F.lit(name).alias("arm"), "rid")
        out = part if out is None else out.unionByName(part)
    return out


_BOUNDS = {"title": 60, "title_short": 10, "kind": 3, "source_uri": 80}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {n} AS bound, count(*) FILTER (length({c}) > {n}) AS rows, CAST(max(length({c})) AS INTEGER) AS longest FROM docs" for c, n in _BOUNDS.items()))
def metadata_bounds(c: Corpus) -> DataFrame:
    return overlong(c.raw("docs"), _BOUNDS)


@query(f"""WITH {DOCS}, k AS (SELECT group_key, kind, count(DISTINCT key) AS n FROM d WHERE kind IS NOT NULL GROUP BY 1, 2), m AS (SELECT group_key, kind AS main FROM k QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY n DESC, kind) = 1),
t AS (SELECT d.group_key, title FROM d LEFT JOIN m USING (group_key) WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY d.group_key ORDER BY valid_from DESC, CASE WHEN kind IS NOT DISTINCT FROM main THEN 0 ELSE 1 END, title DESC) = 1)
SELECT w.group_key, main AS kind, title FROM (SELECT DISTINCT group_key FROM d) w LEFT JOIN m USING (group_key) LEFT JOIN t USING (group_key)""")
def dominant_kinds(c: Corpus) -> DataFrame:
    return upkeep.dominant(c.docs)


@query(f"""WITH {DOCS}, m AS (SELECT DISTINCT group_key AS work, sha256({_SUBJECT}) AS identifier, trim({_SUBJECT}) AS value FROM d WHERE NOT withdrawn AND {_SUBJECT} <> '')
SELECT work, identifier, value, row_number() OVER (PARTITION BY work ORDER BY identifier, value) AS place FROM m""")
def canonical_metadata(c: Corpus) -> DataFrame:
    return upkeep.canonical_metadata(subjects(c))


_EDGES = f"{_CITED}, {DOCS}, e AS (SELECT DISTINCT d.group_key AS source, cited_slug AS target FROM r JOIN d USING (rid)), w AS (SELECT DISTINCT group_key AS work, {_SUBJECT} AS subject FROM d WHERE NOT withdrawn)"


@query(f"""WITH {_EDGES}, n AS (SELECT work, 'prefix' AS reason FROM w WHERE starts_with(work, 'loi-1990') UNION SELECT work, 'subject' FROM w WHERE subject = 'rural leases'), core AS (SELECT DISTINCT work FROM n),
x AS (SELECT * FROM n UNION SELECT target, 'cited' FROM e WHERE source IN (SELECT work FROM core) UNION SELECT source, 'citing' FROM e WHERE target IN (SELECT work FROM core))
SELECT work, string_agg(reason, ',' ORDER BY reason) AS reasons FROM x WHERE work IN (SELECT work FROM w) GROUP BY 1""")
def source_scope(c: Corpus) -> DataFrame:
    """The works of a scope, and why they are in it."""
    edges = cite.resolved(c.citations, c.docs).join(c.docs.select("rid", F.col("group_key").alias("source")), "rid").select("source", F.col("cited_slug").alias("target")).distinct()
    works = c.live.select(F.col("group_key").alias("work"), F.regexp_extract("title", r"(?:relative aux|on|über) (.+) \(", 1).alias("subject")).distinct()
    return upkeep.scope(works, edges, [], ["loi-1990"], ["rural leases"], 1_000_000)


@query(f"""WITH {DOCS}, v AS (SELECT group_key, key, lead(key) OVER (PARTITION BY group_key ORDER BY key) AS next FROM (SELECT DISTINCT group_key, key FROM d)),
a AS (SELECT DISTINCT next AS key, language FROM d JOIN v USING (key) WHERE next IS NOT NULL)
SELECT DISTINCT key, language FROM d WHERE NOT withdrawn AND key IN (SELECT key FROM a) AND (key, language) NOT IN (SELECT (key, language) FROM a)""")
def added_expressions(c: Corpus) -> DataFrame:
    """Languages of a version that the version before it lacks."""
    following = F.lead("key").over(Window.partitionBy("group_key").orderBy("key"))
    versions = c.docs.select("group_key", "key").distinct().select("key", following.alias("next")).where("next is not null")
    return upkeep.added_expressions(c.docs.join(versions, "key").select(F.col("next").alias("key"), "language"), c.docs)


@query(f"""WITH {DOCS}, {PROVISIONS}, x AS (SELECT collection, coalesce(text_available, false) AS wanted, rid IN (SELECT rid FROM p) AS held FROM d WHERE NOT withdrawn)
SELECT collection, count(*) AS expressions, count(*) FILTER (NOT wanted) AS metadata_only, count(*) FILTER (wanted AND held) AS acquired, count(*) FILTER (wanted AND NOT held) AS missing, count(*) FILTER (wanted AND NOT held) = 0 AS complete FROM x GROUP BY 1""")
def acquisition_gate(c: Corpus) -> DataFrame:
    return upkeep.acquisition(c.docs, c.provisions())


@query(f"""WITH {DOCS}, f AS (SELECT group_key, min(valid_from) AS f, min(publication_date) AS p FROM d GROUP BY 1),
s AS (SELECT group_key, valid_from, min(o) AS original FROM (SELECT group_key, valid_from, false AS o FROM d UNION ALL SELECT group_key, p, true FROM f WHERE p < f) GROUP BY 1, 2)
SELECT group_key, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(lead(valid_from) OVER (PARTITION BY group_key ORDER BY valid_from) - 1, '%Y-%m-%d') AS derived_to, original FROM s""")
def original_states(c: Corpus) -> DataFrame:
    return iso(upkeep.original_states(c.docs), "valid_from", "derived_to")


@query(_SEQ + """, st AS (SELECT DISTINCT group_key, language, anchor, p.text_sha FROM p JOIN d USING (rid) WHERE NOT withdrawn)
SELECT language, count(*) AS states, CAST(sum(versions) AS BIGINT) AS versions FROM runs WHERE (group_key, language, anchor, text_sha) IN (SELECT (group_key, language, anchor, text_sha) FROM st) GROUP BY 1""")
def indexed_history(c: Corpus) -> DataFrame:
    """Of each language the runs of wordings that can be searched for."""
    from palimpsest.operators.retrieval import lexical_states

    provisions = c.provisions("article_valid_from")
    rows = upkeep.indexed_history(history.wording_runs(c.docs, provisions), lexical_states(c.docs, c.provisions()))
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("states"), F.sum("versions").alias("versions"))


@query(_EVENTS + """, x AS (SELECT group_key, 'provisions' AS what FROM steps UNION ALL SELECT group_key, 'states' FROM runs UNION ALL SELECT group_key, 'renumbered' FROM bt
UNION ALL SELECT group_key, e FROM ch ANTI JOIN bt USING (group_key, language, ordinal, text_sha)) SELECT group_key, what, count(*) AS n FROM x GROUP BY 1, 2""")
def history_counts(c: Corpus) -> DataFrame:
    """Per work how many provisions, states and events its histories have."""
    provisions = c.provisions("article_valid_from")
    steps = history.version_sequence(c.docs, provisions).select("rid", "group_key").join(c.raw("provisions").where("rid is not null").select("rid", "anchor", F.coalesce(F.lower("text_sha"), F.sha2("text_md", 256)).alias("s"), "article_valid_from").distinct(), "rid")
    events = history.anchor_events(c.docs, c.provisions())
    rows = steps.select("group_key", F.lit("provisions").alias("what")).unionByName(history.wording_runs(c.docs, provisions).select("group_key", F.lit("states").alias("what"))).unionByName(events.select("group_key", F.col("etype").alias("what")))
    return rows.groupBy("group_key", "what").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'vector' AS lacking, chunk_sha FROM (SELECT DISTINCT chunk_sha FROM semantic_chunks WHERE chunk_sha IS NOT NULL) ANTI JOIN embedding_cache USING (chunk_sha)
UNION ALL SELECT 'chunk', chunk_sha FROM (SELECT DISTINCT chunk_sha FROM embedding_cache WHERE chunk_sha IS NOT NULL) ANTI JOIN semantic_chunks USING (chunk_sha)""")
def vector_orphans(c: Corpus) -> DataFrame:
    """Chunks without any vector and vectors of no chunk."""
    chunks, cache = c.raw("semantic_chunks"), c.raw("embedding_cache")
    return upkeep.vectors_without(chunks, cache, "chunk_sha").select(F.lit("vector").alias("lacking"), "chunk_sha").unionByName(upkeep.vectors_without(cache, chunks, "chunk_sha").select(F.lit("chunk").alias("lacking"), "chunk_sha"))


@query("""WITH h AS (SELECT DISTINCT chunk_sha FROM embedding_cache WHERE record IS NOT NULL), s AS (SELECT DISTINCT state_id, chunk_sha FROM semantic_chunks WHERE chunk_sha IS NOT NULL)
SELECT state_id, count(*) AS chunks, count(h.chunk_sha) AS encoded, count(*) = count(h.chunk_sha) AS whole FROM s LEFT JOIN h USING (chunk_sha) GROUP BY 1""")
def vector_coverage(c: Corpus) -> DataFrame:
    return upkeep.vector_coverage(c.raw("semantic_chunks"), c.raw("embedding_cache"))


@query(f"""WITH {DOCS}, {_RESOLVED}, w AS (SELECT DISTINCT mention, work FROM hits), k AS (SELECT DISTINCT group_key, collection FROM d WHERE NOT withdrawn)
SELECT mention, count(DISTINCT work) AS works, count(DISTINCT collection) AS publishers, CASE WHEN count(DISTINCT work) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM w JOIN k ON k.group_key = w.work GROUP BY 1""")
def global_resolutions(c: Corpus) -> DataFrame:
    """What each mention means across publishers: one work of one of them, or several."""
    hits = search.identity_matches(search.query_plans(_asked(c)), search.name_records(c.docs)).select("mention", "work").distinct()
    rows = hits.join(c.live.select(F.col("group_key").alias("work"), "collection").distinct(), "work").groupBy("mention").agg(F.countDistinct("work").alias("works"), F.countDistinct("collection").alias("publishers"))
    return rows.withColumn("status", F.when(F.col("works") == 1, "resolved").otherwise("ambiguous"))


@query(f"""WITH {DOCS} SELECT rid, CASE WHEN valid_to IS NULL THEN 'consolidated state from ' || strftime(valid_from, '%Y-%m-%d') ELSE 'consolidated state from ' || strftime(valid_from, '%Y-%m-%d') || ' to ' || strftime(valid_to, '%Y-%m-%d') END AS label, string_split(key, ':')[-1] AS coordinate,
array_to_string(list_transform(string_split(lower(replace(valid_time_source, '_', ' ')), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS facet, sha256('kind=' || coalesce(kind, '') || chr(10) || 'language=' || coalesce(language, '') || chr(10) || 'title=' || coalesce(title, '')) AS stamp FROM d""")
def version_labels(c: Corpus) -> DataFrame:
    """How each version is called, and the stamp of its record."""
    values = F.create_map(*[x for n in ("title", "kind", "language") for x in (F.lit(n), F.col(n))])
    return c.docs.select("rid", tx.interval_label(F.col("valid_from"), F.col("valid_to"), "publisher_consolidation").alias("label"), tx.version_coordinate(F.col("key")).alias("coordinate"), tx.facet_label(F.col("valid_time_source")).alias("facet"), upkeep.stamp(values).alias("stamp"))
