"""Registered queries: keyword and vector retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.model import Corpus
from palimpsest.operators import retrieval, vectors
from palimpsest.queries_temporal import DOCS, iso

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(Corpus(spark, d))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({_fold(x)}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _normal(x: str) -> str:
    n = f"trim(regexp_replace({_fold(x)}, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))"
    return f"CASE WHEN regexp_full_match({n}, '\\p{{L}}( \\p{{L}})+') THEN replace({n}, ' ', '') ELSE {n} END"


def _bm25(terms: str, key: str, every: bool, limit: int) -> str:
    """SQL of the ranking; ``terms`` gives key, t and w of every token as CTE tokens, with CTE sizes."""
    return f"""{terms},
totals AS (SELECT count(*) AS states, avg(n) AS mean FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest({_tokens('query')}) AS t FROM eval_items),
post AS (SELECT {key}, t, sum(w) AS tf FROM tokens WHERE t IN (SELECT t FROM asked) GROUP BY {key}, t),
held AS (SELECT t, count(*) AS df FROM post GROUP BY 1),
idf AS (SELECT t, mean, greatest(ln((states - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM held, totals),
scored AS (SELECT item_id, {key}, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score, count(*) AS matched FROM post JOIN idf USING (t) JOIN asked USING (t) JOIN sizes USING ({key}) GROUP BY item_id, {key}),
full_ AS (SELECT * FROM scored {'JOIN (SELECT item_id, count(*) AS needed FROM asked GROUP BY 1) USING (item_id) WHERE matched = needed' if every else ''}),
ranked AS (SELECT item_id, {key}, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, {key}) AS rank FROM full_ QUALIFY rank <= {limit})
"""


_DOC_TERMS = f"WITH tk AS (SELECT doc_id, {_tokens('text')} AS x FROM documents), sizes AS (SELECT doc_id, coalesce(len(x), 0) AS n FROM tk), tokens AS (SELECT doc_id, unnest(x) AS t, 1.0::DOUBLE AS w FROM tk)"
_DOC_BM25 = _bm25(_DOC_TERMS, "doc_id", False, 10)


def _bm25_documents(c: Corpus) -> DataFrame:
    return retrieval.bm25(c.raw("documents").select("doc_id", "text"), c.raw("eval_items"), ["doc_id"], {"text": 1.0}, "item_id", "query", False, 10)


@query(_DOC_BM25 + "SELECT item_id, doc_id, score, rank FROM ranked")
def bm25_search(c: Corpus) -> DataFrame:
    return _bm25_documents(c)


_STATES = f"""WITH {DOCS}, pp AS (SELECT DISTINCT rid, seq, anchor, coalesce(lower(text_sha), sha256(text_md)) AS text_sha, work_title, num, heading FROM provisions WHERE rid IS NOT NULL),
occ AS (SELECT group_key, language, anchor, text_sha, rid, work_title, num, heading FROM pp JOIN d USING (rid) WHERE NOT withdrawn
  QUALIFY row_number() OVER (PARTITION BY group_key, language, anchor, text_sha ORDER BY valid_from DESC, rid, seq, work_title NULLS FIRST, num NULLS FIRST, heading NULLS FIRST) = 1),
tx AS (SELECT DISTINCT sha256(text_md) AS text_sha, text_md FROM provisions WHERE text_md IS NOT NULL),
st AS (SELECT occ.*, text_md, group_key || '|' || language || '|' || anchor || '|' || text_sha AS state FROM occ LEFT JOIN tx USING (text_sha)),
tk AS (SELECT state, {_tokens("coalesce(work_title, '')")} AS a, {_tokens("coalesce(num, '')")} AS b, {_tokens("coalesce(heading, '')")} AS c, {_tokens("coalesce(text_md, '')")} AS e FROM st),
sizes AS (SELECT state, len(a) + len(b) + len(c) + len(e) AS n FROM tk),
tokens AS (SELECT state, unnest(a) AS t, 10.0::DOUBLE AS w FROM tk UNION ALL SELECT state, unnest(b), 4.0 FROM tk UNION ALL SELECT state, unnest(c), 6.0 FROM tk UNION ALL SELECT state, unnest(e), 1.0 FROM tk)"""
FIELDS = {"work_title": 10.0, "num": 4.0, "heading": 6.0, "text": 1.0}


def _states(c: Corpus) -> DataFrame:
    states = retrieval.lexical_states(c.docs, c.provisions("work_title", "num", "heading")).join(c.texts, "text_sha", "left")
    return states.withColumn("state", F.concat_ws("|", "group_key", "language", "anchor", "text_sha"))


def _fielded(c: Corpus, limit: int) -> DataFrame:
    return retrieval.bm25(_states(c), c.raw("eval_items"), ["state"], FIELDS, "item_id", "query", False, limit)


@query(_bm25(_STATES, "state", False, 20) + "SELECT item_id, state, score, rank FROM ranked")
def bm25_fielded(c: Corpus) -> DataFrame:
    return _fielded(c, 20)


_HEADINGS = "(SELECT heading AS item_id, heading AS query FROM provisions WHERE heading IS NOT NULL GROUP BY ALL)"


@query(_bm25(_STATES, "state", True, 20).replace("FROM eval_items", f"FROM {_HEADINGS}") + "SELECT item_id, state, score, rank FROM ranked")
def bm25_all_terms(c: Corpus) -> DataFrame:
    """Every heading as a query: states that hold all of its words."""
    headings = c.raw("provisions").where("heading is not null").select(F.col("heading").alias("item_id"), F.col("heading").alias("query")).distinct()
    return retrieval.bm25(_states(c), headings, ["state"], FIELDS, "item_id", "query", True, 20)


@query(_bm25(_STATES, "state", False, 60) + """, w AS (SELECT *, string_split(state, '|')[1] AS work FROM ranked QUALIFY row_number() OVER (PARTITION BY item_id, work ORDER BY rank) <= 2)
SELECT item_id, state, work, score, rank, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS place FROM w QUALIFY place <= 10""")
def work_cap(c: Corpus) -> DataFrame:
    """Six times the limit is fetched, then no work has more than two places of ten."""
    hits = _fielded(c, 60).withColumn("work", F.substring_index("state", "|", 1))
    return retrieval.capped(hits, "item_id", "work", 2, 10)


@query(f"""WITH {DOCS} SELECT language, count(*) AS states, count(DISTINCT text_sha) AS texts FROM (SELECT DISTINCT group_key, language, anchor, coalesce(lower(text_sha), sha256(text_md)) AS text_sha FROM provisions p JOIN d USING (rid) WHERE NOT withdrawn) GROUP BY 1""")
def lexical_states(c: Corpus) -> DataFrame:
    states = retrieval.lexical_states(c.docs, c.provisions())
    return states.groupBy("language").agg(F.count(F.lit(1)).alias("states"), F.countDistinct("text_sha").alias("texts"))


_VOCABULARY = f"vocab AS (SELECT DISTINCT unnest({_tokens('text')}) AS term FROM documents)"


@query(f"""WITH {_VOCABULARY}, f AS (SELECT item_id, word, min(pos) AS pos FROM (SELECT item_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM (SELECT item_id, {_tokens('query')} AS l FROM eval_items)) GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS i FROM f QUALIFY i <= 8),
n AS (SELECT item_id, i, word, term, levenshtein(word, term) AS distance FROM o JOIN vocab ON left(word, 1) = left(term, 1) WHERE length(word) >= 4 AND NOT regexp_matches(word, '[0-9]') AND word NOT IN ('celex', 'ecli', 'article')
      AND levenshtein(word, term) BETWEEN 1 AND CASE WHEN length(word) >= 8 THEN 2 ELSE 1 END),
t AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY item_id, i ORDER BY distance, term) <= 2)
SELECT item_id, word, term, distance FROM t QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY i, distance, term) <= 6""")
def fuzzy_terms(c: Corpus) -> DataFrame:
    vocabulary = c.raw("documents").select(F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    return retrieval.fuzzy_terms(c.raw("eval_items"), vocabulary, "item_id", "query")


_FORMS = ", ".join(f"'{x}'" for x in tx.ACT_FORMS)
_BARE = "nullif(trim(regexp_extract(title, '(?i)^\\s*version\\s+\\p{L}+\\s+applicable\\s+au\\s+\\d{2}/\\d{2}/\\d{4}\\s*:\\s*(.+)$', 1)), '')"
_NAMES = f"""names AS (SELECT DISTINCT work, {_normal('form')} AS name FROM (SELECT group_key AS work, unnest([title, {_BARE}, title_short, group_identifier, group_key]) AS form FROM d WHERE NOT withdrawn) WHERE form IS NOT NULL),
ids AS (SELECT * FROM names WHERE name <> '' AND (regexp_matches(name, '[0-9]') OR string_split(name, ' ')[1] IN ({_FORMS})))"""


@query(f"""WITH {DOCS}, {_NAMES}, q AS (SELECT doc_id, {_normal("text")} AS q FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, work FROM q JOIN ids ON contains(' ' || q || ' ', ' ' || name || ' ')""")
def identity_contained(c: Corpus) -> DataFrame:
    """Works whose name stands in a document."""
    return retrieval.contained_names(c.raw("documents"), retrieval.work_names(c.docs), "doc_id", "text").select("doc_id", "work").distinct()


@query(f"""WITH {DOCS}, {_NAMES} SELECT works, count(*) AS names FROM (SELECT name, count(DISTINCT work) AS works FROM ids GROUP BY 1) GROUP BY 1""")
def identity_collisions(c: Corpus) -> DataFrame:
    """How many names so many works bear: a search for one that several bear must not choose."""
    return retrieval.work_names(c.docs).groupBy("name").agg(F.countDistinct("work").alias("works")).groupBy("works").agg(F.count(F.lit(1)).alias("names"))


@query(f"""WITH {DOCS}, r AS (SELECT group_key, valid_from, title, CAST(lower(coalesce(title, '')) = 'loi relative' OR lower(coalesce(group_identifier, '')) = 'loi relative' AS INT) AS exact FROM d
  WHERE NOT withdrawn AND (contains(lower(coalesce(title, '')), 'loi') OR contains(lower(coalesce(group_identifier, '')), 'loi')) AND (contains(lower(coalesce(title, '')), 'relative') OR contains(lower(coalesce(group_identifier, '')), 'relative')))
SELECT group_key, exact, strftime(valid_from, '%Y-%m-%d') AS valid_from, title FROM r QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY exact DESC, valid_from DESC, title DESC NULLS LAST) = 1 ORDER BY exact DESC, valid_from DESC, group_key LIMIT 30""")
def title_search(c: Corpus) -> DataFrame:
    return iso(retrieval.title_search(c.docs, "loi relative", 30), "valid_from")


@query(f"""WITH a AS (SELECT item_id, replace(regexp_extract({_normal('passage')}, '{tx.ARTICLE}', 1), ' ', '') AS number FROM eval_items),
k AS (SELECT item_id, unnest(CASE WHEN regexp_matches(number, '^[0-9]+$') THEN [number, number || 'er', number || 're'] WHEN regexp_matches(number, '^[0-9]+(er|re)$') THEN [number, number[:-3]] ELSE [number] END) AS num_key FROM a WHERE number <> ''),
q AS (SELECT DISTINCT rid, anchor, lower(regexp_replace(num, '[\\s.\\-]+', '', 'g')) AS num_key FROM provisions WHERE rid IS NOT NULL)
SELECT item_id, num_key, count(*) AS provisions, count(DISTINCT rid) AS versions FROM k JOIN q USING (num_key) GROUP BY 1, 2""")
def article_intent(c: Corpus) -> DataFrame:
    provisions = c.raw("provisions").where("rid is not null").select("rid", "anchor", "num").distinct()
    hits = retrieval.article_hits(c.raw("eval_items"), provisions, "item_id", "passage")
    keys = hits.select("item_id", "num_key", "rid", "anchor").distinct()
    return keys.groupBy("item_id", "num_key").agg(F.count(F.lit(1)).alias("provisions"), F.countDistinct("rid").alias("versions"))


_RELEVANT = """, rel AS (SELECT item_id, doc_id FROM scored JOIN (SELECT item_id, count(*) AS needed FROM asked GROUP BY 1) USING (item_id) WHERE matched = needed),
tot AS (SELECT item_id, count(*) AS relevant FROM rel GROUP BY 1),
g AS (SELECT item_id, min(rank) AS first, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg FROM ranked JOIN rel USING (item_id, doc_id) GROUP BY 1),
m AS (SELECT item_id, relevant, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(coalesce(found / relevant, 0), 6) AS recall, round(coalesce(dcg / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg, coalesce(first, 0) = 1 AS exact_first, coalesce(shown, 0) - coalesce(found, 0) AS irrelevant FROM tot LEFT JOIN g USING (item_id) LEFT JOIN (SELECT item_id, count(*) AS shown FROM ranked GROUP BY 1) USING (item_id))
"""


def _metrics(c: Corpus) -> DataFrame:
    """Relevant to an item are the documents with all words of its query."""
    rows = retrieval.scored(c.raw("documents").select("doc_id", "text"), c.raw("eval_items"), ["doc_id"], {"text": 1.0}, "item_id", "query")
    return retrieval.metrics(retrieval.best(rows, ["doc_id"], "item_id", False, 10), rows.where("matched = needed"), "item_id", "doc_id")


@query(_DOC_BM25 + _RELEVANT + "SELECT * FROM m")
def retrieval_metrics(c: Corpus) -> DataFrame:
    return _metrics(c)


#: Least means that open a kind of retrieval.
GATES = {"mrr": 0.5, "recall": 0.6, "ndcg": 0.6, "exact_first": 0.5}


@query(_DOC_BM25 + _RELEVANT + """, f AS (SELECT split, category, count(*) AS items, round(avg(reciprocal_rank), 5) AS mrr, round(avg(recall), 5) AS recall, round(avg(ndcg), 5) AS ndcg, round(avg(CASE WHEN exact_first THEN 1 ELSE 0 END), 5) AS exact_first FROM m JOIN eval_items USING (item_id) GROUP BY 1, 2)
SELECT *, """ + " AND ".join(f"{n} >= {x}" for n, x in GATES.items()) + " AS passed, concat_ws(',', " + ", ".join(f"CASE WHEN {n} < {x} THEN '{n}' END" for n, x in GATES.items()) + ") AS failed FROM f")
def benchmark_gates(c: Corpus) -> DataFrame:
    """The measures of each split and category, and which gates they fail."""
    rows = _metrics(c).join(c.raw("eval_items").select("item_id", "split", "category"), "item_id")
    mean = lambda x, n: F.round(F.avg(x), 5).alias(n)
    out = rows.groupBy("split", "category").agg(F.count(F.lit(1)).alias("items"), mean("reciprocal_rank", "mrr"), mean("recall", "recall"), mean("ndcg", "ndcg"), mean(F.col("exact_first").cast("int"), "exact_first"))
    failed = F.concat_ws(",", *[F.when(F.col(n) < x, n) for n, x in GATES.items()])
    return out.withColumn("failed", failed).withColumn("passed", F.col("failed") == "")


@query(_bm25(_STATES, "state", False, 20) + """, own AS (SELECT state, split_part(min(rid), ':', 1) AS publisher FROM st GROUP BY 1),
o AS (SELECT item_id, publisher, state, row_number() OVER (PARTITION BY item_id, publisher ORDER BY score DESC, state) AS own_place FROM scored JOIN own USING (state) QUALIFY own_place <= 20),
c AS (SELECT item_id, publisher, count(*) AS n, row_number() OVER (PARTITION BY item_id ORDER BY publisher) AS i, count(*) OVER (PARTITION BY item_id) AS k, greatest(1, 20 // count(*) OVER (PARTITION BY item_id)) AS f FROM o GROUP BY 1, 2),
c1 AS (SELECT *, least(n, least(20, greatest(f, 20 - f * (k - 1)))) AS s FROM c WHERE i = 1), c2 AS (SELECT c.*, 20 - c1.s AS l, least(c.n, least(20 - c1.s, greatest(c.f, 20 - c1.s - c.f * (c.k - 2)))) AS s FROM c JOIN c1 USING (item_id) WHERE c.i = 2),
c3 AS (SELECT c.*, least(c.n, least(c2.l - c2.s, greatest(c.f, c2.l - c2.s - c.f * (c.k - 3)))) AS s FROM c JOIN c2 USING (item_id) WHERE c.i = 3),
sh AS (SELECT item_id, publisher, s FROM c1 UNION ALL SELECT item_id, publisher, s FROM c2 UNION ALL SELECT item_id, publisher, s FROM c3)
SELECT item_id, publisher, state, own_place FROM o JOIN sh USING (item_id, publisher) WHERE own_place <= s""")
def publisher_shares(c: Corpus) -> DataFrame:
    """The hits of each item within its publishers' shares of a common limit (three publishers here)."""
    states = _states(c)
    rows = retrieval.scored(states, c.raw("eval_items"), ["state"], FIELDS, "item_id", "query")
    own = states.groupBy("state").agg(F.substring_index(F.min("rid"), ":", 1).alias("publisher"))
    ranked = rows.join(own, "state").withColumn("rank", F.struct((-F.col("score")).alias("s"), "state"))
    return retrieval.fair_places(ranked, "item_id", "publisher", 20).select("item_id", "publisher", "state", "own_place")


@query("""WITH s AS (SELECT category, split, lower(trim(query)) AS q FROM eval_items WHERE query IS NOT NULL), g AS (SELECT q, min(category) AS category, count(DISTINCT split) AS splits, count(*) AS items FROM s GROUP BY 1)
SELECT category, count(*) AS queries, count(*) FILTER (splits > 1) AS leaked, CAST(sum(items) AS BIGINT) AS items FROM g GROUP BY 1""")
def split_leaks(c: Corpus) -> DataFrame:
    """Of each category the different queries, and those that are in both splits."""
    rows = c.raw("eval_items").where("query is not null").groupBy(F.lower(F.trim("query")).alias("q"))
    groups = rows.agg(F.min("category").alias("category"), F.countDistinct("split").alias("splits"), F.count(F.lit(1)).alias("items"))
    return groups.groupBy("category").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("splits") > 1).alias("leaked"), F.sum("items").alias("items"))


@query("""SELECT event_type, count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY value) AS p99 FROM events GROUP BY 1""")
def latency_percentiles(c: Corpus) -> DataFrame:
    p = retrieval.nearest_rank
    return c.raw("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), p("value", 0.5).alias("p50"), p("value", 0.95).alias("p95"), p("value", 0.99).alias("p99"))


_VECTORS = """v AS (SELECT DISTINCT profile, chunk_sha, hex(record) AS h FROM embedding_cache WHERE octet_length(record) = 72 AND lower(record_sha) = sha256(record) AND profile IS NOT NULL AND chunk_sha IS NOT NULL),
n AS (SELECT profile, chunk_sha, CAST('0x' || h[1:8] AS BIGINT) AS b1, CAST('0x' || h[9:16] AS BIGINT) AS b2, CAST(list_transform(range(8, 72), lambda i: CAST('0x' || h[2*i+1:2*i+2] AS INT) - CASE WHEN CAST('0x' || h[2*i+1:2*i+2] AS INT) > 127 THEN 256 ELSE 0 END) AS DOUBLE[64]) AS u FROM v),
q AS (SELECT * FROM n WHERE CAST('0x' || chunk_sha[1:15] AS BIGINT) % 20 = 0),
ham AS (SELECT q.profile, q.chunk_sha AS asked, n.chunk_sha, CAST(bit_count(xor(n.b1, q.b1)) + bit_count(xor(n.b2, q.b2)) AS INT) AS distance, CAST(array_inner_product(n.u, q.u) AS INT) AS dot FROM q JOIN n ON n.profile = q.profile)"""


def _own(c: Corpus) -> DataFrame:
    """The vectors of all profiles; of each those of ``vectors.askers`` ask all of it."""
    return vectors.well_formed(c.raw("embedding_cache"))


@query(f"WITH {_VECTORS} SELECT profile, asked, chunk_sha, distance FROM ham QUALIFY row_number() OVER (PARTITION BY profile, asked ORDER BY distance, chunk_sha) <= 100")
def hamming_topk(c: Corpus) -> DataFrame:
    return vectors.nearest(_own(c), 100).select("profile", "asked", "chunk_sha", "distance")


_LADDER = f"""WITH {_VECTORS}, near AS (SELECT * FROM ham QUALIFY row_number() OVER (PARTITION BY profile, asked ORDER BY distance, chunk_sha) <= 500),
dots AS (SELECT profile, asked, chunk_sha, distance, dot, row_number() OVER (PARTITION BY profile, asked ORDER BY dot DESC, chunk_sha) AS rank FROM near QUALIFY rank <= 50)"""


@query(_LADDER + " SELECT profile, asked, chunk_sha, distance, dot, round(dot / 16129.0, 6) AS similarity FROM dots")
def int8_rerank(c: Corpus) -> DataFrame:
    return vectors.nearest(_own(c), vectors.NARROW, 50).select("profile", "asked", "chunk_sha", "distance", "dot", F.round(F.col("dot") / 16129.0, 6).alias("similarity"))


@query(f"""WITH {_VECTORS} SELECT profile, asked, chunk_sha, dot FROM ham WHERE dot >= 8000""")
def similarity_scan(c: Corpus) -> DataFrame:
    """Every vector within a similarity of each one asked with; a threshold, not a top-k."""
    return vectors.within(_own(c), 8000).select("profile", "asked", "chunk_sha", "dot")


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM n)
SELECT vec_id, array_to_string(list_transform(v, lambda x: CASE WHEN x / n >= 0 THEN '1' ELSE '0' END), '') AS bits, array_to_string(list_transform(v, lambda x: CAST(round_even(x / n * 127, 0) AS INT)), ',') AS bytes FROM u""")
def quantised_vectors(c: Corpus) -> DataFrame:
    rows = vectors.quantised(c.raw("embeddings"))
    return rows.select("vec_id", "bits", F.array_join(F.transform("bytes", lambda b: b.cast("string")), ",").alias("bytes"))


@query(_LADDER + """, lex AS (SELECT chunk_sha, row_number() OVER (ORDER BY n DESC, chunk_sha) AS rank FROM (SELECT chunk_sha, max(token_count) AS n FROM semantic_chunks WHERE chunk_sha IS NOT NULL AND token_count IS NOT NULL GROUP BY 1) QUALIFY rank <= 50),
u AS (SELECT profile, asked, chunk_sha, 1.0 / (60 + rank) AS part FROM dots UNION ALL SELECT q.profile, q.chunk_sha, lex.chunk_sha, 0.65 / (60 + rank) FROM lex, (SELECT DISTINCT profile, chunk_sha FROM q) q)
SELECT profile, asked, chunk_sha, round(sum(part), 9) AS score, count(*) AS lists FROM u GROUP BY 1, 2, 3""")
def rrf_hybrid(c: Corpus) -> DataFrame:
    """A semantic list fused with a list of another kind, here the longest chunks, of less weight."""
    from pyspark.sql import Window

    own, asked = _own(c), ["profile", "asked"]
    order = Window.partitionBy(*asked).orderBy(F.col("dot").desc(), "chunk_sha")
    near = vectors.nearest(own, vectors.NARROW, 50).withColumn("rank", F.row_number().over(order))
    chunks = c.raw("semantic_chunks").where("chunk_sha is not null and token_count is not null").groupBy("chunk_sha").agg(F.max("token_count").alias("n")).orderBy(F.col("n").desc(), "chunk_sha").limit(50)
    # the list of the limit is the same for every query
    asking = vectors.askers(own.where("profile is not null")).select("profile", F.col("chunk_sha").alias("asked")).distinct()
    listed = asking.crossJoin(F.broadcast(_ranked(chunks, F.col("n").desc())))
    return retrieval.fuse([(near, 1.0), (listed, 0.65)], [*asked, "chunk_sha"])


def _ranked(top: DataFrame, order) -> DataFrame:
    """Ranks of a list that a limit has already bounded."""
    from pyspark.sql import Window

    return top.select("chunk_sha", F.row_number().over(Window.orderBy(order, "chunk_sha")).alias("rank"))


@query(_bm25(_STATES, "state", False, 20) + """, own AS (SELECT state, split_part(min(rid), ':', 1) AS publisher FROM st GROUP BY 1),
lists AS (SELECT item_id, publisher, state, row_number() OVER (PARTITION BY item_id, publisher ORDER BY score DESC, state) AS rank FROM scored JOIN own USING (state) QUALIFY rank <= 20),
f AS (SELECT item_id, state, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS lists FROM lists GROUP BY 1, 2)
SELECT item_id, state, score, lists, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, state) AS place FROM f QUALIFY place <= 20""")
def rrf_publishers(c: Corpus) -> DataFrame:
    """The lists of hits of several publishers as one, fused by rank."""
    from pyspark.sql import Window

    states = _states(c)
    rows = retrieval.scored(states, c.raw("eval_items"), ["state"], FIELDS, "item_id", "query")
    own = states.groupBy("state").agg(F.substring_index(F.min("rid"), ":", 1).alias("publisher"))
    of_publisher = Window.partitionBy("item_id", "publisher").orderBy(F.col("score").desc(), "state")
    lists = rows.join(own, "state").withColumn("rank", F.row_number().over(of_publisher)).where("rank <= 20")
    fused = retrieval.fuse([(lists, 1.0)], ["item_id", "state"])
    return fused.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "state"))).where("place <= 20")


@query(f"""SELECT doc_id, {_normal('text')} AS words FROM documents""")
def normalized_documents(c: Corpus) -> DataFrame:
    return c.raw("documents").select("doc_id", tx.normalize(F.col("text")).alias("words"))


@query(f"""WITH {DOCS} SELECT DISTINCT title, trim(both '-' FROM regexp_replace({_fold('title')}, '[^a-z0-9]+', '-', 'g')) AS slug, len({_tokens('title')}) AS words, string_split({_normal('title')}, ' ')[1] IN ({_FORMS}) AS act_form FROM d WHERE title IS NOT NULL""")
def title_functions(c: Corpus) -> DataFrame:
    t = F.col("title")
    return c.docs.where("title is not null").select(t, tx.slug(t).alias("slug"), F.size(tx.tokens(t)).cast("long").alias("words"), tx.is_act_form(tx.normalize(t)).alias("act_form")).distinct()


@query(f"""WITH {DOCS} SELECT status, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(text_available, false) THEN 'text_not_available' WHEN coalesce(text_public, false) THEN 'ok' ELSE 'text_withheld' END AS status FROM d) GROUP BY 1""")
def text_gate(c: Corpus) -> DataFrame:
    return c.docs.select(tx.text_gate(F.col("text_available"), F.col("text_public")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN token_count <= 32 THEN 32 WHEN token_count <= 64 THEN 64 WHEN token_count <= 128 THEN 128 WHEN token_count <= 256 THEN 256 ELSE 512 END AS bucket, count(DISTINCT chunk_sha) AS chunks FROM semantic_chunks WHERE token_count IS NOT NULL GROUP BY 1""")
def token_buckets(c: Corpus) -> DataFrame:
    rows = c.raw("semantic_chunks").where("token_count is not null")
    return rows.groupBy(tx.token_bucket(F.col("token_count")).alias("bucket")).agg(F.countDistinct("chunk_sha").alias("chunks"))
