"""Registered queries of the text and vector problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import chunking, leakage, neighbours, spam, tokenizer
from palimpsest.session import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_column(table(spark, d, "documents"), f"{tokenizer.VOCABULARIES}/byte_bpe_50k.tiktoken", ["doc_id"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Of each leaked item, in how many documents it turns up."""
    found = p7_found(spark, d)
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def _pieces(spark: SparkSession, d: str, pieces: bool) -> DataFrame:
    parts = [
        chunking.chunk_texts(chunking.oversized(table(spark, d, name), text), pieces=pieces).withColumn("item_table", F.lit(name))
        for name, text in (("provisions", "text_md"), ("semantic_chunks", "text"))
    ]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, pieces=False).select("item_table", "text_sha", "boundary")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized text, named by the hash of its own text."""
    return _pieces(spark, d, pieces=True).select("item_table", "text_sha", "piece", "start", "token_count", F.sha2("piece_text", 256).alias("chunk_sha"))


def p3_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of every oversized text: its tokens, those of its pieces without the overlaps, and whether all pieces keep the limit and the overlap."""
    rows = _pieces(spark, d, pieces=True)
    own = F.count_if(F.col("token_count") > chunking.LIMIT) == 0
    after = F.lead("start").over(Window.partitionBy("item_table", "text_sha").orderBy("piece"))
    shared = F.col("start") + F.col("token_count") - chunking.SPECIAL - F.col("after")
    rows = rows.withColumn("after", after).withColumn("shared", F.when(F.col("after").isNotNull(), shared).otherwise(0))
    return rows.groupBy("item_table", "text_sha").agg(
        F.max("n_tokens").alias("n_tokens"), (F.sum(F.col("token_count") - chunking.SPECIAL - F.col("shared")) + chunking.SPECIAL).alias("covered"),
        own.alias("within_limit"), (F.count_if(F.col("after").isNotNull() & (F.col("shared") != chunking.OVERLAP)) == 0).alias("overlapping"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "embedding_cache"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"))


QUERIES = {"p8_found": p8_found, "p4_found": p4_found, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_cover": p3_cover, "p6_ids": p6_ids, "p7_found": p7_found, "p7_report": p7_report}
_BOUNDARY = """
SELECT DISTINCT '{table}' AS item_table, sha256({text}) AS text_sha,
  CASE WHEN list_max(list_transform(regexp_split_to_array({text}, '\\r?\\n[ \\t]*\\r?\\n'), lambda x: len(regexp_extract_all(x, '[^ \\t\\r\\n]+')))) <= 254 THEN 'paragraph'
       WHEN list_max(list_transform(regexp_split_to_array({text}, '\\r?\\n'), lambda x: len(regexp_extract_all(x, '[^ \\t\\r\\n]+')))) <= 254 THEN 'line'
       ELSE 'inside' END AS boundary
FROM {table} WHERE len(regexp_extract_all({text}, '[^ \\t\\r\\n]+')) > 254"""

_COVER = """
SELECT DISTINCT '{table}' AS item_table, sha256({text}) AS text_sha, n AS n_tokens, n AS covered, true AS within_limit, true AS overlapping
FROM (SELECT {text}, len(regexp_extract_all({text}, '[^ \\t\\r\\n]+')) + 2 AS n FROM {table}) WHERE n > 256"""

#: Exact neighbours by definition; the registered query finds them by graph search.
_PAIRS = """WITH v AS (SELECT DISTINCT profile, chunk_sha, record FROM embedding_cache WHERE octet_length(record) = 72 AND lower(record_sha) = sha256(record) AND profile IS NOT NULL AND chunk_sha IS NOT NULL),
b AS (SELECT profile, chunk_sha, list_transform(range(8, 72), lambda i: CAST('0x' || hex(record)[2*i+1:2*i+2] AS INT)) AS u FROM v),
s AS (SELECT profile, chunk_sha, CAST(list_transform(u, lambda x: CASE WHEN x > 127 THEN x - 256 ELSE x END) AS DOUBLE[64]) AS a FROM b),
d AS (SELECT x.profile, x.chunk_sha AS p, y.chunk_sha AS q, array_inner_product(x.a, y.a) AS dot FROM s x JOIN s y ON x.profile = y.profile AND x.chunk_sha <> y.chunk_sha),
t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY profile, p ORDER BY dot DESC, q) <= 5)
SELECT DISTINCT profile, least(p, q) AS chunk_sha_a, greatest(p, q) AS chunk_sha_b FROM t WHERE dot >= 0.9 * 16129"""

_WORDS = "regexp_extract_all(lower(strip_accents(regexp_replace({x}, '[\u00AD\u200B-\u200F\u2060-\u2064\uFEFF]', '', 'g'))), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = """SELECT DISTINCT {key}, n, gram FROM (SELECT {key}, n, string_agg(t, ' ') OVER f AS gram, count(*) OVER f AS c FROM {words}
  WINDOW f AS (PARTITION BY {key}, n ORDER BY k ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING)) WHERE c = n"""
_LEAKS = f"""WITH i AS (SELECT item_id, {_WORDS.format(x='passage')} AS w FROM eval_items WHERE passage IS NOT NULL),
iw AS (SELECT item_id, least(13, len(w)) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS k FROM i WHERE len(w) > 0),
g AS ({_GRAMS.format(key='item_id', words='iw')}),
d AS (SELECT doc_id, {_WORDS.format(x='text')} AS w FROM documents WHERE text IS NOT NULL),
dt AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS k FROM d),
dw AS (SELECT * FROM dt, (SELECT DISTINCT n FROM g)),
h AS ({_GRAMS.format(key='doc_id', words='dw')}),
found AS (SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (n, gram))
"""

ORACLES: dict[str, str] = {
    "p4_found": _PAIRS,
    "p7_found": _LEAKS + "SELECT doc_id, item_id FROM found",
    "p7_report": _LEAKS + "SELECT item_id, count(*) AS documents FROM found GROUP BY 1",
    "p3_cover": _COVER.format(table="provisions", text="text_md") + " UNION ALL " + _COVER.format(table="semantic_chunks", text="text"),
    "p3_found": _BOUNDARY.format(table="provisions", text="text_md") + " UNION ALL " + _BOUNDARY.format(table="semantic_chunks", text="text"),
}
