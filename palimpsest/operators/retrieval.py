"""Keyword retrieval: postings, BM25, fuzzy terms, identities, rank fusion and its measures."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from palimpsest.functions import text as tx
from palimpsest.session import broadcast_if_small, stored

#: Constants of the ranking function, and of reciprocal rank fusion.
K1, B, RRF = 1.2, 0.75, 60
#: Queries and states of a block where sums are made for every pair of them.
QUERIES, STATES = 5_000, 100_000


def lexical_states(docs: DataFrame, provisions: DataFrame) -> DataFrame:
    """Searchable states: each text of an anchor of a work in a language once.

    ``provisions`` has rid, seq, anchor, text_sha and the fields to search; of a state's
    occurrences the one of the latest version is kept (then the smallest rid).
    """
    fields = [c for c in provisions.columns if c not in ("rid", "seq", "anchor", "text_sha")]
    rows = provisions.join(docs.select("rid", "group_key", "language", "valid_from", "withdrawn"), "rid").where("not withdrawn")
    latest = F.min(F.struct((-F.unix_date("valid_from")).alias("age"), "rid", "seq", *fields)).alias("o")
    out = rows.groupBy("group_key", "language", "anchor", "text_sha").agg(latest)
    return out.select("group_key", "language", "anchor", "text_sha", F.col("o.rid").alias("rid"), *[F.col(f"o.{f}").alias(f) for f in fields])


def _weighted(weight: float):
    return lambda term: F.struct(term.alias("t"), F.lit(float(weight)).alias("w"))


def _tokenised(states: DataFrame, key: list[str], fields: dict[str, float]) -> DataFrame:
    """``key, tokens, length``: the tokens of each state with the weights of their fields."""
    parts = [F.transform(tx.tokens(F.coalesce(F.col(f), F.lit(""))), _weighted(w)) for f, w in fields.items()]
    every = parts[0] if len(parts) == 1 else F.concat(*parts)
    return states.select(*key, every.alias("tokens")).withColumn("length", F.size("tokens"))


def postings(states: DataFrame, key: list[str], fields: dict[str, float]) -> DataFrame:
    """``key, term, tf, length``: weighted term frequencies and the length of each state.

    A term's frequency counts with the weight of its field; the length is of all fields.
    Terms are counted within the row (a sort of its own tokens), so that building the
    postings needs no shuffle.
    """
    rows = _tokenised(states, key, fields)
    # the outer form, or else the optimizer would tokenise once more to drop empty rows
    terms = rows.select(*key, "length", F.explode_outer("tokens").alias("x")).select(*key, "length", "x.t", "x.w").where("t is not null")
    return terms.groupBy(*key, "length", F.col("t").alias("term")).agg(F.sum("w").alias("tf"))


def _hits_once(states: DataFrame, asked: DataFrame, key: list[str], fields: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Postings of the terms that are asked for, and ``states, mean``: one pass over the texts, written once.

    For the totals every state has the term '' as well, which is no token, with its length as
    weight; partial aggregates leave one row of them a task.
    """
    rows = _tokenised(states, key, fields)
    whole = F.array(F.struct(F.lit("").alias("t"), F.col("length").cast("double").alias("w")))
    terms = rows.select(*key, "length", F.explode_outer(F.concat("tokens", whole)).alias("x"))
    # without a key where it is the total
    terms = terms.select(*[F.when(F.col("x.t") != "", F.col(c)).alias(c) for c in (*key, "length")], F.col("x.t").alias("term"), "x.w")
    wanted = asked.select("term").union(states.sparkSession.range(1).select(F.lit(""))).distinct()
    hits = terms.join(broadcast_if_small(wanted), "term", "left_semi").groupBy(*key, "length", "term").agg(F.sum("w").alias("tf"), F.count(F.lit(1)).alias("n"))
    hits = stored(hits)
    return hits.where("term <> ''").drop("n"), hits.where("term = ''").select(F.col("n").alias("states"), (F.col("tf") / F.col("n")).alias("mean"))


def _statistics(states: DataFrame, queries: DataFrame, key: list[str], fields: dict[str, float], query_id: str, query: str, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Postings of the terms that are asked for, and ``query_id, term, needed, df, idf, mean``.

    Statistics are of all states, whatever the filters were.  ``once`` writes both, so that
    no use of them reads the texts again.
    """
    asked = queries.select(query_id, F.array_distinct(tx.tokens(F.col(query))).alias("terms")).select(query_id, F.explode("terms").alias("term"), F.size("terms").cast("long").alias("needed"))
    if once:
        hits, totals = _hits_once(states, asked, key, fields)
    else:
        words = [F.regexp_count(tx.fold(F.coalesce(F.col(f), F.lit(""))), F.lit(r"[\p{L}\p{N}]+")) for f in fields]
        totals = states.select(reduce(lambda a, b: a + b, words).alias("n")).agg(F.count(F.lit(1)).alias("states"), F.avg("n").alias("mean"))
        hits = postings(states, key, fields).join(asked.select("term").distinct(), "term", "left_semi")
    held = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.ln((F.col("states") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    # one row: its broadcast is bounded
    terms = asked.join(held.join(F.broadcast(totals)).select("term", "df", "mean", idf.alias("idf")), "term")
    return hits, stored(terms) if once else terms


def _part() -> Column:
    """What a term adds to the score of a state."""
    return F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))


def _parts(hits: DataFrame, terms: DataFrame, on: list[str], *columns: str) -> DataFrame:
    return hits.join(terms, on).select(*columns, _part().alias("part"), F.lit(1).cast("long").alias("n"))


def scored(states: DataFrame, queries: DataFrame, key: list[str], fields: dict[str, float], query_id: str, query: str) -> DataFrame:
    """``query_id, key, score, matched, needed``: BM25 of every state that holds a term of a query.

    ``matched`` counts the terms that a state holds, of ``needed`` ones.  The result has a
    row for every query and state with a common word.
    """
    hits, terms = _statistics(states, queries, key, fields, query_id, query)
    rows = _parts(hits, terms, ["term"], query_id, "needed", *key)
    return rows.groupBy(query_id, "needed", *key).agg(F.round(F.sum("part"), 6).alias("score"), F.sum("n").alias("matched"))


def bm25(states: DataFrame, queries: DataFrame, key: list[str], fields: dict[str, float], query_id: str, query: str, every_term: bool, limit: int | None, once: bool = False) -> DataFrame:
    """``query_id, key, score, rank``: the best states for each query; equal scores are in order of the key.

    If a state must hold ``every_term``, only states that hold a query's rarest one are
    looked at, and only these are scored by its other terms, so that no query is paired with
    all states that hold a common word; without a ``limit`` all that hold every term come
    out.  Else every state with a term of a query is scored by it.  ``once`` writes postings
    and terms, and makes the sums of any term by blocks (see ``_best_sums``).
    """
    if not every_term:
        if limit is None:
            raise ValueError("without a limit every term must be asked for")
        if once:
            return _best_sums(*_statistics(states, queries, key, fields, query_id, query, True), key, query_id, limit)
        return best(scored(states, queries, key, fields, query_id, query), key, query_id, False, limit)
    hits, terms = _statistics(states, queries, key, fields, query_id, query, once)
    by_rarity = Window.partitionBy(query_id).orderBy("df", "term")
    terms = terms.withColumn("lead", F.row_number().over(by_rarity) == 1)
    first = _parts(hits, terms.where("lead"), ["term"], query_id, "needed", *key)
    others = first.select(query_id, "needed", *key).join(terms.where("not lead").select(query_id, "term", "idf", "mean"), query_id)
    rows = first.unionByName(_parts(hits, others, [*key, "term"], query_id, "needed", *key))
    total = rows.groupBy(query_id, "needed", *key).agg(F.round(F.sum("part"), 6).alias("score"), F.sum("n").alias("matched"))
    if limit is None:
        return total.where("matched = needed").drop("matched", "needed")
    return best(total, key, query_id, True, limit)


def _best_sums(hits: DataFrame, terms: DataFrame, key: list[str], query_id: str, limit: int) -> DataFrame:
    """``query_id, key, score, rank``: as ``best`` of ``scored``, without a row for every query and state that share a word.

    What a term adds to a state is the same for all queries.  So states with these parts and
    queries with their terms meet in blocks, each pair of blocks in a task, where the parts
    are summed by arrays; only the best of a query leave its block.
    """
    weights = terms.select("term", "idf", "mean").distinct()
    rows = hits.join(weights, "term").groupBy(*key).agg(F.collect_list("term").alias("terms"), F.collect_list(_part()).alias("parts"))
    asking = terms.groupBy(query_id).agg(F.sort_array(F.collect_list("term")).alias("asked"))
    parts, blocks = (max(1, -(-df.select(*of).distinct().count() // n)) for df, of, n in ((hits, key, STATES), (terms, [query_id], QUERIES)))
    part, block = (F.pmod(F.xxhash64(*of), F.lit(n)).cast("int") for of, n in ((key, parts), ([query_id], blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asking.select("*", block.alias("_block"), every(parts).alias("_part")).groupBy("_block", "_part")
    right = rows.select("*", part.alias("_part"), every(blocks).alias("_block")).groupBy("_block", "_part")

    def meet(queries: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        states = states.sort_values(key, na_position="first")
        if len(queries) and len(states):
            number = {t: i for i, t in enumerate({t for terms in queries["asked"] for t in terms})}
            of = np.fromiter((number.get(t, -1) for terms in states["terms"] for t in terms), int)
            at, value = np.repeat(np.arange(len(states)), states["terms"].map(len)), np.concatenate(states["parts"].to_numpy())
            order = np.argsort(of, kind="stable")
            at, value, bounds = at[order], value[order], np.searchsorted(of[order], np.arange(len(number) + 1))
            for q, terms in enumerate(queries["asked"]):
                total, held = np.zeros(len(states)), np.zeros(len(states), bool)
                for own in (slice(*bounds[number[t] : number[t] + 2]) for t in terms):
                    total[at[own]] += value[own]
                    held[at[own]] = True
                c = np.flatnonzero(held)
                # scores that are equal to six places are in order of the key
                score = np.floor(total[c] * 1e6 + 0.5)
                if len(c) > limit:
                    near = score >= np.partition(score, len(c) - limit)[len(c) - limit]
                    c, score = c[near], score[near]
                first = np.argsort(-score, kind="stable")[:limit]
                found.append((np.full(len(first), q), c[first], score[first] / 1e6))
        q, c, score = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({query_id: queries[query_id].to_numpy(object)[q]} | {k: states[k].to_numpy(object)[c] for k in key} | {"score": score})

    fields = [StructField(f.name, f.dataType) for f in (terms.schema[query_id], *(hits.schema[k] for k in key))]
    sums = left.cogroup(right).applyInPandas(meet, StructType([*fields, StructField("score", DoubleType())]))
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), *key)
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def best(rows: DataFrame, key: list[str], query_id: str, every_term: bool, limit: int) -> DataFrame:
    """The best of ``scored`` rows of each query, with their ranks."""
    if every_term:
        rows = rows.where("matched = needed")
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), *key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("matched", "needed")


def capped(hits: DataFrame, query_id: str, work: str, per_work: int, limit: int) -> DataFrame:
    """At most ``per_work`` hits of one work in each query's list, then the first ``limit``."""
    within = Window.partitionBy(query_id, work).orderBy("rank")
    overall = Window.partitionBy(query_id).orderBy("rank")
    rows = hits.withColumn("in_work", F.row_number().over(within)).where(F.col("in_work") <= per_work).drop("in_work")
    return rows.withColumn("place", F.row_number().over(overall)).where(F.col("place") <= limit)


def fuzzy_terms(queries: DataFrame, vocabulary: DataFrame, query_id: str, query: str) -> DataFrame:
    """Terms of the vocabulary that a query's words may be misspellings of.

    Words of four letters or more without digits, at most eight of a query, may differ by
    one edit (two from eight letters on) and keep their first letter; two terms a word and
    six a query, nearest first.  Words and terms meet by an equi-join on first letter and
    length, so that no word is compared with the whole vocabulary.
    """
    words = queries.select(query_id, F.posexplode(F.slice(F.array_distinct(tx.tokens(F.col(query))), 1, 8)).alias("at", "word"))
    words = words.where(r"length(word) >= 4 and not word rlike '[0-9]' and word not in ('celex', 'ecli', 'article')")
    most = F.when(F.length("word") >= 8, 2).otherwise(1)
    words = words.withColumn("most", most).withColumn("n", F.explode(F.sequence(F.length("word") - F.col("most"), F.length("word") + F.col("most"))))
    words = words.withColumn("letter", F.substring("word", 1, 1))
    terms = vocabulary.select("term", F.length("term").alias("n"), F.substring("term", 1, 1).alias("letter")).distinct()
    near = words.join(terms, ["letter", "n"]).withColumn("distance", F.levenshtein("word", "term", 2)).where("distance between 1 and most")
    in_word = Window.partitionBy(query_id, "at").orderBy("distance", "term")
    in_query = Window.partitionBy(query_id).orderBy("at", "distance", "term")
    kept = near.withColumn("i", F.row_number().over(in_word)).where("i <= 2").withColumn("j", F.row_number().over(in_query)).where("j <= 6")
    return kept.select(query_id, "word", "term", F.col("distance").cast("long").alias("distance"))


def contained_names(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """``key, work, name``: works whose normalised name stands in a text, word for word.

    Each place of a text gives the hashes of the one and the two words there; only places
    where a name can begin go on, with as many words as the names have that begin so.  These
    meet names by an equi-join on the whole of them, so that what is shuffled is a hash a
    word and no text is paired with all names, not even with those that share a beginning.
    """
    # through a generator, whose output no optimizer rule copies into the lambda
    words = texts.select(key, F.explode_outer(F.array(F.split(tx.normalize(F.col(text)), " "))).alias("words")).where("words is not null")
    known = names.select("name", "work", F.xxhash64("name").alias("whole"))
    begin = names.select(F.xxhash64(F.substring_index("name", " ", 2)).alias("head"), F.size(F.split("name", " ")).alias("n"))
    lengths = begin.groupBy("head").agg(F.sort_array(F.collect_set("n")).alias("sizes"))
    places = F.sequence(F.lit(1), F.size("words"))
    heads = F.transform(places, lambda i: F.struct(i.alias("at"), F.array(F.xxhash64(F.element_at("words", i)), F.xxhash64(F.array_join(F.slice("words", i, 2), " "))).alias("heads")))
    text_id = F.xxhash64(F.array_join("words", " "))
    numbered = words.withColumn("text_id", text_id)
    tried = numbered.select(key, "text_id", F.explode(heads).alias("p")).select(key, "text_id", "p.at", F.explode(F.array_distinct("p.heads")).alias("head"))
    met = tried.join(broadcast_if_small(lengths), "head").groupBy(F.col(key).alias("_key"), F.col("text_id").alias("_text")).agg(F.collect_set(F.struct("at", "sizes")).alias("met"))
    windows = numbered.join(met, F.col(key).eqNullSafe(F.col("_key")) & (F.col("text_id") == F.col("_text"))).select(key, "words", F.explode("met").alias("m"))
    windows = windows.select(key, "words", "m.at", F.explode("m.sizes").alias("n")).where(F.col("at") + F.col("n") <= F.size("words") + 1)
    windows = windows.select(key, F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("w")).withColumn("whole", F.xxhash64("w"))
    windows = windows.join(broadcast_if_small(known.select("whole").distinct()), "whole", "left_semi")
    return windows.join(known, "whole").where("w = name").select(key, "work", "name").distinct()


def work_names(docs: DataFrame) -> DataFrame:
    """``name, work``: normalised forms of the titles and identifiers that works bear.

    A name counts as an identity only if it has a digit or opens with an act's form.
    """
    forms = F.explode(F.array_union(tx.name_forms(F.col("title")), F.array("title_short", "group_identifier", "group_key"))).alias("form")
    rows = docs.where("not withdrawn").select(F.col("group_key").alias("work"), forms).where("form is not null")
    named = rows.select("work", tx.normalize(F.col("form")).alias("name")).where("name <> ''").distinct()
    return named.where(F.col("name").rlike("[0-9]") | tx.is_act_form(F.col("name")))


def title_search(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """Works whose title or identifier contains all terms (up to six), exact matches first.

    If nothing does, the longest term of five letters or more is tried alone by the caller.
    """
    terms = query.lower().split()[:6]
    title, ident = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("group_identifier", F.lit("")))
    held = [F.contains(title, F.lit(t)) | F.contains(ident, F.lit(t)) for t in terms] or [F.lit(False)]
    exact = (title == query.lower()) | (ident == query.lower())
    rows = docs.where("not withdrawn").where(reduce(lambda a, b: a & b, held))
    best = rows.groupBy("group_key").agg(F.max(F.struct(exact.cast("int").alias("exact"), "valid_from", "title")).alias("b"))
    return best.select("group_key", F.col("b.exact").alias("exact"), F.col("b.valid_from").alias("valid_from"), F.col("b.title").alias("title")).orderBy(F.col("exact").desc(), F.col("valid_from").desc(), "group_key").limit(limit)


def article_hits(queries: DataFrame, provisions: DataFrame, query_id: str, query: str) -> DataFrame:
    """Provisions whose number is the article that a query names, in any spelling of it."""
    asked = queries.select(query_id, tx.article_number(tx.normalize(F.col(query))).alias("number")).where("number <> ''")
    spelled = asked.select(query_id, F.explode(tx.ordinal_spellings(F.replace(F.col("number"), F.lit(" "), F.lit("")))).alias("num_key"))
    return spelled.join(provisions.withColumn("num_key", tx.article_key(F.col("num"))), "num_key")


def fuse(lists: list[tuple[DataFrame, float]], key: list[str], rank: str = "rank") -> DataFrame:
    """Reciprocal rank fusion: ``sum(weight / (60 + rank))`` over the lists that hold a key."""
    rows = reduce(DataFrame.unionByName, [df.select(*key, (F.lit(w) / (RRF + F.col(rank))).alias("part")) for df, w in lists])
    return rows.groupBy(*key).agg(F.round(F.sum("part"), 9).alias("score"), F.count(F.lit(1)).alias("lists"))


def fair_shares(found: dict[str, int], limit: int) -> dict[str, int]:
    """Places of a shared limit by publisher, in order: each may count on an equal floor, and takes what those after it need not."""
    floor = max(1, limit // len(found)) if found else 0
    shares, left = {}, limit
    for i, publisher in enumerate(sorted(found)):
        reserved = floor * (len(found) - i - 1)
        shares[publisher] = min(found[publisher], left, max(floor, left - reserved))
        left -= shares[publisher]
    return shares


def fair_places(hits: DataFrame, query_id: str, publisher: str, limit: int) -> DataFrame:
    """The hits of each query within the ``fair_shares`` of their publishers; ``rank`` orders the hits of a publisher.

    Publishers are few; of each only as many hits as the limit are ever counted.
    """
    own = Window.partitionBy(query_id, publisher).orderBy("rank")
    rows = hits.withColumn("own_place", F.row_number().over(own)).where(F.col("own_place") <= limit)
    counts = rows.groupBy(query_id, publisher).agg(F.count(F.lit(1)).cast("int").alias("n")).groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct(F.col(publisher).alias("p"), "n"))).alias("found"))
    floor = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.size("found")).cast("int"))
    start = F.struct(F.lit(limit).alias("left"), F.size("found").alias("more"), F.array().cast("array<struct<p:string,share:int>>").alias("shares"))

    def step(state: Column, x: Column) -> Column:
        share = F.least(x["n"], state["left"], F.greatest(floor, state["left"] - floor * (state["more"] - 1)))
        taken = F.array(F.struct(x["p"].cast("string").alias("p"), share.alias("share")))
        return F.struct((state["left"] - share).alias("left"), (state["more"] - 1).alias("more"), F.concat(state["shares"], taken).alias("shares"))

    shares = counts.select(query_id, F.explode(F.aggregate("found", start, step)["shares"]).alias("s")).select(query_id, F.col("s.p").alias(publisher), "s.share")
    return rows.join(shares, [query_id, publisher]).where(F.col("own_place") <= F.col("share")).drop("share")


def metrics(ranked: DataFrame, relevant: DataFrame, query_id: str, key: str, depth: int = 10) -> DataFrame:
    """Per query: reciprocal rank, recall and nDCG at ``depth``, whether the first hit is relevant, and how many of the hits are not.

    A query without a relevant key has no row.
    """
    gold = relevant.select(query_id, key).distinct()
    total = gold.groupBy(query_id).agg(F.count(F.lit(1)).alias("relevant"))
    top = ranked.where(F.col("rank") <= depth)
    hits = top.join(gold, [query_id, key])
    gains = hits.groupBy(query_id).agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("found"), F.sum(F.lit(1.0) / F.log2(F.col("rank") + 1)).alias("dcg"))
    shown = top.groupBy(query_id).agg(F.count(F.lit(1)).alias("shown"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant").cast("int"), F.lit(depth))), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1))
    rows = total.join(gains, query_id, "left").join(shown, query_id, "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select(
        query_id, "relevant", zero(1.0 / F.col("first")).alias("reciprocal_rank"), zero(F.col("found") / F.col("relevant")).alias("recall"), zero(F.col("dcg") / ideal).alias("ndcg"),
        (F.coalesce("first", F.lit(0)) == 1).alias("exact_first"), (F.coalesce("shown", F.lit(0)) - F.coalesce("found", F.lit(0))).alias("irrelevant"),
    )


def nearest_rank(column: str, p: float) -> Column:
    """The nearest-rank percentile (not interpolated)."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")
