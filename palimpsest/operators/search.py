"""Search by stages: what a query names, articles of it, its words, and works by their metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import retrieval
from palimpsest.session import stored

#: Works that are told of a mention at most; the rest are counted.
CANDIDATES = 20
#: Weights of a work's metadata in a search for works.
WORK_FIELDS = {"identifiers": 12.0, "aliases": 10.0, "titles": 8.0, "facets": 3.0}
#: Words of a query that search for works at most.
WORK_WORDS = 12


def query_plans(queries: DataFrame, query: str = "query") -> DataFrame:
    """``query, normalized, article, role, identifiers, residual`` of the distinct queries.

    ``residual`` is what is left to search provisions for once article, role, references
    back and conversational words are taken off; a query of which nothing is taken off stays
    as it is.  Null queries have no plan.
    """
    rows = queries.where(F.col(query).isNotNull()).select(F.col(query).alias("query")).distinct()
    # through a generator, so that no expression normalises once more for itself
    rows = rows.select("query", F.explode(F.array(tx.normalize(F.col("query")))).alias("normalized"))
    n = F.col("normalized")
    rows = rows.withColumns({"article": tx.article_number(n), "role": tx.role_of(n)})
    rows = rows.withColumn("residual", tx.residual(n, F.col("role")))
    untouched = (F.col("article") == "") & F.col("role").isNull() & (F.col("residual") == n)
    return rows.select("query", "normalized", "article", "role", tx.exact_identifiers(F.col("query")).alias("identifiers"), F.when(untouched, F.trim("query")).otherwise(F.col("residual")).alias("residual"))


def name_records(docs: DataFrame) -> DataFrame:
    """``work, name, kind``: the normalised names under which live works are catalogued."""
    kinds = {
        "identifier": F.array_compact(F.array("group_identifier", "group_key")),
        "short_title": F.coalesce(tx.short_titles(F.col("title_short")), F.array().cast("array<string>")),
        "title": F.coalesce(F.when(F.col("title").isNotNull(), tx.name_forms(F.col("title"))), F.array().cast("array<string>")),
    }

    def tagged(names: Column, kind: str) -> Column:
        return F.transform(names, lambda x: F.struct(x.alias("form"), F.lit(kind).alias("kind")))

    forms = F.concat(*[tagged(names, kind) for kind, names in kinds.items()])
    rows = docs.where("not withdrawn").select(F.col("group_key").alias("work"), "title", "title_short", "group_identifier", "group_key").distinct()
    rows = rows.select("work", F.explode(forms).alias("f")).select("work", tx.normalize(F.col("f.form")).alias("name"), "f.kind")
    return rows.where("name <> ''").distinct()


def _containable(name: Column, kind: Column) -> Column:
    """Whether a name within a longer query names its work rather than being common prose."""
    digit = name.rlike("[0-9]")
    title = (F.instr(name, " ") > 0) & ((F.length(name) >= 12) | tx.is_act_form(name)) & (digit | tx.is_act_form(name))
    return F.when(kind == "short_title", F.length(name) >= 3).when(kind == "identifier", (F.length(name) >= 4) & digit).otherwise(title)


def identity_matches(plans: DataFrame, names: DataFrame) -> DataFrame:
    """``query, normalized, mention, work, kind``: names that a query is or holds.

    The citation form of the query is looked up beside the query itself.
    """
    forms = F.explode(F.array_distinct(F.array("normalized", tx.normalize_citation(F.col("normalized")))))
    values = plans.select("query", "normalized", forms.alias("value")).where("value <> ''")
    exact = values.join(names, F.col("value") == F.col("name")).select("query", "normalized", F.col("name").alias("mention"), "work", "kind")
    within = names.where(_containable(F.col("name"), F.col("kind")))
    held = retrieval.contained_names(values.select("query", "value"), within.select("name", "work").distinct(), "query", "value")
    contained = held.join(within, ["name", "work"]).join(plans.select("query", "normalized"), "query").select("query", "normalized", F.col("name").alias("mention"), "work", "kind")
    return exact.unionByName(contained).distinct()


def resolutions(plans: DataFrame, names: DataFrame) -> DataFrame:
    """``query, mention, status, works, candidates, kind``: what each mention of a query means.

    A mention that one work bears is resolved, one that several bear ambiguous; of these at
    most ``CANDIDATES`` are told, in order.  Mentions that stand behind an amending clause
    only are left out if the query also names a work outside one.  Identifiers that nothing
    bears are unresolved.
    """
    # used three times over: written once, and narrow
    hits = stored(identity_matches(plans, names).select("query", "mention", "work", "kind", tx.only_amended(F.col("normalized"), F.col("mention")).alias("amended")))
    place = F.row_number().over(Window.partitionBy("query", "mention").orderBy("work"))
    told = hits.select("query", "mention", "work").distinct().withColumn("place", place).where(F.col("place") <= CANDIDATES)
    told = told.groupBy("query", "mention").agg(F.array_sort(F.collect_list("work")).alias("candidates"))
    rank = F.when(F.col("kind") == "short_title", 0).when(F.col("kind") == "title", 1).otherwise(2)
    mentions = hits.groupBy("query", "mention").agg(F.countDistinct("work").alias("works"), F.min(F.struct(rank.alias("r"), "kind")).alias("k"), F.max("amended").alias("amended"))
    of_query = Window.partitionBy("query")
    kept = mentions.withColumn("outside", F.sum((~F.col("amended")).cast("int")).over(of_query)).where("not amended or outside = 0")
    status = F.when(F.col("works") == 1, "resolved").otherwise("ambiguous")
    found = kept.join(told, ["query", "mention"]).select("query", "mention", status.alias("status"), "works", "candidates", F.col("k.kind").alias("kind"))
    asked = plans.select("query", F.explode("identifiers").alias("identifier")).select("query", "identifier", tx.normalize(F.col("identifier")).alias("mention"))
    lacking = asked.join(hits.select("query", "mention").distinct(), ["query", "mention"], "left_anti")
    nothing = lacking.select("query", F.col("identifier").alias("mention"), F.lit("unresolved").alias("status"), F.lit(0).cast("long").alias("works"), F.array().cast("array<string>").alias("candidates"), F.lit(None).cast("string").alias("kind"))
    return found.unionByName(nothing)


def article_evidence(plans: DataFrame, resolved: DataFrame, docs: DataFrame, provisions: DataFrame, limit: int) -> DataFrame:
    """``query, group_key, language, anchor, text_sha, rid, rank``: articles of the number that a query names.

    Of works that the query resolves to; of each text of an anchor the latest version.
    ``provisions`` has rid, seq, anchor, ptype, num and text_sha.
    """
    asked = plans.where("article <> ''").join(resolved.where("status = 'resolved'").select("query", F.explode("candidates").alias("group_key")).distinct(), "query")
    number, anchor = F.replace("article", F.lit(" "), F.lit("")), F.replace("article", F.lit(" "), F.lit("_"))
    keys = F.array_union(
        F.transform(tx.ordinal_spellings(number), lambda x: F.concat(F.lit("num "), x)), F.transform(tx.ordinal_spellings(anchor), lambda x: F.concat(F.lit("anchor art_"), x))
    )
    wanted = asked.select("query", "group_key", F.explode(keys).alias("spelling"))
    own_number, own_anchor = tx.article_key(F.col("num")), F.lower(F.replace(F.replace("anchor", F.lit("."), F.lit("")), F.lit("-"), F.lit("_")))
    # an anchor that spells the number alone is asked for with it and never without
    alike = (own_anchor == F.concat(F.lit("art_"), own_number)) & ~F.contains(own_number, F.lit("_"))
    own = F.array(F.concat(F.lit("num "), own_number), F.when(alike, None).otherwise(F.concat(F.lit("anchor "), own_anchor)))
    rows = docs.where("not withdrawn").select("rid", "group_key", "language", "valid_from").join(provisions.where("ptype = 'article'"), "rid")
    rows = rows.withColumn("spelling", F.explode(F.array_compact(own)))
    hits = wanted.join(rows, ["group_key", "spelling"])
    latest = F.min(F.struct((-F.unix_date("valid_from")).alias("age"), "seq", "rid"))
    best = hits.groupBy("query", "group_key", "language", "anchor", "text_sha").agg(latest.alias("o"))
    order = Window.partitionBy("query").orderBy("o.age", "o.seq", "o.rid")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "group_key", "language", "anchor", "text_sha", F.col("o.rid").alias("rid"), "rank")


def work_states(docs: DataFrame) -> DataFrame:
    """``work, language`` and the searchable metadata of each live work."""
    joined = lambda *cs: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array(*cs)))))), " ")
    rows = docs.where("not withdrawn").groupBy(F.col("group_key").alias("work"), "language")
    return rows.agg(joined("group_identifier").alias("identifiers"), joined("title_short").alias("aliases"), joined("title").alias("titles"), joined("kind").alias("facets"))


def work_words(normalized: Column) -> Column:
    """The words of a query that search for works: of three letters or all digits, no stop words."""
    words = F.filter(F.split(normalized, " "), lambda w: ((F.length(w) >= 3) | w.rlike("^[0-9]+$")) & ~w.isin(*tx.STOP_WORDS))
    return F.slice(F.array_distinct(words), 1, WORK_WORDS)


def work_metadata_search(docs: DataFrame, plans: DataFrame, limit: int) -> DataFrame:
    """``query, work, language, score, rank``: works whose metadata hold any word of a query, weighted by field."""
    asked = plans.select("query", F.array_join(work_words(F.col("normalized")), " ").alias("words")).where("words <> ''")
    return retrieval.bm25(work_states(docs), asked, ["work", "language"], WORK_FIELDS, "query", "words", False, limit, once=True)


def staged(stages: list[DataFrame], key: list[str], limit: int) -> DataFrame:
    """``query, key, stage, place``: stages of evidence in order, a key found by several in its first; ranked by ``rank`` within."""
    rows = reduce(DataFrame.unionByName, [df.select("query", *key, "rank").withColumn("stage", F.lit(i)) for i, df in enumerate(stages)])
    first = rows.groupBy("query", *key).agg(F.min(F.struct("stage", "rank")).alias("b"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("b.stage", "b.rank", *key))
    return first.withColumn("place", place).where(F.col("place") <= limit).select("query", *key, F.col("b.stage").alias("stage"), "place")


def staged_search(docs: DataFrame, provisions: DataFrame, states: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """``query, group_key, language, anchor, text_sha, stage, place``: the stages of a keyword search.

    Articles that a query names come first, or else provisions with all words of what is
    left of it; then the works that it names, those that it may name, and works whose
    metadata hold its words.  Evidence of a query that names works is of these works only.
    ``states`` are the lexical states with their fields.
    """
    key = ["group_key", "language", "anchor", "text_sha"]
    # every stage builds on the versions and on what the queries mean: written once, which keeps the plans small
    docs = stored(docs.select("rid", "group_key", "group_identifier", "language", "valid_from", "withdrawn", "kind", "title", "title_short"))
    plans = stored(query_plans(queries))
    found = stored(resolutions(plans, stored(name_records(docs))))
    named = stored(found.where("status = 'resolved'").select("query", F.explode("candidates").alias("group_key")).distinct())
    articles = article_evidence(plans, found, docs, provisions, limit)
    left = plans.where("article = '' and residual <> ''").select("query", "residual")
    fields = {"work_title": 10.0, "num": 4.0, "heading": 6.0, "text": 1.0}
    worded = stored(retrieval.bm25(states, left, key, fields, "query", "residual", True, None, once=True))
    scoped = worded.join(named, ["query", "group_key"], "left_semi").unionByName(worded.join(named, "query", "left_anti").select(*worded.columns))
    keyword = scoped.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), *key))).where(F.col("rank") <= limit)
    blank = lambda df: df.withColumns({"anchor": F.lit(""), "text_sha": F.lit("")})
    languages = docs.where("not withdrawn").select("group_key", "language").distinct()
    by_name = Window.partitionBy("query").orderBy("group_key", "language")
    works = blank(named.join(languages, "group_key")).withColumn("rank", F.row_number().over(by_name))
    unsure = found.where("status = 'ambiguous'").select("query", F.explode("candidates").alias("group_key")).distinct()
    maybe = blank(unsure.join(languages, "group_key")).withColumn("rank", F.row_number().over(by_name))
    unnamed = stored(plans.join(named, "query", "left_anti").select("query", "normalized"))
    weak = blank(work_metadata_search(docs, unnamed, limit).withColumnRenamed("work", "group_key"))
    return staged([articles, keyword, works, maybe, weak], key, limit)


def short_titles_on(docs: DataFrame, on: Column) -> DataFrame:
    """``group_key, language, segment, valid_from``: short titles in effect on a day, the latest start of each."""
    rows = docs.where("title_short is not null").where((F.col("valid_from") <= on) & (F.col("valid_to").isNull() | (F.col("valid_to") >= on)))
    rows = rows.select("group_key", "language", "valid_from", F.explode(tx.short_titles(F.col("title_short"))).alias("segment"))
    return rows.groupBy("group_key", "language", "segment").agg(F.max("valid_from").alias("valid_from"))


def taxonomy_matches(metadata: DataFrame, plans: DataFrame, on: Column, limit: int) -> DataFrame:
    """``query, work, identifier, matched, rank``: subjects of works that share words with a query.

    ``metadata`` has work, identifier, value, valid_from and valid_to; subjects in effect on
    the day count.  Words and subjects meet by an equi-join on words; a subject that is the
    whole query comes first, then those of most shared words.
    """
    asked = plans.select("query", "normalized", F.explode(work_words(F.col("normalized"))).alias("word"))
    held = metadata.where((F.col("valid_from") <= on) & (F.col("valid_to").isNull() | (F.col("valid_to") >= on)))
    labels = held.select("work", "identifier", tx.normalize(F.col("value")).alias("label")).where("label <> ''").distinct()
    words = labels.select("identifier", "label").distinct().select("identifier", "label", F.explode(F.array_distinct(F.split("label", " "))).alias("word"))
    hits = asked.join(words, "word").groupBy("query", "normalized", "identifier", "label").agg(F.count(F.lit(1)).alias("matched"))
    # subjects are cut before they meet their works
    whole = (F.col("label") != F.col("normalized")).cast("int")
    top = hits.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(whole, F.col("matched").desc(), "identifier"))).where(F.col("i") <= limit)
    rows = top.join(labels, ["identifier", "label"])
    order = Window.partitionBy("query").orderBy("i", "work")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query", "work", "identifier", "matched", "rank")


def shaped(hits: DataFrame, query: str, work: str, anchor: str, limit: int, scoped: bool = False) -> DataFrame:
    """Ranked hits with each anchor of a work once and no more than two of a work, unless works were asked for."""
    first = Window.partitionBy(query, work, anchor).orderBy("rank")
    rows = hits.withColumn("again", F.row_number().over(first)).where("again = 1").drop("again")
    return retrieval.capped(rows, query, work, limit + 1 if scoped else 2, limit)


def grouped(hits: DataFrame, query: str, outer: str, inner: str) -> DataFrame:
    """Hits with the place of their group and of the work in it, both in the order of their first hits."""
    rows = hits.withColumns({"_o": F.min("rank").over(Window.partitionBy(query, outer)), "_i": F.min("rank").over(Window.partitionBy(query, outer, inner))})
    of = lambda *order: F.dense_rank().over(Window.partitionBy(query).orderBy(*order))
    return rows.withColumns({"group_place": of("_o"), "work_place": of("_o", "_i")}).drop("_o", "_i")
