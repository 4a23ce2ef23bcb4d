"""Queries over the whole of their tables: nothing left out, nothing given up."""

from __future__ import annotations

import hashlib
import random
from types import SimpleNamespace

import numpy as np

from palimpsest import queries_history, queries_retrieval, queries_temporal
from palimpsest.operators import citations, diff, retrieval, search, vectors
from tests.test_core import doc, docs, got


def cache_row(profile, name, v):
    record = np.packbits(v >= 0, bitorder="little").tobytes() + v.astype(np.int8).tobytes()
    return profile, name, record, hashlib.sha256(record).hexdigest()


def test_edges_follow_the_href(spark):
    held = docs(spark, doc("loi-1", "2020-01-01"), doc("loi-2", "2020-01-01"), doc("loi-3", "2020-01-01", withdrawn=True))
    one, two, gone = (r["rid"] for r in held.orderBy("group_key").collect())
    rows = [
        (1, one, "a", None, "/eli/x/y/loi/2/jo#art_1"),  # no slug
        (2, one, "b", "loi-9", "HTTPS://H/ELI/X/Y/LOI/2?l=fr"),  # another slug
        (3, one, "c", None, " TP:loi-2:2020-01-01--0#art_2"),  # named by collection
        (4, one, "d", "LOI-5", "zz:loi-2"),  # no collection: the slug as stored
        (5, one, "e", None, "mailto:a@b"), (6, one, "f", None, None), (7, gone, "g", None, "/eli/x/y/loi/2"),
        (8, two, "h", None, "tp:loi-1"), (9, two, "i", None, "/eli/x/y/loi/2/consolide/20200101"),
    ]
    cites = spark.createDataFrame(rows, "citation_id long, rid string, anchor string, cited_slug string, href string")
    provisions = spark.createDataFrame([(one, "a", "1")], "rid string, anchor string, num string")
    out = citations.cited_by(cites, held, provisions)
    want = [("loi-1", "loi-2", "h", None), ("loi-2", "loi-1", "a", "1"), ("loi-2", "loi-1", "b", None), ("loi-2", "loi-1", "c", None), ("loi-2", "loi-2", "i", None), ("loi-5", "loi-1", "d", None)]
    assert got(out, "cited_slug", "group_key", "anchor", "num") == want
    assert [tuple(r) for r in citations.most_cited(cites, held, 2).collect()] == [("loi-2", 2), ("loi-1", 1)]


def test_as_of_work_answers_for_every_work(spark):
    held = docs(spark, doc("w1", "2016-01-01"), doc("w2", "2010-01-01"), doc("w2", "2011-01-01", n=1), doc("w2", "2011-01-01", language="fr", n=1), doc("w3", "2012-01-01"), doc("w4", "2012-01-01", withdrawn=True))
    out = queries_temporal.as_of_work(SimpleNamespace(docs=held, live=held.where("not withdrawn")))
    assert got(out, "group_key", "valid_from", "containing") == [("w2", "2011-01-01", 2), ("w3", "2012-01-01", 1)]



def test_long_diffs_are_as_exact_as_short_ones(monkeypatch):
    words = [f"w{i}" for i in range(3100)]
    kinds = [k for k, _ in diff.word_diff(" ".join(["a", *words, "z"]), " ".join(["b", *words[:1500], "new", *words[1501:], "y"]))]
    assert (kinds.count("="), kinds.count("-"), kinds.count("+")) == (3099, 3, 3)
    assert {k for k, _ in diff.word_diff("x " + "L’A " * 2500 + "x", "y " + "l'a " * 2500 + "y")} == {"=", "-", "+"}
    rng = random.Random(12)
    pairs = [[[rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2)] for _ in range(200)]
    exact = [len(diff.common(a, b)) for a, b in pairs]
    monkeypatch.setattr(diff, "CELLS", 9)
    for (a, b), n in zip(pairs, exact):
        found = diff.common(a, b)
        assert len(found) == n and all(a[i] == b[j] for i, j in found) and all(x < y and u < w for (x, u), (y, w) in zip(found, found[1:]))


def test_vector_queries_ask_all_profiles_with_every_twentieth(spark, monkeypatch):
    rng = np.random.default_rng(13)
    held = {}
    for profile, n in (("p", 250), ("q", 120)):
        base = rng.normal(size=64)
        v = base + 0.8 * rng.normal(size=(n, 64))
        held[profile] = {hashlib.sha256(f"{i}".encode()).hexdigest(): x for i, x in enumerate(np.round(127 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int8))}
    cache = spark.createDataFrame([cache_row(p, n, x) for p, own in held.items() for n, x in own.items()], "profile string, chunk_sha string, record binary, record_sha string")
    chunks = spark.createDataFrame([(n, 5) for n in list(held["p"])[100:140]] + [("none", 7)], "chunk_sha string, token_count int")
    corpus = SimpleNamespace(raw=lambda name: {"embedding_cache": cache, "semantic_chunks": chunks}[name])
    top, near, scan = [], [], []
    for p, own in held.items():
        for a in (x for x in own if int(x[:15], 16) % 20 == 0):
            far = {n: int(((own[a] >= 0) != (x >= 0)).sum()) for n, x in own.items()}
            dot = {n: int(own[a].astype(int) @ x.astype(int)) for n, x in own.items()}
            order = sorted(own, key=lambda n: (far[n], n))
            top += [(p, a, n, far[n]) for n in order[:100]]
            near += [(p, a, n, far[n], dot[n]) for n in sorted(order[:500], key=lambda n: (-dot[n], n))[:50]]
            scan += [(p, a, n, dot[n]) for n in own if dot[n] >= 8000]
    for rows, queries in ((100_000, 500), (60, 3)):  # in one block, and in several
        monkeypatch.setattr(vectors, "ROWS", rows)
        monkeypatch.setattr(vectors, "QUERIES", queries)
        assert got(queries_retrieval.hamming_topk(corpus)) == sorted(top)
        assert got(queries_retrieval.int8_rerank(corpus), "profile", "asked", "chunk_sha", "distance", "dot") == sorted(near)
        assert got(queries_retrieval.similarity_scan(corpus)) == sorted(scan)
    fused = got(queries_retrieval.rrf_hybrid(corpus), "profile", "asked", "chunk_sha")
    assert {x[:2] for x in fused} == {x[:2] for x in top} and {x[:3] for x in near} <= set(fused) and all((p, a, "none") in fused for p, a in {x[:2] for x in top})
    misses = got(queries_history.embedding_cache_misses(corpus))
    assert misses == sorted([("p", "none"), ("q", "none"), *(("q", n) for n in list(held["p"])[120:140])])


def most_rows(df):
    """The most rows that a step of a plan gave; the plan is run."""
    df.collect()

    def own(node):
        inner = [getattr(node, f)() for f, kind in (("executedPlan", "AdaptiveSparkPlanExec"), ("plan", "QueryStageExec")) if kind in node.getClass().getSimpleName()]
        below = node.children()
        rows = node.metrics().get("numOutputRows")
        return max([rows.get().value() if rows.isDefined() else 0, *map(own, inner), *(own(below.apply(i)) for i in range(below.size()))])

    return own(df._jdf.queryExecution().executedPlan())


def test_questions_are_not_paired_with_all_works_that_share_a_word(spark, monkeypatch):
    held = docs(spark, *(doc(f"w{i:02}", "2020-01-01", language=lang, title=f"loi relative port{i % 7} ville{i}", title_short=None) for i in range(60) for lang in ("en", "fr")))
    asked = spark.createDataFrame([(f"q{i:02}", f"loi relative port{i % 9} ville{i % 5} nothing") for i in range(80)], "query string, normalized string")
    words = asked.select("query", "normalized")
    want = got(retrieval.bm25(search.work_states(held), words, ["work", "language"], search.WORK_FIELDS, "query", "normalized", False, 10))
    assert len(want) == 800 and len({x[3] for x in want if x[0] == "q00"}) < 10  # with ties
    found = search.work_metadata_search(held, asked, 10)
    # 80 times 120 pairs share a word
    assert got(found) == want and most_rows(found) < 2_000
    for queries, states in ((80, 50), (9, 1_000), (7, 11)):
        monkeypatch.setattr(retrieval, "QUERIES", queries)
        monkeypatch.setattr(retrieval, "STATES", states)
        assert got(search.work_metadata_search(held, asked, 10)) == want
    assert got(search.work_metadata_search(held, asked.where("query = ''"), 10)) == got(search.work_metadata_search(held.where("withdrawn"), asked, 10)) == []


def test_texts_are_not_paired_with_all_names_that_begin_alike(spark):
    names = spark.createDataFrame([(f"loi du {i} mars", f"w{i}") for i in range(100)] + [("loi du", "short"), ("loi du 3", "more"), ("loi", "one")], "name string, work string")
    texts = spark.createDataFrame([(i, f"voir la Loi du {i} mars, ou loi du {i}") for i in range(100)], "id int, text string")
    found = retrieval.contained_names(texts, names, "id", "text")
    want = [(i, f"w{i}", f"loi du {i} mars") for i in range(100)] + [(i, w, n) for i in range(100) for w, n in (("short", "loi du"), ("one", "loi"))] + [(3, "more", "loi du 3")]
    assert got(found) == sorted(want, key=repr)
    # compared only where whole names are equal, never name by name
    assert "StartsWith" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_articles_whose_anchor_repeats_the_number(spark):
    held = docs(spark, doc("w1", "2020-01-01"))
    rid = held.first()["rid"]
    rows = [(rid, 1, "art_1er", "article", "1er", "a"), (rid, 2, "art_2", "article", None, "b"), (rid, 3, "art_12_bis", "article", "12bis", "c"), (rid, 4, "art_12bis", "article", "12 bis", "d"), (rid, 5, "x", "article", "2", "e"), (rid, 6, "art_12_bis", "article", "12_bis", "f")]
    provisions = spark.createDataFrame(rows + rows[:2], "rid string, seq int, anchor string, ptype string, num string, text_sha string")
    plans = spark.createDataFrame([(q, a) for q, a in (("q1", "1"), ("q2", "2"), ("q3", "12 bis"))], "query string, article string")
    resolved = plans.selectExpr("query", "'resolved' status", "array('w1') candidates")
    out = search.article_evidence(plans, resolved, held, provisions, 10)
    assert got(out, "query", "text_sha", "rank") == [("q1", "a", 1), ("q2", "b", 1), ("q2", "e", 2), ("q3", "c", 1), ("q3", "d", 2), ("q3", "f", 3)]
