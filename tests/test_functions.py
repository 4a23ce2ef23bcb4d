"""Column functions, retrieval on a small index, operations, sources and streams."""

from __future__ import annotations

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import retrieval, search, vectors
from palimpsest.plans import operations as ops


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (tx.normalize, "Règlement (UE) n° 5", "reglement ue n 5"),
        (tx.normalize, "C R R", "crr"),
        (tx.normalize, None, None),
        (lambda c: tx.normalize_citation(tx.normalize(c)), "Loi modifiée du 5 avril", "loi du 5 avril"),
        (tx.article_number, "see article 42 ter of", "42 ter"),
        (tx.article_number, "particle 5", ""),
        (tx.ordinal_spellings, "1er", ["1er", "1"]),
        (tx.ordinal_spellings, "1", ["1", "1er", "1re"]),
        (tx.ordinal_spellings, "42ter", ["42ter"]),
        (tx.exact_identifiers, "x 32016r0679 CELEX 32016R0679 ECLI:EU:C:2020:559", ["32016r0679", "ECLI:EU:C:2020:559"]),
        (tx.short_titles, "b, a , b", ["a", "b"]),
        (tx.role_of, "implementing regulation 5", "implementing"),
        (tx.without_conversation, "what about the stamp duty", "stamp duty"),
        (tx.responsibilities_of, "find provisions that describe the responsibilities of the keeper", "keeper"),
        (tx.version_coordinate, "a:b:c", "c"),
        (tx.canonical_work, "eu:32016R0679", "32016r0679"),
        (tx.slug, "Été 2020!", "ete-2020"),
        (tx.follows_amending_clause, "la loi modifiant la", True),
        (tx.follows_amending_clause, "modifiant la loi du 5", False),
        (tx.cites_by_date, "the Act of 5 April 1993", True),
        (tx.facet_label, "rural_leases", "Rural Leases"),
    ],
)
def test_text_functions(spark, f, value, want):
    assert one(spark, value, f) == want


def test_iso_date_is_strict(spark):
    assert one(spark, "2020-02-30", lambda c: tx.iso_date(c).cast("string")) is None
    assert one(spark, "2020-02-29", lambda c: tx.iso_date(c).cast("string")) == "2020-02-29"


def test_snippet(spark):
    text = "word " * 100 + "Règlement here " + "tail " * 100
    for form in ("NFC", "NFD"):
        s = one(spark, unicodedata.normalize(form, text), lambda c: tx.snippet(c, F.lit("RÈGLE zz")))
        assert s.startswith("... word") and s.endswith("tail ...") and "Règlement" in unicodedata.normalize("NFC", s) and 246 <= len(s) <= 260
    assert one(spark, "short  text", lambda c: tx.snippet(c, F.lit("zzz"))) == "short text"
    assert one(spark, " \u00a0", lambda c: tx.snippet(c, F.lit("zzz"))) is None


def test_bm25_prefers_rare_terms_and_asks_for_all(spark):
    docs = spark.createDataFrame([(1, "stamp duty act"), (2, "stamp stamp"), (3, "other"), (4, None), (5, "other words"), (6, "more"), (7, "and more")], "id int, text string")
    asked = spark.createDataFrame([(0, "stamp duty")], "q int, query string")
    rows = retrieval.bm25(docs, asked, ["id"], {"text": 1.0}, "q", "query", False, 5).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [1, 2]
    assert [r["id"] for r in retrieval.bm25(docs, asked, ["id"], {"text": 1.0}, "q", "query", True, 5).collect()] == [1]


def test_fuzzy_terms(spark):
    asked = spark.createDataFrame([(0, "lizense stamp 12345 abc")], "q int, query string")
    vocabulary = spark.createDataFrame([("license",), ("licence",), ("stamps",), ("stump",), ("stamp",), ("xtamp",)], "term string")
    rows = retrieval.fuzzy_terms(asked, vocabulary, "q", "query")
    assert sorted((r["word"], r["term"]) for r in rows.collect()) == [("lizense", "license"), ("stamp", "stamps"), ("stamp", "stump")]


def test_contained_names(spark):
    texts = spark.createDataFrame([(1, "See the Act of 1993 on X, and more"), (2, "Act of 19"), (3, None), (4, "gdpr1")], "id int, text string")
    names = spark.createDataFrame([("act of 1993", "w1"), ("gdpr1", "w2")], "name string, work string")
    assert sorted(map(tuple, retrieval.contained_names(texts, names, "id", "text").select("id", "work").collect())) == [(1, "w1"), (4, "w2")]


def test_fusion_caps_and_shares(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int")
    b = spark.createDataFrame([("y", 1)], "k string, rank int")
    fused = retrieval.fuse([(a, 1.0), (b, 1.0)], ["k"]).orderBy(F.col("score").desc()).collect()
    assert [r["k"] for r in fused] == ["y", "x"]
    hits = spark.createDataFrame([(0, "w", i) for i in range(1, 5)] + [(0, "v", 5)], "q int, work string, rank int")
    assert [r["rank"] for r in retrieval.capped(hits, "q", "work", 2, 3).orderBy("place").collect()] == [1, 2, 5]
    assert retrieval.fair_shares({"a": 9, "b": 1, "c": 9}, 7) == {"a": 3, "b": 1, "c": 3}
    assert retrieval.fair_shares({"a": 1, "b": 9}, 10) == {"a": 1, "b": 9} and retrieval.fair_shares({}, 3) == {}
    shared = spark.createDataFrame([(0, p, i) for p, n in (("a", 9), ("b", 1), ("c", 9)) for i in range(n)], "q int, p string, rank int")
    assert retrieval.fair_places(shared, "q", "p", 7).groupBy("p").count().orderBy("p").collect() == [("a", 3), ("b", 1), ("c", 3)]
    staged = search.staged([df.withColumn("query", F.lit("q")) for df in (b, a)], ["k"], 10)
    assert sorted(map(tuple, staged.select("k", "stage", "place").collect())) == [("x", 1, 2), ("y", 0, 1)]


def test_metrics(spark):
    ranked = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "q int, k string, rank int")
    gold = spark.createDataFrame([(0, "b"), (1, "z")], "q int, k string")
    rows = {r["q"]: r for r in retrieval.metrics(ranked, gold, "q", "k").collect()}
    assert rows[0]["reciprocal_rank"] == 0.5 and rows[0]["recall"] == 1.0 and rows[0]["ndcg"] == pytest.approx(0.63093, abs=1e-5)
    assert rows[1]["reciprocal_rank"] == 0


def test_vector_ladder(spark):
    rec = lambda bits, v: bytes(bits) + bytes(x % 256 for x in v)
    q = rec([0] * 8, [100] + [0] * 63)
    rows = [("p", "a", q), ("p", "b", rec([255] + [0] * 7, [-100] + [0] * 63)), ("p", "c", rec([1] + [0] * 7, [120] + [0] * 63))]
    df = spark.createDataFrame(rows, "profile string, chunk_sha string, record binary")
    out = vectors.ladder(df, q, 3).collect()
    assert [(r["chunk_sha"], r["distance"], r["dot"]) for r in out] == [("c", 1, 12000), ("a", 0, 10000), ("b", 8, -10000)]


def test_validation():
    assert ops.validate("timeline", {"work": "w"})["limit"] == 100
    for name, arguments in (("timeline", {}), ("timeline", {"work": "w", "x": 1}), ("as_of", {"work": "w", "date": "2020-02-30"}), ("diff", {"work": "w", "from_date": "2021-01-01", "to_date": "2020-01-01"}), ("search", {"query": "q", "limit": 51}), ("as_of", {"work": "w", "date": "2020-01-01", "mode": "select"})):
        with pytest.raises(ops.ArgumentError):
            ops.validate(name, arguments)
    assert ops.nearest_anchors(["art_1er"], ["art_1", "anx_1", "art_2"]) == ["art_1"]
    assert ops.nearest_anchors(["article_07"], ["art_7", "art_70", "anx_7"]) == ["art_7"]
    assert ops.nearest_anchors(["art_9"], [*(f"art_{i}" for i in range(20, 40)), "anx_9"]) == [f"art_{i}" for i in range(20, 26)]
    assert ops.nearest_anchors(["sched_2"], ["art_2", "anx_1"]) == ["art_2"]


def test_operations(spark):
    from palimpsest.model import Corpus

    run = ops.Operations(Corpus(spark, "/root/testdata/sf0.001"))
    state = run.corpus.live.where("text_public").orderBy("group_key", "valid_from").first()
    work, day = state["group_key"], state["valid_from"].isoformat()
    assert run.call("timeline", work=work).status == "ok"
    assert run.call("timeline", work="none").status == "unknown_work"
    assert run.call("as_of", work=work, date=day).status in ("ok", "ambiguous_version", "text_withheld", "text_not_available")
    assert run.call("as_of", work=work, date="1800-01-01").status == "no_version_for_date"
    assert run.call("in_force_on", date=day).status == "ok"
    assert run.call("coverage", publisher=state["collection"].upper()).status == "ok"
    assert run.call("coverage", publisher="nobody").status == "unknown_publisher"
    assert run.call("changes_in_period", **{"from": "1700-01-01", "to": "1700-12-31"}).status == "no_changes_in_period"
    assert run.call("changes_in_period", **{"from": "1990-01-01", "to": "2020-12-31"}).rows.count() == 20
    anchor = run.corpus.provisions().where(F.col("rid") == state["rid"]).first()
    if anchor is not None:
        assert run.call("article_history", work=work, anchor=anchor["anchor"]).status == "ok"
    assert run.call("article_history", work=work, anchor="nowhere").status in ("unknown_anchor", "no_provision_history")
    assert run.call("provenance", lex_id="x").status == "no_result"
    cited = run.corpus.citations.where("cited_slug is not null").first()["cited_slug"]
    assert run.call("cited_by", work=cited).status == "ok"
    assert run.call("search", query=state["title"] or "act", fuzzy=False).status in ("ok", "no_result")
    assert run.call("diff", work=work, from_date=day, to_date=day).status in ("ok", "ambiguous_version", "text_not_available")


def test_paged_source(spark, tmp_path):
    from palimpsest.sources import paged

    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps({"a": i, "b": None}) + "\n" for i in range(7)))
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").option("fields", "a,b").option("total", 7).option("pageSize", 3).option("path", str(path)).load()
    assert sorted(map(tuple, df.collect())) == [(str(i), None) for i in range(7)]
    with pytest.raises(ValueError, match="more than"):
        paged.pages(10_001, 500)


def test_derived_json_and_staged_write(spark, tmp_path):
    import hashlib

    from palimpsest.sources import files

    sha = hashlib.sha256(b"text").hexdigest()
    body = {"lex_id": "k", "language": "fr", "valid_from": "2020-01-01", "provisions": [{"anchor": "e", "text_md": ""}, {"anchor": "a", "text_md": "text", "text_sha256": sha, "path": ["P", "Q"], "citations": [{"href": "/eli/a/b/c", "text": "t"}]}]}
    (tmp_path / "fr.json").write_text(json.dumps(body))
    rows = files.derived_provisions(files.read_derived(spark, str(tmp_path / "fr.json")))
    assert [(r["seq"], r["anchor"], r["path"], r["sha_ok"]) for r in rows.collect()] == [(0, "a", "P / Q", True)]
    assert files.derived_citations(rows).first()["href"] == "/eli/a/b/c"
    out = str(tmp_path / "table")
    files.staged_write(spark.range(3), out)
    files.staged_write(spark.range(5), out)
    assert files.read_current(spark, out).count() == 5 and files.drop_stale(spark, out) == 1
    assert files.read_current(spark, out).count() == 5 and files.drop_stale(spark, out) == 0
    with pytest.raises(Exception):  # noqa: B017 - a table that cannot be written leaves the old one
        files.staged_write(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), out)
    assert files.read_current(spark, out).count() == 5


def test_meta_records(spark, tmp_path):
    from palimpsest.sources import files

    for n, events in (("a", []), ("b", [{"event": "withdrawn", "at": "2020"}]), ("c", [{"event": "withdrawn", "at": "2020"}, {"event": "resighted", "at": "2021"}])):
        folder = tmp_path / "works" / "w" / "versions" / n
        folder.mkdir(parents=True)
        (folder / "meta.json").write_text(json.dumps({"lex_id": n, "work": "w", "events": events, "expressions": [{"language": "fr", "valid_from": "2020-01-01"}, {"language": "de"}]}))
    rows = files.meta_expressions(files.read_meta(spark, str(tmp_path)))
    assert sorted((r["lex_id"], r["language"], r["withdrawn"]) for r in rows.collect()) == [(n, x, n == "b") for n in "abc" for x in ("de", "fr")]


def test_index_is_opened_only_if_whole(spark, tmp_path):
    from palimpsest.model import Corpus
    from palimpsest.sources import files, index

    corpus, path = Corpus(spark, "/root/testdata/sf0.001"), str(tmp_path / "index")
    index.write_index(corpus, path)
    tables = index.open_index(spark, path)
    assert set(tables) == set(index.TABLES) and tables["docs"].count() == corpus.docs.count()
    manifest = {r["table"]: r["folder"] for r in files.read_current(spark, f"{path}/manifest").collect()}
    spark.read.parquet(manifest["docs"]).limit(1).write.mode("append").parquet(manifest["docs"])
    with pytest.raises(ValueError, match="docs is not what was written"):
        index.open_index(spark, path)
    index.write_catalog(corpus, str(tmp_path / "catalog"))
    assert files.read_current(spark, str(tmp_path / "catalog" / "works")).count() > 0
    index.write_derived(corpus, str(tmp_path / "derived"))
    back = files.derived_provisions(spark.read.schema(files.DERIVED).json(str(tmp_path / "derived" / "json")))
    assert back.count() > 0 and back.where("not sha_ok").count() == 0
    files.export_dataset(corpus.raw("provisions").where("rid is not null"), str(tmp_path / "export"))
    assert spark.read.json(str(tmp_path / "export")).count() == corpus.raw("provisions").where("rid is not null").count()


def test_whole_listings_leave_tombstones(spark, tmp_path):
    from palimpsest.streaming import incremental

    step = incremental.apply_observations(str(tmp_path / "log"), ["title"], whole=True)
    schema = "rid string, observed_from timestamp, withdrawn boolean, valid_to date, title string"
    at = lambda d: __import__("datetime").datetime(2024, 1, d)
    step(spark.createDataFrame([("a", at(1), False, None, "x"), ("b", at(1), False, None, "y"), (None, at(1), False, None, "z")], schema), 0)
    for _ in range(2):
        step(spark.createDataFrame([("a", at(2), False, None, "x"), ("c", at(2), False, None, "w")], schema), 1)
    step(spark.createDataFrame([("a", at(3), False, None, "x2"), ("b", at(3), False, None, "y"), ("c", at(3), False, None, "w")], schema), 2)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert sorted((r["rid"], r["observed_from"].day, r["withdrawn"]) for r in log.collect()) == [("a", 1, False), ("a", 3, False), ("b", 1, False), ("b", 2, True), ("b", 3, False), ("c", 2, False)]


def test_stream_equals_batch_and_replay(spark, tmp_path):
    from palimpsest.streaming import incremental

    d = "/root/testdata/sf0.001"
    batch = incremental.windowed_counts(spark.read.parquet(f"{d}/events.parquet"))
    stream = incremental.run_available(incremental.windowed_counts(incremental.read_stream(spark, d, "events")), spark)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))
    step = incremental.apply_observations(str(tmp_path / "log"), ["valid_to", "title"])
    rows = spark.read.parquet(f"{d}/docs.parquet")
    for n in (0, 1, 1):
        step(rows, n)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == rows.select("rid").distinct().count()


def test_rules():
    from palimpsest.operators.extraction import gazette_window
    from palimpsest.plans import rules

    assert rules.greedy_budget([5, 9, 4, 1], 10) == [True, False, True, True]
    assert all(rules.gates({"exact": 1, "no_hit": 1, "resolution": 1, "role": 1, "leaks": 0, "ndcg": 0.6}, 0.6, (0.5, 0.4), 200, 0.5).values())
    assert not rules.gates({}, 0.6, (0.4, 0.4), 300, 0.8)["latency"]
    assert rules.stamp_text({"b": "2", "a": "1"}) == "a=1\nb=2" and len(rules.stamp_hash({})) == 64
    assert rules.equivalent_fraction({"a", "b"}, {"b"}) == 1.0 and rules.equivalent_fraction(set(), {"b"}) == 0.0
    issue = "Sommaire: Loi du 1er août 2001\nArt. 7 x\nLOI  du 1er AOUT 2001 portant\nArticle 1 A\nArt. 2 B\nRèglement du 3 mai 2002\nArt. 1 C"
    assert gazette_window(issue, "Loi", "2001-08-01") == "LOI  du 1er AOUT 2001 portant\nArticle 1 A\nArt. 2 B\n"
    assert gazette_window(issue, "Loi", "1999-01-02") is None


def test_whole_library_without_llm():
    """Nothing outside the subpackage imports it."""
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "palimpsest"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "palimpsest.llm" not in path.read_text(), path


def test_library_works_where_llm_is_deleted(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "palimpsest", tmp_path / "palimpsest", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'p1_found' in q, 'p3_found' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    n, core, llm, sql = out.stdout.split()
    assert int(n) > 100 and (core, llm, sql) == ("True", "False", "True")


def test_recorded_adapter(spark, tmp_path):
    from palimpsest.sources import adapter

    (tmp_path / "w1").mkdir()
    (tmp_path / "works.json").write_text('["w1", "w2"]')
    (tmp_path / "w1" / "versions.json").write_text(json.dumps([{"version": "v1", "valid_from": "2020-01-01", "language": "fr", "title": "t", "body": "w1/a.xml"}, {"version": "v2", "valid_from": "2021-01-01", "body": "w1/none.xml"}, {"version": "v3", "body": "w1/empty.xml"}, {"version": "v4"}]))
    (tmp_path / "w1" / "a.xml").write_bytes(b"<a/>")
    (tmp_path / "w1" / "empty.xml").write_bytes(b"")
    source = adapter.Recorded(str(tmp_path))
    rows = adapter.acquired(adapter.enumerate_versions(spark, source, 2), source).orderBy("version").collect()
    assert [(r["version"], r["outcome"]) for r in rows] == [("v1", "ok"), ("v2", "failed: FileNotFoundError"), ("v3", "empty"), ("v4", "no body")]
    assert bytes(rows[0]["content"]) == b"<a/>" and rows[0]["valid_from"].isoformat() == "2020-01-01" and source.alternatives("w1", "v1") == []
    bindings = spark.createDataFrame([("w", "c1", "2020-01-01", "fr", "t", "LOI"), ("w", "c1", "2020-01-01", "de", "u", "LOI"), ("w", "c1", "2020-01-01", "en", "x", "ACT"), ("w", "c2", "2021-05-01", "fr", "t2", None), ("w", "c3", None, "fr", "t", None)], "work string, consolidation string, date string, language string, title string, kind string")
    out = adapter.consolidations(bindings.withColumn("date", F.col("date").cast("date"))).orderBy("consolidation").collect()
    assert [(r["consolidation"], str(r["valid_to"]), r["kind"], len(r["titles"])) for r in out] == [("c1", "2021-04-30", "LOI", 3), ("c2", "None", None, 1)]


def test_paged_source_counts_and_types(spark, tmp_path):
    from palimpsest.sources import paged

    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps({"a": i, "b": f"x{i}"}) + "\n" for i in range(7)))
    spark.dataSource.register(paged.PagedSource)
    rows = spark.read.format("paged").option("columns", "a long, b string").option("pageSize", "3").load(str(path))
    assert rows.schema["a"].dataType.simpleString() == "bigint" and rows.rdd.getNumPartitions() == 3 and rows.agg(F.sum("a")).first()[0] == 21


def test_encoding_of_what_a_cache_lacks(spark):
    import numpy as np

    def encoder(texts):
        return [[len(t) - 12, 1.0, -2.0, 0.5, t.count("a"), -1.0, 3.0, 0.0] for t in texts]

    chunks = spark.createDataFrame([("s1", "aa", 4), ("s1", "aa", 4), ("s2", "b", 600), ("s3", "c", None), (None, "d", 1), ("s4", None, 1)], "chunk_sha string, text string, token_count int")
    cache = spark.createDataFrame([("p", "s2", bytearray(b"x")), ("q", "s1", bytearray(b"x")), ("p", "s3", None)], "profile string, chunk_sha string, record binary")
    rows = vectors.encode_missing(chunks, cache, "p", encoder).orderBy("chunk_sha").collect()
    assert [r["chunk_sha"] for r in rows] == ["s1", "s3"] and all(len(r["record"]) == 9 for r in rows)
    assert [len(b) for b in vectors.batches_of(np.array([3] * 70 + [500] * 20))] == [64, 6, 16, 4]


def test_search_refuses_another_role(spark):
    from palimpsest.model import Corpus

    run = ops.Operations(Corpus(spark, "/root/testdata/sf0.001"))
    assert run.call("search", query="the delegated act on fees", document_role="implementing").status == "no_result"
    assert run.call("search", query="fees", retrieval_mode="hybrid").status == "retrieval_mode_unavailable"
    with pytest.raises(ops.ArgumentError):
        run.call("search", query="fees", time_scope="as_of")
