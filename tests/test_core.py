"""Operators on small tables with known answers."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from palimpsest.operators import diff, extraction, history, intervals, orphans, rollups, scd, snapshots, temporal

D = dt.date.fromisoformat
T = dt.datetime.fromisoformat
DOCS = "rid string, key string, collection string, group_key string, group_identifier string, kind string, language string, valid_from date, valid_to date, observed_from timestamp, withdrawn boolean, text_available boolean, text_public boolean, title string, title_short string, record_sha string"


def doc(work, start, end=None, language="en", seen="2024-01-01", withdrawn=False, kind="REG", n=0, collection="tp", **more):
    key = f"{collection}:{work}:{start}--{n:064x}"
    row = {"rid": f"{key}|{language}|{start}", "key": key, "collection": collection, "group_key": work, "group_identifier": f"urn:{work}", "kind": kind, "language": language,
           "valid_from": D(start), "valid_to": D(end) if end else None, "observed_from": T(seen), "withdrawn": withdrawn, "text_available": True, "text_public": True, "title": f"{work} thing", "title_short": None, "record_sha": "a"} | more
    return tuple(row[c.split()[0]] for c in DOCS.split(", "))


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), DOCS)


def got(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# ---- intervals


def brute_spans(rows):
    out = {}
    for e, a, b in rows:
        out.setdefault(e, set()).update(range(a.toordinal(), b.toordinal() + 1))
    spans = set()
    for e, days in out.items():
        days = sorted(days)
        start = days[0]
        for x, y in zip(days, days[1:] + [None]):
            if y is None or y != x + 1:
                spans.add((e, "period", dt.date.fromordinal(start), dt.date.fromordinal(x)))
                if y is not None:
                    spans.add((e, "gap", dt.date.fromordinal(x + 1), dt.date.fromordinal(y - 1)))
                    start = y
    return spans


def test_spans_equal_day_by_day_cover(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        a = dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(400))
        rows.append((rng.choice("abc"), a, a + dt.timedelta(rng.randrange(0, 9))))
    df = spark.createDataFrame(rows, "e string, valid_from date, valid_to date")
    assert set(got(intervals.merged_spans(df, ["e"]))) == brute_spans(rows)


def test_spans_of_dirty_rows(spark):
    rows = [("a", D("2020-01-01"), None, 1), ("a", D("2019-01-01"), D("2019-12-31"), 2), (None, D("2020-01-05"), D("2020-01-05"), 3), ("b", None, D("2020-01-01"), 4), ("b", D("2020-02-01"), D("2020-01-01"), 5), ("c", D("2020-01-01"), D("9999-12-31"), 6), ("c", D("2020-01-01"), D("9999-12-31"), 6)]
    df = spark.createDataFrame(rows, "e string, valid_from date, valid_to date, __to int")
    assert got(intervals.merged_spans(df, ["e"])) == sorted([("a", "period", D("2019-01-01"), None), (None, "period", D("2020-01-05"), D("2020-01-05")), ("c", "period", D("2020-01-01"), None)], key=repr)
    assert got(intervals.merged_spans(df.limit(0), ["e"])) == []


def test_version_spans_take_the_last_observation(spark):
    df = docs(spark, doc("w", "2020-01-01", "2020-01-31"), doc("w", "2020-01-01", "2020-02-10", seen="2024-02-01"), doc("w", "2020-02-20", "2020-02-25"), doc("w", "2020-03-01", withdrawn=True), doc("w", "2020-04-01", "2020-03-01"))
    spans = intervals.spans_as_text(intervals.version_spans(df))
    assert got(spans, "span_kind", "span_from", "span_to") == [("gap", "2020-02-11", "2020-02-19"), ("period", "2020-01-01", "2020-02-10"), ("period", "2020-02-20", "2020-02-25")]
    assert got(intervals.spans_as_text(intervals.version_spans(docs(spark, doc("v", "2021-01-01")))), "span_to") == [("open",)]


# ---- snapshots


def test_snapshot_diff_arrays_against_sets():
    rng = random.Random(2)
    for block in (2, 3, 256):
        rows = {(i, k): rng.randrange(3) for i in range(6) for k in range(9) if rng.random() < 0.6}
        want = set()
        for (i, k), d in rows.items():
            if k and (i, k - 1) not in rows:
                want.add((0, i, k))
            if k and rows.get((i, k - 1), d) != d:
                want.add((1, i, k))
            if k < 8 and (i, k + 1) not in rows:
                want.add((2, i, k))
        found = set()
        buckets = {}
        for (i, k), d in rows.items():
            buckets.setdefault((i, k // block), []).append((i, k, d, k == 8, True))
            if k % block == block - 1 and k < 8:
                buckets.setdefault((i, k // block + 1), []).append((i, k, d, False, False))
        for b in buckets.values():
            i, k, d, last, own = map(np.array, zip(*b))
            kind, at = snapshots.diff_arrays(i, i, k, d, last, own, block)
            found |= set(zip(kind.tolist(), i[at].tolist(), k[at].tolist()))
        assert found == want


def test_provision_changes(spark):
    r = lambda day, n=0: f"tp:w:{day}--{n:064x}|fr|{day}"
    rows = [
        (r("2020-01-01"), "a", "AA", None, "x"), (r("2020-01-01"), "a", "aa", None, "x"), (r("2020-01-01"), "b", "bb", None, "x"), (r("2020-01-01"), None, "n", None, "x"),
        (r("2021-01-01"), "a", "aa", None, "x"), (r("2021-01-01"), "b", "cc", None, "x"), (r("2021-01-01"), "c", None, "text", "x"),
        (r("2021-01-01", 1), "c", "982d9e3eb996f559e633f4d194def3761d909f5a3b647d1a851fead67c32c9d1", None, "x"),
        (None, "z", "zz", None, "x"), ("tp:other:2020-01-01--0|fr|2020-01-01", "a", "aa", None, "x"),
    ]
    df = spark.createDataFrame(rows, "rid string, anchor string, text_sha string, text_md string, last string")
    assert got(snapshots.provision_changes(df)) == sorted(
        [(r("2021-01-01"), "b", "changed"), (r("2021-01-01"), "c", "added"), (r("2021-01-01"), None, "removed"), (r("2021-01-01", 1), "a", "removed"), (r("2021-01-01", 1), "b", "removed")], key=repr
    )
    assert got(snapshots.provision_changes(df.limit(0))) == []


# ---- orphans


def test_orphans(spark):
    held = docs(spark, doc("loi-1", "2020-01-01", seen="2024-01-01"), doc("loi-1", "2021-01-01", seen="2024-06-01", n=1), doc("loi-2", "2020-01-01", seen="2024-01-01"), doc("loi-2", "2020-01-01", seen="2024-02-01", withdrawn=True))
    hrefs = ["/eli/x/y/loi/1/jo#a", " HTTPS://h/ELI/x/y/loi/1?l=fr ", "/eli/x/y/loi/1/consolide/20210101/", "tp:loi-1", "TP:loi-2", "tp:loi-3", f"tp:loi-1:2020-01-01--{0:064x}#art", "zz:loi-1", "mailto:a@b", "", None, "tp:loi-1", "/eli/x/y/loi/1/consolide/20210101"]
    rows = [(i, h, T("2024-03-01"), "r") for i, h in enumerate(hrefs)]
    rows[12] = (12, hrefs[12], T("2024-07-01"), "r")
    rows[11] = (3, "tp:loi-1", T("2024-03-01"), "r")
    citations = spark.createDataFrame(rows, "citation_id long, href string, observed_from timestamp, parent string")
    observations = spark.createDataFrame([(1, f" TP:loi-1:2020-01-01--{0:064x} ", T("2024-01-01")), (2, "tp:loi-1:x", T("2024-01-01")), (3, None, None), (4, f"tp:loi-1:2020-01-01--{0:064x}", T("2023-12-31"))], "obs_id long, key string, observed_from timestamp")
    want = [("citations", 2, "2024-03"), ("citations", 4, "2024-03"), ("citations", 5, "2024-03"), ("obs_history", 2, "2024-01"), ("obs_history", 4, "2023-12")]
    found = orphans.orphan_references(held, citations, observations)
    assert got(found) == want
    assert got(orphans.orphan_report(found)) == [("citations", "2024-03", 3), ("obs_history", "2023-12", 1), ("obs_history", "2024-01", 1)]
    assert len(got(orphans.orphan_references(held.limit(0), citations, observations.limit(0)))) == 4  # without docs only ELI paths are references
    assert got(orphans.orphan_references(held, citations.limit(0), observations.limit(0))) == []


# ---- point in time


def test_in_force_and_ambiguity(spark):
    df = docs(spark, doc("w1", "2020-01-01", "2021-12-31"), doc("w1", "2022-01-01"), doc("w2", "2019-06-01", n=1), doc("w2", "2019-06-01", n=2), doc("w3", "2025-01-01", withdrawn=True))
    rows = temporal.in_force_on(df, "2021-12-31")
    assert got(rows, "group_key", "choices") == [("w1", 1), ("w2", 2), ("w2", 2)]
    assert got(temporal.in_force_on(df, "2026-01-01"), "group_key") == [("w1",), ("w2",), ("w2",)]
    assert ("w3",) in got(temporal.effective_on(df, "2026-01-01"), "group_key")


def test_language_selects_an_expression_not_a_state(spark):
    from palimpsest.model import FilterSet

    df = docs(spark, doc("w", "2020-01-01", "2020-12-31", "fr"), doc("w", "2021-01-01", language="en"))
    assert got(temporal.in_force_on(df, "2021-06-01", FilterSet(language="fr"))) == []


def test_as_of_join_equals_scan(spark):
    rng = random.Random(3)
    versions = []
    for i in range(120):
        a = dt.date(2000, 1, 1) + dt.timedelta(rng.randrange(4000))
        versions.append(doc(f"w{rng.randrange(5)}", a.isoformat(), (a + dt.timedelta(rng.randrange(-3, 900))).isoformat() if rng.random() < 0.9 else None, n=i))
    probes = [(f"w{rng.randrange(6)}", dt.date(2000, 1, 1) + dt.timedelta(rng.randrange(5000))) for _ in range(200)]
    out = temporal.as_of_join(spark.createDataFrame(probes, "group_key string, on_date date"), docs(spark, *versions))
    for r in out.collect():
        starts = [v[7] for v in versions if v[3] == r["group_key"] and v[7] <= r["on_date"] and (v[8] is None or v[8] >= r["on_date"])]
        assert r["valid_from"] == max(starts, default=None)


def test_changes(spark):
    df = docs(spark, doc("w1", "2020-01-01", "2021-12-31", kind="LOI"), doc("w1", "2022-01-01", kind="LOI"), doc("w2", "2019-06-01", kind="RGD"))
    provisions = spark.createDataFrame([(df.collect()[i]["rid"], s, f"art_{s}", t) for i, s, t in ((0, 1, "x"), (0, 2, "y"), (1, 1, "x"), (1, 2, "z"))], "rid string, seq int, anchor string, text_sha string")
    rows = rollups.wording_comparison(rollups.changes_in_period(df, "2019-01-01", "2023-01-01"), df, provisions)
    assert got(rows, "group_key", "versions", "distinct_texts", "text_comparable") == [("w1", 2, 2, True), ("w2", 1, 0, False)]


# ---- histories


def _history(spark):
    df = docs(spark, *[doc("w", f"202{i}-01-01", f"202{i}-12-31") for i in range(4)])
    rids = [r["rid"] for r in df.orderBy("key").collect()]
    text = [{"a": "1", "b": "2"}, {"a": "1", "c": "2"}, {"a": "9"}, {"a": "9", "b": "2", "d": "5"}]
    rows = [(rids[i], n, a, t, D("2020-01-01")) for i, v in enumerate(text) for n, (a, t) in enumerate(v.items())]
    return df, spark.createDataFrame(rows, "rid string, seq int, anchor string, text_sha string, article_valid_from date")


def test_runs_break_on_change_and_absence(spark):
    runs = history.wording_runs(*_history(spark))
    y = lambda n: D(f"202{n}-01-01")
    e = lambda n: D(f"202{n}-12-31")
    assert got(runs, "anchor", "valid_from", "valid_to", "text_sha", "validity_conflict") == [("a", y(0), e(1), "1", False), ("a", y(2), e(3), "9", True), ("b", y(0), e(0), "2", False), ("b", y(3), e(3), "2", True), ("c", y(1), e(1), "2", True), ("d", y(3), e(3), "5", True)]


def test_anchor_events(spark):
    events = history.anchor_events(*_history(spark))
    assert got(events, "etype", "from_anchor", "to_anchor", "anchor") == [("inserted", None, None, "b"), ("inserted", None, None, "d"), ("removed", None, None, "c"), ("renumbered", "b", "c", None)]


def test_digest_ignores_order(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("b", "x")], "p string, q string")
    one = got(history.table_digest(df, ["p", "q"]))
    assert one == got(history.table_digest(df.orderBy(df.p.desc()), ["p", "q"])) != got(history.table_digest(df.where("p = 'a'"), ["p", "q"]))


# ---- maintenance


def test_reconcile_and_replay(spark):
    held = docs(spark, doc("a", "2020-01-01"), doc("b", "2020-01-01"), doc("c", "2020-01-01", withdrawn=True), doc("d", "2020-01-01"), doc("e", "2020-01-01", withdrawn=True))
    seen = docs(spark, doc("a", "2020-01-01", "2020-05-01"), doc("b", "2020-01-01", title="new"), doc("c", "2020-01-01"), doc("f", "2020-01-01"))
    fields = ["valid_to", "title"]
    actions = scd.reconcile(held, seen, fields)
    want = {"a": "interval_closed", "b": "revised", "c": "resighted", "d": "tombstoned", "e": "still_withdrawn", "f": "first_seen"}
    assert {r["rid"].split(":")[1]: r["action"] for r in actions.collect()} == want
    after = scd.state_at(held.unionByName(scd.apply_actions(held, seen, actions, "2025-01-01")), "2025-01-01")
    assert {r["action"] for r in scd.reconcile(after, seen, fields).collect()} == {"unchanged", "still_withdrawn"}


# ---- texts


def test_word_diff_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        d = diff.word_diff(" ".join(a), " ".join(b))
        assert [w for k, w in d if k != "+"] == a and [w for k, w in d if k != "-"] == b
        assert sum(k == "=" for k, _ in d) == best[-1, -1]
    assert {k for k, _ in diff.word_diff("L’œuvre — X", "l'oeuvre - x")} == {"="}


def test_long_diffs_go_by_paragraph(monkeypatch):
    monkeypatch.setattr(diff, "CELLS", 9)
    d = diff.word_diff("a b\n\nc d\n\ne f", "a b\n\nc x\n\ne f")
    assert d == [("=", "a"), ("=", "b"), ("=", "c"), ("-", "d"), ("+", "x"), ("=", "e"), ("=", "f")]
    assert diff.line_diff("a\nb", "a\nc") == [("=", "a"), ("-", "b"), ("+", "c")]


AKN = """<akomaNtoso xmlns="u"><act><body><chapter><num>Chapitre 1</num><article eId="art_1"><num>Article 1</num><heading>But</heading><p>Le  texte.</p></article>
<article eId="art_1"><num>Art. 1</num><p>Bis</p></article></chapter></body></act></akomaNtoso>"""
FORMEX = "<CONS.ACT><PREAMBLE>x</PREAMBLE><DIVISION><TITLE>Part I</TITLE><ARTICLE IDENTIFIER='001'><TI.ART>Article 1</TI.ART><STI.ART>Scope</STI.ART><P>Text<NOTE>n</NOTE> here</P></ARTICLE></DIVISION><ANNEX><TITLE><TI>ANNEX II</TI></TITLE><P>More</P></ANNEX></CONS.ACT>"
FORMEX_2 = """<ACT><TOC>x</TOC><ARTICLE IDENTIFIER='002'><TI.ART>Article 2</TI.ART><PARAG><NO.PARAG>1.</NO.PARAG><ALINEA>Rules. It applies to:<LIST><ITEM><NP><NO.P>(a)</NO.P><TXT>controllers;</TXT></NP></ITEM>
<ITEM><NP><NO.P>(b)</NO.P><TXT>the <QUOT.START CODE="2018"/>Union<QUOT.END CODE="2019"/>.</TXT></NP></ITEM></LIST></ALINEA></PARAG><TBL><ROW><CELL>Step</CELL><CELL>Weight<NOTE>f</NOTE></CELL></ROW><ROW><CELL>1</CELL><CELL>20 %</CELL></ROW></TBL></ARTICLE></ACT>"""
WRAPPED = """<html><body><div id="cpt_I"><p class="title-division-1">CHAPTER I</p><p class="title-division-2">General</p><div class="eli-subdivision" id="art_1"><p class="title-article-norm">Article 1</p><p class="stitle-article-norm">Scope</p>
<p>See <b>all</b> of <a href="u">[it]</a>.<a class="modref" href="m">M1</a></p><ol><li>one</li><li><p>two</p></li></ol><div class="eli-subdivision" id="art_9"/></div></div><div class="eli-subdivision" id="anx_1"><table><tr><td>A</td><td>B | C</td></tr><tr><td>x</td></tr></table></div></body></html>"""
TWICE = '<akomaNtoso xmlns="u" xmlns:s="v"><act><body><article eId="art_1"><num>Art. 1</num><p s:n="5" s:n="5">x</p></article></body></act></akomaNtoso>'
PAGE = "<html><body><p>before</p><p class='title-division-1'>Title I</p><p class='title-article-norm'>Article 2</p><p class='stitle-article-norm'>Scope</p><p>One &amp; two<script>no</script></p><p>Three</body>"


@pytest.mark.parametrize(
    ("source", "profile", "want"),
    [
        (AKN, "akn", [("art_1", "1", "But", "Chapitre 1", "Le texte."), ("art_1__2", "1", None, "Chapitre 1", "Bis")]),
        ("<akomaNtoso xmlns='u'><act><body><p>Only <i>this</i></p></body></act></akomaNtoso>", "akn", [("document", None, None, None, "Only *this*")]),
        (FORMEX, "formex", [("art_1", "Article 1", "Scope", "Part I", "Text here"), ("anx_ii", None, "ANNEX II", None, "More")]),
        (FORMEX_2, "formex", [("art_2", "Article 2", None, None, "**1.** Rules. It applies to:\n\n(a) controllers;\n(b) the ‘Union’.\n\n| Step | Weight |\n| --- | --- |\n| 1 | 20 % |")]),
        (WRAPPED, "wrapped", [("art_1", "Article 1", "Scope", "CHAPTER I — General", "See **all** of [it].\n\n1. one\n2. two"), ("anx_1", None, None, None, "| A | B \\| C |\n| --- | --- |\n| x |  |")]),
        (TWICE, "akn-repaired", [("art_1", "1", None, None, "x")]),
        (PAGE, "page", [("art_2", "Article 2", "Scope", "Title I", "One & two\n\nThree")]),
        ("intro\nArticle 1 — But\nA\nArticle 1er\nB", "plain", [("art_1", "1", "But", None, "A"), ("art_1er", "1er", None, None, "B")]),
        ("<p>Just <b>text</b>", "whole", [("document", None, None, None, "Just text")]),
        ("<akomaNtoso>broken <b>", "whole", [("document", None, None, None, "broken")]),
        (None, "none", []),
        ("  ", "none", []),
    ],
)
def test_extraction(source, profile, want):
    name, rows = extraction.extract(source)
    markdown = extraction.assemble(rows)
    assert all(markdown[r["md_start"] : r["md_end"]] == r["text"] for r in rows)
    assert (name, [(r["anchor"], r["num"], r["heading"], r["path"], r["text"]) for r in rows]) == (profile, want)


def test_gazette_by_title():
    lines = ["Sommaire", "Loi concernant la protection des consommateurs", "autres", "Article 3", "x", "Loi du 3 mai 1990 concernant la", "protection des consommateurs", "preamble", "Article 1er", "Un", "Article 2", "Deux"]
    rows = extraction.gazette_by_title(lines, "Loi concernant la protection des consommateurs")
    assert [(r["anchor"], r["text"]) for r in rows] == [("art_1er", "Un"), ("art_2", "Deux")]
    again = extraction.gazette_by_title([*lines, "Article 1er", "Encore"], "Loi concernant la protection des consommateurs")
    assert [r["anchor"] for r in again] == ["document"]
    assert extraction.gazette_by_title(lines, "Loi sur les forains") == [] == extraction.gazette_by_title([], None)
    assert extraction.better(rows, again) is rows and extraction.better(again, rows) is rows


def test_covering_manifestation(spark):
    files = spark.createDataFrame([("v1", "fmx", "a", 5, "p1"), ("v1", "html", "b", 9, "p1"), ("v2", "fmx", "c", 5, "p1"), ("v2", "pdf", "d", 9, "p1"), ("v2", "pdf", "e", 11, "p2")], "v string, format string, name string, size int, part string")
    bodies = spark.createDataFrame([("v1", "p1"), ("v2", "p1"), ("v2", "p2")], "v string, part string")
    assert got(extraction.covering_manifestation(files, bodies, ["v"], "fmx", {"html": 0, "pdf": 1}), "v", "name", "format") == [("v1", "a", "fmx"), ("v2", "e", "pdf")]


def test_more_empty_than_before(spark):
    now = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "s string")
    before = spark.createDataFrame([("a",), ("b",)], "s string")
    assert got(extraction.more_empty_than_before(now, before, ["s"])) == [("a", 2, 1), ("c", 1, 0)]
