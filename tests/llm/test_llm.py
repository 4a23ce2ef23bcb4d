"""Text and vector operators against brute force, round trips and known answers."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from palimpsest.llm import chunking, leakage, neighbours, spam, tokenizer
from palimpsest.llm import words as ws

np.seterr(over="ignore")
RANKS = f"{tokenizer.VOCABULARIES}/byte_bpe_50k.tiktoken"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# ---- chunking


def ref_kind(text, limit=256):
    count = lambda s: len(re.findall(r"[^ \t\r\n]+", s)) + 2
    lines, blocks = re.split(r"\r?\n", text), [[]]
    for line in lines:
        if re.fullmatch(r"[ \t]*", line):
            blocks.append([])
        else:
            blocks[-1].append(line)
    if max(count("\n".join(b)) for b in blocks) <= limit:
        return "paragraph"
    return "line" if max(map(count, lines)) <= limit else "inside"


def test_chunks_cover_texts_with_overlap():
    rng = random.Random(1)
    for _ in range(200):
        limit, overlap, least = rng.choice([(12, 3, 2), (20, 0, 5), (256, 32, 96)])
        n = rng.randrange(1, 6 * limit)
        text = "".join(rng.choice(["wörd", "a", "(x)"]) + rng.choice([" "] * 12 + ["\n", "\r\n", "\n\n", "\r\n \t\r\n", "\t", "\r", "\n\r\n", "\n \r \n"]) for _ in range(n))
        parts, count, kind = chunking.chunk_text(text, limit, overlap, least)
        tokens = re.findall(r"[^ \t\r\n]+", text)
        assert count == len(tokens) + 2 and kind == ref_kind(text, limit)
        at = 0
        for i, (piece, size, start) in enumerate(parts):
            own = re.findall(r"[^ \t\r\n]+", piece)
            assert len(own) + 2 == size <= limit and tokens[start : start + len(own)] == own and piece in text
            assert start == (at - overlap if i else 0)
            at = start + len(own)
        assert at == len(tokens)


def test_an_edit_moves_only_neighbouring_cuts():
    rng = random.Random(2)
    tokens = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    before = {p for p, _, _ in chunking.chunk_text(" ".join(tokens))[0]}
    tokens[1500:1500] = ["new", "words"]
    after = {p for p, _, _ in chunking.chunk_text(" ".join(tokens))[0]}
    assert len(before - after) <= 6 and len(before) > 20


def test_chunks_prefer_paragraphs(spark):
    text = "\n\n".join(" ".join(f"p{i}w{j}" for j in range(60)) for i in range(9))
    parts, _, kind = chunking.chunk_text(text)
    assert kind == "paragraph" and all(p.split()[-1].endswith("w59") for p, _, _ in parts)
    df = spark.createDataFrame([(text, 1, "x"), (text, 2, "y"), (None, 3, "z"), ("", 4, "z"), ("short", 5, "z")], "t string, text int, text_sha string")
    big = chunking.oversized(df, "t")
    assert rows_of(big, "text_sha") == [(hashlib.sha256(text.encode()).hexdigest(),)]
    assert chunking.chunk_texts(big).count() == len(parts)
    assert chunking.chunk_texts(big, pieces=False).count() == 1
    assert chunking.chunk_texts(chunking.oversized(df.limit(0), "t")).count() == 0


# ---- neighbours


def brute(vectors, names, k=5, least=0.9):
    d = vectors.astype(int) @ vectors.T.astype(int)
    out = set()
    for i, a in enumerate(names):
        order = sorted((x for x in range(len(names)) if x != i), key=lambda j: (-d[i, j], names[j]))[:k]
        out |= {tuple(sorted((a, names[j]))) for j in order if d[i, j] * 10 >= least * 161290 - 1e-6}
    return out


def cache_row(profile, name, v, bad=False):
    record = np.packbits(v >= 0, bitorder="little").tobytes() + v.astype(np.int8).tobytes()
    sha = hashlib.sha256(record).hexdigest()
    return profile, name, bytearray(record), "0" * 64 if bad else sha.upper() if len(name) % 2 else sha


def some_vectors(rng, n, spread=0.25):
    centres = rng.normal(size=(max(1, n // 6), 64))
    v = centres[rng.integers(len(centres), size=n)] + spread * rng.normal(size=(n, 64))
    return np.round(127 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int8)


def test_graph_recall():
    rng = np.random.default_rng(3)
    v = some_vectors(rng, 2500)
    unit = neighbours._unit(v)
    graph = neighbours.Graph(unit)
    ids, _ = graph.search(unit, keep=10)
    d = unit @ unit.T
    want = np.argsort(-d, axis=1)[:, :6]
    assert np.mean([len(set(w) & set(i)) / 6 for w, i in zip(want, ids)]) > 0.97
    assert neighbours.Graph(unit[:1]).search(unit[:1], keep=3)[0].tolist() == [[0, -1, -1]]


def test_similar_pairs_with_copies_and_dirt(spark):
    rng = np.random.default_rng(4)
    v = some_vectors(rng, 300)
    v[200:260] = v[200]  # many copies of one vector
    names = [f"n{i:04d}" for i in range(len(v))]
    rows = [cache_row("p", n, x) for n, x in zip(names, v)]
    rows += rows[:20] + [cache_row("q", "n0000", v[0]), cache_row("q", "n0001", v[0]), cache_row("p", "bad", v[0], bad=True), ("p", "short", bytearray(b"x"), "y"), ("p", "null", None, None), (None, "n", rows[0][2], rows[0][3]), ("p", None, rows[0][2], rows[0][3])]
    df = spark.createDataFrame(rows, "profile string, chunk_sha string, record binary, record_sha string")
    found = rows_of(neighbours.similar_pairs(df))
    want = {("p", *x) for x in brute(v, names)} | {("q", "n0000", "n0001")}
    assert len(set(found) & want) >= 0.99 * len(want) and len(set(found) - want) <= 0.01 * len(want)
    assert len(found) == len(set(found))
    assert rows_of(neighbours.similar_pairs(df.limit(0))) == []


def test_many_cells_and_split_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 60)
    rng = np.random.default_rng(5)
    v = some_vectors(rng, 400, 0.15)
    names = [f"n{i:04d}" for i in range(len(v))]
    df = spark.createDataFrame([cache_row("p", n, x) for n, x in zip(names, v)], "profile string, chunk_sha string, record binary, record_sha string")
    want = {("p", *x) for x in brute(v, names)}
    assert len(set(rows_of(neighbours.similar_pairs(df))) & want) >= 0.9 * len(want)
    monkeypatch.setattr(neighbours, "SHARD_MOST", 25)
    assert len(set(rows_of(neighbours.similar_pairs(df))) & want) >= 0.9 * len(want)


# ---- tokenizer


TEXTS = [
    "", None, "a", " ", "  ", "\n", "don't can't we'll I've 's 'street ''s x's's 're-do 'LL", "Règlement n° 5 — l’été", "  two  spaces \n\n lines\r\n\tTabs ", "a" * 3000, " " * 500, "é".encode().decode(),
    "é ­​﻿", "\U0001f600\U0001f468‍\U0001f469 日本語 العربية", "1234567 12a34 ½²", "<|endoftext|> &amp; <b>", "x y z　", "'", "''", "' s", "'s", "\x00\x01", "end'", "ſ'S 'ſ",
]


def test_ids_equal_the_public_library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as f:
        ranks = tokenizer.load_ranks(f.read())
    plain = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    alphabet = list("abcdefgh  \n\t'’-.,;éüß0123日😀­́") + ["'s", "'ll", " the", "tion"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(1500)]
    encoder = tokenizer.BlockEncoder(ranks)
    for block in (texts, texts[:40], texts[::-1]):
        flat, ends = encoder.encode(block)
        ids = [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]
        assert ids == [plain.encode_ordinary(t) if t else [] for t in block]
        assert [tokenizer.decode(i, ranks) for i in ids] == [t or "" for t in block]


def test_encode_column(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, "a", "x"), (None, "a", "x")], "doc_id int, text string, ids string")
    rows = tokenizer.encode_column(df, RANKS, ["doc_id"]).collect()
    assert len(rows) == len(TEXTS) + 2
    assert {r["doc_id"]: r["ids"] for r in rows}[0] == []
    assert tokenizer.encode_column(df.limit(0), RANKS, ["doc_id"]).count() == 0


# ---- leakage


def test_words():
    assert ws.words("L’É­TÉ été_x STRASSE straße ﬁn 5²") == ["l", "ete", "ete", "x", "strasse", "strasse", "fin", "5²"]
    assert ws.words(None) == ws.words("") == ws.words("​") == []


def test_winnowing_guarantee():
    rng = np.random.default_rng(7)
    for _ in range(200):
        shared = rng.integers(0, 2**63, 13, np.uint64)
        a, b = (np.r_[rng.integers(0, 2**63, rng.integers(0, 9), np.uint64), shared, rng.integers(0, 2**63, rng.integers(0, 9), np.uint64)] for _ in range(2))
        p, q = (set(ws.grams(x, 7)[ws.winnow(ws.grams(x, 7), 7)].tolist()) for x in (a, b))
        assert p & q


def leak_case():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 7, 12, 13, 14, 40])))) for i in range(40)] + [(40, None), (41, ""), (42, "  "), (43, "Ünique Phrase")]
    docs = []
    for d in range(150):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        if d % 3 == 0:
            w = (rng.choice(items[:40])[1]).split()
            a = rng.randrange(len(w))
            parts[rng.randrange(len(parts) + 1) : 0] = w[a : a + rng.randrange(1, 30)]
        docs.append((d, " ".join(parts).upper() if d % 2 else " ".join(parts)))
    docs += [(150, None), (151, ""), (152, "the üni­que, PHRASE."), (152, "again"), (None, "unique phrase")]
    want = {(d, i) for d, t in docs for i, p in items if leakage.has_span(ws.words(t), ws.words(p))}
    return docs, items, want


def test_leaks_equal_brute_force_by_either_way(spark, monkeypatch):
    docs, items, want = leak_case()
    d = spark.createDataFrame(docs, "doc_id int, text string")
    i = spark.createDataFrame(items + items[:5], "item_id int, passage string")
    assert len(want) > 30
    found = rows_of(leakage.leaked_items(d, i))
    assert set(found) == want and len(found) == len(want)
    monkeypatch.setattr(leakage, "BROADCAST_ITEMS", 3)
    assert set(rows_of(leakage.leaked_items(d, i))) == want
    assert rows_of(leakage.leaked_items(d.limit(0), i)) == [] == rows_of(leakage.leaked_items(d, i.limit(0)))


# ---- spam


def test_suffix_coverage_equals_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        s = [rng.randrange(4) for _ in range(rng.randrange(25))]
        for times in (2, 3):
            want = [False] * len(s)
            for a in range(len(s)):
                for b in range(a + 1, len(s) + 1):
                    if sum(s[x : x + b - a] == s[a:b] for x in range(len(s))) >= times:
                        want[a:b] = [True] * (b - a)
            assert spam.suffix_coverage(s, times) == want


CLAUSE = "The keeper of the register shall refund the annual statement on a duly reasoned request. "
LIST = "".join(f"[cheap notary](https://site{i}.example/{i}) " for i in range(30))


@pytest.mark.parametrize(
    ("text", "is_spam"),
    [
        (None, False), ("", False), (" ​", False), (CLAUSE, False), (CLAUSE * 20, False),
        ("cheap notary, best lawyer, " * 20, True), ("CHEAP NOT​ARY " * 30, True), (LIST, True), (CLAUSE + LIST, True), (CLAUSE * 30 + LIST[:120], False),
        ("#tag_one #tagtwo #tagthree " * 9, True),
        ("\n".join(f"Set Place{i}x A5 blue {i}.49 SKU{i}" for i in range(20)), True),
        ("".join(f'<a href="https://s{i}.example/a">label here</a> ' for i in range(20)), True),
        ("Act of 2006-12-23 on ferries\n\n" + "\n".join(f"Article {i} Fees Place ...... {i}" for i in range(1, 30)), False),
        ("| Nr | Pos |\n|---|---|\n" + "\n".join(f"| {i} | rural leases |" for i in range(30)), False),
        ("\n".join(f"Loi du 2001-02-{i:02d} relative aux baux" for i in range(1, 29)), False),
    ],
)
def test_spam(text, is_spam):
    assert (spam.spam_share(text) > spam.SHARE) is is_spam


def test_spam_pages(spark):
    df = spark.createDataFrame([(1, "cheap notary " * 40, "a"), (1, "cheap notary " * 40, "b"), (2, CLAUSE, "c"), (3, None, "d"), (None, LIST, "e"), (4, "kw b " * 60_000, "f")], "doc_id int, text string, __doc string")
    assert rows_of(spam.spam_pages(df)) == [(1,), (4,), (None,)]
    assert rows_of(spam.spam_pages(df.limit(0))) == []
