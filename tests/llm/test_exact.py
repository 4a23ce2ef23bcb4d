"""Ties and natural gaps: nothing is left out of the results."""

from __future__ import annotations

import numpy as np

from palimpsest.llm import chunking, leakage, neighbours, spam, tokenizer
from palimpsest.llm import words as ws
from tests.llm.test_llm import RANKS, brute, cache_row, rows_of, some_vectors
from tests.test_core import got


def test_ties_go_to_the_smaller_name_however_many(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(2, 64))
    base = np.round(90 * base / np.linalg.norm(base, axis=1, keepdims=True)).astype(np.int8)
    base[:, :60] = np.where(base[:, :60] == 0, 1, base[:, :60])
    base[1] = -base[0]
    # members differ in one byte that is alike in all: equal products with the base and each other
    v = np.concatenate([np.repeat(base[:1], 61, axis=0), np.repeat(base[1:], 9, axis=0)])
    v[:, :60] = np.sign(v[:, :60]) * 16
    for i in range(60):
        v[1 + i, i] += np.sign(v[1 + i, i])
    for i in range(8):
        v[62 + i, i] += np.sign(v[62 + i, i])
    names = [f"n{i:04d}" for i in rng.permutation(len(v))]
    df = spark.createDataFrame([cache_row("p", n, x) for n, x in zip(names, v)], "profile string, chunk_sha string, record binary, record_sha string")
    for k in (5, 10):
        want = sorted(("p", *x) for x in brute(v, names, k))
        assert len(want) > 100 and got(neighbours.similar_pairs(df, k=k)) == want



def test_early_natural_gaps_are_cut_at():
    words = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    for gap in ("\n", "\n\n"):
        parts, _, _ = chunking.chunk_text(words("a", 50) + gap + words("b", 250))
        assert parts[0][0] == words("a", 50) and parts[1][0].split("\n")[-1].startswith("b0 ")
        # after the first cut too, though not within the overlap's own tokens
        parts, _, _ = chunking.chunk_text(words("a", 200) + gap + words("b", 40) + gap + words("c", 253))
        assert [p for p, _, _ in parts][0] == words("a", 200) and parts[1][0].endswith("b39")
        assert all(size <= 256 for _, size, _ in parts)
    parts, _, _ = chunking.chunk_text(words("a", 20) + "\n" + words("b", 300))
    assert all(b > a for a, b in zip([s for _, _, s in parts], [s for _, _, s in parts][1:])) and len(parts) == 2


def test_askers_of_a_cell_are_split(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = some_vectors(rng, 300, 0.15)
    names = [f"n{i:04d}" for i in range(len(v))]
    df = spark.createDataFrame([cache_row("p", n, x) for n, x in zip(names, v)], "profile string, chunk_sha string, record binary, record_sha string")
    whole = rows_of(neighbours.similar_pairs(df))
    for members, askers in ((100, 10_000), (10_000, 90), (100, 90)):
        monkeypatch.setattr(neighbours, "SHARD_MOST", members)
        monkeypatch.setattr(neighbours, "ASKERS_MOST", askers)
        cells = neighbours.fit_profiles(neighbours.valid_vectors(df))["p"]
        assert (cells.parts.max() > 1) == (members < 300) and (cells.slices.max() > 1) == (askers < 300)
        assert rows_of(neighbours.similar_pairs(df)) == whole


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n)), "".join("ba"[bin(i).count("1") & 1] for i in range(n))


def test_words_of_one_hash_are_told_apart(monkeypatch):
    with open(RANKS, "rb") as f:
        ranks = tokenizer.load_ranks(f.read())
    texts = [x + end for n in (16, 64, 1024, 4096) for x in thue_morse(n) for end in ("", "c", " d")] + ["xy yx xxyy yyxx"]
    want = [list(map(int, tokenizer.BlockEncoder(ranks).encode([t])[0])) for t in texts]
    assert [tokenizer.decode(x, ranks) for x in want] == texts

    def ids(encoder, block):
        flat, ends = encoder.encode(block)
        return [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]

    assert ids(tokenizer.BlockEncoder(ranks), texts) == want
    # a hash that knows only the length of a word: the comparison of bytes decides
    monkeypatch.setattr(tokenizer.BlockEncoder, "_hashes", lambda self, data, a, size: size.astype(np.uint64))
    encoder = tokenizer.BlockEncoder(ranks)
    assert ids(encoder, texts) == want and ids(encoder, texts[::-1]) == want[::-1]
    assert [ids(encoder, [t])[0] for t in texts] == want


def test_hits_are_extended_to_the_span_only():
    item = [f"w{i}" for i in range(40)]
    hashes = ws.WordHashes()
    index = leakage.Fingerprints.of([hashes(item), hashes(["a"] * 9), hashes(["a"] * 30), []])
    texts = [["x", *item[5 + i : 5 + i + n], "y"] for n in range(7, 20) for i in range(15)]
    texts += [["b"] * 5 + ["a"] * n + ["b"] for n in (8, 9, 12, 13, 400)] + [[], item[:12] + ["z"] + item[12:24]]
    spelled = [item, ["a"] * 9, ["a"] * 30, []]
    want = [(d, i) for d, t in enumerate(texts) for i, p in enumerate(spelled) if leakage.has_span(t, p)]
    assert leakage._leaked(index, spelled, texts, hashes) == want


def test_boundary_is_what_cuts_alone_can_do():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(255, 1200))
        gap = rng.choice([0, 1, 2], p=rng.choice([[0.995, 0.003, 0.002], [0.98, 0.015, 0.005], [0.999, 0.0005, 0.0005]]), size=n).astype(np.int8)
        gap[0] = 2
        rolled = rng.integers(0, 2**63, n).astype(np.uint64)
        longest = {k: int(np.diff(np.r_[np.flatnonzero(gap >= k), n]).max()) for k in (1, 2)}
        assert chunking.boundary_kind(gap, rolled) == ("paragraph" if longest[2] <= 254 else "line" if longest[1] <= 254 else "inside")


SENTENCES = {
    "es": "El tribunal podrá conceder una prórroga del plazo cuando la persona interesada lo solicite por escrito. ",
    "nl": "De bevoegde autoriteit kan de vergunning intrekken als de houder niet aan de voorwaarden voldoet. ",
    "it": "Il giudice può concedere una proroga del termine quando la parte interessata ne fa richiesta scritta. ",
    "pl": "Sąd może przedłużyć termin na wniosek strony złożony na piśmie w ciągu trzech dni od doręczenia. ",
}
CITED = {
    "en": ["The court found that the notice had been sent too late.", "No party may rely on a term that was not agreed in writing.", "The register is open to all who can show an interest in it.", "A fee is due when the application is filed with the office.", "The decision may be appealed within thirty days of receipt."],
    "es": ["El tribunal declaró que el aviso se había enviado demasiado tarde.", "Ninguna de las partes puede invocar una cláusula que no fue pactada por escrito.", "El registro está abierto a todos los que demuestren un interés en él.", "La tasa se paga cuando se presenta la solicitud en la oficina.", "La decisión se puede recurrir en el plazo de treinta días."],
}


def test_running_text_of_any_language_is_no_spam():
    for text in SENTENCES.values():
        assert spam.spam_share(text) == spam.spam_share(text * 6) == 0
    for lines in CITED.values():
        for form in ("{} [source](https://s.example/{})", "{} https://s.example/{}", '{} (<a href="https://s.example/{}">source</a>)'):
            assert spam.spam_share("\n".join(form.format(x, i) for i, x in enumerate(lines))) <= 0.5
            assert spam.spam_share(" ".join(form.format(x, i) for i, x in enumerate(lines))) <= 0.5
    assert spam.spam_share('<div data-x="' + "a " * 250 + '">' + " ".join(CITED["en"][:3]) + "</div>") == 0
    for text in ("comprar casa barata, abogado barato, " * 20, "goedkope notaris Amsterdam\n" * 20, "kup teraz tanio prawnik " * 20, "law pdf X{0}, best lawyer Y{0}, " * 40):
        assert spam.spam_share(text) == 1
    contents = "\n".join(f"Kapitel {i} Gebühren {'.' * 6} {2 * i}" for i in range(1, 30))
    assert spam.spam_share("Der Schulrat übermittelt die Grenzkarte binnen acht Tagen nach Eingang.\n" + contents) == 0
    assert spam.spam_share("\n".join(f"{n}. Fees and duties" for n in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"))) == 0
