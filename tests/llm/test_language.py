"""Sums over segmentations against enumeration and exact arithmetic; what the query learns from and predicts."""

import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillon.llm import langid, queries

DIR = "/root/testdata/sf0.001"
PIECES = [b" ", b"a", b"b", b" a", b"ab", b"ba", b"aab", b"bbbb"]


def segmentations(word, at=0):
    """Every list of pieces that spells the word."""
    if at == len(word):
        yield []
    for i, piece in enumerate(PIECES):
        if word.startswith(piece, at):
            for rest in segmentations(word, at + len(piece)):
                yield [i, *rest]


def exact(pieces, p, word):
    """The sum over all segmentations, in fractions."""
    sums = [Fraction(1)] + [Fraction(0)] * len(word)
    for e in range(1, len(word) + 1):
        for i, piece in enumerate(pieces):
            if e >= len(piece) and word[e - len(piece) : e] == piece:
                sums[e] += sums[e - len(piece)] * Fraction(p[i])
    return sums[-1]


def log(x: Fraction) -> float:
    shift = x.numerator.bit_length() - x.denominator.bit_length()
    return math.log(float(x / Fraction(2) ** shift)) + shift * math.log(2)


@pytest.mark.parametrize("long,every", [(64, 16), (2, 16), (64, 3), (0, 2)])
def test_sums_and_expected_counts(monkeypatch, long, every):
    monkeypatch.setattr(langid, "LONG_BYTES", long)
    monkeypatch.setattr(langid, "EVERY", every)
    rng = random.Random(3)
    p = np.array([[rng.random(), rng.random()] for _ in PIECES])
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 16))) for _ in range(25)]
    counts = np.array([[rng.randrange(3), 1] for _ in words], dtype=float)
    want, logs = np.zeros_like(p), []
    for word, n in zip(words, counts, strict=True):
        ways = list(segmentations(b" " + word))
        for k in (0, 1):
            weights = [math.prod(p[i, k] for i in way) for way in ways]
            logs.append(math.log(sum(weights)))
            for way, weight in zip(ways, weights, strict=True):
                for i in way:
                    want[i, k] += n[k] * weight / sum(weights)
    trie = langid.Pieces(PIECES)
    assert langid.forward(trie, p, words).ravel() == pytest.approx(logs)
    assert langid.expected_counts(trie, p, words, counts) == pytest.approx(want)


def test_long_words_and_other_scripts():
    pieces = langid.read_pieces(langid.vocabulary_path())
    rng = np.random.default_rng(5)
    p = rng.random((len(pieces), 1)) ** 8 / len(pieces)
    p /= p.sum()
    letters = random.Random(6)
    words = ["donaudampfschifffahrtsgesellschaftskapitaen", "ภาษาไทยเป็นภาษาที่มีระดับเสียง", "日本語の文章は単語の間に空白がない", "и", "x" * 300]
    words = [w.encode() for w in words] + [bytes(letters.choices(range(97, 123), k=n)) for n in (1, 7, 23, 24, 25, 40, 60, 64, 65, 130)]
    got = langid.forward(langid.Pieces(pieces), p, words)[:, 0]
    known = {x: i for i, x in enumerate(pieces)}
    for word, value in zip(words, got, strict=True):
        held = [x for x in {(b" " + word)[a:b] for a in range(len(word) + 1) for b in range(a + 1, min(len(word) + 1, a + 40) + 1)} if x in known]
        assert value == pytest.approx(log(exact(held, [p[known[x], 0] for x in held], b" " + word)), rel=1e-9)


def test_words_are_whole():
    text = "Donaudampfschifffahrtsgesellschaftskapitän ภาษาไทยเป็นภาษาที่มีระดับเสียง, " + "x" * 500
    assert [w.decode() for w in langid.words_of(text)] == ["donaudampfschifffahrtsgesellschaftskapitän", "ภาษาไทยเป็นภาษาที่มีระดับเสียง", "x" * 500]


def test_query_keeps_the_folds(spark):
    docs = {r["doc_id"]: r for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()}
    got = queries.queries()["op2_language_id"](spark, DIR).collect()
    out = {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    learned = {r["lang"] for i, r in docs.items() if i not in out and r["lang"] is not None}
    assert {r["doc_id"] for r in got if r["held_out"]} == out
    for r in got:
        letters = any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")
        assert (r["lang_pred"] in learned and 0.25 <= r["score"] <= 1) if letters else (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_held_out_rows_teach_nothing(spark):
    """Other labels in the held-out fold change no prediction."""
    rows = [(i, f"{'der hund und die katze' if i % 2 else 'the dog and the cat'} {i}", "de" if i % 2 else "en") for i in range(60)]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, t, x in rows]
    a, b = (sorted(langid.identify_held_out(spark.createDataFrame(r, "doc_id long, text string, lang string")).collect()) for r in (rows, wrong))
    assert a == b and {r["lang_pred"] for r in a} == {"de", "en"}
    assert all(r["lang_pred"] == ("de" if r["doc_id"] % 2 else "en") for r in a)


def test_only_letters_make_words():
    assert langid.words_of("“Hallo”—Welt … «oui» naïve2x") == [w.encode() for w in ("hallo", "welt", "oui", "naïve", "x")]
    assert langid.words_of("été हिन्दी") == [w.encode() for w in ("été", "हिन्दी")]


def test_long_words_are_summed_together():
    """Padded in one matrix, words of many lengths give what each gives alone."""
    pieces = langid.Pieces([b" a", b"a", b"ab", b"b", b"ba", b" ", b"aba"])
    rng = np.random.default_rng(5)
    p = rng.random((7, 3))
    words = ["".join(rng.choice(list("ab"), n)).encode() for n in (65, 66, 70, 100, 101, 333, 1200, 1201, 5000)]
    got = langid.forward(pieces, p, words)
    for i, w in enumerate(words):
        edges = pieces.edges(langid._letters(w))
        for k in range(3):
            sums, logs = langid._chain(edges, p, k)
            assert got[i, k] == pytest.approx(np.log(sums[-1]) + logs[-1], rel=1e-9)
