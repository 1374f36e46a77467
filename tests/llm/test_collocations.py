"""Collocations against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
from helpers_llm import DOCS, low, odd_documents

from orderflow.llm import collocations


def plain(rows, least, first):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(w)
            counts.update(("und" if lang is None else lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    frequent = {k: n for k, n in counts.items() if n >= least and len(k[1]) > 1}
    out = []
    for (lang, w), a in frequent.items():
        cuts = [((1000000 * a * a) // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        held = any(o == lang and len(v) > len(w) and w in (v[:2], v[1:]) and 100 * n >= 50 * a for (o, v), n in frequent.items())
        if not held:
            out.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]], total[lang]))
    out.sort()
    rank = Counter()
    got = []
    for lang, score, a, phrase, l, r, n in out:  # noqa: E741
        rank[lang] += 1
        if rank[lang] <= first:
            got.append((lang, rank[lang], phrase.decode(), -a, l, r, n, -score))
    return sorted(got)


def run(docs, **k):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.collocations(docs, **k).collect())


@pytest.mark.parametrize("lot, bits", [(4096, 26), (3, 8)])
def test_against_plain_counting(spark, monkeypatch, lot, bits):
    """A hot word and a hot piece, odd blanks and signs, letters beyond ASCII, a full map of pairs and parts dealt to several tasks."""
    monkeypatch.setattr(collocations, "LOT", lot)
    monkeypatch.setattr(collocations, "MAP_BITS", bits)
    rng = np.random.default_rng(2)
    words = ["de", "La", "Été", "x y", "b\x00c", " ", "z-z", "ÀB", "q", "de"]
    marks = [" ", "  ", "\t", ", ", ".", "\n", "\x0b", "\r\n", " ", " "]
    texts = ["".join(words[rng.integers(0, 10)] + marks[rng.integers(0, 10)] for _ in range(rng.integers(0, 120))) for _ in range(60)]
    rows = [(t, ["fr", "EN", None, "und", ""][k % 5]) for k, t in enumerate(texts)] + [("De la mer. de LA mer; de de de de", "fr")] * 40 + [(None, "fr"), ("", None), (" .\t.", "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS m", "'p' AS piece", "2 AS f", "'r' AS rank")
    assert run(docs) == plain(rows, 10, 2000)
    assert run(docs, least=2, first=7) == plain(rows, 2, 7)


def test_odd_and_no_rows(spark):
    odd = odd_documents(spark)
    assert run(odd, least=1) == plain([(r.text, r.lang) for r in odd.collect()], 1, 2000)
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_products_beyond_64_bits(spark):
    """Counts whose products pass 64 bits are divided exactly."""
    n = 3_000_000_019
    counts = spark.createDataFrame([("fr", "a", n + 7), ("fr", "b", n + 1), ("fr", "a b", n)], "lang string, phrase string, f long")
    (got,) = collocations.scored(counts).collect()
    assert (got.a, got.l, got.r, got.score) == (n, n + 7, n + 1, 1000000 * n * n // ((n + 7) * (n + 1)))


def test_counting_spills(monkeypatch):
    """More different phrases than the memory holds."""
    import pyarrow as pa

    monkeypatch.setattr(collocations, "MEMORY", "40MB")
    batches = (pa.record_batch({"lang": ["fr"] * 50_000, "phrase": [f"phrase number {k % 900_000}" for k in range(b, b + 50_000)], "f": [2] * 50_000}) for b in range(0, 1_800_000, 50_000))
    got = [r for b in collocations.added_up(batches, 3) for r in b.column("f").to_pylist()]
    assert len(got) == 900_000 and set(got) == {4}
