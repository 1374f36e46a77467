"""Mentions by the automaton and by the Bloom filter, against a plain search."""

import re

import numpy as np
import pytest

from orderflow.operators import gazetteer

SIGNS = ["'", "-", ", ", " ", " ", " ", "  ", " ", "_", "\n", ".", " à "]


def tokens(text):
    out, k = [], 0
    while k < len(text):
        if text[k].isalnum():
            end = k
            while end < len(text) and text[end].isalnum():
                end += 1
            out.append((text[k:end], k, end))
            k = end
        else:
            if text[k] not in " \t\n\x0b\f\r":
                out.append((text[k], k, k + 1))
            k += 1
    return out


def plain(text, keys, fold):
    found, said = [], tokens(text or "")
    for i in range(len(said)):
        for n in range(1, min(9, len(said) - i) + 1):
            if tuple(fold(t) for t, _, _ in said[i : i + n]) in keys:
                found.append((-n, said[i][1], said[i + n - 1][2]))
    taken = []
    for _, a, b in sorted(found):
        if all(b <= c or d <= a for c, d in taken):
            taken.append((a, b))
    return sorted(taken)


@pytest.mark.parametrize("shipped", [1 << 20, 0])
@pytest.mark.parametrize("ignore_case", [False, True])
def test_against_a_plain_search(spark, monkeypatch, shipped, ignore_case):
    monkeypatch.setattr(gazetteer, "SHIPPED_BYTES", shipped)
    rng = np.random.default_rng(7)
    words = ["Lyon", "lyon", "Part", "Dieu", "Saint", "L'Isle", "d", "Été", "x2", "Saint-Étienne", "Le", "Mans", "II"]
    names = sorted({"".join(words[rng.integers(0, 13)] + ("" if k == n - 1 else [" ", "-", "'"][rng.integers(0, 3)]) for k in range(n)) for n in rng.integers(1, 5, 60)})
    texts = ["".join(words[rng.integers(0, 13)] + SIGNS[rng.integers(0, 12)] for _ in range(rng.integers(0, 40))) for _ in range(120)] + [None, "", " \n", "Lyon " * 4000]
    docs = spark.createDataFrame([(f"{k % 90}" if k % 7 else None, t, 1) for k, t in enumerate(texts)], "order_id string, sentence string, rid int").repartition(3)
    fold = str.lower if ignore_case else str
    forms = lambda v: {v, re.sub(r"\s+", " ", v.replace("-", " ")).strip(), re.sub(r"\s+", "-", v)}
    keys = {tuple(fold(t) for t, _, _ in tokens(f)) for v in names for f in forms(v)}
    wanted = sorted((f"{k % 90}" if k % 7 else "", (t or "")[a:b], a, b) for k, t in enumerate(texts) for a, b in plain(t, keys, fold))
    got = gazetteer.mentions(docs, spark.createDataFrame([(n,) for n in names], "name string"), ignore_case).collect()
    assert sorted((r.order_id or "", r.text, r.start, r.end) for r in got) == wanted and len(wanted) > 1000


def test_texts_are_not_shuffled_and_no_run_of_tokens_is_a_row(spark):
    docs = spark.createDataFrame([("1", "de Lyon à Paris")], "order_id string, sentence string")
    monkey = gazetteer.spread
    try:
        gazetteer.spread = lambda rows: rows
        found = gazetteer.mentions(docs, spark.createDataFrame([("Lyon",), ("Paris",)], "name string"))
        pairs = gazetteer.row_pairs(docs, spark.createDataFrame([("Lyon",), ("Paris",)], "name string"))
    finally:
        gazetteer.spread = monkey
    for rows in (found, pairs):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
    assert [r.text for r in found.collect()] == ["Lyon", "Paris"]
    assert [(r.departure, r.destination) for r in pairs.collect()] == [("Lyon", "Paris")]


def test_a_large_dictionary_meets_only_what_passes_the_filter(spark, monkeypatch):
    """30,000 names: of the runs of tokens hardly any but true mentions are looked up."""
    names = spark.range(30_000).selectExpr("concat('Ville ', id) AS name")
    bits = gazetteer.bloom_filter(gazetteer._keys(names, False))
    passes = lambda key: all(int(bits[p >> 6]) >> (p & 63) & 1 for p in gazetteer._places(key))
    assert all(passes(f"Ville\x01{k}") for k in range(0, 30_000, 97)) and sum(passes(f"Bourg\x01{k}") for k in range(5000)) < 5
