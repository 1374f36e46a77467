"""The index of names against all pairs of slots and names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderflow.functions.fuzzy import weighted_ratio
from orderflow.operators import extract, fuzzy_index

FOLDER = "/root/testdata/sf0.001"
TOWNS = (
    "paris lyon marseille toulouse nice nantes montpellier strasbourg bordeaux lille rennes reims le-havre saint-etienne toulon grenoble dijon angers nimes"
    " villeurbanne clermont-ferrand aix-en-provence brest limoges tours amiens perpignan metz besancon y eu us by is sy oo saint denis,saint denis en val,saint-denis,le mans,le le mans,la roche sur yon,la roche sur foron,sur"
).replace(",", " ").split()
PHRASES = ["saint denis", "saint denis en val", "denis saint", "le mans", "le le mans", "la roche sur yon", "la roche sur foron", "ville de la roche", "saint jean de monts", "saint jean", "saint"]


def mistyped(rng, word):
    letters, out = "abcdefghijklmnopqrstuvwxyz '-", list(word)
    for _ in range(int(rng.integers(0, 4))):
        at, kind = int(rng.integers(0, len(out) + 1)), rng.integers(0, 4)
        if kind == 0 and out:
            out.pop(min(at, len(out) - 1))
        elif kind == 1:
            out.insert(at, letters[rng.integers(0, len(letters))])
        elif kind == 2 and len(out) > 1:
            at = min(at, len(out) - 2)
            out[at], out[at + 1] = out[at + 1], out[at]
        elif out:
            out[min(at, len(out) - 1)] = letters[rng.integers(0, len(letters))]
    return " ".join("".join(out).split())


def best_of_all(slot, names):
    scored = [(-weighted_ratio(slot, n), n) for n in names]
    score, name = min(scored, default=(0.0, ""))
    return (slot, round(-score, 6), name) if -score >= fuzzy_index.LEAST else (slot, 0.0, "")


def same(spark, slots, names):
    rows = spark.createDataFrame([(s,) for s in slots], "slot string").repartition(4)
    cities = spark.createDataFrame([(n.title(), n) for n in names], "city string, city_norm string")
    found = {r.slot: (r.slot, round(r.score, 6), r.city_norm) for r in fuzzy_index.near_cities(rows, cities).collect()}
    wanted = {s: best_of_all(s, names) for s in slots}
    assert {s: found.get(s, (s, 0.0, "")) for s in slots} == wanted
    return wanted


@pytest.mark.parametrize("seed", [0, 1])
def test_against_all_pairs_of_misspelt_names(spark, seed):
    """Misspelt towns and phrases, with words put around, before and twice, words of one letter, and names of one letter."""
    rng = np.random.default_rng(seed)
    names = sorted(set(TOWNS) | set(PHRASES))
    slots = {mistyped(rng, names[rng.integers(0, len(names))]) for _ in range(500)}
    for _ in range(250):
        words = [mistyped(rng, names[rng.integers(0, len(names))]) for _ in range(int(rng.integers(2, 5)))]
        slots.add(" ".join(" ".join(words).split()))
    slots |= set(names) | {"a", "y y", "ly", "xy z", "denis denis saint", "q" * 70, "lyon " * 12 + "x"}
    wanted = same(spark, sorted(s for s in slots if s.strip() == s and s), names)
    assert sum(score > 0 for _, score, _ in wanted.values()) > 300


def test_against_all_pairs_of_short_strings(spark):
    """All strings of up to four of two letters, and words of them."""
    short = [""]
    for _ in range(4):
        short += [x + c for x in short if len(x) == max(map(len, short)) for c in "ab"]
    short = sorted({s for s in short if s} | {"a b", "b a", "ab a", "a ab", "ba ab", "ab ba b"})
    same(spark, short, short)


def test_no_slots_and_no_names(spark):
    names = spark.createDataFrame([("Lyon", "lyon")], "city string, city_norm string")
    slots = spark.createDataFrame([("lyonn",)], "slot string")
    assert fuzzy_index.near_cities(slots.limit(0), names).count() == 0 and fuzzy_index.near_cities(slots, names.limit(0)).count() == 0


def test_rows_of_the_registered_queries(spark):
    from orderflow.jobs import registry
    from orderflow.jobs.views import view

    names = sorted(r.city_norm for r in extract.city_names(view(spark, FOLDER, "cities")).collect())
    for query, least in (("fuzzy_matches", fuzzy_index.LEAST), ("fuzzy_slots", 0.0)):
        got = registry.queries()[query](spark, FOLDER).collect()
        assert len(got) > 40
        for r in got[:: 1 if least else 5]:
            score = max(weighted_ratio(r.slot, n) for n in names)
            assert abs(r.score - (score if score >= least else 0)) < 1e-6, r.slot


def test_names_do_not_pass_the_driver(spark, monkeypatch):
    """No block of a larger dictionary is collected where orders are parsed."""
    monkeypatch.setattr(extract, "BLOCK_NAMES", 1)
    monkeypatch.setattr(extract, "best_matches", None)
    slots = spark.createDataFrame([("toulosue",), ("lion",), ("nowhere at all",)], "slot string")
    cities = spark.createDataFrame([("Toulouse",), ("Lyon",)], "city string")
    got = {r.slot: r.city for r in extract.match_cities(slots, cities).where(F.col("slot").isNotNull()).collect()}
    assert got == {"toulosue": "Toulouse", "lion": None, "nowhere at all": None}
