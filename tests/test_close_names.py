"""Names that differ by a letter or two, found by letters left out: against all pairs, and without meeting a part of all alike names."""

import numpy as np
import pytest
from test_fuzzy_index import PHRASES, TOWNS, best_of_all, mistyped

from orderflow.functions.fuzzy import Names, weighted_ratio
from orderflow.operators import extract, fuzzy_index

ALIKE = ["bourg" + f"{i * 7:06d}".translate(str.maketrans("0123456789", "afhjkmpquv")) for i in range(400)]


def _slots():
    rng = np.random.default_rng(5)
    slots = {mistyped(rng, n) for n in (*ALIKE[:120], *TOWNS, *PHRASES)}
    slots |= {ALIKE[3] + " et je vais", "larochesuryon", "la rochesur yon", "saintdenis", "a", ""} | {n[:-2] for n in ALIKE[:20]} | {n + "xy" for n in ALIKE[20:40]}
    return sorted(s for s in slots if s.strip() == s and s)


@pytest.mark.parametrize("indexed", [True, False])
def test_against_all_pairs(spark, indexed):
    names, slots = sorted({*ALIKE, *TOWNS, *PHRASES}), _slots()
    rows, cities = spark.createDataFrame([(s,) for s in slots], "slot string"), spark.createDataFrame([(n,) for n in names], "city string")
    found = {r.slot: (r.slot, round(r.score, 6), r.city_norm) for r in extract.fuzzy_cities(rows, cities, fuzzy_index.LEAST, indexed=indexed).collect()}
    wanted = {s: best_of_all(s, names) for s in slots}
    assert found == wanted and sum(x[1] > 0 for x in wanted.values()) > 120
    near = {r.slot: (r.slot, round(r.score, 6), r.city_norm) for r in extract.fuzzy_cities(rows, cities, fuzzy_index.LEAST, indexed=indexed, most_gap=4).collect()}
    assert near == {s: x if x[1] and abs(len(x[2]) - len(s)) <= 4 else (s, 0.0, "") for s, x in wanted.items()}


def test_alike_names_are_not_all_met(spark, monkeypatch):
    """Slots with one slip, and slots with more words than any name, are left to the index by nobody; it met a part of all pairs."""
    left, keep = [], fuzzy_index.candidates

    def watched(slots, names, *more):
        left.append(slots.count())
        return keep(slots, names, *more)

    monkeypatch.setattr(fuzzy_index, "candidates", watched)
    monkeypatch.setattr(extract, "BLOCK_NAMES", 10)
    slots = {f"{n[:4]}gg{n[5:]}": n for n in ALIKE[:100]} | {n[:7] + n[8] + n[7] + n[9:]: n for n in ALIKE[100:200] if n[7] != n[8]}
    slots = {s: n for s, n in slots.items() if s not in ALIKE}
    rows = spark.createDataFrame([(s,) for s in [*slots, *(f"bourgg{n[5:]} et je vais" for n in ALIKE[:50])]], "slot string")
    got = {r.slot: r.city for r in extract.match_cities(rows, spark.createDataFrame([(n,) for n in ALIKE], "city string")).collect()}
    assert sum(left) <= 20
    for s in slots:
        score, name = min((-weighted_ratio(s, n), n) for n in ALIKE)
        assert got[s] == (name if -score >= 85 else None)
    assert all(got[s] is None for s in got if s.endswith("vais"))


def test_names_in_memory_of_near_lengths():
    names = sorted({*ALIKE[:60], *TOWNS, *PHRASES})
    known = Names([(k, n, n) for k, n in enumerate(names)])
    for s in _slots():
        _, score, name = best_of_all(s, names)
        assert known.best(s, 85.0, 4)[2] == (name if score and abs(len(name) - len(s)) <= 4 else "")
        assert (known.closest(s) or (0, 0, name))[2] == name
    single = Names([(k, n, n) for k, n in enumerate(ALIKE)])
    found = {s: single.closest(s) for s in _slots()}
    assert all(best_of_all(s, ALIKE)[1:] == (round(x[0], 6), x[2]) for s, x in found.items() if x) and sum(map(bool, found.values())) > 40


def test_a_stream_takes_more_names_than_a_block(spark):
    """Over 20,000 names, held to the batch job; a stream raised an error before."""
    names = ["bourg" + f"{i:05d}".translate(str.maketrans("0123456789", "afhjkmpquv")) for i in range(20_500)]
    cities = spark.createDataFrame([(n,) for n in names], "city string")
    slots = [f"bourgg{n[5:]}" for n in names[::4000]] + [n[:7] + n[8] + n[7] + n[9:] for n in names[70::4100]] + names[:2] + ["nulle part"]
    wanted = {r.slot: r.city for r in extract.match_cities(spark.createDataFrame([(s,) for s in slots], "slot string"), cities).collect()}
    matcher = extract.SlotMatcher(cities)
    assert {s: matcher.city(s) for s in slots} == wanted and sum(map(bool, wanted.values())) > 6
