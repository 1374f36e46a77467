"""Whitening against rational arithmetic and a plain decomposition."""

from fractions import Fraction

import numpy as np
import pytest

from orderflow.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, n int, whitened string"


def rows_of(vectors):
    return [(i, v, 0, "x", 1, "w") for i, v in vectors]


def plain(vectors):
    """Sums and covariance of the different integer vectors by fractions."""
    ints = {i: tuple(int(np.floor(256 * float(np.float32(c)))) for c in v) for i, v in vectors}
    fit = sorted(set(ints.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(d)] for i in range(d)]
    return ints, n, sums, mean, np.array([[float(v) for v in r] for r in cov])


@pytest.mark.parametrize("scale", [1.0, 1e6, 3e11])
def test_against_fractions(spark, scale, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(6, 6))
    vectors = [(k, [float(c) for c in np.float32((rng.normal(size=6) @ mixed + 5) * scale)]) for k in range(150)]
    vectors += [(200 + k, vectors[k % 7][1]) for k in range(80)]
    odd = [(900, None), (901, [1.0] * 5 + [None]), (902, [1.0] * 5 + [float("nan")]), (903, [float("inf")] + [0.0] * 5), (904, [1.0, 2.0]), (905, [3e38] * 6)]
    docs = spark.createDataFrame(rows_of([*vectors, (None, vectors[0][1]), *odd]), VECTORS).repartition(5)
    got = whitening.whiten(docs).collect()
    ints, n, sums, mean, cov = plain(vectors)
    assert n == 150 and sorted({r.vec_id for r in got if r.vec_id is not None}) == sorted(ints) and len(got) == 4 * 231
    values, axes = np.linalg.eigh(cov)
    signs = {}
    for r in got:
        x = ints[0 if r.vec_id is None else r.vec_id]
        exact = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        assert r.n == n and r.deviation_exact == str(exact) and r.deviation == (exact if exact < 2**63 else None)
        value, axis = values[-r.component], axes[:, -r.component]
        wanted = sum(float(a - m) * u for a, m, u in zip(x, mean, axis, strict=True)) / np.sqrt(value)
        sign = signs.setdefault(r.component, 1 if wanted * r.whitened > 0 else -1)
        assert abs(wanted * sign - r.whitened) < 1e-8 * (1 + abs(wanted))
        assert abs(r.explained - value / np.trace(cov)) < 1e-9 and 0 <= r.identity_error < 1e-8
    assert len({r.identity_error for r in got}) == 1


def test_cross_products_are_exact():
    rng = np.random.default_rng(1)
    for bits in (8, 21, 40, 62):
        x = rng.integers(-(1 << bits), 1 << bits, (50, 5))
        assert (whitening.cross_products(x) == x.astype(object).T @ x.astype(object)).all()


def test_little_spread_and_no_rows(spark):
    flat = spark.createDataFrame(rows_of([(k, [0.5, float(k % 3), 0.25]) for k in range(9)]), VECTORS)
    got = whitening.whiten(flat).collect()
    assert len(got) == 27 and {r.n for r in got} == {3}
    assert all(r.whitened == 0 and r.explained == 0 for r in got if r.component > 1)
    assert all(abs(r.explained - 1) < 1e-12 for r in got if r.component == 1) and got[0].identity_error < 1e-12
    one = whitening.whiten(flat.limit(1)).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, 0.0, 0.0, 0.0)] * 3
    for none in (flat.limit(0), spark.createDataFrame(rows_of([(1, None), (2, [])]), VECTORS)):
        out = whitening.whiten(none)
        assert out.count() == 0 and out.columns[:2] == ["vec_id", "component"]


def test_registered_query(spark):
    from orderflow import llm

    folder = "/root/testdata/sf0.001"
    got = llm.queries()["op12_whitening"](spark, folder).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    ints, n, sums, mean, cov = plain([(i, v) for i, v in vectors if v is not None and None not in v and np.isfinite(v).all()])
    values = np.linalg.eigvalsh(cov)[::-1]
    assert len(got) == 4 * len(ints) and {r.n for r in got} == {n}
    for r in got:
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(ints[r.vec_id], sums, strict=True))
        assert abs(r.explained / (values[r.component - 1] / np.trace(cov)) - 1) < 1e-9 and r.identity_error < 1e-9
