"""Lookups with heavy keys, and profiles by sketches against exact ones."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from orderflow.operators import extract, lookup, stations


@pytest.fixture
def parts(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("16", "false", "-1"), strict=True):
        spark.conf.set(n, v)
    yield 16
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_a_pair_in_a_third_of_the_orders_is_no_large_task(spark, parts):
    """One pair in a third of the rows and null in a fifth: partitions of the result hold under twice the median."""
    rows = spark.range(40_000).repartition(16).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("c"), F.col("id") % 3001)).alias("departure"), F.when(F.col("id") % 3 == 0, "pair").otherwise("x").alias("destination")
    )
    keys = ["departure", "destination"]
    known = rows.where("departure IS NOT NULL AND departure != 'c7'").select(*keys).distinct().withColumn("answer", F.concat_ws("|", *keys))
    (heavy,) = lookup.heavy_keys(rows, keys)
    assert 2 <= len(heavy) <= parts
    got = lookup.looked_up(rows, known, keys)
    plain = rows.join(known, keys, "left")
    assert got.exceptAll(plain.select(*got.columns)).isEmpty() and got.count() == 40_000
    size = lambda df: [r["count"] for r in df.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("count"), F.max("answer")).collect()]
    assert max(size(plain)) > 4 * median(size(plain)) and max(size(got)) < 2 * median(size(got))


def test_no_rows_and_no_heavy_keys(spark):
    known = spark.createDataFrame([("a", 1)], "k string, v int")
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert lookup.looked_up(rows.limit(0), known, ["k"]).count() == 0
    assert sorted((r.k or "", r.v) for r in lookup.looked_up(rows, known, ["k"], []).collect()) == [("", None), ("a", 1), ("b", None)]
    assert sorted((r.k or "", r.v) for r in lookup.looked_up(rows, known, ["k"]).collect()) == [("", None), ("a", 1), ("b", None)]


def test_orders_of_one_pair(spark):
    said = [("1", "Je vais à Lyon depuis Paris")] * 300 + [(str(k), f"Je vais à Lyon depuis {c}") for k, c in enumerate(["Nice", "Nulle", "Paris"])] + [(None, None)] * 40
    cities = spark.createDataFrame([("Lyon",), ("Paris",), ("Nice",)], "city string")
    got = extract.parse_orders(spark.createDataFrame(said, "order_id string, sentence string"), cities).groupBy("departure", "destination", "status").count().collect()
    assert sorted(((r.departure or ""), (r.destination or ""), r.status, r["count"]) for r in got) == [("", "", "INVALID", 41), ("Nice", "Lyon", "OK", 1), ("Paris", "Lyon", "OK", 301)]


def test_sketches_are_near_the_exact_profile(spark):
    rows = spark.range(200_000).selectExpr("CASE WHEN id % 7 = 0 THEN NULL ELSE concat('v', id % 50000) END AS a", "id % 3 AS b", "CAST(NULL AS STRING) AS c", "repeat('x', CAST(id % 101 AS INT)) AS `d.e`")
    exact = {r.column: r for r in stations.profile(rows).collect()}
    got = {r.column: r for r in stations.sketched_profile(rows).collect()}
    assert set(got) == set(exact) == {"a", "b", "c", "d.e"}
    for c, r in got.items():
        assert (r.n_rows, r.n_null) == (exact[c].n_rows, exact[c].n_null) and abs(r.n_different - exact[c].n_different) <= 0.03 * exact[c].n_different
    assert (got["d.e"].least_length, got["d.e"].greatest_length) == (0, 100) and abs(got["d.e"].median_length - 50) <= 3
    assert (got["c"].n_different, got["c"].least_length, got["c"].median_length) == (0, None, None)
    plan = stations.sketched_profile(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert stations.sketched_profile(rows.limit(0)).where("n_rows = 0 AND n_different = 0").count() == 4
