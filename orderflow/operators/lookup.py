"""Lookups of many rows in a table with one row for each key, where a few keys may be in a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that a sketch tracks for each key that it is to find; it errs by one part in so many of what such a key has.
TRACKED = 8
MOST_TRACKED = 1_000_000


def heavy_keys(rows: DataFrame, *keys: list[str]) -> list[list[int]]:
    """Hashes of the keys that have more rows than a shuffle partition has on average, for each list of columns.

    One pass with a frequent-items sketch of bounded size for each list; the driver gets at most as many hashes as there are
    partitions. Null is a key like others. No rows have none.
    """
    parts = min(max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_TRACKED // TRACKED)
    hashed = [F.xxhash64(*k).alias(f"k{i}") for i, k in enumerate(keys)]
    tops = [F.expr(f"approx_top_k(k{i}, {parts}, {max(1024, TRACKED * parts)})").alias(f"t{i}") for i in range(len(keys))]
    found = rows.select(*hashed).agg(F.count("*").alias("n"), *tops).first()
    return [[x["item"] for x in found[f"t{i}"] or [] if x["count"] * parts >= found.n] for i in range(len(keys))]


def _among(keys: list[str], heavy: list[int]) -> Column:
    return F.xxhash64(*keys).isin(heavy)


def looked_up(rows: DataFrame, known: DataFrame, keys: list[str], heavy: list[int] | None = None) -> DataFrame:
    """``rows`` with the columns of ``known``, null for keys that it lacks: a left join on ``keys``.

    ``known`` has at most one row for each key, and its keys have the types of those of ``rows``. Rows of heavy keys meet a
    broadcast of these keys' rows, of which there are no more than shuffle partitions, and stay where they are; the rest is shuffled.
    """
    heavy = heavy_keys(rows, keys)[0] if heavy is None else heavy
    if not heavy:
        return rows.join(known, keys, "left")
    hot = rows.where(_among(keys, heavy)).join(F.broadcast(known.where(_among(keys, heavy))), keys, "left")
    return hot.unionByName(rows.where(~_among(keys, heavy)).join(known, keys, "left"))
