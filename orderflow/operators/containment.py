"""Which strings hold which others, as an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_by(longer: DataFrame, longer_col: str, shorter: DataFrame, shorter_col: str) -> DataFrame:
    """Different pairs of a value of ``longer`` and a value of ``shorter`` that is a part of it, under their column names.

    The longer strings are cut into their parts of just the lengths that the shorter ones have, so that equality is
    containment: a common beginning such as ``saint`` makes no hot key. Nulls and empty strings hold and are nothing.
    """
    short = shorter.select(F.col(shorter_col).alias("part")).where("part != ''").distinct()
    lengths = sorted(r.n for r in short.select(F.length("part").alias("n")).distinct().collect())  # a few dozen numbers
    sizes = F.array(*map(F.lit, lengths)).cast("array<int>")
    whole = F.col("whole")
    parts = F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(whole)), lambda n: F.transform(
        F.sequence(F.lit(1), F.length(whole) - n + 1), lambda i: F.substring(whole, i, n))))
    cut = longer.select(F.col(longer_col).alias("whole")).where("whole != ''").distinct().select("whole", F.explode(F.array_distinct(parts)).alias("part"))
    return cut.join(short, "part").select(F.col("whole").alias(longer_col), F.col("part").alias(shorter_col))
