"""Strict scores of extracted pairs, acceptance rates, and reasons for failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcomes(rows: DataFrame) -> DataFrame:
    """``expected_dep, expected_dest, expected_valid, departure, destination`` with ``outcome``: TP, TN, FALSE_POSITIVE,
    FALSE_NEGATIVE or WRONG_PAIR. A null departure is no answer."""
    answered, wanted = F.col("departure").isNotNull(), F.col("expected_valid") == 1
    same = F.col("departure").eqNullSafe(F.col("expected_dep")) & F.col("destination").eqNullSafe(F.col("expected_dest"))
    kind = (
        F.when(wanted & answered & same, "TP")
        .when(wanted & answered, "WRONG_PAIR")
        .when(wanted, "FALSE_NEGATIVE")
        .when(answered, "FALSE_POSITIVE")
        .otherwise("TN")
    )
    return rows.withColumn("outcome", kind)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / F.nullif(whole, F.lit(0)))


def scores(judged: DataFrame) -> DataFrame:
    """One row: ``tp, fp, fn, tn, precision, recall, f1``; a wrong pair counts as a false positive and a false negative."""
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    one = judged.agg(n("TP").alias("tp"), n("FALSE_POSITIVE", "WRONG_PAIR").alias("fp"), n("FALSE_NEGATIVE", "WRONG_PAIR").alias("fn"), n("TN").alias("tn"))
    tp = F.col("tp")
    shares = one.withColumns({"precision": _share(tp, tp + F.col("fp")), "recall": _share(tp, tp + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    return shares.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0))))


def errors(judged: DataFrame, id_col: str, limit: int = 20, order: tuple[str, ...] = ()) -> DataFrame:
    """The first errors, with what was expected and what was found: by the columns ``order`` (a place gives input order), else by id."""
    wrong = judged.where(~F.col("outcome").isin("TP", "TN"))
    return wrong.orderBy(*(order or (id_col,))).limit(limit).select(id_col, "sentence", "outcome", "expected_dep", "expected_dest", "departure", "destination")


def rates(resolved: DataFrame) -> DataFrame:
    """One row: ``n, n_ok, n_invalid, ok_percent, invalid_percent`` of rows with ``ok``."""
    one = resolved.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))
    one = one.withColumn("n_invalid", F.col("n") - F.col("n_ok"))
    return one.withColumns({f"{c}_percent": 100 * _share(F.col(f"n_{c}"), F.col("n")) for c in ("ok", "invalid")})


def failure_reasons(resolved: DataFrame, limit: int = 10) -> DataFrame:
    """The commonest reasons of rows that are not ``ok``."""
    return resolved.where("NOT ok").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(limit)
