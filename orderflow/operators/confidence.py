"""How sure an extracted pair is, and the full resolution of a sentence with candidate stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.text import stripped
from orderflow.operators.extract import parsed_rows
from orderflow.operators.gazetteer import row_pairs
from orderflow.operators.stations import candidates_for_city, candidates_for_words, free_words
from orderflow.sources.scratch import stored

# Fixed values.
BOTH, ONE, NEITHER, FAILED = 0.93, 0.85, 0.72, 0.15
FREE_CANDIDATES, STEP, MOST_AMBIGUITY, CONTAMINATION = 3, 0.02, 0.10, 0.05
REASONS = {
    "baseline": ("invalid_or_ambiguous", "invalid_or_ambiguous_helpful_mode"),
    "gazetteer": ("spacy_no_result", "spacy_no_result_helpful"),
}


def literal_confidence(sentence: Column, departure: Column, arrival: Column) -> Column:
    """Struct ``confidence, strength, departure_literal, arrival_literal`` from the names' presence in the sentence."""
    low = F.lower(F.coalesce(sentence, F.lit("")))
    dep, arr = (F.contains(low, F.lower(F.coalesce(c, F.lit("")))) for c in (departure, arrival))
    return F.struct(
        F.when(dep & arr, BOTH).when(dep | arr, ONE).otherwise(NEITHER).alias("confidence"),
        F.when(dep & arr, "both_literal").when(dep | arr, "one_literal").otherwise("none_literal").alias("strength"),
        dep.alias("departure_literal"),
        arr.alias("arrival_literal"),
    )


def _ambiguity(n: Column) -> Column:
    return F.least(F.lit(MOST_AMBIGUITY), F.greatest(F.lit(0.0), (n - FREE_CANDIDATES) * STEP))


def penalties(departure: Column, arrival: Column, dep_names: Column, arr_names: Column) -> Column:
    """Struct ``ambiguity, contamination``: for many candidates, and for the other city's name among them."""
    other = lambda city, names: F.when(
        (F.coalesce(city, F.lit("")) != "") & F.contains(F.lower(F.array_join(names, " ")), F.lower(city)), CONTAMINATION
    ).otherwise(0.0)
    return F.struct(
        (_ambiguity(F.size(dep_names)) + _ambiguity(F.size(arr_names))).alias("ambiguity"),
        (other(arrival, dep_names) + other(departure, arr_names)).alias("contamination"),
    )


def candidate_lists(cities: DataFrame, stations: DataFrame, limit: int = 12) -> DataFrame:
    """``city`` values to ``city, candidates``, an array of stations in their order."""
    rows = candidates_for_city(cities, stations, limit)
    one = F.struct("rank", "station_name", "uic_code", "latitude", "longitude")
    return rows.groupBy("city").agg(F.array_sort(F.collect_list(one)).alias("candidates"))


def resolve(orders: DataFrame, cities: DataFrame, stations: DataFrame, mode: str = "baseline", helpful: bool = False, limit: int = 12) -> DataFrame:
    """``order_id, sentence`` to one row each: pair, candidates of both sides, confidence, penalties and reason.

    ``mode`` is baseline (patterns and dictionary) or gazetteer (first two names mentioned). A blank sentence has
    reason empty_input and confidence 0, an unknown mode unknown_mode and 0; a failure has the mode's reason and
    0.15, and if ``helpful`` stations proposed from its words. Each row of a null or repeated id is answered for itself.
    """
    empty = stripped(F.coalesce("sentence", F.lit(""))) == ""
    asked = orders.select("order_id", "sentence", empty.alias("empty"))
    none = F.lit(None).cast("string")
    if mode == "baseline":
        pairs = parsed_rows(asked, cities)
    elif mode == "gazetteer":
        pairs = row_pairs(asked, cities.select(F.col("city").alias("name")))
    else:
        pairs = asked.select(F.struct("*").alias("row"), none.alias("departure"), none.alias("destination"))
    pairs = stored(pairs.select("row.*", "departure", "destination"))
    known = candidate_lists(pairs.select(F.explode(F.array("departure", "destination")).alias("city")), stations, limit)
    side = lambda city, name: known.select(F.col("city").alias(city), F.col("candidates").alias(name))
    rows = pairs.join(side("departure", "dep_candidates"), "departure", "left").join(side("destination", "arr_candidates"), "destination", "left")
    empty_list = F.array().cast(known.schema["candidates"].dataType)
    rows = rows.withColumns({c: F.coalesce(c, empty_list) for c in ("dep_candidates", "arr_candidates")})
    ok, base = F.col("departure").isNotNull(), literal_confidence(F.col("sentence"), F.col("departure"), F.col("destination"))
    less = penalties(F.col("departure"), F.col("destination"), F.col("dep_candidates.station_name"), F.col("arr_candidates.station_name"))
    sure = F.greatest(F.lit(0.0), base["confidence"] - less["ambiguity"] - less["contamination"])
    reason = F.when(ok, F.lit("ok")).when(F.col("empty"), F.lit("empty_input"))
    reason = reason.otherwise(F.lit(REASONS[mode][helpful] if mode in REASONS else "unknown_mode"))
    failed = F.when(F.col("empty"), 0.0).otherwise(FAILED if mode in REASONS else 0.0)
    out = rows.select(
        "order_id", "sentence", ok.alias("ok"), "departure", "destination", "dep_candidates", "arr_candidates",
        F.when(ok, sure).otherwise(failed).alias("confidence"),
        F.when(ok, base["strength"]).alias("strength"),
        F.when(ok, less["ambiguity"]).alias("ambiguity_penalty"),
        F.when(ok, less["contamination"]).alias("contamination_penalty"),
        reason.alias("reason"),
    )
    if not helpful or mode not in REASONS:
        return out
    # stations are proposed for sets of words and looked up by them, so rows need no key
    words = F.when(~F.col("ok") & (F.col("reason") != "empty_input"), free_words(F.col("sentence")))
    offered = candidates_for_words(out.select(words.alias("words")).where("size(words) > 0").distinct(), stations, limit)
    one = F.struct("rank", "station_name", "uic_code", "latitude", "longitude")
    offered = offered.groupBy("words").agg(F.array_sort(F.collect_list(one)).alias("proposed"))
    return out.withColumn("words", words).join(offered, "words", "left").drop("words")
