"""Station candidates: by city, by free text, by code, by name; the hub of a city; a profile of the raw list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.functions.text import norm_french, stripped
from orderflow.operators.containment import held_by

# Fixed values.
CANDIDATE_WORDS = (("gare", 10), ("part dieu", 8), ("perrache", 7), ("saint", 2), ("st", 2), ("centre", 2))
HUB_WORDS = (("tgv", 200), ("gare", 100), ("centre", 40), ("halte", -60), ("car", -80))
HUBS = (("paris", "gare de lyon", 10_000), ("lyon", "part dieu", 9_000), ("lyon", "perrache", 8_000))
LEAST_TOKEN = 4


def _points(name: Column, words) -> Column:
    out = F.lit(0)
    for word, points in words:
        out = out + F.when(F.contains(name, F.lit(word)), points).otherwise(0)
    return out


def _top(rows: DataFrame, keys: list[str], order: list[Column], limit: int | None) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def _runs(words: Column, most: int) -> Column:
    """All runs of one to ``most`` neighbouring words, joined by blanks."""
    size = F.size(words)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), size), lambda i: i + n - 1 <= size), lambda i: F.array_join(F.slice(words, i, n), " ")))))


def candidates_for_city(cities: DataFrame, stations: DataFrame, limit: int = 12) -> DataFrame:
    """Different ``city`` values to ``city, rank, rank_score`` and their stations, best first.

    A station is a candidate if its normal name holds the city's as whole words. Names are cut into runs of as many words
    as the longest city has, and joined with the cities by equality.
    """
    asked = cities.select("city").distinct().withColumn("city_norm", norm_french(F.col("city"))).where("city_norm != ''")
    most = asked.agg(F.max(F.size(F.split("city_norm", " ")))).first()[0] or 1
    cut = stations.where("station_norm != ''").select("*", F.explode(_runs(F.split("station_norm", " "), most)).alias("city_norm"))
    met = cut.join(asked, "city_norm")
    leads = F.when(F.startswith("station_norm", F.concat("city_norm", F.lit(" "))), 20).otherwise(0)
    short = F.greatest(F.lit(0), 12 - F.floor(F.least(F.length("station_norm"), F.lit(60)) / 5))
    scored = met.withColumn("rank_score", (leads + _points(F.col("station_norm"), CANDIDATE_WORDS) + short).cast("int"))
    best = _top(scored, ["city"], [F.desc("rank_score"), F.asc("station_name"), F.asc("uic_code")], limit)
    return best.select("city", "rank", "rank_score", "station_name", "uic_code", "latitude", "longitude")


def free_words(text: Column) -> Column:
    """The words of four letters or more of a text, sorted, repeats kept."""
    return F.array_sort(F.filter(F.split(norm_french(text), " "), lambda w: F.length(w) >= LEAST_TOKEN))


def candidates_for_words(asked: DataFrame, stations: DataFrame, limit: int = 12) -> DataFrame:
    """Different ``words`` arrays to ``words, rank, hits`` and the stations whose normal name holds most of them.

    Pairs of a word and a name come from an equi-join on parts of the names.
    """
    counted = asked.select("words", F.explode("words").alias("word")).groupBy("words", "word").agg(F.count("*").alias("n"))
    met = held_by(stations, "station_norm", counted, "word")
    hits = counted.join(met, "word").groupBy("words", "station_norm").agg(F.sum("n").alias("hits"))
    order = [F.desc("hits"), F.length("station_norm").asc(), F.asc("station_norm")]
    # each name has a station, and those of one name rank alike up to their own names and codes
    few = _top(hits, ["words"], order, limit).drop("rank")
    first = _top(stations, ["station_norm"], [F.asc("station_name"), F.asc("uic_code")], limit).drop("rank")
    best = _top(few.join(first, "station_norm"), ["words"], [F.desc("hits"), F.length("station_norm").asc(), F.asc("station_name"), F.asc("uic_code")], limit)
    return best.select("words", "rank", "hits", "station_name", "uic_code", "latitude", "longitude")


def candidates_for_text(texts: DataFrame, stations: DataFrame, limit: int = 12, id_col: str = "order_id", text_col: str = "sentence") -> DataFrame:
    """Stations whose normal name holds words of four letters or more of the text; id, ``rank, hits`` and the station.

    A word that stands twice counts twice. Texts with the same words are ranked once. Null texts have no words; null and
    repeated ids are given as they come.
    """
    asked = texts.select(id_col, free_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    return asked.join(candidates_for_words(asked.select("words").distinct(), stations, limit), "words").drop("words")


def by_code(codes: DataFrame, stations: DataFrame) -> DataFrame:
    """``codes`` (``uic_code``) with the first station of that very code by name; null if there is none."""
    one = stations.groupBy("uic_code").agg(F.min(F.struct("station_name", "latitude", "longitude")).alias("s")).select("uic_code", "s.*")
    return codes.join(one.where("uic_code != ''"), "uic_code", "left")


def search(queries: DataFrame, stations: DataFrame, limit: int | None = 10) -> DataFrame:
    """Different ``query`` values to ``query, rank`` and the stations whose name holds them, in any case, by name.

    The query is taken literally. No limit gives all stations.
    """
    asked = queries.select("query", F.lower("query").alias("low_query")).distinct()
    named = stations.withColumn("low", F.lower("station_name"))
    met = held_by(named, "low", asked, "low_query").join(asked, "low_query").select("query", "low")
    return _top(met.join(named, "low"), ["query"], [F.asc("station_name"), F.asc("uic_code")], limit).select("query", "rank", "station_name", "uic_code")


def hub_of_city(cities: DataFrame, stations: DataFrame) -> DataFrame:
    """Different ``city`` values to ``city, hub_name, hub_uic, hub_score``: the best station whose name begins with the
    city's and a blank, or else holds it."""
    asked = cities.select("city").distinct().withColumn("low", stripped(F.lower("city"))).where("low != ''")
    named = stations.select("station_name", "uic_code", stripped(F.lower("station_name")).alias("name"))
    met = held_by(named, "name", asked, "low").join(asked, "low")
    # beginnings are better than other places, and other places count only where there is no beginning
    tier = F.when(F.startswith("name", F.concat("low", F.lit(" "))), 1).otherwise(2)
    all_ = met.join(named, "name").withColumn("tier", tier)
    score = F.greatest(F.lit(0), 30 - F.floor(F.length("name") / 3)) + _points(F.col("name"), HUB_WORDS)
    for city, word, points in reversed(HUBS):
        score = F.when((F.col("low") == city) & F.contains("name", F.lit(word)), points).otherwise(score)
    best = _top(all_.withColumn("hub_score", score.cast("int")), ["city"], [F.asc("tier"), F.desc("hub_score"), F.asc("station_name"), F.asc("uic_code")], 1)
    return best.select("city", F.col("station_name").alias("hub_name"), F.col("uic_code").alias("hub_uic"), "hub_score")


def profile(rows: DataFrame) -> DataFrame:
    """One row per column: ``column, n_rows, n_null, n_different``, all from one pass."""
    asked = [F.count("*").alias("n")]
    for i, c in enumerate(rows.columns):
        asked += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null{i}"), F.count_distinct(F.col(f"`{c}`")).alias(f"diff{i}")]
    one = rows.agg(*asked)
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"null{i}").alias("n_null"), F.col(f"diff{i}").alias("n_different")) for i, c in enumerate(rows.columns)))
    return one.select(F.explode(each).alias("r")).select("r.*")


def sketched_profile(rows: DataFrame, log_registers: int = 14) -> DataFrame:
    """One row per column: ``column, n_rows, n_null, n_different, least_length, median_length, greatest_length``, from one pass without a
    shuffle of values.

    Counts of rows and nulls and the least and greatest length are exact; different values are counted by mergeable HyperLogLog sketches (a
    standard error of ``1.04 / 2^(log_registers / 2)``, 0.8 percent), the median length of the text by a KLL sketch (a rank error
    of about 1.3 percent). A column without values has 0 different ones and null lengths. What is sent is a few KB for each column and
    task, however many values there are; ``profile`` counts exactly.
    """
    asked = [F.count("*").alias("n")]
    for i, c in enumerate(rows.columns):
        text = F.col(f"`{c}`").cast("string")
        length = F.length(text).cast("long")
        asked += [
            F.count_if(text.isNull()).alias(f"null{i}"),
            F.hll_sketch_agg(text, log_registers).alias(f"diff{i}"),
            F.min(length).alias(f"least{i}"),
            F.max(length).alias(f"most{i}"),
            F.kll_sketch_agg_bigint(length).alias(f"kll{i}"),
        ]
    one = rows.agg(*asked)
    row = lambda i, c: F.struct(
        F.lit(c).alias("column"),
        F.col("n").alias("n_rows"),
        F.col(f"null{i}").alias("n_null"),
        F.coalesce(F.hll_sketch_estimate(f"diff{i}"), F.lit(0)).cast("long").alias("n_different"),
        F.col(f"least{i}").alias("least_length"),
        F.when(F.col(f"least{i}").isNotNull(), F.kll_sketch_get_quantile_bigint(F.col(f"kll{i}"), F.lit(0.5))).alias("median_length"),
        F.col(f"most{i}").alias("greatest_length"),
    )
    return one.select(F.explode(F.array(*(row(i, c) for i, c in enumerate(rows.columns)))).alias("r")).select("r.*")


def first_rows(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first rows in the order of the columns, nulls first."""
    return rows.orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in rows.columns)).limit(n)
