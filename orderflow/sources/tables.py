"""Readers and writers: order lines, labelled rows, stations, timetables, dictionaries, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.functions.text import coordinates, norm_french, stripped
from orderflow.sources.records import PLACE, csv_records

LABELLED = "sentence_id string, sentence string, expected_dep string, expected_dest string, expected_valid int"
# Headers of the raw station list and our names for them.
RAW_STATIONS = {"Nom": "station_name", "Trigramme": "trigram", "Position géographique": "position", "Code(s) UIC": "uic_code"}
STATION_COLUMNS = ("station_name", "uic_code", "latitude", "longitude")
TIMETABLE = {
    "stops": ("stop_id", "stop_name", "stop_code"),
    "stop_times": ("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"),
    "trips": ("trip_id", "route_id"),
    "routes": ("route_id",),
}


def order_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """``id,sentence`` lines, cut at the first comma, to ``order_id, sentence, status``; blank lines go.

    A line without a comma keeps its whole text as id and has status INVALID_FORMAT. Blanks of any kind are no part of an id
    or a sentence at their ends. ``place`` is kept where lines have one (``records.placed_lines``).
    """
    line = stripped(F.col(col))
    parts, has = F.split(line, ",", 2), F.contains(line, F.lit(","))
    return lines.where(line != "").select(
        stripped(parts[0]).alias("order_id"),
        F.when(has, stripped(F.get(parts, F.lit(1)))).alias("sentence"),
        F.when(has, F.lit("OK")).otherwise(F.lit("INVALID_FORMAT")).alias("status"),
        *(c for c in lines.columns if c == "place"),
    )


def triplets(lines: DataFrame, col: str = "value") -> DataFrame:
    """``id,departure,destination`` lines, cut at two commas at most; lines without three non-empty parts go."""
    parts = F.transform(F.split(F.col(col), ",", 3), lambda x: stripped(x))
    names = ("order_id", "departure", "destination")
    rows = lines.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))
    return rows.where(" AND ".join(f"{n} != ''" for n in names))


def valid_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Result lines without an INVALID answer."""
    return lines.where(~F.contains(F.col(col), F.lit(",INVALID")))


def labelled_rows(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    """Labelled sentences of CSV files with header; a blank expectation is null.

    With ``placed`` rows have a ``place`` that sorts them in input order, sentences may hold line ends, and columns are found by name.
    """
    blank = lambda c: F.nullif(stripped(F.col(c)), F.lit("")).alias(c)
    if placed:
        rows = csv_records(spark, path, tuple(c.split()[0] for c in LABELLED.split(", ")))
        rows = rows.withColumns({"expected_valid": F.expr("try_cast(expected_valid AS INT)"), "place": F.struct(*PLACE)})
    else:
        rows = spark.read.schema(LABELLED).option("header", True).option("escape", '"').csv(path)
    return rows.select("sentence_id", "sentence", blank("expected_dep"), blank("expected_dest"), "expected_valid", *(["place"] if placed else []))


def benchmark_rows(spark: SparkSession, path: str) -> DataFrame:
    """The first two fields of a CSV file without header; rows with a blank one go."""
    rows = spark.read.schema("order_id string, sentence string").option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return rows.select(*(stripped(F.col(c)).alias(c) for c in ("order_id", "sentence"))).where("order_id != '' AND sentence != ''")


def raw_stations(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """The raw station list with our names; without ``sep`` the delimiter is the one that the header line has most of."""
    if sep is None:
        head = spark.read.text(path).limit(1).first()
        line = head.value if head else ""
        sep = max(";,\t|", key=line.count)
    rows = spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    rows = rows.toDF(*(" ".join(c.replace("﻿", "").split()) for c in rows.columns))
    missing = [c for c in RAW_STATIONS if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return rows.select(*(F.col(f"`{c}`").alias(n) for c, n in RAW_STATIONS.items()))


def clean_stations(raw: DataFrame) -> DataFrame:
    """Raw stations with coordinates as numbers; rows without a name or a coordinate go."""
    at = coordinates(F.col("position"))
    rows = raw.select("station_name", "trigram", "uic_code", at["latitude"].alias("latitude"), at["longitude"].alias("longitude"))
    return rows.na.drop(subset=["station_name", "latitude", "longitude"])


def stations(rows: DataFrame) -> DataFrame:
    """Clean stations with their normal name; raises if a column is missing."""
    missing = [c for c in STATION_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return rows.withColumn("station_norm", norm_french(F.col("station_name")))


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV files with header."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def timetable(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a timetable folder, all columns as text; quoted fields may hold commas, quotes and line ends, and large files
    are read in parts all the same. Only columns that are used are read."""
    return timetable_of(**{t: csv_records(spark, f"{folder}/{t}.txt", columns) for t, columns in TIMETABLE.items()})


def timetable_of(stops: DataFrame, stop_times: DataFrame, trips: DataFrame, routes: DataFrame | None = None) -> dict[str, DataFrame]:
    """Timetable tables with their columns as text, blank for null, and normal stop names.

    Only ``stop_code`` may be missing, and is blank then; another missing column raises.
    """
    given = {"stops": stops, "stop_times": stop_times, "trips": trips} | ({"routes": routes} if routes is not None else {})
    missing = [f"{t}.{c}" for t, rows in given.items() for c in TIMETABLE[t] if c not in rows.columns and c != "stop_code"]
    if missing:
        raise ValueError(f"columns are missing: {missing}")

    def text(rows: DataFrame, c: str) -> Column:
        return (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(c)

    out = {t: rows.select(*(text(rows, c) for c in TIMETABLE[t])) for t, rows in given.items()}
    out["stops"] = out["stops"].withColumn("stop_name_norm", norm_french(F.col("stop_name")))
    return out


def dictionary(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """Entries of a dictionary file, one a line, trimmed; with ``comments`` lines that begin with # go."""
    rows = spark.read.text(path).select(stripped(F.col("value")).alias("city")).where("city != ''")
    return rows.where(~F.col("city").startswith("#")) if comments else rows


def order_answers(orders: DataFrame) -> DataFrame:
    """``order_id, status, departure, destination`` to one line each: the pair, or the reason why there is none. ``place`` is kept if there."""
    pair = F.concat_ws(",", "order_id", "departure", "destination")
    line = F.when(F.col("status") == "OK", pair).otherwise(F.concat_ws(",", "order_id", "status"))
    return orders.select("order_id", line.alias("line"), *(c for c in orders.columns if c == "place"))


def schedule_lines(answers: DataFrame) -> DataFrame:
    """Schedule answers to lines ``order_id, line_no, line``: the route and then the journey, or one line that there is none.

    The stop of a transfer is a step of the route.
    """
    line = lambda *parts: F.concat_ws(",", "order_id", *parts)
    direct = line(F.lit("SCHEDULE"), F.lit("DIRECT"), "departure", "destination", "dep1", "arr1", "trip1", "from_name", "to_name")
    transfer = line(F.lit("SCHEDULE"), F.lit("1_TRANSFER"), "departure", "destination", "dep1", "arr1", "trip1", "dep2", "arr2", "trip2", "from_name", "transfer_name", "to_name")
    lines = (
        F.when(F.col("kind") == "direct", F.array(line("departure", "destination"), direct))
        .when(F.col("kind") == "transfer", F.array(line("departure", "transfer_name", "destination"), transfer))
        .otherwise(F.array(line(F.lit("NO_SCHEDULE_FOUND"), "departure", "destination")))
    )
    return answers.select("order_id", F.posexplode(lines).alias("line_no", "line"))
