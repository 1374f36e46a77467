"""The flagship job: order sentences to cities, hubs, stops and a timetable answer for each order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.operators.extract import parse_orders
from orderflow.operators.lookup import looked_up
from orderflow.operators.stations import hub_of_city
from orderflow.operators.timetable import MOST_LEGS, answers_between, named, stops_of_stations
from orderflow.sources.scratch import stored

ANSWERS = (
    "order_id", "departure", "destination", "kind", "trip1", "dep1", "arr1", "transfer_stop", "trip2", "dep2", "arr2",
    "from_stop", "to_stop", "from_name", "transfer_name", "to_name", "route1", "route2",
)


def city_stops(cities: DataFrame, stations: DataFrame, stops: DataFrame) -> DataFrame:
    """Different ``city`` values to ``place`` (the city) and ``stop_id``: the stops of its hub's codes, or else, if no stop has
    such a code or no station is its hub, the stops whose name holds the city's."""
    asked = cities.select("city").distinct()
    hubs = hub_of_city(asked, stations).select("city", "hub_uic")
    own = asked.join(hubs, "city", "left").select(F.col("city").alias("station_id"), F.col("city").alias("station_name"), F.col("hub_uic").alias("uic_code"))
    return stops_of_stations(own, stops).withColumnRenamed("station_id", "place")


def answer_triplets(triplets: DataFrame, stations: DataFrame, timetable: dict[str, DataFrame], most_legs: int | None = MOST_LEGS) -> DataFrame:
    """``order_id, departure, destination`` (two cities) to one answer each: ``ANSWERS``.

    ``kind`` is direct, transfer or none. All searching is for the different pairs of cities, and rides are built for
    the different cities; orders only look their pair's answer up. Null and repeated ids are given as they come; an order that
    lacks a city has none. ``most_legs=None`` searches transfers among all rides.
    """
    rows = triplets.select("order_id", "departure", "destination")
    pairs = rows.where("departure IS NOT NULL AND destination IS NOT NULL").select(F.col("departure").alias("from_place"), F.col("destination").alias("to_place")).distinct()
    pairs = stored(pairs.withColumn("query_id", F.struct("from_place", "to_place")))
    cities = pairs.select(F.explode(F.array("from_place", "to_place")).alias("city"))
    places = stored(city_stops(cities, stations, timetable["stops"]))
    found = answers_between(pairs, places, timetable["stop_times"], most_legs)
    found = named(found, timetable, {"trip1": "route1", "trip2": "route2"}, {"from_stop": "from_name", "transfer_stop": "transfer_name", "to_stop": "to_name"})
    found = found.withColumns({"departure": F.col("query_id.from_place"), "destination": F.col("query_id.to_place")}).drop("query_id")
    return looked_up(rows, found, ["departure", "destination"]).withColumn("kind", F.coalesce("kind", F.lit("none"))).select(*ANSWERS)


def answer_orders(
    orders: DataFrame, cities: DataFrame, stations: DataFrame, timetable: dict[str, DataFrame], most_legs: int | None = MOST_LEGS
) -> DataFrame:
    """``order_id, sentence`` to the schedule answer of each valid order, as ``answer_triplets``; each row of a repeated id has its own."""
    parsed = stored(parse_orders(orders, cities).where("status = 'OK'").select("order_id", "departure", "destination"))
    return answer_triplets(parsed, stations, timetable, most_legs)
