"""Itineraries with stations on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.functions.geo import great_circle_km

# Fixed values.
LABELS = ("Départ", "Étape", "Arrivée")


def itineraries(orders: DataFrame) -> DataFrame:
    """``order_id, departure, via, arrival`` (stations as structs, via an array or null) to one row per point.

    Columns: ``order_id, pos, label, station, distance_km`` from the point before, 0 at the first. The points of an order
    stand in one row already, so nothing is shuffled.
    """
    points = F.concat(F.array("departure"), F.coalesce("via", F.array()), F.array("arrival"))
    last = F.size("points") - 1
    at = lambda i: F.get("points", i)
    steps = F.transform(
        "points",
        lambda p, i: F.struct(
            i.alias("pos"),
            F.when(i == 0, LABELS[0]).when(i == last, LABELS[2]).otherwise(LABELS[1]).alias("label"),
            p.alias("station"),
            F.when(i == 0, 0.0).otherwise(great_circle_km(at(i - 1)["latitude"], at(i - 1)["longitude"], p["latitude"], p["longitude"])).alias("distance_km"),
        ),
    )
    return orders.select("order_id", points.alias("points")).select("order_id", F.explode(steps).alias("s")).select("order_id", "s.*")
