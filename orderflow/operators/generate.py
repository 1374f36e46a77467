"""Labelled and noisy orders in any number; each row depends on its id and the seed only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.functions.text import controlled_typo, mild_typo, one_of, uniform, with_noise
from orderflow.sources.scratch import stored

# Wordings.
VALID = (
    "Je veux aller de {dep} à {dest}",
    "Je souhaite me rendre à {dest} depuis {dep}",
    "Je vais à {dest} depuis {dep}",
    "Je veux un trajet de {dep} vers {dest}",
    "Aller de {dep} à {dest} s'il vous plaît",
)
TRASH = ("Bonjour", "Salut", "Merci", "Comment ça va", "Quel temps fait-il", "Je m'appelle Paul", "Paris est une belle ville", "J'aime le train")
AMBIGUOUS = ("Je veux aller de {dep} ou {other} à {dest}", "Je souhaite aller de {dep} à {dest} ou {other}")
GOAL_ONLY = ("Je veux aller à {dest}", "Aller à {dest} s'il te plaît")
ORIGIN_ONLY = ("Je pars de {dep}", "Depuis {dep}")
ORDERS = (
    "Je voudrais aller de {dep} à {dest}",
    "Je veux aller de {dep} à {dest}",
    "Je souhaite me rendre à {dest} depuis {dep}",
    "Comment aller de {dep} vers {dest} ?",
    "Billet de {dep} à {dest}",
    "Un ticket {dep} {dest}",
    "Réserver un train de {dep} à {dest} pour demain",
    "Je pars de {dep} et je vais à {dest}",
    "Des trains en partance de {dep} vers {dest}",
    "Je voudrais un billet {dep}-{dest}",
    "Je veux aller de {dep} à {dest} demain",
    "Je veux aller de {dep} à {dest} ce soir",
    "Je veux aller de {dep} à {dest} lundi",
    "Salut, je veux aller de {dep} à {dest} stp",
    "Je dois rejoindre {dest} en partant de {dep} avec mon ami Albert",
    "Pour le boulot: {dep} -> {dest}",
    "Je voudrais aller de {dep} à {dest} en passant par {other}",
    "Je veux aller de {dep} à {dest} via {other}",
)
NO_ORDERS = (
    "Bonjour",
    "Merci beaucoup",
    "Je suis à la maison",
    "Quel temps fait-il à {dep} ?",
    "J'aime {dep}",
    "Avec mes amis florence et paris je mange une pizza",
    "Je veux aller demain",
    "Train",
    "Je veux un billet",
    "Peux-tu m'aider ?",
    "Je pars",
    "Aller à",
    "de à",
)


def _filled(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def numbered_names(cities: DataFrame) -> DataFrame:
    """Different ``city`` values with their ``place`` in the order of names, from 0; each range of names is numbered for itself."""
    ranged = stored(cities.select("city").where("city IS NOT NULL").distinct().repartitionByRange("city").withColumn("range", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"), F.min("city").alias("first"))
    starts = sizes.select("range", F.coalesce(before, F.lit(0)).alias("start"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("range").orderBy("city"))
    return ranged.join(F.broadcast(starts), "range").select((F.col("start") + own - 1).alias("place"), "city")


def _with_cities(ids: DataFrame, cities: DataFrame, least: int, seed: int) -> DataFrame:
    """``id`` rows with three different cities ``dep, dest, other``: a start, and two steps from it in a list without the start."""
    names = stored(numbered_names(cities))
    n = names.count()
    if n < least:
        raise ValueError(f"at least {least} cities are needed")
    place = lambda salt, size: F.floor(uniform(F.col("id"), salt, seed) * size)
    drawn = ids.select("id", place("first", n).alias("a"), place("second", n - 1).alias("b"), place("third", n - 2).alias("c"))
    a, b, c = (F.col(x) for x in "abc")
    at = {"dep": a, "dest": (a + 1 + b) % n, "other": (a + 1 + F.when(c < b, c).otherwise(c + 1)) % n}
    rows = drawn.select("id", *(x.cast("long").alias(f"{k}_place") for k, x in at.items()))
    for k in at:
        rows = rows.join(names.select(F.col("place").cast("long").alias(f"{k}_place"), F.col("city").alias(k)), f"{k}_place", "left")
    return rows.select("id", *at)


def labelled_orders(ids: DataFrame, cities: DataFrame, seed: int = 42) -> DataFrame:
    """``id`` rows to labelled sentences: 55 % valid, 20 % trash, 15 % incomplete, 10 % ambiguous.

    A quarter of the valid ones have each city mistyped with even odds. ``cities`` has a ``city`` (three different ones at least)
    and may be large.
    """
    key, rows = F.col("id"), _with_cities(ids, cities, 3, seed)
    u = lambda salt: uniform(key, salt, seed)
    dep, dest, other = F.col("dep"), F.col("dest"), F.col("other")
    slip = lambda name, side: F.when((u("slips") < 0.25) & (u(f"slip {side}") < 0.5), mild_typo(name, F.concat_ws(side, key, key), seed)).otherwise(name)
    pick = lambda options, salt: one_of(list(options), u(salt))
    kind = u("kind")
    valid = kind < 0.55
    half = F.when(u("half") < 0.5, pick(GOAL_ONLY, "goal")).otherwise(pick(ORIGIN_ONLY, "origin"))
    text = (
        F.when(valid, _filled(pick(VALID, "valid"), dep=slip(dep, "dep"), dest=slip(dest, "dest")))
        .when(kind < 0.75, pick(TRASH, "trash"))
        .when(kind < 0.90, _filled(half, dep=dep, dest=dest))
        .otherwise(_filled(pick(AMBIGUOUS, "ambiguous"), dep=dep, dest=dest, other=other))
    )
    return rows.select(
        key.cast("string").alias("sentence_id"), text.alias("sentence"), F.when(valid, dep).alias("expected_dep"), F.when(valid, dest).alias("expected_dest"), valid.cast("int").alias("expected_valid")
    )


def noisy_orders(ids: DataFrame, cities: DataFrame, invalid_ratio: float = 0.25, seed: int = 42) -> DataFrame:
    """``id`` rows to ``order_id, sentence`` with controlled typos and noise; five cities at least."""
    key, rows = F.col("id"), _with_cities(ids, cities, 5, seed)
    u = lambda salt: uniform(key, salt, seed)
    slips = {n: controlled_typo(F.col(n), F.concat_ws(n, key, key), seed) for n in ("dep", "dest", "other")}
    wrong = _filled(one_of(list(NO_ORDERS), u("no order")), dep=F.col("dep"))
    right = _filled(one_of(list(ORDERS), u("order")), **slips)
    text = F.when(u("invalid") < invalid_ratio, wrong).otherwise(right)
    name = key.cast("string")
    padded = F.concat(F.lit("S"), F.lpad(name, F.greatest(F.lit(5), F.length(name)), F.lit("0")))
    return with_noise(rows.select(padded.alias("order_id"), text.alias("sentence")), "sentence", F.col("order_id"), seed)
