"""Departure and destination of travel orders: keyword filter, slots by pattern, dictionary match.

All matching is done on the different slots and joined back, so a slot that a million orders share costs one match. Orders are
rows and not ids: ids may be null or repeated, and every row of the input has its own row in the result.
"""

from __future__ import annotations

import hashlib
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.functions.fuzzy import Names, best_matches
from orderflow.functions.text import clean_slot, norm_ascii, stripped
from orderflow.operators import fuzzy_index
from orderflow.operators.containment import held_by
from orderflow.operators.lookup import heavy_keys, looked_up
from orderflow.sources.scratch import spread, stored

# Fixed values.
KEYWORDS = ("a", "de", "rendre", "bus", "vers")
TO = "(?:a|à)"
VERBS = "(?:aller|vais|va|allons|allez)"
LEAST_SENTENCE = 4
LEAST_SLOT = 3
LEAST_SCORE = 85.0
MOST_GAP = 4
#: Names shipped to a task at once; a larger dictionary is matched in blocks.
BLOCK_NAMES = 20_000
#: Names that each task of a stream holds, and answers for slots that it keeps.
STREAM_NAMES, STREAM_SLOTS = 200_000, 100_000

#: In order: pattern, group of the departure, group of the destination. The first that matches decides.
PATTERNS = (
    *((rf"(?iUd)\b{word}\s+(.+?)\s+{link}\s+(.+?)\b", 1, 2) for word, link in (("de", TO), ("depuis", TO), ("de", "vers"))),
    *((rf"(?iUd)\b{verb}\s+{TO}\s+(.+?)\s+depuis\s+(.+?)\b", 2, 1) for verb in (VERBS, "rendre")),
)


def is_about_travel(sentence: Column) -> Column:
    """Whether the normal form holds any keyword, as a part of a word too."""
    # a keyword in the text as it is stays in the normal form, so most sentences need not be normalised
    return F.contains(F.lower(sentence), F.lit(KEYWORDS[0])) | norm_ascii(sentence).rlike("|".join(KEYWORDS))


def slots(sentence: Column) -> Column:
    """Struct of the cleaned departure and destination slots of the first pattern that matches; null if none does."""
    out = F.lit(None).cast("struct<dep:string,dest:string>")
    for pattern, dep, dest in reversed(PATTERNS):
        part = lambda g: clean_slot(F.regexp_extract(sentence, pattern, g))  # noqa: E731, B023
        out = F.when(sentence.rlike(pattern), F.struct(part(dep).alias("dep"), part(dest).alias("dest"))).otherwise(out)
    return out


def _found_slots() -> Column:
    """The slots of ``sentence``; null where it is too short, off topic or fits no pattern."""
    text = stripped(F.col("sentence"))
    return F.when((F.length(text) >= LEAST_SENTENCE) & is_about_travel(text), slots(text))


def order_slots(orders: DataFrame) -> DataFrame:
    """``orders`` with ``dep_slot, dest_slot``; null where the sentence is too short, off topic or fits no pattern."""
    found = orders.withColumn("__slots", _found_slots())
    return found.select(*(F.col(f"`{c}`") for c in orders.columns), F.col("__slots.dep").alias("dep_slot"), F.col("__slots.dest").alias("dest_slot"))


def city_names(cities: DataFrame) -> DataFrame:
    """A dictionary ``city`` to ``city, city_norm``; of names with the same normal form the last by name stays."""
    return cities.select("city", norm_ascii(F.col("city")).alias("city_norm")).where("city_norm != ''").groupBy("city_norm").agg(F.max("city").alias("city"))


def contained_cities(slots_: DataFrame, cities: DataFrame) -> DataFrame:
    """Different normal ``slot`` values to ``slot, city, n_cities`` for those that hold names of the dictionary.

    ``city`` is set if there is just one. The pairs come from an equi-join on parts of the slots.
    """
    names = city_names(cities)
    met = held_by(slots_, "slot", names, "city_norm").join(names, "city_norm")
    return met.groupBy("slot").agg(F.count("*").alias("n_cities"), F.min("city").alias("city")).select("slot", F.when(F.col("n_cities") == 1, F.col("city")).alias("city"), "n_cities")


def _searched(slots_: DataFrame, names: DataFrame, least: float, block_names: int, indexed: bool | None, most_gap: int | None) -> DataFrame:
    """``fuzzy_cities`` for slots that have no close name, from ``city_names``; of the index only those that have a name."""
    size = names.count() if indexed is None else None
    if indexed or least >= fuzzy_index.LEAST and size is not None and size > BLOCK_NAMES:
        slots_ = slots_ if most_gap is None else stored(fuzzy_index.with_near_lengths(slots_, names, most_gap))
        return fuzzy_index.near_cities(slots_, names).where(F.col("score") >= least)
    n, best = max(1, ceil((names.count() if size is None else size) / block_names)), None
    for b in range(n):
        rows = names.where(F.pmod(F.xxhash64("city_norm"), F.lit(n)) == b).collect()
        known = [(k, r.city_norm, r.city) for k, r in enumerate(sorted(rows, key=lambda r: r.city_norm))]
        got = slots_.select("slot").mapInPandas(best_matches(known, least, most_gap if n == 1 else None), "score double, name_order int, city_norm string, city string, slot string")
        best = got if best is None else best.unionByName(got)
    if n > 1:
        best = best.groupBy("slot").agg(F.min_by(F.struct("score", "city_norm", "city"), F.struct(-F.col("score"), "city_norm")).alias("r")).select("slot", "r.*")
    return best.select("slot", "score", "city_norm", "city")


def fuzzy_cities(
    slots_: DataFrame, cities: DataFrame, least: float = 0.0, block_names: int = BLOCK_NAMES, indexed: bool | None = None, most_gap: int | None = None
) -> DataFrame:
    """Different normal ``slot`` values to their best name ``slot, score, city_norm, city``.

    A slot whose best score is below ``least`` has score 0 and no name, and so has one whose best name is longer or shorter by more than
    ``most_gap`` letters, if that is given. On equal scores the first name by its normal form wins.

    From a least score of ``fuzzy_index.LEAST`` on, names that differ by a letter or two are looked up first (``fuzzy_index.closest``); what follows is for
    the slots whose best name that does not prove. A dictionary of more than ``BLOCK_NAMES`` names is searched by an index over letters; neither
    slots nor names pass the driver (``indexed`` decides in place of the size). A smaller one is counted and goes to all tasks, where scores are
    computed for names whose bound by common letters allows a better one, the best first. Below that score no index has a proven bound, and a larger dictionary goes in blocks.
    """
    names = city_names(cities)
    if least < fuzzy_index.LEAST:
        found = _searched(slots_, names, least, block_names, indexed, None)
    else:
        names, slots_ = stored(names), stored(slots_.select("slot"))
        close = stored(fuzzy_index.closest(slots_, names).where(F.col("score") >= least))
        found = _searched(slots_.join(close, "slot", "left_anti"), names, least, block_names, indexed, most_gap).select("slot", "score", "city_norm", "city")
        proven = close.join(names, "city_norm").select("slot", "score", "city_norm", "city")
        several = names.where(F.contains("city_norm", F.lit(" ")))
        if not several.isEmpty():
            # a name of several words may still be better than one of one word
            more = fuzzy_index.near_cities(close.where("NOT whole").select("slot"), several)
            proven = proven.unionByName(more).groupBy("slot").agg(F.min_by(F.struct("score", "city_norm", "city"), F.struct(-F.col("score"), "city_norm")).alias("r")).select("slot", "r.*")
        found = found.unionByName(proven)
    if most_gap is not None:
        found = found.where(F.abs(F.length("city_norm") - F.length("slot")) <= most_gap)
    found = found.where(F.col("score") > 0)
    return slots_.select("slot").join(found, "slot", "left").select("slot", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("city_norm", F.lit("")).alias("city_norm"), F.coalesce("city", F.lit("")).alias("city"))


def match_cities(slots_: DataFrame, cities: DataFrame) -> DataFrame:
    """Different ``slot`` values to ``slot, city``: the one name they hold, or the best name if near enough, or null.

    A slot that holds several names is ambiguous. The gap of lengths is tested on the best name only.
    """
    own = slots_.select("slot", norm_ascii(F.col("slot")).alias("norm"))
    norms = own.where(F.length("norm") >= LEAST_SLOT).select(F.col("norm").alias("slot")).distinct()
    held = stored(contained_cities(norms, cities))
    rest = norms.join(held, "slot", "left_anti")
    near = fuzzy_cities(rest, cities, LEAST_SCORE, most_gap=MOST_GAP).where(F.col("score") >= LEAST_SCORE)
    found = held.select("slot", "city").unionByName(near.select("slot", "city")).where("city IS NOT NULL")
    return own.join(found.withColumnRenamed("slot", "norm"), "norm", "left").select("slot", "city")


class SlotMatcher:
    """``match_cities`` for one normal slot after another, for streams: the dictionary goes to each task, so it has at most ``STREAM_NAMES`` names.

    ``digest`` tells dictionaries apart.
    """

    def __init__(self, cities: DataFrame):
        rows = city_names(cities).limit(STREAM_NAMES + 1).collect()
        if len(rows) > STREAM_NAMES:
            raise ValueError(f"a stream's own matching takes up to {STREAM_NAMES} names; resolve_stream takes more")
        self.names = sorted((r.city_norm, r.city) for r in rows)
        self.digest = hashlib.sha256(repr(self.names).encode()).hexdigest()

    def city(self, norm: str | None) -> str | None:
        """The one name that the slot holds, or the nearest if near enough; null if it holds several or none is near."""
        if norm is None or len(norm) < LEAST_SLOT:
            return None
        known, lengths, near, seen = self._compiled()
        if norm not in seen:
            if len(seen) >= STREAM_SLOTS:
                seen.clear()
            parts = {norm[i : i + n] for n in lengths for i in range(len(norm) - n + 1)}
            held = [known[p] for p in parts if p in known]
            if held:
                seen[norm] = held[0] if len(held) == 1 else None
            else:
                seen[norm] = (near.closest(norm) or near.best(norm, LEAST_SCORE, MOST_GAP))[3] or None
        return seen[norm]

    def _compiled(self) -> tuple[dict[str, str], list[int], Names, dict[str, str | None]]:
        """What a task makes of the names, once for each dictionary: names, their lengths, what finds near ones, and answers."""
        if self.digest not in _COMPILED:
            _COMPILED.clear()
            near = Names([(k, norm, city) for k, (norm, city) in enumerate(self.names)])
            _COMPILED[self.digest] = dict(self.names), sorted({len(n) for n, _ in self.names}), near, {}
        return _COMPILED[self.digest]


#: The last dictionary of this process, by its digest.
_COMPILED: dict[str, tuple] = {}


def normal_slots(orders: DataFrame) -> DataFrame:
    """``orders`` with ``dep_norm, dest_norm``, the normal forms of their slots; columns only, so for streams too."""
    found = order_slots(orders)
    norms = (norm_ascii(F.col(f"{side}_slot")).alias(f"{side}_norm") for side in ("dep", "dest"))
    return found.select(*(F.col(f"`{c}`") for c in orders.columns), *norms)


def parsed_rows(orders: DataFrame, cities: DataFrame) -> DataFrame:
    """Every row of ``orders`` (with a ``sentence``) as ``row``, with ``departure`` and ``destination``.

    Both are null unless a pattern fits, each slot names one city of the dictionary, and the two differ. Sentences are
    searched once: the slots are stored with the rows, as the search for cities and the lookup both read them.
    """
    rows = spread(orders).select(F.struct(*(F.col(f"`{c}`") for c in orders.columns)).alias("row"), _found_slots().alias("slots"))
    cut = stored(rows.select("row", F.col("slots.dep").alias("dep_slot"), F.col("slots.dest").alias("dest_slot")))
    used = stored(cut.select(F.explode(F.array("dep_slot", "dest_slot")).alias("slot")).where("slot IS NOT NULL").distinct())
    known = stored(match_cities(used, cities).where("city IS NOT NULL"))
    side = lambda name, slot: known.select(F.col("slot").alias(slot), F.col("city").alias(name))
    heavy = heavy_keys(cut, ["dep_slot"], ["dest_slot"])
    both = looked_up(cut, side("departure", "dep_slot"), ["dep_slot"], heavy[0])
    both = looked_up(both, side("destination", "dest_slot"), ["dest_slot"], heavy[1])
    ok = F.coalesce(F.col("departure") != F.col("destination"), F.lit(False))
    return both.select("row", F.when(ok, F.col("departure")).alias("departure"), F.when(ok, F.col("destination")).alias("destination"))


def parse_orders(orders: DataFrame, cities: DataFrame) -> DataFrame:
    """``order_id, sentence`` to ``order_id, sentence, departure, destination, status``, a row each.

    ``status`` is OK, or INVALID: then the pair is null, because no pattern fits, a slot names no
    city or several, or both name the same. A status that is given and is not OK stays. A null or empty
    sentence is INVALID; null and repeated ids are given as they come. A ``place`` that is given stays.
    """
    status = F.when(F.col("departure").isNotNull(), F.lit("OK")).otherwise(F.lit("INVALID"))
    if "status" in orders.columns:
        status = F.when(F.col("row.status") != "OK", F.col("row.status")).otherwise(status)
    place = [F.col("row.place").alias("place")] if "place" in orders.columns else []
    return parsed_rows(orders, cities).select("row.order_id", "row.sentence", "departure", "destination", status.alias("status"), *place)


def route_cities(orders: DataFrame) -> DataFrame:
    """``orders`` with ``route``, the pair as an array, and ``route_status``: INVALID_PATH if an end is blank."""
    dep, dest = (stripped(F.col(c)) for c in ("departure", "destination"))
    fit = F.coalesce((dep != "") & (dest != ""), F.lit(False))
    return orders.withColumns(
        {"route": F.when(fit, F.array(dep, dest)), "route_status": F.when(fit, F.lit("OK")).otherwise(F.lit("INVALID_PATH"))}
    )
