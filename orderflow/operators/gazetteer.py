"""Mentions of dictionary names in free text: longest first, none over another.

Names of up to ``SHIPPED_BYTES`` are compiled to an automaton that each task reads its texts with, once, whatever their number; no text is
shuffled. Of a larger dictionary tasks get a Bloom filter of fixed size, and only runs of tokens that pass it are looked up by an equi-join.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from orderflow.functions.text import name_variants
from orderflow.sources.scratch import spread, stored

#: Runs of letters and digits, and single signs.
_TOKEN = re.compile(r"[^\W_]+|[^\w \t\n\x0b\f\r]|_")
#: Names, as bytes of their token keys, up to which the dictionary goes to all tasks as an automaton.
SHIPPED_BYTES = 8 << 20
#: Bits of the Bloom filter of a larger dictionary, 8 MB, and hashes of a key.
FILTER_BITS, FILTER_HASHES = 26, 3
_END = "\x01"
_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
_RUNS = ArrayType(StructType([StructField("key", StringType()), StructField("n", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def longest_names(stations: DataFrame, limit: int = 600) -> DataFrame:
    """The different station names, longest first; of equal lengths by name."""
    names = stations.where("station_name IS NOT NULL").select(F.col("station_name").cast("string").alias("name")).distinct()
    return names.orderBy(F.length("name").desc(), "name").limit(limit)


def _tokens(text: str, ignore_case: bool) -> tuple[list[str], list[int], list[int]]:
    """Tokens, and the places where they begin and end."""
    found = list(_TOKEN.finditer(text))
    return [m[0].lower() if ignore_case else m[0] for m in found], [m.start() for m in found], [m.end() for m in found]


def _keys(names: DataFrame, ignore_case: bool) -> DataFrame:
    """Dictionary names and their variants as token keys: ``key, n``."""

    @F.pandas_udf(StringType())
    def key_of(v: pd.Series) -> pd.Series:
        return v.map(lambda x: _END.join(_tokens(x, ignore_case)[0]))

    each = names.select(F.explode(name_variants(F.col("name"))).alias("v")).select(key_of("v").alias("key")).where("key != ''").distinct()
    return each.withColumn("n", F.length("key") - F.length(F.replace("key", F.lit(_END), F.lit(""))) + 1)


def _free(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of spans ``-tokens, start, end`` that overlap the longest in tokens, then the first; in text order."""
    spans.sort()
    taken: list[tuple[int, int]] = []
    held: set[int] = set()
    for _, start, end in spans:
        if held.isdisjoint(range(start, end)):
            held.update(range(start, end))
            taken.append((start, end))
    return sorted(taken)


@lru_cache(maxsize=4)
def _automaton(keys: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for key in keys:
        out.add_word(f"{_END}{key}{_END}", key.count(_END) + 1)
    if keys:
        out.make_automaton()
    return out


def _by_automaton(keys, ignore_case: bool):
    """A function of texts to their free spans. ``keys`` is a broadcast of the names' keys."""

    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        known, out = _automaton(keys.value), []
        for text in texts:
            tokens, starts, ends = _tokens(text, ignore_case)
            found: list[tuple[int, int, int]] = []
            if tokens and len(known):
                said = _END + _END.join(tokens) + _END
                at = {p: k for k, p in enumerate(np.cumsum([len(t) + 1 for t in tokens]).tolist())}
                found = [(-n, starts[at[p] - n + 1], ends[at[p]]) for p, n in known.iter(said)]
            out.append([{"start": a, "end": b} for a, b in _free(found)])
        return pd.Series(out, dtype=object)

    return spans.asNondeterministic()  # else a filter on the spans would have each text read twice


def _places(key: str) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key.encode())
    low, high = h & (1 << 64) - 1, h >> 64
    return [((low + k * high) & (1 << 64) - 1) >> (64 - FILTER_BITS) for k in range(FILTER_HASHES)]


def bloom_filter(keys: DataFrame) -> np.ndarray:
    """The Bloom filter of a table's ``key``: 8 MB, however many there are; a full one lets all pass."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def places(key: pd.Series) -> pd.Series:
        return key.map(_places)

    at = keys.select(F.explode(places("key")).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words.column("i").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _by_filter(rows: DataFrame, keys: DataFrame, ignore_case: bool) -> DataFrame:
    """Rows with a ``rid`` to ``rid, spans``: runs of tokens that pass the filter are looked up among all keys."""
    sizes = sorted(r.n for r in keys.select("n").distinct().collect())  # as many as the longest name has tokens
    bits = rows.sparkSession.sparkContext.broadcast(bloom_filter(keys))

    @F.pandas_udf(_RUNS)
    def runs(texts: pd.Series) -> pd.Series:
        out, known = [], bits.value
        passes = lambda key: all(int(known[p >> 6]) >> (p & 63) & 1 for p in _places(key))
        for text in texts:
            tokens, starts, ends = _tokens(text, ignore_case)
            every = ((_END.join(tokens[i : i + n]), n, starts[i], ends[i + n - 1]) for n in sizes for i in range(len(tokens) - n + 1))
            out.append([{"key": k, "n": n, "start": a, "end": b} for k, n, a, b in every if passes(k)])
        return pd.Series(out, dtype=object)

    @F.pandas_udf(_SPANS)
    def free(found: pd.Series) -> pd.Series:
        return found.map(lambda spans: [{"start": a, "end": b} for a, b in _free([(-s["n"], s["start"], s["end"]) for s in spans])])

    met = rows.select("rid", F.inline(runs.asNondeterministic()("text"))).join(keys, ["key", "n"], "left_semi")
    return met.groupBy("rid").agg(F.collect_list(F.struct("n", "start", "end")).alias("found")).select("rid", free("found").alias("spans"))


def with_mentions(texts: DataFrame, names: DataFrame, ignore_case: bool = False, text_col: str = "sentence") -> DataFrame:
    """Every row of ``texts`` as ``row`` with its ``text`` and ``spans``, the places of dictionary names (``name``, with their variants) in
    text order. Null and empty texts have none."""
    rows = spread(texts).select(F.struct(*(F.col(f"`{c}`") for c in texts.columns)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = stored(_keys(names, ignore_case))
    size = keys.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    if size <= SHIPPED_BYTES:
        sent = rows.sparkSession.sparkContext.broadcast(tuple(sorted(r.key for r in keys.select("key").collect())))
        return rows.withColumn("spans", _by_automaton(sent, ignore_case)("text"))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()))
    found = _by_filter(rows, keys, ignore_case)
    return rows.join(found, "rid", "left").select("row", "text", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def mentions(texts: DataFrame, names: DataFrame, ignore_case: bool = False, id_col: str = "order_id", text_col: str = "sentence") -> DataFrame:
    """Spans of dictionary names (``name``, with their variants) in ``texts``: id, ``text, start, end``.

    Tokens are runs of letters and digits, and single signs. Of overlapping spans the longest stays, then the first.
    Texts and names may both be large. Each row of a repeated or null id has its own mentions; null and empty texts have none.
    """
    found = with_mentions(texts, names, ignore_case, text_col).select(F.col(f"row.`{id_col}`").alias(id_col), F.col("text").alias("__text"), F.inline("spans"))
    return found.select(id_col, F.substring("__text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "start", "end")


def first_two(found: DataFrame, id_col: str = "order_id") -> DataFrame:
    """Mentions to ``id, departure, destination``: the first two that differ beyond case, in text order; others go.

    Mentions of one id are taken for those of one text; see ``row_pairs`` where ids are null or repeated.
    """
    once = found.groupBy(id_col, F.lower("text").alias("__low")).agg(F.min(F.struct("start", "text")).alias("m"))
    ordered = once.groupBy(id_col).agg(F.array_sort(F.collect_list("m")).alias("m")).where(F.size("m") >= 2)
    return ordered.select(id_col, F.col("m")[0]["text"].alias("departure"), F.col("m")[1]["text"].alias("destination"))


def row_pairs(texts: DataFrame, names: DataFrame, text_col: str = "sentence") -> DataFrame:
    """Every row of ``texts`` as ``row`` with the first two names its text mentions: ``departure, destination``, else null."""
    said = F.transform("spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    rows = with_mentions(texts, names, text_col=text_col).select("row", said.alias("said"))
    first = F.get("said", F.lit(0))
    second = F.get(F.filter("said", lambda x: F.lower(x) != F.lower(first)), F.lit(0))
    return rows.select("row", F.when(second.isNotNull(), first).alias("departure"), second.alias("destination"))
