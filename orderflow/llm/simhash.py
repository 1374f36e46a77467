"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are cut into five segments on a ring. If two fingerprints differ in at most
``d = 2`` bits, some segment starts a chain whose every prefix of ``l`` segments differs in at most
``l * d / 5`` bits: 0 after one and two segments, 1 after three and four, 2 after all. So each
fingerprint is dealt by five keys, the pairs of neighbouring segments (26 bits), the third and fourth
prefix are tested on what meets, and only then the whole Hamming distance.

Copies cost nothing here: equal fingerprints are one row from the start. A bucket with more than
``hot_bucket`` different fingerprints is not joined with itself; its members name every
value within one bit of theirs outside the two equal segments (39 values). Two of them are within two
bits of each other just if they name a common value, and at most 39 fingerprints name the same one, so
such a bucket costs rows in proportion to its members and loses no link.

Where an exact check follows, more bits may differ (``wide_pairs``): seven segments and six bits, so that the budgets of one, two and three
segments are 0, 1 and 2 bits. Members name what the three segments hold (27 bits) and all within one bit of it in the last
two; two that keep the budgets name a common value.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from orderflow.llm._shared import drop_written, met_by, table, unsent, written
from orderflow.llm.components import connected_components

SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
MAX_BITS = 2
WIDE_SEGMENTS = ((0, 9), (9, 9), (18, 9), (27, 9), (36, 9), (45, 9), (54, 10))
WIDE_BITS = 6
SEED = 42


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits that over half of the hashes have, as a signed long; the hashes come in slices."""
    counts, n = np.zeros(64, np.int64), 0
    for h in hashes:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprint_of(text: bytes, width: int = 3) -> int:
    """The SimHash of one UTF-8 text as a signed long; a text without words has 0."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks only
    if not words:
        return 0
    if len(words) < width:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(width)))), len(words) - width + 1
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    return majority(np.fromiter(map(digest, islice(shingles, 65536)), np.uint64, min(left, 65536)) for left in range(n, 0, -65536))


@F.arrow_udf(LongType())
def simhash(text: pa.Array) -> pa.Array:
    """Fingerprint of each text; null has no words."""
    return pa.array([fingerprint_of(x or b"") for x in text.cast(pa.binary()).to_pylist()], pa.int64())


def _segment(fp: Column, i: int) -> Column:
    at, width = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _chain_keys(fp: Column) -> Column:
    """The five chains of two segments, each a start and the 26 bits (or 25) that must be equal."""
    return F.array(
        *(
            F.struct(F.lit(i).alias("start"), F.shiftleft(_segment(fp, i), 13).bitwiseOR(_segment(fp, i + 1)).alias("key"))
            for i in range(len(SEGMENTS))
        )
    )


def _within_budget(x: Column, start: Column, max_bits: int) -> Column:
    """Whether the differing bits ``x`` keep the budget of each longer prefix of the chain from ``start``."""
    n, out = len(SEGMENTS), F.lit(False)
    for i in range(n):
        third = F.bit_count(_segment(x, i + 2))
        fourth = third + F.bit_count(_segment(x, i + 3))
        fits = (third <= 3 * max_bits // n) & (fourth <= 4 * max_bits // n) & (F.bit_count(x) <= max_bits)
        out = F.when(start == i, fits).otherwise(out)
    return out


def _near_values(fp: Column, start: int) -> Column:
    """fp, and fp with one bit flipped outside the two segments of the chain."""
    held = {(start + k) % len(SEGMENTS) for k in (0, 1)}
    bits = [at + b for i, (at, width) in enumerate(SEGMENTS) if i not in held for b in range(width)]
    masks = [0] + [(1 << b) - (1 << 64 if b == 63 else 0) for b in bits]
    return F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: fp.bitwiseXOR(m))


def near_links(fingerprints: DataFrame, hot_bucket: int = 64) -> DataFrame:
    """Distinct fingerprints ``fp`` (long) to links ``(u, v)`` that connect all within two bits.

    Not every link is given: what differs in at most two bits is connected through given ones, and every
    given one is within two bits.
    """
    dealt = fingerprints.select("fp", F.explode(_chain_keys(F.col("fp"))).alias("c")).select("fp", "c.start", "c.key")
    sizes = dealt.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(dealt.join(unsent(sizes), ["start", "key"]), "buckets")
    few, many = met.where(F.col("n") <= hot_bucket), met.where(F.col("n") > hot_bucket)
    pairs = (
        few.select("start", "key", F.col("fp").alias("u"))
        .join(unsent(few.select("start", "key", F.col("fp").alias("v"))), ["start", "key"])
        .where(F.col("u") > F.col("v"))
        .where(_within_budget(F.col("u").bitwiseXOR(F.col("v")), F.col("start"), MAX_BITS))
        .select("u", "v")
    )
    values = F.when(F.lit(False), F.array().cast("array<long>"))
    for i in range(len(SEGMENTS)):
        values = values.when(F.col("start") == i, _near_values(F.col("fp"), i))
    stars = (
        many.select("fp", "start", F.explode(values).alias("value"))
        .groupBy("value", "start")
        .agg(F.collect_set("fp").alias("near"))
        .where(F.size("near") > 1)
        .select(F.array_min("near").alias("v"), F.explode("near").alias("u"))
        .where("u != v")
        .select("u", "v")
    )
    return pairs.unionByName(stars)


def _wide_keys(fp: Column) -> Column:
    """The values that a fingerprint names, each with the start of its chain above the 27 or 28 bits."""
    n, out = len(WIDE_SEGMENTS), []
    for i in range(n):
        chain = [WIDE_SEGMENTS[(i + k) % n] for k in range(3)]
        held = fp.bitwiseAND(F.lit(sum((1 << w) - 1 << at for at, w in chain) - (1 << 64 if any(at + w == 64 for at, w in chain) else 0)).cast("long"))
        flips = [0] + [(1 << at + b) - (1 << 64 if at + b == 63 else 0) for at, w in chain[1:] for b in range(w)]
        out += [F.struct(F.lit(i).cast("byte").alias("start"), held.bitwiseXOR(F.lit(m).cast("long")).alias("value")) for m in flips]
    return F.array(*out)


def _keeps_budgets(x: Column, start: Column) -> Column:
    """Whether the differing bits ``x`` keep the budget of each prefix of the chain from ``start``, the whole ring included."""
    n, out = len(WIDE_SEGMENTS), F.lit(False)
    for i in range(n):
        fits, spent = F.bit_count(x) <= WIDE_BITS, F.lit(0)
        for k in range(n - 1):
            at, width = WIDE_SEGMENTS[(i + k) % n]
            spent = spent + F.bit_count(F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
            fits = fits & (spent <= (k + 1) * WIDE_BITS // n)
        out = F.when(start == i, fits).otherwise(out)
    return out


def wide_pairs(fingerprints: DataFrame, few: int = 8) -> DataFrame:
    """Distinct fingerprints ``fp`` (long) to pairs ``(u, v)``, ``u > v``, of those within six bits, as candidates of an exact check.

    Every pair that meets in a bucket of at most ``few`` is given. In a larger bucket each member meets the smallest one only, so that a
    group of copies costs rows in proportion to its size; the caller has another way to what that leaves.
    """
    # a file of fingerprints is small, what they name is not
    spread = fingerprints.repartition(int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    dealt = spread.select("fp", F.explode(_wide_keys(F.col("fp"))).alias("c")).select("fp", "c.start", "c.value")
    met = dealt.groupBy("start", "value").agg(F.count("*").alias("n"), F.max("fp").alias("u"), F.min("fp").alias("v")).where("n > 1")
    met = written(met, "rings")
    more = written(met_by(dealt, met.where("n > 2").select("start", "value", "n", "v"), ["start", "value"]), "rings")
    some = more.where(F.col("n") <= few)
    x, y = (some.select("start", "value", F.col("fp").alias(k)) for k in "uv")
    pairs = met.where("n = 2").select("start", "u", "v").unionByName(x.join(unsent(y), ["start", "value"]).where("u > v").select("start", "u", "v"))
    pairs = pairs.unionByName(more.where((F.col("n") > few) & (F.col("fp") != F.col("v"))).select("start", F.col("fp").alias("u"), "v"))
    out = written(pairs.where(_keeps_budgets(F.col("u").bitwiseXOR(F.col("v")), F.col("start"))).select("u", "v").distinct(), "near")
    for done in (met, more):
        drop_written(done)
    return out


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, fp, component_id, keep_id, keep_hash``.

    ``component_id`` is the smallest id reachable over links of two differing bits or fewer, itself included.
    Rows with a null id take part: they get the id of their component, null if it has none.
    A null text has no words; its fingerprint is zero and links like any other. Repeated rows are
    each given. ``keep_id, keep_hash`` name the row of the component to keep: the smallest id (nulls last),
    then the smallest text hash.
    """
    marked = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.xxhash64(F.col(text_col)).alias("text_hash"),
            simhash(F.col(text_col)).alias("fp"),
        ),
        "fingerprints",
    )
    first = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    groups = marked.groupBy("fp").agg(F.min(first).alias("first"))
    roots = connected_components(near_links(groups.select("fp")))
    placed = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    classes = placed.join(heads, "root").select("fp", "head")
    return marked.join(classes, "fp").select(
        "doc_id",
        "text_hash",
        "fp",
        F.col("head.id").alias("component_id"),
        F.col("head.id").alias("keep_id"),
        F.col("head.hash").alias("keep_hash"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=near_duplicate_classes) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates, as ``classes`` finds them; columns as they were.

    The row with the smallest id stays (rows without an id last); of repeats of that very row, one.
    """
    kept = classes(docs, id_col, text_col).where(
        F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash"))
    )
    kept = kept.groupBy(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).agg(F.count("*").alias("times"))
    kept = written(kept, "kept")
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(id_col).cast("long").alias("own_id"),
        F.xxhash64(F.col(text_col)).alias("own_hash"),
    )
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("kept_hash"))
    single = own.join(kept.where("times = 1"), same, "left_semi").select("row")
    # repeats of one row meet before they are shuffled, however many there are; other texts are not moved for them
    repeated = own.join(kept.where("times > 1"), same, "left_semi").groupBy("own_id", "own_hash").agg(F.first("row").alias("row"))
    return single.unionByName(repeated.select("row")).select("row.*")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id of its near-duplicates."""
    return near_duplicate_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
