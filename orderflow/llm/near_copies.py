"""Near copies by the similarity of their word shingles: SimHash with pigeonring, then MinHash bands, find candidates; exact Jaccard confirms them.

A text's shingles are its runs of ``WIDTH`` words. Two texts are near copies if at least ``SIMILAR`` of their different
shingles are common. Texts whose SimHash over these shingles is the same or within six bits are candidates first (``simhash.wide_pairs``), and what
they link is one component from then on. At the least similarity fingerprints differ in about ten bits, more than a pigeonring
over 64 bits can sift without meeting a part of all pairs. So for what is not in one component yet each text is dealt by ``BANDS`` keys of
``ROWS`` least hashes each; a pair at the least similarity shares none of them with probability ``(1 - 0.8^4)^20``, under 3 in 100,000,
and every pair that shares one is confirmed by its whole shingle sets.

A bucket is not joined with itself. Its members are first held against one of them, the one that meets most others in all its
buckets: of a text and its edited copies that is the text, and most copies are linked to it. Members of one component
are never compared again. What of different components is left in a bucket of a few is compared, and
in larger buckets found by an exact prefix join: two sets that are similar enough share one of their rarest shingles, as many as
their sizes leave room for differences. The rarest shingles of a copy that was edited too much are its own, so it
meets nobody. So a large group of copies costs pairs about in proportion to its size, and no link is lost.
"""

from __future__ import annotations

from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from orderflow.llm._shared import drop_written, unsent, written
from orderflow.llm.components import connected_components
from orderflow.llm.simhash import majority, wide_pairs

WIDTH = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 4
SEED = 42
#: Members of a bucket that are compared with each other, if of different components; larger buckets go by prefixes.
FEW = 8
#: Sizes of sets are told apart in steps of this factor where prefixes are cut.
STEP = 1.05
#: Pairs that share a text's set in one task.
LOT = 2048
#: Hashes of texts that are sent to all tasks to pick the texts; more are joined with all texts by a shuffle.
SENT = 500_000

_RNG = np.random.default_rng(SEED)
_FACTORS, _ADDED = (_RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1) for _ in range(2))
_MIX, _BAND = np.uint64(0x9E3779B97F4A7C15), _RNG.integers(0, 1 << 64, BANDS, np.uint64)


def shingle_hashes(text: bytes) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; a text of fewer words is one shingle, and so is none."""
    words = text.lower().split()
    if len(words) < WIDTH:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(WIDTH)))), len(words) - WIDTH + 1
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), islice(shingles, n)), np.uint64, n)


def shingle_set(text: bytes) -> np.ndarray:
    """The different hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text))


def band_keys_of(hashes: np.ndarray) -> np.ndarray:
    """The keys of one text by its different hashes; equal ones of two texts are of the same band."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for a in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[a : a + 4096] * _FACTORS + _ADDED).min(axis=1), out=least)
    keys = _BAND.copy()
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


@F.arrow_udf(StructType([StructField("fp", LongType()), StructField("keys", ArrayType(LongType()))]))
def marks(text: pa.Array) -> pa.Array:
    """The SimHash of each text's shingles and its keys; null has no words."""
    fps, keys = [], []
    for x in text.cast(pa.binary()).to_pylist():
        hashes = shingle_hashes(x or b"")
        fps.append(majority(hashes[a : a + 65536] for a in range(0, len(hashes), 65536)))
        keys.append(band_keys_of(np.unique(hashes)))
    return pa.StructArray.from_arrays([pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["fp", "keys"])


@F.arrow_udf(BinaryType())
def shingle_sets(text: pa.Array) -> pa.Array:
    return pa.array([shingle_set(x or b"").tobytes() for x in text.cast(pa.binary()).to_pylist()], pa.binary())


def _similar(a: bytes, b: bytes) -> bool:
    m, n = len(a) // 8, len(b) // 8
    if min(m, n) < SIMILAR * max(m, n):
        return False
    common = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
    return common >= SIMILAR * (m + n - common)


@F.arrow_udf(ArrayType(LongType()))
def elements(sets: pa.Array) -> pa.Array:
    """The shingles of each set."""
    return pa.array([np.frombuffer(x, np.int64) for x in sets.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(BooleanType())
def similar(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two sets have the least similarity."""
    return pa.array([_similar(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.bool_())


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` whose sets are similar. The set of a ``v`` with many pairs goes to as many tasks as they fill."""
    lots = pairs.groupBy("v").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    u, v = (sets.select(F.col("text_hash").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "uv")
    dealt = pairs.join(lots, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("lots")).cast("int").alias("lot"))
    copies = v.join(lots, "v").select("v", "v_set", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    return dealt.join(unsent(u), "u").join(unsent(copies), ["v", "lot"]).where(similar("u_set", "v_set")).select("u", "v")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / float(np.log(STEP)) + 1e-9).cast("int")


def prefix_pairs(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """``text_hash, root`` to the pairs ``(u, v)`` of different roots that may be similar; all that are similar are among them.

    Of two sets of ``a`` and ``b`` shingles that are similar, at least ``o`` are common, ``o = (a + b) * 0.8 / 1.8``; so
    in any order the first ``a - o + 1`` of one and the first ``b - o + 1`` of the other have one in common. The order is by rarity.
    Prefixes are cut for each class of sizes that the other set may be of, so that they are as short as the sizes allow.
    """
    held = placed.join(sets, "text_hash").select("text_hash", "root", F.explode(elements("shingles")).alias("element"))
    rarity = held.groupBy("element").agg(F.count("*").alias("n"))
    ranked = held.join(unsent(rarity), "element").groupBy("text_hash", "root").agg(F.array_sort(F.collect_list(F.struct("n", "element"))).alias("ranked"))
    sized = ranked.select("text_hash", "root", F.col("ranked.element").alias("ranked"), F.size("ranked").alias("a"))
    own, a = _size_class(F.col("a")), F.col("a")
    classes = F.sequence(_size_class(F.ceil(a * SIMILAR - 1e-9)), _size_class(F.floor(a / SIMILAR + 1e-9)))
    cut = sized.select("*", own.alias("own"), F.explode(classes).alias("other"))
    least = F.greatest(F.lit(1.0), F.ceil(F.pow(F.lit(STEP), F.col("other")) - 1e-6))  # the smallest size of the other's class
    common = F.greatest(F.ceil((a + least) * (SIMILAR / (1 + SIMILAR)) - 1e-9), F.ceil(a * SIMILAR - 1e-9)).cast("int")
    prefix = F.slice("ranked", F.lit(1), F.greatest(F.lit(0), a - common + 1))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    rows = cut.select("text_hash", "root", "own", low, high, F.explode(prefix).alias("element"))
    on = ["low", "high", "element"]
    # what only texts of one component have is what a large group of copies is made of; it goes first
    mixed = rows.groupBy(*on).agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select(*on)
    rows = written(rows.join(unsent(mixed), on, "left_semi"), "prefixes")
    x = rows.where("own = low").select(*on, F.col("text_hash").alias("x"), F.col("root").alias("x_root"))
    y = rows.where("own = high").select(*on, F.col("text_hash").alias("y"), F.col("root").alias("y_root"))
    met = x.join(unsent(y), on).where("x_root != y_root AND (low != high OR x < y)")
    return met.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """``text_hash, fp`` to candidates ``(u, v)``: each text and the first of its fingerprint, and the first ones of fingerprints within six bits."""
    groups = written(texts.groupBy("fp").agg(F.min("text_hash").alias("v"), F.count("*").alias("n")), "fingerprints")
    equal = texts.join(groups.where("n > 1"), "fp").where("text_hash != v").select(F.col("text_hash").alias("u"), "v")
    near = wide_pairs(groups.select("fp"))
    one, other = (groups.select(F.col("fp").alias(k), F.col("v").alias(f"{k}_text")) for k in "uv")
    apart = near.join(one, "u").join(other, "v").select(F.greatest("u_text", "v_text").alias("u"), F.least("u_text", "v_text").alias("v"))
    out = written(equal.unionByName(apart), "candidates")
    for done in (groups, near):
        drop_written(done)
    return out


def similar_links(texts: DataFrame, sets_of) -> DataFrame:
    """Different texts as ``text_hash, fp, keys`` to links ``(u, v)`` that connect all near copies; each link is one.

    ``sets_of`` turns a table of ``text_hash`` into ``text_hash, shingles``.
    """
    first = fingerprint_pairs(texts.select("text_hash", "fp"))
    dealt = texts.select("text_hash", F.explode("keys").alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(dealt.join(unsent(sizes), "key"), "buckets")
    wanted = met.select("text_hash").unionByName(first.select(F.explode(F.array("u", "v")).alias("text_hash"))).distinct()
    sets = written(sets_of(wanted), "shingles")
    near = written(_confirmed(first, sets), "links")
    found = connected_components(near).withColumnRenamed("node", "text_hash")
    rooted = met.join(found, "text_hash", "left").withColumn("near", F.coalesce("root", "text_hash")).drop("root")
    # a bucket whose members are all linked by their fingerprints is done
    mixed = rooted.groupBy("key").agg(F.min("near").alias("r"), F.max("near").alias("s")).where("r != s").select("key")
    dealt, met = met, written(rooted.join(mixed, "key", "left_semi"), "buckets")
    meets = met.groupBy("text_hash").agg(F.sum("n").alias("meets"))
    heads = met.join(meets, "text_hash").groupBy("key").agg(F.max(F.struct("meets", "text_hash", "near")).alias("h")).select("key", F.col("h.text_hash").alias("v"), F.col("h.near").alias("v_near"))
    stars = written(met.join(heads, "key").where("near != v_near").select(F.col("text_hash").alias("u"), "v").distinct(), "stars")
    links = near.unionByName(written(_confirmed(stars, sets), "links"))
    roots = connected_components(links).withColumnRenamed("node", "text_hash")
    placed = written(met.drop("near").join(roots, "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash")), "placed")
    open_ = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("key")
    left = written(placed.join(open_, "key", "left_semi"), "open")
    few = left.where(F.col("n") <= FEW)
    x, y = (few.select("key", F.col("text_hash").alias(k), F.col("root").alias(f"{k}_root")) for k in "uv")
    pairs = x.join(unsent(y), "key").where("u_root != v_root AND u > v").select("u", "v").distinct()
    pairs = pairs.unionByName(prefix_pairs(left.where(F.col("n") > FEW).select("text_hash", "root").distinct(), sets)).distinct()
    tried = stars.unionByName(first).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    new = written(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
    more = written(_confirmed(new, sets), "links")
    for done in (first, dealt, met, sets, stars, placed, left, new):
        drop_written(done)
    return links.unionByName(more)


def near_copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, keep_id, keep_hash``.

    Classes are what is reachable over pairs of near copies; ``keep_id, keep_hash`` name the row to keep: the smallest
    id (nulls last), then the smallest text hash. Texts without words are one class; null ids and repeated rows are given as they come.
    """
    text_hash = F.xxhash64(F.col(text_col)).alias("text_hash")
    marked = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash, marks(F.col(text_col)).alias("m")).select("doc_id", "text_hash", "m.fp", "m.keys"), "bands")

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = F.broadcast(wanted) if wanted.limit(SENT + 1).count() <= SENT else wanted
        own = docs.select(text_hash, F.col(text_col).alias("text")).join(wanted, "text_hash", "left_semi")
        return own.groupBy("text_hash").agg(F.first("text").alias("text")).select("text_hash", shingle_sets("text").alias("shingles"))

    first = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    texts = written(marked.groupBy("text_hash").agg(F.min(first).alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "texts")
    roots = connected_components(similar_links(texts, sets_of)).withColumnRenamed("node", "text_hash")
    placed = texts.select("text_hash", "first").join(roots, "text_hash", "left").withColumn("root", F.coalesce("root", "text_hash"))
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    classes = placed.join(heads, "root").select("text_hash", "head")
    return marked.join(classes, "text_hash").select("doc_id", "text_hash", F.col("head.id").alias("keep_id"), F.col("head.hash").alias("keep_hash"))
