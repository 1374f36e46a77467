"""Documents whose sets of word n-grams are nearly the same: an exact Jaccard join by relations between sets.

A document's set has the hashes of its runs of ``WIDTH`` words. Two sets of ``a`` and ``b`` elements are linked if 100 times what they share is at
least ``SIMILAR`` times their union; then at most ``15 (a + b) / 185`` elements are in one only. All steps keep every link:

* *Segments* sift. The range of hashes is cut into more segments than linked sets of about this size can differ in, so two linked sets have
  the same elements in one of them at least. Sets that share no segment's content with another set go no further. A text in a third
  of all rows is one set; a passage of many documents fills hardly a segment alone.
* *Answers.* The sets that share a segment are compared with one of them, that which meets most, their leader. What a set has more and less
  than its leader is stored. Two sets with the same leader are later compared by these differences alone.
* *Index.* Sets that may be linked but are in different components so far meet in an index over their rarest elements. Its lists are cut into
  blocks by the size of the set and the position of the element in it; a set with the element at position ``i`` skips all blocks of positions ``j``
  where ``i + j`` elements, which only one of them has, are more than may differ.

What is in one component already is not compared again, so a large group of copies costs comparisons about in proportion to
its size. Elements are 64-bit hashes, sets are told apart by 128 bits.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from orderflow.llm._shared import drop_written, table, text_slices, written
from orderflow.llm.components import connected_components

WIDTH = 4
#: Least similarity, in hundredths.
SIMILAR = 85
SEED = 42
#: Members of a bucket that are compared with each other, if of different components; larger buckets go by the index.
FEW = 8
#: Differences to a leader are stored at this similarity (hundredths) or more; less similar sets have no common leader.
RELATED = 60
#: Blocks that positions are cut into.
BLOCKS = 4
#: Comparisons that share a set in one task.
LOT = 2048
#: Bits of maps that tell tasks which keys are wanted: 8 MB; a full map lets all pass, and an exact join follows.
MAP_BITS = 26

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 64, WIDTH, np.uint64) | np.uint64(1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _classes() -> np.ndarray:
    """The greatest size of each class; linked sets are of the same or of neighbouring classes."""
    out = [0]
    while out[-1] < 1 << 40:
        out.append((out[-1] + 1) * 100 // SIMILAR)
    return np.array(out[1:], np.int64)


CLASSES = _classes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def most_apart(both: int) -> int:
    """How many elements at most are in one only of two linked sets, with so many elements taken together."""
    return both * (100 - SIMILAR) // (100 + SIMILAR)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The set of each text, sorted. A text of fewer than ``WIDTH`` words is one element; without words or null it has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    row = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
    words = split.flatten()
    whole = pc.greater(pc.binary_length(words), 0)
    row, words = row[whole.to_numpy(zero_copy_only=False)], words.filter(whole)
    coded = words.dictionary_encode()
    each = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    hashes = each[coded.indices.to_numpy()]
    ends = np.cumsum(np.bincount(row, minlength=len(split))) if len(row) else np.zeros(len(split), int)
    runs = np.zeros(max(0, len(hashes) - WIDTH + 1), np.uint64)
    for k, factor in enumerate(_FACTORS):
        runs += hashes[k : k + len(runs)] * factor
    runs, out, start = _mixed(runs), [], 0
    for end in ends.tolist():
        if end - start >= WIDTH:
            out.append(np.unique(runs[start : end - WIDTH + 1]))
        else:
            short = b" ".join(words[start:end].cast(pa.binary()).to_pylist())
            out.append(np.array([xxhash.xxh64_intdigest(short, seed=SEED)] if end > start else [], np.uint64))
        start = end
    return out


def segment_keys(elements: np.ndarray) -> np.ndarray:
    """Keys of the segments of a set, for its own class and the next. Two linked sets have one in common.

    Of ``apart + 1 + spare`` segments, linked sets have ``1 + spare`` equal ones. Empty segments have keys only if there are more than
    ``spare`` of them, as only then may all equal ones be empty.
    """
    n, out = len(elements), []
    if not n:
        return np.zeros(0, np.int64)
    mixed, high = _mixed(elements + _A), elements >> np.uint64(32)
    own = int(np.searchsorted(CLASSES, n))
    for c in (own, own + 1):
        largest = int(CLASSES[c])
        apart = most_apart(2 * largest)
        spare = 2 + largest // 250 if apart else 0
        count = apart + 1 + spare
        segment = (high * np.uint64(count)) >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        content, at = np.add.reduceat(mixed, starts), segment[starts]
        if count - len(starts) > spare:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), at)
            content, at = np.append(content, np.zeros(len(empty), np.uint64)), np.append(at, empty)
        out.append(_mixed(content + at * _A + np.uint64((c + 1) << 40)))
    return np.concatenate(out).view(np.int64)


def set_id(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def _with_sets(docs: DataFrame, columns: list[StructField], row_of) -> DataFrame:
    """``doc_id`` and the columns that ``row_of`` makes of each set and its id; rows for which it gives None are left out."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text", 1 << 20):
                rows = [(i, r) for i, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text")), strict=True) if (r := row_of(s)) is not None]
                fields = list(zip(*(r for _, r in rows), strict=True)) or [()] * len(columns)
                types = [{"LongType": pa.int64(), "BinaryType": pa.binary(), "ArrayType": pa.list_(pa.int64())}[type(c.dataType).__name__] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), *(pa.array(f, t) for f, t in zip(fields, types, strict=True))], ["doc_id", *(c.name for c in columns)])

    return docs.mapInArrow(run, StructType([StructField("doc_id", LongType()), *columns]))


def _in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) >> np.uint64(64 - MAP_BITS)
    return ((bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def map_of(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each place, by its first bits, that a value of a long column has: 8 MB, however many there are."""
    at = keys.select(F.shiftrightunsigned(column, 64 - MAP_BITS).alias("at"))
    bits = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[bits.column("i").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return out


def _head(ids: Column) -> Column:
    """The first 64 bits of a set's id."""
    return F.conv(F.substring(F.hex(ids), 1, 16), 16, -10).cast("long")


# ---- comparisons ----------------------------------------------------------------------------------------------------


_ANSWER = StructType([StructField("common", LongType()), StructField("lost", BinaryType()), StructField("gained", BinaryType())])


@F.arrow_udf(_ANSWER)
def answer(own: pa.Array, leader: pa.Array) -> pa.Array:
    """What a set shares with its leader, and the leader's elements it lacks and those it has besides (if they are related)."""
    rows = []
    for x, y in zip(own, leader, strict=True):
        x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
        shared = np.intersect1d(x, y, assume_unique=True)
        near = 100 * len(shared) >= RELATED * (len(x) + len(y) - len(shared))
        lost, gained = (np.setdiff1d(v, shared, assume_unique=True).tobytes() for v in (y, x)) if near else (None, None)
        rows.append({"common": len(shared), "lost": lost, "gained": gained})
    return pa.array(rows, pa.struct([("common", pa.int64()), ("lost", pa.binary()), ("gained", pa.binary())]))


@F.arrow_udf(LongType())
def shared_by_differences(size: pa.Array, lost_x: pa.Array, gained_x: pa.Array, lost_y: pa.Array, gained_y: pa.Array) -> pa.Array:
    """What two sets share, from the size of their leader and their differences to it."""
    out = []
    for n, *parts in zip(size.to_pylist(), *(c.to_pylist() for c in (lost_x, gained_x, lost_y, gained_y)), strict=True):
        lx, gx, ly, gy = (np.frombuffer(v, np.uint64) for v in parts)
        both = lambda a, b: len(np.intersect1d(a, b, assume_unique=True))
        out.append(n - len(lx) - len(ly) + both(lx, ly) + both(gx, gy))
    return pa.array(out, pa.int64())


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``u, v`` with their sizes ``a, b`` and ``answer`` of ``u`` to ``v``. The set of a ``v`` with many pairs goes to as many tasks as they fill."""
    lots = pairs.groupBy("v").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    own, other = (sets.select(F.col("u").alias(k), F.col("n").alias(n), F.col("elements").alias(f"{k}_set")) for k, n in (("u", "a"), ("v", "b")))
    dealt = pairs.join(lots, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("lots")).cast("int").alias("lot"))
    copies = other.join(lots, "v").select("v", "b", "v_set", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    return dealt.join(own, "u").join(copies, ["v", "lot"]).select("u", "v", "a", "b", answer("u_set", "v_set").alias("got"))


def _links(rows: DataFrame, common: str) -> DataFrame:
    return rows.where(100 * F.col(common) >= SIMILAR * (F.col("a") + F.col("b") - F.col(common))).select("u", "v")


def links_of(pairs: DataFrame, sets: DataFrame, leaders: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``u, v``) that are linked. Sets with the same leader are compared by their differences to it, others whole."""
    x, y = (leaders.select(F.col("u").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("leader", "lost", "gained")), F.col("n").alias(n), F.col("leader_n").alias(f"size_{k}")) for k, n in (("u", "a"), ("v", "b")))
    led = pairs.join(x, "u", "left").join(y, "v", "left")
    same = F.coalesce(F.col("leader_u") == F.col("leader_v"), F.lit(False))
    derived = led.where(same).withColumn("common", shared_by_differences("size_u", "lost_u", "gained_u", "lost_v", "gained_v"))
    whole = _compared(led.where(~same).select("u", "v"), sets)
    return _links(derived, "common").unionByName(_links(whole, "got.common"))


# ---- index ----------------------------------------------------------------------------------------------------------


@F.arrow_udf(ArrayType(LongType()))
def _members(sets: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(x, np.int64) for x in sets.to_pylist()], pa.list_(pa.int64()))


def _class_of(n: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, CLASSES.tolist())), lambda c: c < n))


def _apart(both: Column) -> Column:
    return F.floor(both * (100 - SIMILAR) / (100 + SIMILAR)).cast("int")


def _width(c: Column) -> Column:
    """Positions in a block of a set of this class."""
    return F.floor(_apart(2 * F.element_at(F.array(*map(F.lit, CLASSES.tolist())), c + 1)) / BLOCKS).cast("int") + 1


def index_pairs(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, root`` to the pairs ``u, v`` of different roots that may be linked; all that are linked are among them.

    Elements are ordered by how few of these sets have them. In that order the first element that linked sets have in common has
    ``i`` and ``j`` elements before it that only one of them has.
    """
    held = placed.join(sets, "u").select("u", "root", "n", F.explode(_members("elements")).alias("element"))
    rarity = held.groupBy("element").agg(F.count("*").alias("count"), F.min("root").alias("r"), F.max("root").alias("s"))
    # positions count all elements, but those of one set or of one component only are in no list
    lists = held.join(rarity, "element").groupBy("u", "root", "n").agg(F.array_sort(F.collect_list(F.struct("count", "element", (F.col("r") != F.col("s")).alias("mixed")))).alias("order"))
    n = F.col("n")
    first = F.slice("order", F.lit(1), _apart(n + F.floor(n * 100 / SIMILAR)) + 1)
    posted = lists.withColumn("class", _class_of(n)).select("u", "root", "n", "class", F.posexplode(first).alias("at", "e")).where("e.mixed")
    entries = written(posted.select("u", "root", "n", "class", "at", F.col("e.element").alias("element")), "entries")
    skip = lambda c: F.floor((_apart(n + F.element_at(F.array(*map(F.lit, CLASSES.tolist())), c + 1)) - F.col("at")) / _width(c)).cast("int")
    asked = entries.select("*", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("other"))
    asked = asked.withColumn("last", skip(F.col("other"))).where("last >= 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last"))))
    x = asked.select("element", F.col("other").alias("class"), "block", F.col("u").alias("x"), F.col("root").alias("x_root"), F.col("n").alias("a"), F.col("at").alias("i"), F.col("class").alias("own"))
    y = entries.select("element", "class", F.floor(F.col("at") / _width(F.col("class"))).cast("int").alias("block"), F.col("u").alias("y"), F.col("root").alias("y_root"), F.col("n").alias("b"), F.col("at").alias("j"))
    rest = F.abs((F.col("a") - F.col("i")) - (F.col("b") - F.col("j")))
    met = x.join(y, ["element", "class", "block"]).where("x_root != y_root AND (own != class OR x < y)").where(F.col("i") + F.col("j") + rest <= _apart(F.col("a") + F.col("b")))
    return met.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


# ---- the join -------------------------------------------------------------------------------------------------------


def _candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_shingles, set_id`` of all documents, and ``u, set_id, keys`` of the sets that share a key with another set."""
    fields = [StructField("n_shingles", LongType()), StructField("set_id", BinaryType()), StructField("keys", ArrayType(LongType()))]
    marked = written(_with_sets(docs, fields, lambda s: (len(s), set_id(s) if len(s) else None, segment_keys(s))), "sets")
    each = marked.select(F.explode("keys").alias("key"), F.xxhash64("set_id").alias("s"))
    shared = written(each.groupBy("key").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a != b").select("key"), "keys")
    sent = docs.sparkSession.sparkContext.broadcast(map_of(shared, "key"))

    @F.arrow_udf(ArrayType(LongType()))
    def wanted(keys: pa.Array) -> pa.Array:
        flat, length = keys.flatten().to_numpy(), pc.list_value_length(keys).to_numpy()
        kept = _in_map(sent.value, flat) if len(flat) else np.zeros(0, bool)
        ends = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(length)), length)[kept], minlength=len(length))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[kept]))

    kept = marked.where("n_shingles > 0").select("set_id", wanted("keys").alias("keys")).where("size(keys) > 0")
    sets = written(kept.groupBy("set_id").agg(F.first("keys").alias("keys")).withColumn("u", F.monotonically_increasing_id()), "meeting")
    met = sets.select("u", F.explode("keys").alias("key")).join(shared, "key", "left_semi")
    meeting = written(met.groupBy("u").agg(F.collect_list("key").alias("keys")).join(sets.select("u", "set_id"), "u"), "meeting")
    slim = written(marked.select("doc_id", "n_shingles", "set_id"), "sets")
    for done in (marked, shared, sets):
        drop_written(done)
    return slim, meeting


def _elements(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``u, n, elements`` of the sets."""
    sent = docs.sparkSession.sparkContext.broadcast(map_of(sets.select(_head(F.col("set_id")).alias("h")), "h"))

    def row(s):
        own = set_id(s) if len(s) else None
        return (own, s.tobytes()) if own and _in_map(sent.value, np.frombuffer(own[:8], ">u8").astype(np.uint64))[0] else None

    got = _with_sets(docs, [StructField("set_id", BinaryType()), StructField("elements", BinaryType())], row)
    once = got.groupBy("set_id").agg(F.first("elements").alias("elements"))
    return once.join(sets.select("set_id", "u"), "set_id").select("u", (F.length("elements") / 8).cast("long").alias("n"), "elements")


def set_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (``doc_id, text``) to ``doc_id, n_shingles, set_id``, to ``u, set_id`` of sets that others are like, and to links
    ``u, v`` that connect all that are linked."""
    marked, meeting = _candidates(docs)
    sets = written(_elements(docs, meeting), "elements")
    each = meeting.select("u", F.explode("keys").alias("key"))
    met = written(each.join(each.groupBy("key").agg(F.count("*").alias("m")), "key"), "buckets")
    meets = met.groupBy("u").agg(F.sum("m").alias("meets"))
    heads = met.join(meets, "u").groupBy("key").agg(F.max(F.struct("meets", "u")).alias("h")).select("key", F.col("h.u").alias("v"))
    stars = met.join(heads, "key").where("u != v").select("u", "v").distinct()
    answers = written(_compared(stars, sets), "answers")
    links = written(_links(answers, "got.common"), "links")
    near = answers.where("got.lost IS NOT NULL").groupBy("u").agg(F.max(F.struct(F.col("got.common"), "v", "a", "b", F.col("got.lost"), F.col("got.gained"))).alias("x"))
    leaders = near.select("u", F.col("x.v").alias("leader"), F.col("x.a").alias("n"), F.col("x.b").alias("leader_n"), "x.lost", "x.gained")
    roots = connected_components(links).withColumnRenamed("node", "u")
    placed = written(met.join(roots, "u", "left").withColumn("root", F.coalesce("root", "u")), "placed")
    open_ = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("key")
    left = written(placed.join(open_, "key", "left_semi"), "open")
    few = left.where(F.col("m") <= FEW)
    x, y = (few.select("key", F.col("u").alias(k), F.col("root").alias(f"{k}_root")) for k in "uv")
    pairs = x.join(y, "key").where("u_root != v_root AND u > v").select("u", "v").distinct()
    pairs = pairs.unionByName(index_pairs(left.where(F.col("m") > FEW).select("u", "root").distinct(), sets)).distinct()
    tried = answers.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    new = written(pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
    more = written(links_of(new, sets, leaders), "links")
    for done in (met, sets, answers, placed, left, new):
        drop_written(done)
    return marked, meeting.select("u", "set_id"), links.unionByName(more)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, n_copies``.

    ``component_id`` is the smallest id that is reachable by links, its own included; ``n_copies`` is the number of other rows with the same
    set. A null text, and one without words, has no element, no links and its own id. Null ids are given as they come and are no
    component's smallest id, unless it has no other; repeated rows are linked with each other. Other columns are not read. No rows give none.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked, sets, links = set_links(own)
    roots = connected_components(links).withColumnRenamed("node", "u")
    each = marked.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    rooted = sets.join(roots, "u", "left").select("set_id", F.coalesce("root", "u").alias("root"))
    placed = written(each.join(rooted, "set_id", "left"), "placed")
    least = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"))
    classes = placed.join(least, "root", "left").select("set_id", F.coalesce("least", "first").alias("component_id"), (F.col("rows") - 1).alias("n_copies"))
    out = marked.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents by 4-word shingles and a similarity of 0.85."""
    return jaccard_components(table(spark, sf_dir, "documents"))
