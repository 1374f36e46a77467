"""Benchmark decontamination over a distributed positional inverted index.

The corpus is indexed in shards of some million words: for each term its sorted positions in the shard,
numbered through all its documents with a gap between them. The index is a Parquet table in the shared
folder; only terms that occur in the benchmark are stored, as no other can take part in a match. A window of
an item is then looked up in each shard: the positions of its rarest term there, less its place in the window,
are the candidates, and the positions of the next rarest terms are intersected with them until none is left
or all terms agree. All terms in place is an exact match; a start from which every term stands within ``slop``
words of its place is a match by proximity.
"""

from __future__ import annotations

from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm._shared import table, text_slices, written

WINDOW = 10
SLOP = 2  # words that a term may stand before or after its place in a match by proximity
GAP = 64  # unused positions between documents; more than a window and its slop
SHARD_WORDS = 2_000_000
#: Up to so many bytes of benchmark text are looked up at once and shipped to the tasks.
BLOCK_BYTES = 8 << 20
#: A benchmark with more different terms than this is indexed against with all terms of the corpus.
MOST_TERMS = 500_000
#: Windows, and starts of windows, that a task looks at in one step.
LOOKED_UP, CANDIDATES = 100_000, 1_000_000

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

INDEX = (
    "shard string, doc_ids array<bigint>, n_words array<bigint>, terms array<string>, sizes array<bigint>,"
    " positions binary"
)
MATCHES = (
    "shard string, doc bigint, doc_id bigint, n_words bigint, hit_begins array<bigint>, hit_ends array<bigint>,"
    " item_ids array<bigint>, near_ids array<bigint>"
)


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case."""
    return text.translate(_WORDS).split()


def _shard(name: str, held: list, names: list[bytes]) -> pa.RecordBatch:
    ids = np.concatenate([x for _, x in held]) if held else np.zeros(0, np.int64)
    counts = np.array([len(x) for _, x in held], np.int64)
    base = np.cumsum(counts + GAP) - counts - GAP
    at = np.repeat(base - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))
    known = ids >= 0
    ids, at = ids[known], at[known]
    order = np.argsort(ids, kind="stable")
    terms, sizes = np.unique(ids, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name]),
            pa.array([[d for d, _ in held]], pa.list_(pa.int64())),
            pa.array([counts], pa.list_(pa.int64())),
            pa.array([[names[t].decode() for t in terms]], pa.list_(pa.string())),
            pa.array([sizes], pa.list_(pa.int64())),
            pa.array([at[order].astype("<i4").tobytes()]),
        ],
        [x.split()[0] for x in INDEX.split(", ")],
    )


def build_index(docs: DataFrame, terms: list[bytes] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of postings of the whole texts; ``terms`` are those to keep, None keeps all. Null has no words."""

    def run(batches):
        fixed = None if terms is None else {t: i for i, t in enumerate(terms)}
        task, n = TaskContext.get(), 0
        held, size, own = [], 0, {}
        for whole in batches:
            for batch in text_slices(whole, "text"):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                    words = words_of(text or b"")
                    if fixed is None:
                        ids = (own.setdefault(w, len(own)) for w in words)
                    else:
                        ids = map(fixed.get, words, repeat(-1))
                    held.append((doc_id, np.fromiter(ids, np.int32, len(words))))
                    size += len(words) + GAP
                    if size >= SHARD_WORDS:
                        yield _shard(f"{task.partitionId()}-{n}", held, terms or list(own))
                        held, size, own, n = [], 0, {}, n + 1
        if held:
            yield _shard(f"{task.partitionId()}-{n}", held, terms or list(own))

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, INDEX)


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


class Windows:
    """The different windows of some items, by length: their terms, and which items have them. An item without an id owns none."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.terms: dict[bytes, int] = {}
        self.ids = np.unique(np.array([i for i, _ in items if i is not None], np.int64))
        found: dict[int, tuple[list, list]] = {}
        for item_id, text in items:
            words = np.array([self.terms.setdefault(w, len(self.terms)) for w in words_of(text)], np.int32)
            size = min(WINDOW, len(words))
            if size:
                own, owners = found.setdefault(size, ([], []))
                own.append(np.lib.stride_tricks.sliding_window_view(words, size))
                owner = len(self.ids) if item_id is None else np.searchsorted(self.ids, item_id)
                owners.append(np.full(len(words) - size + 1, owner))
        self.by_size = {n: self._different(np.concatenate(own), np.concatenate(owners)) for n, (own, owners) in sorted(found.items())}

    @staticmethod
    def _different(windows: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different windows, the items of all of them in their order, and where those of each begin."""
        windows, place = np.unique(windows, axis=0, return_inverse=True)
        pairs = np.unique(place.ravel() << 32 | owners)
        return windows, pairs & 0xFFFFFFFF, np.searchsorted(pairs >> 32, np.arange(len(windows) + 1))

    def found_in(self, terms: list[str], sizes: list[int], positions: np.ndarray, slop: int):
        """Yields (window length, windows met, their starts, whether each is exact), a bounded number at a time."""
        sizes = np.array(sizes, np.int64)
        begins = np.cumsum(sizes) - sizes
        # the list's number above the position: one sorted array holds all lists
        keys = np.repeat(np.arange(len(sizes)) << 32, sizes) + positions
        slot, size = np.full(len(self.terms), -1), np.zeros(len(self.terms), np.int64)
        for k, t in enumerate(terms):
            i = self.terms.get(t.encode())
            if i is not None:
                slot[i], size[i] = k, sizes[k]
        for length, (windows, _, _) in self.by_size.items():
            for a in range(0, len(windows), LOOKED_UP):
                met = a + np.flatnonzero(size[windows[a : a + LOOKED_UP]].min(axis=1) > 0)
                order = np.argsort(size[windows[met]], axis=1, kind="stable")
                rarest = slot[windows[met, order[:, 0]]] if len(met) else met
                lots = np.cumsum(sizes[rarest]) // CANDIDATES
                for lot in np.split(np.arange(len(met)), np.flatnonzero(np.diff(lots)) + 1):
                    n = sizes[rarest[lot]]
                    own = np.repeat(lot, n)
                    starts = positions[_ranges(begins[rarest[lot]], n)] - order[own, 0]
                    if slop:
                        near = starts[:, None] + np.arange(-slop, slop + 1) + (1 << 32)
                        both = np.unique((own << 34)[:, None] + near)
                        own, starts = both >> 34, (both & (1 << 34) - 1) - (1 << 32)
                    exact = np.ones(len(own), bool)
                    for k in range(0 if slop else 1, length):
                        if not len(own):
                            break
                        place = order[own, k]
                        want = (slot[windows[met[own], place]] << 32) + starts + place
                        low = np.searchsorted(keys, want - slop)
                        fits = (low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] <= want + slop)
                        if slop:
                            exact &= keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
                        own, starts, exact = own[fits], starts[fits], exact[fits]
                    if len(own):
                        yield length, met[own], starts, exact

    def items_of(self, length: int, docs: np.ndarray, met: np.ndarray) -> np.ndarray:
        """Pairs of a document and an item that has one of the windows met there, as ``document << 32 | item``."""
        _, owners, begins = self.by_size[length]
        docs, met = np.divmod(np.unique(docs << 32 | met), 1 << 32)
        n = begins[met + 1] - begins[met]
        docs, owners = np.repeat(docs, n), owners[_ranges(begins[met], n)]
        return np.unique((docs << 32 | owners)[owners < len(self.ids)])


def _lists(values: np.ndarray, docs: np.ndarray, n: int) -> pa.Array:
    """The values of each of ``n`` documents; ``docs`` is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(docs, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int64()))


def _matches(windows: Windows, slop: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["n_words"], np.int64)
                base, n = np.cumsum(counts + GAP) - counts - GAP, len(counts)
                edge, pairs = np.zeros(int(base[-1] + counts[-1]) + GAP + 1, np.int64), ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
                positions = np.frombuffer(row["positions"], "<i4").astype(np.int64)
                for length, met, starts, exact in windows.found_in(row["terms"], row["sizes"], positions, slop):
                    np.add.at(edge, starts[exact], 1)
                    np.add.at(edge, starts[exact] + length, -1)
                    at = np.maximum(np.searchsorted(base, starts + slop, "right") - 1, 0)
                    for kind, which in zip(pairs, (exact, ~exact), strict=True):
                        kind.append(windows.items_of(length, at[which], met[which]))
                held = np.unique(np.concatenate(pairs[0]))
                near = np.setdiff1d(np.concatenate(pairs[1]), held)
                step = np.diff(np.concatenate(([0], np.cumsum(edge) > 0, [0])).astype(np.int8))
                begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                at = np.searchsorted(base, begins, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * n),
                        pa.array(range(n), pa.int64()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(counts),
                        _lists(begins - base[at], at, n),
                        _lists(ends - base[at], at, n),
                        *(_lists(windows.ids[x & 0xFFFFFFFF], x >> 32, n) for x in (held, near)),
                    ],
                    [x.split()[0] for x in MATCHES.split(", ")],
                )

    return run


#: What deals items to blocks: the text of an item without an id.
_ITEM = "coalesce(CAST(item_id AS STRING), text)"


def _blocks(items: DataFrame) -> int:
    """In how many blocks by hash the items are looked up, so that each holds a bounded amount of text."""
    n = max(1, ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BLOCK_BYTES))
    while n > 1:
        sizes = items.groupBy(F.pmod(F.xxhash64(F.expr(_ITEM)), F.lit(n)).alias("b")).agg(F.sum(F.octet_length("text")).alias("s"), F.countDistinct(F.expr(_ITEM)).alias("k"))
        if sizes.where((F.col("s") > 2 * BLOCK_BYTES) & (F.col("k") > 1)).isEmpty():
            break
        n *= 2
    return n


def _terms(items: DataFrame) -> list[bytes] | None:
    """The benchmark's different terms, or None if there are too many to ship."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.explode(F.split(lower, _NOT_A_WORD)).alias("t")).where("t != ''").distinct()
    got = terms.limit(MOST_TERMS + 1).collect()
    return None if len(got) > MOST_TERMS else sorted(r.t.encode() for r in got)


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    slop: int = SLOP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``, with the benchmark passages found in its whole text.

    Columns: ``doc_id, n_words, hit_begins, hit_ends, item_ids, near_ids``. Hits are spans of word numbers
    (end exclusive) that lie in an exact occurrence of a window of ten consecutive words of an item, or of a whole
    item that has fewer; ``item_ids`` have such an occurrence, ``near_ids`` only one by proximity. Null texts and
    items have no words; an item without an id hits, and is named nowhere; items with the same id are one. Null and
    repeated doc_ids are given as they come. An empty benchmark hits nothing.

    The benchmark is looked up in blocks of bounded size, one after another, against the same stored index; the driver
    holds one block at a time.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("text IS NOT NULL")
    index, n, found = written(build_index(docs, _terms(items), id_col, text_col), "index"), _blocks(items), None
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64(F.expr(_ITEM)), F.lit(n)) == b).collect()
        got = index.mapInArrow(_matches(Windows([(r.item_id, r.text.encode()) for r in rows]), slop), MATCHES)
        got = written(got.where("size(hit_begins) > 0 OR size(near_ids) > 0 OR %s" % ("true" if b == 0 else "false")), "matches") if n > 1 else got
        found = got if found is None else found.unionByName(got)
    if n > 1:
        joined = {c: F.flatten(F.collect_list(c)) for c in ("hit_begins", "hit_ends", "item_ids", "near_ids")}
        found = found.groupBy("shard", "doc").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(v.alias(c) for c, v in joined.items())
        )
        found = found.withColumn("near_ids", F.array_except("near_ids", "item_ids"))
    return found.select("doc_id", "n_words", "hit_begins", "hit_ends", "item_ids", "near_ids")


def _n_hit() -> Column:
    """Words under any of the spans, which may overlap if they come from several blocks."""
    spans = F.array_sort(F.arrays_zip("hit_begins", "hit_ends"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(
            (a.n + F.greatest(F.lit(0).cast("long"), s.hit_ends - F.greatest(a.end, s.hit_begins))).alias("n"),
            F.greatest(a.end, s.hit_ends).alias("end"),
        ),
        lambda a: a.n,
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no window of the benchmark; columns as they were.

    Rows are told apart by a hash of id and text, so null and repeated ids do no harm.
    """
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.xxhash64(id_col, text_col).alias("key"),
        F.col(text_col).alias("text"),
    )
    hit = benchmark_matches(keyed, benchmark, slop=0, id_col="key").where(F.size("hit_begins") > 0)
    hit = written(hit.select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return keyed.select("row", "key").join(hit, "key", "left_anti").select("row.*")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, those under a benchmark window, the items found, and those found by proximity only."""
    found = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    names = lambda c: F.array_sort(F.transform(c, lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        _n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names("item_ids"), ","), 256).alias("items_sha256"),
        (F.size("hit_begins") > 0).alias("contaminated"),
        F.array_join(names("near_ids"), ",").alias("near_items"),
    )


def op10_oracle() -> str:
    """The same rows in DuckDB SQL. For proximity, each place of a window's rarest word is tried with every shift."""
    w = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '%s')" % w
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {low} AS ws FROM documents),
    b AS (SELECT item_id, {low} AS ws FROM benchmark),
    win AS (SELECT DISTINCT item_id, len(g) AS k, array_to_string(g, ' ') AS g FROM (
        SELECT item_id, ws[i : i + least({WINDOW}, len(ws)) - 1] AS g
        FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0))),
    places AS (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win)),
    hit AS (SELECT rid, i, a.k, item_id FROM places a JOIN win ON win.k = a.k AND win.g = array_to_string(ws[i : i + a.k - 1], ' ')),
    n AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
    s AS (SELECT rid, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l
          FROM hit GROUP BY rid),
    said AS (SELECT rid, p, ws[p] AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
    often AS (SELECT x, count(*) AS n FROM said GROUP BY x),
    term AS (SELECT g, o, string_split(g, ' ')[o] AS x FROM (SELECT DISTINCT g, unnest(range(1, k + 1)) AS o FROM win)),
    rare AS (SELECT g, arg_min(o, coalesce(n, 0) * 100 + o) AS o, arg_min(x, coalesce(n, 0) * 100 + o) AS x, min(coalesce(n, 0)) AS least
             FROM term LEFT JOIN often USING (x) GROUP BY g),
    tried AS (SELECT DISTINCT rid, g, p - o + e AS i FROM rare JOIN said USING (x), (SELECT unnest(range(-{SLOP}, {SLOP + 1})) AS e) WHERE least > 0),
    fits AS (SELECT rid, g FROM (SELECT rid, g, i, string_split(g, ' ') AS gs, ws FROM tried JOIN d USING (rid))
             WHERE list_bool_and(list_transform(range(1, len(gs) + 1), lambda o: list_contains(ws[greatest(i + o - {SLOP}, 1) : greatest(i + o + {SLOP}, 0)], gs[o])))),
    near AS (SELECT rid, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM fits JOIN win USING (g)
             WHERE (rid, item_id) NOT IN (SELECT rid, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items,
           sha256(coalesce(s.l, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated, coalesce(near.l, '') AS near_items
    FROM d LEFT JOIN n USING (rid) LEFT JOIN s USING (rid) LEFT JOIN near USING (rid)
    """
