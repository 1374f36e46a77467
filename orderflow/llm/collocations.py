"""Collocations: phrases of two and three words, scored by how often their parts occur.

Texts are cut into pieces, and equal pieces of a language are counted once with their multiplicity. Each task lists the phrases of its
pieces and adds their multiplicities up in duckdb, which spills to disk when its memory is full; the sums go to buckets by the hash
of language and phrase, where duckdb adds them up again and lets only the frequent ones out. So a word that a third of all pieces
have reaches its bucket as one row of each task. Parts of candidates are looked up by requests, which are shuffled to where the
counts of the part are; a part that many candidates have is dealt to several tasks.
"""

from __future__ import annotations

import os
import tempfile
from functools import reduce

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from orderflow.llm._shared import drop_written, table, text_slices, written

AT_LEAST = 10
#: A candidate goes if a longer one that holds it has this share of its occurrences.
COVERED = 50
FIRST = 2000
#: Memory of a task's duckdb; what is beyond goes to the task's temporary folder and is deleted with it.
MEMORY = "300MB"
#: Bits of the maps of frequent words and pairs. Longer phrases with a part that the map lacks are not counted; a full map lets all pass.
MAP_BITS = 26
#: Requests for a part that one task answers.
LOT = 4096
#: Rows of a language are ranked in so many groups before the best of each meet.
GROUPS = 64

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COUNTS = "lang string, phrase string, f long"


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, piece, m, n_words``: each different piece of a language, its words joined by a space, and how often it occurs.

    A null text has no pieces, a null language is ``und``.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _CAPITALS, _SMALL)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    cut = docs.select(lang.alias("lang"), F.explode(F.split(text, r"[.,;:!?\n-\r]")).alias("piece"))
    clean = cut.select("lang", F.trim(F.regexp_replace("piece", r"[ \t]+", " ")).alias("piece")).where("piece != ''")
    counted = clean.groupBy("lang", "piece").agg(F.count("*").alias("m"))
    return counted.withColumn("n_words", F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1)


def added_up(batches, least: int):
    """Batches of ``lang, phrase, f`` to batches of the same with equal phrases added up, those of ``least`` and more."""
    with tempfile.TemporaryDirectory(prefix="counts-") as folder, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": os.path.join(folder, "spill"), "preserve_insertion_order": False}) as con:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
        rows = pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches))
        con.register("rows", rows)
        found = con.sql(f"SELECT lang, phrase, sum(f)::BIGINT AS f FROM rows GROUP BY lang, phrase HAVING sum(f) >= {least}")
        yield from found.to_arrow_reader(16384)


def _hashes(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    each = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return each[coded.indices.to_numpy()]


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of so many words (one or two) from the words' hashes; their first bits are the place in the map."""
    mixed = words * np.uint64(0x9E3779B97F4A7C15)
    if size == 2:
        mixed = mixed[:-1] + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def phrases(batch: pa.RecordBatch, size: int, frequent: np.ndarray | None = None) -> pa.RecordBatch:
    """The phrases of ``size`` words of a batch of pieces, with the pieces' multiplicity. ``frequent`` is a map of phrases of one word
    less; what has a part that is not in it is left out."""
    split = pc.split_pattern(batch.column("piece"), " ")
    words, length = split.flatten(), pc.list_value_length(split).to_numpy()
    piece = np.repeat(np.arange(len(length)), length)
    left = np.cumsum(length)[piece] - np.arange(len(piece))  # words from here to the end of the piece
    start = np.flatnonzero(left >= size)
    if frequent is not None and len(start):
        at = _runs(_hashes(words), size - 1) >> np.uint64(65 - (64 * len(frequent)).bit_length())
        known = ((frequent[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        start = start[known[start] & known[start + 1]]
    parts = [words.take(pa.array(start + k)) for k in range(size)]
    joined = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
    return pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(piece[start])), joined, batch.column("m").take(pa.array(piece[start]))], ["lang", "phrase", "f"])


def counted(parts: DataFrame, size: int, least: int, frequent: np.ndarray | None = None) -> DataFrame:
    """``lang, phrase, f`` of the phrases of ``size`` words that occur ``least`` times or more in ``parts`` (``lang, piece, m``)."""
    sent = None if frequent is None else parts.sparkSession.sparkContext.broadcast(frequent)

    def of_task(batches):
        own = None if sent is None else sent.value
        small = (s for b in batches for s in text_slices(b, "piece", 1 << 20))
        yield from added_up((phrases(s, size, own) for s in small), 1)

    partial = parts.select("lang", "piece", "m").mapInArrow(of_task, _COUNTS)
    return partial.repartition("lang", "phrase").mapInArrow(lambda batches: added_up(batches, least), _COUNTS)


@F.arrow_udf(LongType())
def _hash_of_words(phrase: pa.Array) -> pa.Array:
    return pa.array(_runs(_hashes(phrase), 1).view(np.int64))


@F.arrow_udf(LongType())
def _hash_of_pairs(phrase: pa.Array) -> pa.Array:
    both = pc.split_pattern(phrase, " ").flatten()
    return pa.array(_runs(_hashes(both), 2)[::2].view(np.int64))


def map_of(frequent: DataFrame, size: int) -> np.ndarray:
    """A bit for each place that a ``phrase`` of one or two words has: 8 MB, however many there are."""
    hashed = (_hash_of_words if size == 1 else _hash_of_pairs)("phrase")
    at = frequent.select(F.shiftrightunsigned(hashed, 64 - MAP_BITS).alias("at"))
    bits = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[bits.column("i").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return out


def answered(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang, part, ...`` with the ``n`` of the part. A part with many requests is answered in as many tasks as they fill."""
    lots = requests.groupBy("lang", "part").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    known = lots.join(counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("n")), ["lang", "part"])
    dealt = known.where("lots > 1").select("lang", "part", F.col("lots").alias("__lots"))  # a small table: requests / LOT at most
    lot = F.pmod(F.xxhash64("phrase", "k"), F.coalesce("__lots", F.lit(1))).cast("int")
    asked = requests.join(dealt, ["lang", "part"], "left").withColumn("lot", lot).drop("__lots")
    copies = known.select("lang", "part", "n", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    return asked.join(copies, ["lang", "part", "lot"]).drop("lot")


def _cuts(words: Column) -> Column:
    """The parts of a candidate for each place to cut it: ``k, side, part``."""
    part = lambda a, n: F.concat_ws(" ", F.slice(words, a, n))
    return F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(words) - 1),
            lambda k: F.array(*(F.struct(k.alias("k"), F.lit(side).alias("side"), p.alias("part")) for side, p in (("l", part(F.lit(1), k)), ("r", part(k + 1, F.size(words) - k))))),
        )
    )


def scored(counts: DataFrame) -> DataFrame:
    """All frequent phrases (``lang, phrase, f``) to candidates ``lang, phrase, a, l, r, score`` by their worst cut."""
    whole = counts.where("instr(phrase, ' ') > 0")
    requests = whole.select("lang", "phrase", "f", F.explode(_cuts(F.split("phrase", " "))).alias("cut")).select("lang", "phrase", F.col("f").alias("a"), "cut.*")
    found = answered(requests, counts)
    cuts = found.groupBy("lang", "phrase", "k").agg(F.max("a").alias("a"), *(F.max(F.when(F.col("side") == s, F.col("n"))).alias(s) for s in "lr"))
    exact = cuts.withColumns({f"x{c}": F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r")})
    each = exact.withColumn("score", F.expr("(xa * xa * 1000000BD) div (xl * xr)").cast("long"))
    worst = each.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("w"))
    return worst.select("lang", "phrase", "a", "w.l", "w.r", "w.score")


def uncovered(found: DataFrame) -> DataFrame:
    """Those candidates that no longer candidate holds with half of their occurrences."""
    words = F.split("phrase", " ")
    inner = F.array(*(F.concat_ws(" ", F.slice(words, k, 2)) for k in (1, 2)))
    longer = found.where(F.size(words) == 3).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return found.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < COVERED * F.col("a"), F.lit(True))).drop("longer")


def ranked(found: DataFrame, first: int = FIRST) -> DataFrame:
    """The best of each language with their ``rank``. Groups of a language are ranked first, so that its task gets a bounded number."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= first)
    grouped = best(found.withColumn("g", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS)).cast("int")), "lang", "g").drop("g", "rank")
    return best(grouped, "lang")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = AT_LEAST, first: int = FIRST) -> DataFrame:
    """The collocations of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``n`` counts the words of the language, ``a``, ``l`` and ``r`` the candidate and the parts of its worst cut. Null and empty texts and
    texts without words add nothing, a null language is ``und``, repeated rows count as often as they come; other
    columns are not read. No texts give no rows.
    """
    parts = written(pieces(docs, text_col, lang_col), "pieces")
    total = parts.groupBy("lang").agg(F.sum(F.col("m") * F.col("n_words")).alias("n"))
    counts = [written(counted(parts, 1, least), "counts")]
    for size in (2, 3):
        known = map_of(counts[-1], size - 1)
        counts.append(written(counted(parts.where(F.col("n_words") >= size), size, least, known), "counts"))
    found = written(scored(reduce(DataFrame.unionByName, counts)), "scored")
    best = written(ranked(uncovered(found), first).join(total, "lang"), "best")
    for done in (parts, *counts, found):
        drop_written(done)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


def op11_oracle() -> str:
    """The same rows in DuckDB SQL."""
    return rf"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
    t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
    g AS (SELECT lang, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k))),
    c AS (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= {AT_LEAST}),
    cut AS (SELECT lang, g, f, k, g[1 : k] AS x, g[k + 1 : len(g)] AS y FROM (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM c WHERE len(g) > 1)),
    s AS (SELECT cut.lang, cut.g, cut.f AS a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * cut.f * cut.f) // (l.f::HUGEINT * r.f))::BIGINT AS score
          FROM cut JOIN c AS l ON l.lang = cut.lang AND l.g = cut.x JOIN c AS r ON r.lang = cut.lang AND r.g = cut.y),
    w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    h AS (SELECT lang, h, max(f) AS f FROM (SELECT lang, unnest([g[1 : 2], g[2 : 3]]) AS h, f FROM c WHERE len(g) = 3) GROUP BY lang, h),
    u AS (SELECT w.lang, array_to_string(w.g, ' ') AS phrase, a, l, r, score FROM w LEFT JOIN h ON h.lang = w.lang AND h.h = w.g WHERE h.f IS NULL OR 100 * h.f < {COVERED} * a)
    SELECT lang, rank, phrase, a, l, r, n, score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM u) JOIN t USING (lang) WHERE rank <= {FIRST}
    """
