"""Quality rules as a bitmask ledger.

Every rule is evaluated once, over the whole text; the ledger keeps what was measured and one bit for each rule
that failed. A policy is a versioned set of rules. Whether a policy keeps a document, and what a policy
without one of its rules would keep, are bit operations on the ledger: texts are not read again.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orderflow.llm._shared import table, text_slices

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_plain_words",
    "n_capitals",
)

#: Bit of each rule, and the condition under which a document fails it. The order never changes; new rules go last.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "words_without_letters": "10 * n_plain_words > 3 * n_words",
    "capitals": "2 * n_capitals > word_chars",
}
BASE = ("few_words", "repeated_words")
POLICIES = {
    "base": BASE,
    "v1": tuple(RULES),
}

_BLANKS, _SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
_CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]")
#: Each byte as a letter (from A-Z, a-z and all beyond ASCII), a blank, or something else.
_KIND = bytes(b if b in b" \t\n\v\f\r" else 97 if b >= 128 or chr(b).isalpha() else 46 for b in range(256))


def mask(rules) -> int:
    """The bits of some rules."""
    return sum(1 << list(RULES).index(r) for r in rules)


def _repeat_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    first, twice = set(), set()
    for w in windows:
        (twice if w in first else first).add(w)
    n, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def measured(text: str) -> tuple[int, ...]:
    """The measures of one text, in their order."""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        len(lines),
        sum(b"a" not in x for x in data.translate(_KIND).split()),
        len(_CAPITALS.findall(text)),
    )


def _measure(text_col: str):
    """A function for ``mapInArrow`` that adds the measures of a text column."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, text_col):
                rows = [measured(x or "") for x in batch.column(text_col).to_pylist()]
                found = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *MEASURES])

    return run


def _with_measures(rows: DataFrame, text_col: str) -> DataFrame:
    fields = [StructField(m, LongType()) for m in MEASURES]
    return rows.mapInArrow(_measure(text_col), StructType([*rows.schema.fields, *fields]))


def _fail_bits() -> Column:
    bits = (F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, test in enumerate(RULES.values()))
    return reduce(Column.bitwiseOR, bits).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the measures, and ``fail_bits``.

    A null text has no words and fails ``few_words`` just as an empty one does. Null ids and repeated
    rows are given as they come; other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    got = _with_measures(own, "text").drop("text")
    return got.withColumn("fail_bits", _fail_bits())


def passes(fail_bits: Column, policy: str) -> Column:
    """Whether a policy keeps what has these bits."""
    return fail_bits.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy does: ``rule, n_docs, n_failed, n_failed_alone, n_kept, n_kept_without``.

    Bit patterns are counted first, so that only as many rows as there are patterns meet.
    """
    own, rules = mask(POLICIES[policy]), POLICIES[policy]
    patterns = book.select(F.col("fail_bits").bitwiseAND(F.lit(own).cast("long")).alias("b")).groupBy("b").count()
    each = patterns.select(
        "b", "count", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in rules))).alias("r")
    ).select("b", "count", "r.*")
    total = lambda test: F.sum(F.when(test, F.col("count")).otherwise(0))
    b, bit = F.col("b"), F.col("bit")
    return each.groupBy("rule").agg(
        F.sum("count").alias("n_docs"),
        total(b.bitwiseAND(bit) != 0).alias("n_failed"),
        total(b == bit).alias("n_failed_alone"),
        total(b == 0).alias("n_kept"),
        total(b.bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
    )


def keep_documents(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with their columns. A null text has no words and goes."""
    # positions for names, so that no column of docs can clash with a measure
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    got = _with_measures(named, f"c{docs.columns.index(text_col)}")
    return got.where(passes(_fail_bits(), policy)).select(*named.columns).toDF(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, whether it fails the base rules, and whether the current policy keeps it."""
    book = ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id",
        *MEASURES,
        "fail_bits",
        (~passes(F.col("fail_bits"), "base")).alias("base_failed"),
        passes(F.col("fail_bits"), "v1").alias("kept"),
    )


def op4_oracle() -> str:
    """The same rows in DuckDB SQL."""
    w, bits = r"[^\x20\x09-\x0D]+", " + ".join(f"CASE WHEN {t} THEN {1 << i} ELSE 0 END" for i, t in enumerate(RULES.values()))
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{w}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{w}')) AS ls FROM d),
    g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
          FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
    p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
    m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
            length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
            coalesce(p.n, 0)::BIGINT AS n_repeat_words,
            len(ls)::BIGINT AS n_lines,
            len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')))::BIGINT AS n_plain_words,
            length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g'))::BIGINT AS n_capitals
          FROM w LEFT JOIN p USING (rid)),
    b AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
    SELECT *, (fail_bits & {mask(BASE)}) <> 0 AS base_failed, (fail_bits & {mask(POLICIES['v1'])}) = 0 AS kept FROM b
    """
