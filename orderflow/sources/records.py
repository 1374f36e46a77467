"""CSV files in which quoted fields may hold line ends, read in parallel by byte ranges, with the place of each record.

A range that begins within a quoted field cannot tell so by itself. So the lines that hold a quote are read first: each range then
says how it ends if it begins outside a quoted field and if it begins within one, and a walk over the ranges of a file, one
row each, gives how each begins. Then each range is cut into records by itself; only records that cross ranges are put together
apart. Lines are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.sources.scratch import stored

#: What tells the place of a record: sorted by these, records are in input order, files by their path.
PLACE = ("file", "block", "row")
_PLACE_TYPES = "`file` string, `block` long, `row` long"


def ends_inside(text: str, inside: bool) -> bool:
    """Whether ``text`` ends within a quoted field, if it begins within one or at the start of a field. A quote opens a field only as its
    first character; elsewhere in a field without quotes it is a character like others."""
    at = 0
    while True:
        if not inside:
            if not text.startswith('"', at):
                at = text.find(",", at) + 1
                if not at:
                    return False
                continue
            at, inside = at + 1, True
        at = text.find('"', at)
        if at < 0:
            return True
        if text.startswith('""', at):
            at += 2
            continue
        at, inside = text.find(",", at) + 1, False
        if not at:
            return False


def fields(record: str) -> list[str]:
    """The fields of a record without their quotes; doubled quotes of a quoted field are one, what follows its end belongs to it."""
    if '"' not in record:
        return record.split(",")
    out, at = [], 0
    while True:
        value = ""
        if record.startswith('"', at):
            at += 1
            while True:
                end = record.find('"', at)
                value += record[at : end if end >= 0 else len(record)]
                at = end + 1 if end >= 0 else len(record)
                if end < 0 or not record.startswith('"', at):
                    break
                value, at = value + '"', at + 1
        end = record.find(",", at)
        out.append(value + record[at : end if end >= 0 else len(record)])
        if end < 0:
            return out
        at = end + 1


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, bool, str]]:
    """File, range, whether it begins inside, and line, of lines in their order."""
    for batch in batches:
        yield from zip(batch["file"], batch["block"], batch["inside"], batch["value"], strict=True)


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How each range ends, by how it begins, from its lines with quotes; lines without one change nothing."""
    at, out = None, []
    for file, block, _, line in _ranges(batches):
        if at != (file, block):
            at = (file, block)
            out.append([file, block, False, True])
        out[-1][2:] = [ends_inside(line, state) for state in out[-1][2:]]
    yield pd.DataFrame(out, columns=["file", "block", "if_outside", "if_inside"])


def _walk(ranges: pd.DataFrame) -> pd.DataFrame:
    """The stretches of a file from the range in which a field is left open to the range that has the next quote."""
    rows, inside, out = ranges.sort_values("block"), False, []
    last = None
    for block, if_outside, if_inside in zip(rows["block"], rows["if_outside"], rows["if_inside"], strict=True):
        if inside:
            out.append((rows["file"].iloc[0], last, block))
        inside, last = bool(if_inside if inside else if_outside), block
    if inside:
        raise ValueError(f"a quoted field does not end: {rows['file'].iloc[0]}")
    return pd.DataFrame(out, columns=["file", "since", "until"])


def _records(lines: Iterator[tuple[str, int, bool, str]]) -> Iterator[tuple[str, int, int, str, str]]:
    """File, range, number and text of each record of a range, and what it is: whole, or the tail, middle or head of one that crosses ranges."""
    at, held, row, inside, begins_inside = None, [], 0, False, False

    def cut() -> Iterator[tuple[str, int, int, str, str]]:
        if held:
            yield *at, row, "\n".join(held), "middle" if begins_inside and row == 0 else "head"

    for file, block, begins, line in lines:
        if at != (file, block):
            yield from cut()
            at, held, row, inside, begins_inside = (file, block), [], 0, begins, begins
        held.append(line)
        if inside or '"' in line:
            inside = ends_inside(line, inside)
        if not inside:
            yield file, block, row, "\n".join(held), "tail" if begins_inside and row == 0 else "whole"
            held, row = [], row + 1
    yield from cut()


def _values(columns: list[str], places: list[int]) -> Callable[[Iterator[tuple[str, int, int, str]]], Iterator[pd.DataFrame]]:
    """A function from records with their places to tables of the fields at ``places``; blank fields and blank lines are null and nothing."""

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*PLACE, *columns])

    def run(records: Iterator[tuple[str, int, int, str]]) -> Iterator[pd.DataFrame]:
        rows = []
        for file, block, row, text in records:
            text = text.removesuffix("\r")
            if text == "" or (block == 0 and row == 0):  # the header of each file
                continue
            parts = fields(text)
            rows.append((file, block, row, *(parts[p] or None if p < len(parts) else None for p in places)))
            if len(rows) == 10_000:
                yield table(rows)
                rows = []
        yield table(rows)

    return run


def csv_records(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """CSV files with headers, all alike, as text columns, after ``file, block, row``: by these, records are in input order.

    Of ``columns`` those that a file has are read; without them all are, and a name that stands twice is the first one's. Blanks around names and a byte
    order mark are no part of them. Quoted fields may hold commas, doubled quotes and line ends. Blank fields are null, short records
    are filled with null, fields beyond the header and blank lines go. Lines end with a line feed, after a carriage return or not. A quoted field
    that does not end raises when rows are read. Files without a header have no columns. A record is held by one task, whatever its length.

    What is broadcast are the stretches of ranges that fields cross: at most a row for each range (``spark.sql.files.maxPartitionBytes``).
    """
    text = spark.read.option("lineSep", "\n").text(path)
    first = text.where("_metadata.file_block_start = 0").limit(1).first()
    names = [n.strip() for n in fields((first.value if first else "").replace("﻿", "").removesuffix("\r"))]
    wanted = [n for n in (dict.fromkeys(names) if columns is None else columns) if n and n in names]
    schema = ", ".join([_PLACE_TYPES, *(f"`{n}` string" for n in wanted)])
    values = _values(wanted, [names.index(n) for n in wanted])

    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quoted = lines.where(F.contains("value", F.lit('"'))).withColumn("inside", F.lit(False))
    ends = quoted.mapInPandas(_ends, "`file` string, `block` long, if_outside boolean, if_inside boolean")
    open_ = F.broadcast(ends.groupBy("file").applyInPandas(_walk, "`file` string, since long, until long").alias("o"))
    l, within = lines.alias("l"), F.col("l.file") == F.col("o.file")  # noqa: E741
    began = l.join(open_, within & (F.col("block") > F.col("since")) & (F.col("block") <= F.col("until")), "left")
    began = began.select("l.*", F.col("since").isNotNull().alias("inside"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return values((f, b, r, t) for f, b, r, t, kind in _records(_ranges(batches)) if kind == "whole")

    def crossing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [x for x in _records(_ranges(batches)) if x[-1] != "whole"]
        yield pd.DataFrame(parts, columns=[*PLACE, "text", "kind"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return values(x for batch in batches for x in zip(*(batch[c] for c in (*PLACE, "text")), strict=True))

    touched = began.alias("l").join(open_, within & (F.col("block") >= F.col("since")) & (F.col("block") <= F.col("until")), "left_semi")
    parts = touched.mapInPandas(crossing, f"{_PLACE_TYPES}, text string, kind string")
    # a tail or middle belongs to the last head before it
    head = F.struct("block", "row")
    parts = parts.selectExpr("*", "last(CASE WHEN kind = 'head' THEN struct(block, row) END, true) OVER (PARTITION BY file ORDER BY block, row) AS head")
    glued = parts.groupBy("file", "head").agg(F.array_sort(F.collect_list(F.struct(head.alias("at"), "text"))).alias("parts"))
    glued = glued.select("file", "head.block", "head.row", F.array_join(F.col("parts.text"), "\n").alias("text"))
    return began.mapInPandas(whole, schema).unionByName(glued.mapInPandas(joined, schema))


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as ``value`` with ``place``, a struct that sorts them in input order: files by their path, then as they stand.

    ``place`` is for sorting; its last part hangs on how files are packed into tasks. Store it before rows are read twice.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select("value", place.alias("place"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a ``place`` to the same with ``line_no`` from 1 in input order in its stead.

    Rows are sorted by ranges of places and stored; the first number of each range comes from the counts of those before it, so no task
    sorts all. One row for each range is broadcast.
    """
    part = stored(rows.orderBy("place").withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    # a row's number within its partition are the low 33 bits of its id
    sizes = part.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", F.coalesce(F.expr("sum(n) OVER (ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0)).alias("__before"))
    within = F.col("__row").bitwiseAND((1 << 33) - 1)
    out = part.join(F.broadcast(before), "__part").withColumn("line_no", F.col("__before") + within + 1)
    return out.select("line_no", *(F.col(f"`{c}`") for c in rows.columns if c != "place"))
