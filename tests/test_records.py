"""CSV records with line ends in quoted fields, held to Python's own reader however the files are cut; input order."""

import csv
import random

import pytest

from orderflow.operators import evaluate
from orderflow.sources import tables
from orderflow.sources.records import csv_records, ends_inside, fields, placed_lines


@pytest.fixture(params=[7, 64, 100_000])
def cut_at(spark, request):
    """Ranges of so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _read(spark, path, columns=None):
    rows = csv_records(spark, str(path), columns).orderBy("file", "block", "row").collect()
    return [tuple(r)[3:] for r in rows]


def test_records_of_any_cut(spark, tmp_path, cut_at):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(['a', 'é', ',', '"', "\n", "\r\n", " ", "x"]) for _ in range(rng.randrange(12)))
    rows = [[str(i), word(), word()] for i in range(60)]
    rows[20][1] = "long\n" * 30
    for name, part in (("a.txt", rows[:35]), ("b.txt", rows[35:])):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator="\r\n").writerows([["﻿id", " first ", "second"], *part])
    want = [tuple(v or None for v in r) for r in rows]
    assert _read(spark, tmp_path) == want
    assert _read(spark, tmp_path, ("second", "none", "id")) == [(r[2], r[0]) for r in want]


def test_odd_files(spark, tmp_path, cut_at):
    def of(text):
        path = tmp_path / f"f{len(list(tmp_path.iterdir()))}.txt"
        path.write_bytes(text.encode())
        return path

    assert _read(spark, of('a,b\n5" pipe,x\n\n"q"z,"1\n\n2"\nshort\nlong,1,2\n,')) == [('5" pipe', "x"), ("qz", "1\n\n2"), ("short", None), ("long", "1"), (None, None)]
    assert _read(spark, of("a,b\n")) == []
    assert csv_records(spark, str(of(""))).columns == ["file", "block", "row"]
    with pytest.raises(Exception, match="does not end"):
        _read(spark, of('a,b\n1,"open\n2,3\n'))


def test_small_parts():
    assert fields('"a""b",c,"",') == ['a"b', "c", "", ""]
    assert [ends_inside(x, False) for x in ('a"b', '"a', '"a""', '"a",b', 'a,"b')] == [False, True, True, False, True]
    assert [ends_inside(x, True) for x in ("a", 'a"', 'a","', 'a"",')] == [True, False, True, True]


def test_timetable_with_line_ends(spark, tmp_path):
    (tmp_path / "stops.txt").write_text('stop_id,stop_name,zone\nA,"Gare\nde Lyon",1\nB,"Lyon, Part ""Dieu""",2\n')
    (tmp_path / "stop_times.txt").write_text("trip_id,stop_id,stop_sequence,arrival_time,departure_time\nT,A,1,,06:00:00\n")
    (tmp_path / "trips.txt").write_text("route_id,trip_id\nR,T\n")
    (tmp_path / "routes.txt").write_text("route_id\nR\n")
    known = tables.timetable(spark, str(tmp_path))
    assert {(r.stop_id, r.stop_name, r.stop_code) for r in known["stops"].collect()} == {("A", "Gare\nde Lyon", ""), ("B", 'Lyon, Part "Dieu"', "")}
    assert [tuple(r) for r in known["stop_times"].collect()] == [("T", "A", "1", "", "06:00:00")]
    assert [tuple(r) for r in known["trips"].collect()] == [("T", "R")]


def test_errors_in_input_order(spark, tmp_path):
    for name, ids in (("1.csv", (9, 3)), ("2.csv", (7, 1, 5))):
        (tmp_path / name).write_text("sentence_id,sentence,expected_dep,expected_dest,expected_valid\n" + "".join(f"{i},x,A,B,1\n" for i in ids))
    rows = tables.labelled_rows(spark, str(tmp_path), placed=True)
    judged = evaluate.outcomes(rows.selectExpr("*", "CAST(NULL AS STRING) AS departure", "CAST(NULL AS STRING) AS destination"))
    listed = evaluate.errors(judged, "sentence_id", 4, order=("place",))
    assert [r.sentence_id for r in listed.collect()] == ["9", "3", "7", "1"]


def test_lines_keep_their_place(spark, tmp_path, cut_at):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i},vers {i}\n" for i in range(50)))
    orders = tables.order_lines(placed_lines(spark, str(tmp_path)))
    assert [r.order_id for r in orders.orderBy("place").collect()] == [f"{n}{i}" for n in "ab" for i in range(50)]
