"""The streaming plan with known pairs in the state store, held to the batch job; stops, restarts and changed dictionaries."""

import shutil

from orderflow.operators.extract import SlotMatcher, match_cities, normal_slots, parse_orders
from orderflow.sources import tables
from orderflow.streaming import orders as streams

TOWNS = "Paris,Lyon,Marseille,Toulouse,Le Havre,Saint-Etienne,Lille,Brest,Aix".split(",")
SLOTS = ["paris", "gare de lyon", "toulosue", "loyn", "paris lyon", "xx", "", "saint etienne", "st etiene", "marseile", "havre", "brest brest", "a" * 300]


def _cities(spark, names=TOWNS):
    return spark.createDataFrame([(n,) for n in names], "city string")


def _answers(spark, path):
    return sorted(r.line for r in spark.read.schema("order_id string, line string").parquet(path).collect())


def _batch(spark, path, cities):
    return sorted(r.line for r in tables.order_answers(parse_orders(tables.order_lines(spark.read.text(path)), cities)).collect())


def test_slots_one_by_one_are_as_in_batches(spark):
    slots = spark.createDataFrame([(s,) for s in SLOTS], "slot string")
    want = {r.slot: r.city for r in match_cities(slots, _cities(spark)).collect()}
    matcher = SlotMatcher(_cities(spark))
    assert {s: matcher.city(s) for s in SLOTS} == want and matcher.city(None) is None
    assert SlotMatcher(_cities(spark, [])).city("paris") is None


def test_no_line_is_lost_or_doubled(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    cities = _cities(spark)

    def arrive(name, lines):
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")

    def run(known):
        streams.append_stream(streams.answered_lines(streams.order_stream(spark, folder), known), out, state).awaitTermination()

    same = [f"{i},Je veux aller de Paris à Toulosue demain" for i in range(200)]
    arrive("a.txt", [*same, "x", "", "7,Bonjour", "7,Je vais à Lyon depuis Lille", "8,Je veux aller de Paris à Paris", "9,Je veux aller de Rennes à Lyon"])
    run(cities)
    assert _answers(spark, out) == _batch(spark, folder, cities)
    run(cities)  # nothing has arrived
    arrive("b.txt", [*same[:50], "10,Je vais à Brest depuis Aix"])
    run(cities)
    assert _answers(spark, out) == _batch(spark, folder, cities)
    # a batch whose end was not noted is done again: its lines are there once
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    shutil.move(last, tmp_path / "taken")
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run(cities)
    assert _answers(spark, out) == _batch(spark, folder, cities)
    # another dictionary holds from then on
    before = _answers(spark, out)
    arrive("c.txt", ["11,Je veux aller de Paris à Toulosue demain", "12,Je veux aller de Rennes à Lyon"])
    run(_cities(spark, ["Paris", "Toulosue", "Rennes", "Lyon"]))
    assert _answers(spark, out) == sorted([*before, "11,Paris,Toulosue", "12,Rennes,Lyon"])


def test_plan_has_state_and_no_batch_function(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1,Je vais à Lyon depuis Lille\n")
    answers = streams.answered_lines(streams.order_stream(spark, str(tmp_path / "in")), _cities(spark))
    query = streams.append_stream(answers, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert "FlatMapGroupsInPandasWithState" in plan and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    assert normal_slots(tables.order_lines(spark.read.text(str(tmp_path / "in")))).first().dest_norm == "lyon"
