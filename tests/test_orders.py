"""The rules that are easy to get wrong, on small inline tables."""

import pytest
from pyspark.sql import functions as F

from orderflow.functions import fuzzy, text
from orderflow.jobs.schedule import answer_orders
from orderflow.operators import confidence, evaluate, extract, gazetteer, generate, itinerary, stations, timetable
from orderflow.sources import tables
from orderflow.streaming import orders as streams

CITIES = "Paris Toulouse Lyon Marseille Bordeaux Lille Nantes Strasbourg Montpellier Rennes Nice Grenoble Saint-Etienne Le_Havre Reims Toulon Angers Dijon Nimes Clermont-Ferrand".split()


@pytest.fixture(scope="module")
def cities(spark):
    return spark.createDataFrame([(c.replace("_", " "),) for c in CITIES], "city string")


PAIRS = [
    ("Je souhaite me rendre à Paris depuis Toulouse", "Toulouse", "Paris"),
    ("Je vais à Nantes depuis Lyon", "Lyon", "Nantes"),
    ("Je veux un trajet de Strasbourg vers Montpellier", "Strasbourg", "Montpellier"),
    ("Je veux aller de Paris à Paris", None, None),
    ("Je veux aller de Paris ou Lyon à Marseille", None, None),
    ("Je veux aller à Paris", None, None),
    ("Je souhaite aller de Nimes à Marseille ou Strasbourg", "Nimes", "Marseille"),
    ("Je veux aller de Marseile à Toulosue", "Marseille", "Toulouse"),
    ("Je veux aller de Loyn à Toulosue", None, None),  # three of four letters in order are 75, below the cutoff
    ("Je veux aller de Lyon à Le Havre", None, None),
    ("Je veux aller de Le Havre à Lyon", "Le Havre", "Lyon"),
    ("JE VEUX ALLER DE LYON À PARIS", "Lyon", "Paris"),
    ("Aller de Lyon à Paris s'il vous plaît", "Lyon", "Paris"),
    ("Aller de Lyon svp à Paris", "Lyon", "Paris"),
    ("Je veux aller de Saint à Lyon", None, None),
    ("Bonjour", None, None),
    ("   ", None, None),
    (None, None, None),
    ("abc", None, None),
]


def test_parse_orders(spark, cities):
    rows = spark.createDataFrame([(str(i), s) for i, (s, _, _) in enumerate(PAIRS)], "order_id string, sentence string")
    got = {r.order_id: (r.departure, r.destination, r.status) for r in extract.parse_orders(rows, cities).collect()}
    for i, (sentence, dep, dest) in enumerate(PAIRS):
        assert got[str(i)] == (dep, dest, "OK" if dep else "INVALID"), sentence


def test_dictionary_in_blocks(spark, cities):
    slots = spark.createDataFrame([("loyn",), ("toulosue",), ("marseile",), ("zzz",)], "slot string")
    one = {tuple(r)[:2] + (r.city,) for r in extract.fuzzy_cities(slots, cities).collect()}
    few = {tuple(r)[:2] + (r.city,) for r in extract.fuzzy_cities(slots, cities, block_names=4).collect()}
    assert one == few and {("toulosue", "Toulouse"), ("marseile", "Marseille")} <= {(r[0], r[2]) for r in one}


def test_weighted_ratio():
    assert fuzzy.weighted_ratio("", "a") == 0
    assert fuzzy.weighted_ratio("paris", "paris") == 100
    assert fuzzy.ratio("loyn", "lyon") == 75
    assert fuzzy.weighted_ratio("par", "paris") == pytest.approx(90)
    assert fuzzy.weighted_ratio("saint", "saint-etienne") == pytest.approx(90)
    assert fuzzy.weighted_ratio("le bourg", "le havre du nord") == pytest.approx(85.5)
    assert fuzzy.ratio("abcde", "xbxdx") == pytest.approx(40)


def test_order_lines_and_triplets(spark):
    lines = spark.createDataFrame([("S1,a, b",), ("no comma here",), ("  ",), ("S42, de Paris",)], "value string")
    got = {tuple(r) for r in tables.order_lines(lines).collect()}
    assert got == {("S1", "a, b", "OK"), ("no comma here", None, "INVALID_FORMAT"), ("S42", "de Paris", "OK")}
    three = spark.createDataFrame([("1, a, b, c",), ("2,a",), ("3,,b",)], "value string")
    assert [tuple(r) for r in tables.triplets(three).collect()] == [("1", "a", "b, c")]


def test_text_functions(spark):
    row = spark.createDataFrame([("L’Œuvre «Évian»–les-Bains  ß", "12345678;x, 87654321", "48.84, 2.37", "nan, 1")], "a string, b string, c string, d string")
    got = row.select(
        text.norm_ascii(F.col("a")).alias("a"), text.norm_french(F.col("a")).alias("f"), text.codes_in(F.col("b")).alias("b"),
        text.coordinates(F.col("c")).alias("c"), text.coordinates(F.lit("1,2,3")).alias("d"), text.name_variants(F.lit(" Le Mans-Sud ")).alias("v"),
        text.code_in_id(F.lit("x12345678y")).alias("i"), text.code_in_id(F.lit("x")).alias("n"),
    ).first()
    assert got.a == "l'oeuvre evian -les-bains ss" and got.f == "l œuvre évian les-bains"
    assert got.b == ["12345678", "87654321"] and tuple(got.c) == (48.84, 2.37) and tuple(got.d) == (None, None)
    assert got.v == ["Le Mans-Sud", "Le Mans Sud", "Le-Mans-Sud"] and got.i == "12345678" and got.n is None


STATIONS = [
    ("Paris Gare de Lyon", "10000001", 48.84, 2.37), ("Paris Est", "10000002;10000003", 48.87, 2.36), ("Lyon Part Dieu", "20000001", 45.76, 4.86),
    ("Lyon Perrache", "20000002", 45.75, 4.83), ("Saint-Etienne Centre", "30000001", 45.44, 4.40), ("Carcassonne", "40000001", 43.22, 2.35),
]


@pytest.fixture(scope="module")
def places(spark):
    return tables.stations(spark.createDataFrame(STATIONS, "station_name string, uic_code string, latitude double, longitude double"))


def test_stations(spark, places):
    asked = spark.createDataFrame([("Paris",), ("Lyon",), ("Carcassonne",), ("Etienne",)], "city string")
    best = {r.city: (r.hub_name, r.hub_score) for r in stations.hub_of_city(asked, places).collect()}
    assert best == {"Paris": ("Paris Gare de Lyon", 10000), "Lyon": ("Lyon Part Dieu", 9000), "Carcassonne": ("Carcassonne", -53), "Etienne": ("Saint-Etienne Centre", 64)}
    found = [(r.city, r.rank, r.station_name) for r in stations.candidates_for_city(asked, places).orderBy("city", "rank").collect()]
    assert [x for x in found if x[0] == "Lyon"] == [("Lyon", 1, "Lyon Part Dieu"), ("Lyon", 2, "Lyon Perrache"), ("Lyon", 3, "Paris Gare de Lyon")]
    assert not [x for x in found if x[0] == "Etienne"]  # a hyphen is no word boundary
    texts = spark.createDataFrame([("1", "lyon LYON perrache gare"), ("2", "abc")], "order_id string, sentence string")
    got = [(r.order_id, r.rank, r.hits, r.station_name) for r in stations.candidates_for_text(texts, places).orderBy("rank").collect()]
    assert got[:3] == [("1", 1, 3, "Lyon Perrache"), ("1", 2, 3, "Paris Gare de Lyon"), ("1", 3, 2, "Lyon Part Dieu")]
    with pytest.raises(ValueError):
        tables.stations(spark.createDataFrame([("x",)], "station_name string"))


TIMES = [
    ("T1", "A", "1", "06:00:00", "06:05:00"), ("T1", "B", "2", "07:00:00", "07:05:00"), ("T1", "C", "3", "08:00:00", "08:05:00"),
    ("T2", "B", "1", "06:50:00", "06:59:00"), ("T2", "D", "2", "09:00:00", "09:05:00"), ("T3", "B", "9", "07:00:00", "07:00:00"),
    ("T3", "D", "10", "25:10:00", "25:10:00"), ("T4", "C", "2", "10:00:00", "10:05:00"), ("T4", "A", "9", "11:00:00", "11:05:00"),
    ("T5", "A", "x", "05:00:00", "05:00:00"), ("T5", "C", "2", "06:00:00", "06:00:00"), ("T6", "A", "1", "05:30:00", "05:30:00"),
    ("T6", "E", "2", None, None), ("T7", "E", "1", "04:00:00", "04:00:00"), ("T7", "F", "2", "08:00:00", "08:00:00"),
]


def test_timetable(spark):
    times = spark.createDataFrame(TIMES, "trip_id string, stop_id string, stop_sequence string, arrival_time string, departure_time string")
    stops = spark.createDataFrame([(s, f"Stop {s}", None) for s in "ABCDEF"], "stop_id string, stop_name string, stop_code string")
    trips = spark.createDataFrame([("T1", "R1")], "trip_id string, route_id string")
    known = tables.timetable_of(stops, times, trips)
    goals = [("AC", "A", "C"), ("AD", "A", "D"), ("AF", "A", "F"), ("FA", "F", "A")]
    ends = spark.createDataFrame([(q, side, s) for q, a, b in goals for side, s in (("from", a), ("to", b))], "query_id string, side string, stop_id string")
    direct = timetable.direct_journeys(ends, known["stop_times"]).collect()
    assert [(r.query_id, r.trip_id, r.departure, r.arrival) for r in direct] == [("AC", "T1", "06:05:00", "08:00:00")]
    queries = spark.createDataFrame([(q,) for q, _, _ in goals], "query_id string")
    got = {r.query_id: (r.kind, r.trip1, r.transfer_stop, r.trip2, r.arr2) for r in timetable.schedule_answers(ends, known["stop_times"], queries).collect()}
    assert got == {
        "AC": ("direct", "T1", None, None, None), "AD": ("transfer", "T1", "B", "T3", "25:10:00"),
        "AF": ("transfer", "T6", "E", "T7", "08:00:00"), "FA": ("none", None, None, None, None),
    }
    named = timetable.named(timetable.direct_journeys(ends, known["stop_times"]), known, {"trip_id": "route"}, {"from_stop": "name"}).first()
    assert (named.route, named.name) == ("R1", "Stop A")
    assert timetable.legs(ends, known["stop_times"], "from", most=1).count() == 3
    asked = spark.createDataFrame([("1", "stop a", ""), ("2", "nowhere", "12345678")], "station_id string, station_name string, uic_code string")
    assert [tuple(r) for r in timetable.stops_of_stations(asked, known["stops"]).collect()] == [("1", "A")]


def test_mentions(spark):
    texts = spark.createDataFrame([("1", "De Saint-Etienne à Lyon Part Dieu, puis Lyon"), ("2", None), ("3", "à Paris depuis Toulouse")], "order_id string, sentence string")
    names = spark.createDataFrame([("Saint Etienne",), ("Lyon",), ("Lyon Part Dieu",), ("Paris",), ("Toulouse",)], "name string")
    got = [(r.order_id, r.text, r.start, r.end) for r in gazetteer.mentions(texts, names).orderBy("order_id", "start").collect()]
    assert got[:3] == [("1", "Saint-Etienne", 3, 16), ("1", "Lyon Part Dieu", 19, 33), ("1", "Lyon", 40, 44)]
    pairs = {r.order_id: (r.departure, r.destination) for r in gazetteer.first_two(gazetteer.mentions(texts, names)).collect()}
    assert pairs == {"1": ("Saint-Etienne", "Lyon Part Dieu"), "3": ("Paris", "Toulouse")}
    low = spark.createDataFrame([("1", "lyon")], "order_id string, sentence string")
    assert gazetteer.mentions(low, names).count() == 0 and gazetteer.mentions(low, names, ignore_case=True).count() == 1


def test_confidence_and_scores(spark, cities, places):
    rows = spark.createDataFrame([("1", "Je veux aller de Paris à Lyon"), ("2", "Bonjour gare perrache"), ("3", " ")], "order_id string, sentence string")
    got = {r.order_id: r for r in confidence.resolve(rows, cities, places, helpful=True).collect()}
    assert got["1"].ok and round(got["1"].confidence, 6) == 0.83 and got["1"].strength == "both_literal"
    assert (got["2"].reason, got["2"].confidence, got["2"].proposed[0].station_name) == ("invalid_or_ambiguous_helpful_mode", 0.15, "Lyon Perrache")
    assert (got["3"].reason, got["3"].confidence) == ("empty_input", 0.0)
    assert {r.reason for r in confidence.resolve(rows, cities, places, mode="other").collect()} == {"unknown_mode", "empty_input"}
    judged = spark.createDataFrame([("a", "b", 1, "a", "b"), ("a", "b", 1, "a", "c"), ("a", "b", 1, None, None), (None, None, 0, "a", "b"), (None, None, 0, None, None)], "expected_dep string, expected_dest string, expected_valid int, departure string, destination string")
    one = evaluate.scores(evaluate.outcomes(judged)).first()
    assert (one.tp, one.fp, one.fn, one.tn) == (1, 2, 2, 1) and one.f1 == pytest.approx(1 / 3)
    assert evaluate.scores(evaluate.outcomes(judged.limit(0))).first().f1 == 0


def test_itinerary(spark):
    one = "struct<station_name:string,latitude:double,longitude:double>"
    rows = spark.createDataFrame([("1", ("a", 48.84, 2.37), [("b", 45.76, 4.86)], ("c", 45.75, 4.83)), ("2", ("a", 0.0, 0.0), None, ("b", 0.0, 180.0))], f"order_id string, departure {one}, via array<{one}>, arrival {one}")
    got = [(r.order_id, r.pos, r.label, round(r.distance_km)) for r in itinerary.itineraries(rows).orderBy("order_id", "pos").collect()]
    assert got == [("1", 0, "Départ", 0), ("1", 1, "Étape", 391), ("1", 2, "Arrivée", 3), ("2", 0, "Départ", 0), ("2", 1, "Arrivée", 20015)]


def test_generated_shares(spark, cities):
    rows = generate.labelled_orders(spark.range(20_000), cities)
    valid = rows.where("expected_valid = 1")
    assert abs(valid.count() / 20_000 - 0.55) < 0.02 and valid.where("expected_dep = expected_dest").isEmpty()
    assert abs(rows.where("sentence IN ('Bonjour', 'Salut', 'Merci', 'Comment ça va')").count() / 20_000 - 0.10) < 0.02
    again = generate.labelled_orders(spark.range(20_000).repartition(7), cities.unionByName(cities))
    assert rows.exceptAll(again).isEmpty()
    noisy = generate.noisy_orders(spark.range(5_000), cities)
    assert noisy.where("order_id = 'S00042'").count() == 1 and noisy.select("sentence").distinct().count() > 1_000
    with pytest.raises(ValueError):
        generate.noisy_orders(spark.range(1), cities.limit(4))


def test_rows_with_the_same_id_or_none(spark, cities, places):
    """Every row is answered for itself, whatever its id; null, empty and very long sentences have an answer too."""
    long = "mot " * 5_000 + "de Lyon à Paris " + "mot " * 5_000
    said = [("1", "Je veux aller de Lyon à Paris"), ("1", "Je veux aller de Paris à Lyon"), ("1", "Je veux aller de Lyon à Paris"), (None, "Aller de Nantes à Lille"), (None, "Bonjour"), ("2", None), ("2", ""), ("3", long)]
    rows = spark.createDataFrame(said, "order_id string, sentence string")
    pairs = [("Lyon", "Paris"), ("Paris", "Lyon"), ("Lyon", "Paris"), ("Nantes", "Lille"), (None, None), (None, None), (None, None), ("Lyon", "Paris")]
    key = lambda r: tuple((x is None, x or "") for x in r)
    wanted = sorted(((i, s, *p) for (i, s), p in zip(said, pairs, strict=True)), key=key)
    got = extract.parse_orders(rows, cities)
    assert sorted(((r.order_id, r.sentence, r.departure, r.destination) for r in got.collect()), key=key) == wanted
    for mode in ("baseline", "gazetteer"):
        found = confidence.resolve(rows, cities, places, mode=mode, helpful=True).collect()
        assert sorted(((r.order_id, r.sentence, r.departure, r.destination) for r in found), key=key) == wanted
        assert all(r.ok == (r.departure is not None) for r in found)
    names = cities.withColumnRenamed("city", "name")
    spoken = [(r.order_id, r.text) for r in gazetteer.mentions(rows, names).collect()]
    assert sorted(spoken, key=key) == sorted([(i, c) for (i, _), p in zip(said, pairs, strict=True) for c in p if c], key=key)
    empty = rows.limit(0)
    assert extract.parse_orders(empty, cities).isEmpty() and gazetteer.mentions(empty, names).isEmpty() and confidence.resolve(empty, cities, places).isEmpty()
    assert extract.parse_orders(rows, cities.limit(0)).where("status = 'OK'").isEmpty() and gazetteer.mentions(rows, names.limit(0)).isEmpty()


def test_nested_and_chained_mentions(spark):
    names = spark.createDataFrame([("a b c",), ("c d",), ("d e f g",), ("b",), ("g h",), ("x",)], "name string")
    texts = spark.createDataFrame([("1", "a b c d e f g h x x"), ("2", "b x " * 3000)], "order_id string, sentence string")
    got = gazetteer.mentions(texts, names)
    assert [r.text for r in got.where("order_id = '1'").orderBy("start").collect()] == ["a b c", "d e f g", "x", "x"]
    assert got.where("order_id = '2'").count() == 6000


def test_best_names_by_all_scores():
    """Pruned by bounds, the best name is that of all scores."""
    rng = __import__("random").Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
    norms = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(150)})
    known = fuzzy.Names([(k, n, n.upper()) for k, n in enumerate(norms)])
    for _ in range(150):
        slot = " ".join(word() for _ in range(rng.randint(1, 3)))
        scores = [(fuzzy.weighted_ratio(slot, n), -k) for k, n in enumerate(norms)]
        score, k = max(scores)
        for least in (0.0, 60.0, 85.0):
            assert known.best(slot, least)[:3] == ((score, -k, norms[-k]) if score > 0 and score >= least else (0.0, -1, ""))
    assert fuzzy.Names([]).best("a") == (0.0, -1, "", "")


GTFS = {
    "stops.txt": 'stop_id,stop_name,stop_code\nP1,"Paris ""Gare de Lyon"", Hall 1",10000001\nL1,Lyon Part Dieu,20000001\nM1,"Dijon, Ville",\nN1,Gare de Nantes,\nG1,Grenoble,70000000\n',
    "stop_times.txt": "trip_id,stop_id,stop_sequence,arrival_time,departure_time\nT1,P1,1,07:00:00,07:05:00\nT1,L1,2,09:00:00,09:05:00\nT2,P1,1,08:00:00,08:00:00\nT2,M1,2,09:30:00,09:31:00\nT3,M1,1,,09:40:00\nT3,N1,2,12:00:00,\n",
    "trips.txt": "trip_id,route_id\nT1,R1\nT2,R2\n",
    "routes.txt": "route_id\nR1\nR2\n",
}


def test_schedule_lines_from_files(spark, cities, places, tmp_path):
    """An order to its lines: by the hub's code, by the city's name where the hub has no stop or there is no hub, and none."""
    for name, content in GTFS.items():
        (tmp_path / name).write_text(content)
    known = tables.timetable(spark, str(tmp_path))
    said = ["S42,Je voudrais aller de Paris à Lyon demain", "\tS43 , Je vais à Nantes depuis Paris\u00a0", "S44,de Lyon à Grenoble", "S45,Bonjour", "S42,Je voudrais aller de Paris à Lyon demain", "no comma"]
    orders = tables.order_lines(spark.createDataFrame([(x,) for x in said], "value string"))
    answers = answer_orders(orders, cities, places, known)
    lines = [r.line for r in tables.schedule_lines(answers).orderBy("order_id", "line_no", "line").collect()]
    paris = 'Paris "Gare de Lyon", Hall 1'
    assert lines == [
        "S42,Paris,Lyon", "S42,Paris,Lyon", *[f"S42,SCHEDULE,DIRECT,Paris,Lyon,07:05:00,09:00:00,T1,{paris},Lyon Part Dieu"] * 2,
        "S43,Paris,Dijon, Ville,Nantes", f"S43,SCHEDULE,1_TRANSFER,Paris,Nantes,08:00:00,09:30:00,T2,09:40:00,12:00:00,T3,{paris},Dijon, Ville,Gare de Nantes",
        "S44,NO_SCHEDULE_FOUND,Lyon,Grenoble",
    ]
    one = answers.where("order_id = 'S43'").first()
    assert (one.from_stop, one.transfer_stop, one.to_stop, one.route1, one.route2) == ("P1", "M1", "N1", "R2", "")
    assert sorted(r.line for r in tables.order_answers(extract.parse_orders(orders, cities)).collect())[-3:] == ["S44,Lyon,Grenoble", "S45,INVALID", "no comma,INVALID_FORMAT"]
    (tmp_path / "trips.txt").write_text("trip_id,x\nT1,R1\n")
    with pytest.raises(ValueError, match="trips.route_id"):
        tables.timetable(spark, str(tmp_path))


def test_stream_that_goes_on(spark, cities, places, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1,Paris,Lyon\nx\n")
    stops = spark.createDataFrame([("P", "Paris", "10000001"), ("L", "Lyon", "20000001")], "stop_id string, stop_name string, stop_code string")
    times = spark.createDataFrame([("T", "P", "1", "06:00:00", "06:00:00"), ("T", "L", "2", "08:00:00", "08:00:00")], "trip_id string, stop_id string, stop_sequence string, arrival_time string, departure_time string")
    known = tables.timetable_of(stops, times, spark.createDataFrame([("T", "R")], "trip_id string, route_id string"))
    own = streams.schedule_stream(streams.order_stream(spark, str(tmp_path / "in")), places, known, str(tmp_path / "out"), str(tmp_path / "state"), every="1 second")
    own.processAllAvailable()
    (tmp_path / "in" / "b.txt").write_text("2,Lyon,Paris\n")
    own.processAllAvailable()
    own.stop()
    got = spark.read.schema("order_id string, line_no int, line string").parquet(str(tmp_path / "out" / "*"))
    assert sorted(r.line for r in got.collect()) == ["1,Paris,Lyon", "1,SCHEDULE,DIRECT,Paris,Lyon,06:00:00,08:00:00,T,Paris,Lyon", "2,NO_SCHEDULE_FOUND,Lyon,Paris"]
