"""Labelled files of one's own, whole, and acceptance on noisy orders.

``ORDERFLOW_LABELLED`` names a folder with ``eval.csv``, ``synthetic_eval.csv`` and ``cities.txt``; without it those tests are skipped.
"""

import os

import pytest
from pyspark.sql import functions as F

from orderflow.operators import confidence, evaluate, extract, generate
from orderflow.sources import tables

FOLDER = os.environ.get("ORDERFLOW_LABELLED", "")
TOWNS = "Paris,Lyon,Marseille,Toulouse,Nice,Nantes,Montpellier,Strasbourg,Bordeaux,Lille,Rennes,Reims,Saint-Etienne,Toulon,Le Havre,Grenoble,Dijon,Angers,Brest,Clermont-Ferrand".split(",")
LABELLED = [
    ("1", "Je souhaite me rendre à Nice depuis Dijon", "Dijon", "Nice", 1, "TP"),
    ("2", "Je vais à Brest depuis Reims, merci", "Reims", "Brest", 1, "TP"),
    ("3", "Je veux un trajet de Rennes vers Angers demain", "Rennes", "Angers", 1, "TP"),
    ("4", "Je veux aller de Lyno à Toulosue", "Lyon", "Toulouse", 1, "FALSE_NEGATIVE"),
    ("5", "Je veux aller de Paris à Le Havre", "Paris", "Le Havre", 1, "FALSE_NEGATIVE"),
    ("6", "Je veux aller de Lille à Lille", None, None, 0, "TN"),
    ("7", "Je veux aller de Lille ou Nantes à Reims", None, None, 0, "TN"),
    ("8", "Je souhaite aller de Dijon à Reims ou Nantes", None, None, 0, "FALSE_POSITIVE"),
    ("9", "Quelle heure est-il", None, None, 0, "TN"),
]


def cities(spark):
    return spark.createDataFrame([(t,) for t in TOWNS], "city string")


def judged(rows, known):
    found = extract.parse_orders(rows.withColumnRenamed("sentence_id", "order_id").select("order_id", "sentence"), known)
    return evaluate.outcomes(rows.join(found.select(F.col("order_id").alias("sentence_id"), "departure", "destination"), "sentence_id"))


def test_outcomes_by_the_rules(spark):
    rows = spark.createDataFrame([r[:5] for r in LABELLED], tables.LABELLED)
    got = {r.sentence_id: r.outcome for r in judged(rows, cities(spark)).collect()}
    assert got == {r[0]: r[5] for r in LABELLED}


@pytest.mark.skipif(not FOLDER, reason="no folder of labelled files")
@pytest.mark.parametrize("name, wanted", [("eval.csv", (6, 0, 0, 6)), ("synthetic_eval.csv", (233, 20, 54, 194))])
def test_whole_files(spark, name, wanted):
    rows = tables.labelled_rows(spark, f"file://{FOLDER}/{name}")
    one = evaluate.scores(judged(rows, tables.dictionary(spark, f"file://{FOLDER}/cities.txt"))).first()
    assert (one.tp, one.fp, one.fn, one.tn) == wanted


def test_acceptance_on_noisy_orders(spark):
    """Of noisy orders among twenty towns the rules accept about 40 in a hundred, and the names alone fewer."""
    noisy = generate.noisy_orders(spark.range(4000), cities(spark))
    stations = tables.stations(spark.createDataFrame([(f"{t} Gare", f"{k:08d}", 45.0, 2.0) for k, t in enumerate(TOWNS)], "station_name string, uic_code string, latitude double, longitude double"))
    share = {}
    for mode, reason in (("baseline", "invalid_or_ambiguous"), ("gazetteer", "spacy_no_result")):
        found = confidence.resolve(noisy, cities(spark), stations, mode=mode)
        share[mode] = evaluate.rates(found).first().ok_percent
        assert evaluate.failure_reasons(found, 1).first().reason == reason
    assert abs(share["baseline"] - 40) < 8 and abs(share["gazetteer"] - 27) < 8, share
