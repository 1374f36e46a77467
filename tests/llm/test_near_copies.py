"""Near copies by shingles, against all pairs."""

import numpy as np
import pytest
from helpers_llm import FOLDER, near_copies_of as wanted_of

import corpus_pipeline
from orderflow.llm import near_copies, simhash


def test_edited_copies_go(spark):
    """Groups of edited copies, a chain whose ends differ, short texts and texts without words."""
    rng = np.random.default_rng(5)
    texts = {900: "a b c", 901: "A  b c", 902: "", 903: None, 904: "a b d"}
    for g in range(8):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for k in range(12):
            own = list(base)
            for at in rng.integers(0, 200, rng.integers(0, 9)):
                own[at] = f"e{rng.integers(0, 10**6)}"
            texts[g * 20 + k] = " ".join(own)
            base = own if g >= 4 else base
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    wanted = wanted_of(texts)
    got = {r.doc_id: r.keep_id for r in near_copies.near_copy_classes(docs).collect()}
    assert got == wanted
    kept = simhash.drop_near_duplicates(docs, classes=near_copies.near_copy_classes)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(wanted.values()))


def test_pipeline_stage_drops_edited_copies(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    wanted = wanted_of({r.doc_id: r.text for r in docs.collect()})
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = {r.doc_id for r in stage(spark, docs, FOLDER).collect()}
    assert got == set(wanted.values()) and not {145, 177} & got  # edited copies of 6 and 1, over two bits apart


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([(None, None)] * n, "doc_id long, text string")
    assert simhash.drop_near_duplicates(docs, classes=near_copies.near_copy_classes).count() == n


@pytest.mark.parametrize("few", [0, 8])
def test_groups_whose_copies_are_not_alike(spark, monkeypatch, few):
    """A text with many edited copies, most near it, most not near each other, and some near a copy only."""
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "LOT", 7)
    rng, texts = np.random.default_rng(9), {}
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    edit = lambda words, n: [f"e{rng.integers(0, 10**9)}" if k in set(rng.choice(len(words), n, False)) else w for k, w in enumerate(words)]
    for k in range(120):
        texts[k] = edit(base, int(rng.integers(0, 6)))
    for k in range(120, 150):
        texts[k] = edit(texts[int(rng.integers(0, 120))], int(rng.integers(1, 4)))[: int(rng.integers(130, 150))]
    docs = {k: " ".join(w) for k, w in texts.items()}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    wanted = wanted_of(docs)
    assert len(set(wanted.values())) > 10
    assert {r.doc_id: r.keep_id for r in near_copies.near_copy_classes(rows).collect()} == wanted


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Null, empty, repeated and very long texts, null ids, extra columns with clashing names, and an empty table."""
    good = "The mill by the river stood for a hundred years, and those who lived there said that it would stand for a hundred more, whatever the people of the town might think of it, since nobody had ever seen the water rise above the second step of the old stone stairs that led to the garden behind the house."
    rng = np.random.default_rng(1)
    long = " ".join("".join(w) for w in rng.choice(list("abcdefghij"), (30_000, 6)))
    rows = [(1, good), (1, good), (2, good + " token=Abc123Def456Ghi789xyz"), (3, None), (4, ""), (5, "few words"), (None, good.replace("mill", "barn").replace("river", "lake").replace("town", "village").replace("stone", "wooden").replace("garden", "yard")), (6, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, key string, rid long")
    for name, table in (("odd", docs), ("none", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 6] and all(r.n_tokens > 50 for r in got)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).isEmpty()
