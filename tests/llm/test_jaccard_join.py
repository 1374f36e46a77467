"""Links and components of 4-word shingles, against all pairs."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import DOCS, FOLDER, low, odd_documents, slow_components, words

from orderflow.llm import jaccard_join


def plain_set(text):
    w = words(low(text))
    return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def plain(rows):
    """Rows ``(id, text)`` to ``(id, n, component, copies)`` in their order."""
    sets = [plain_set(t) for _, t in rows]
    near = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root, ids = slow_components(near, range(len(rows))), {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root[k], []).append(i)
    least = {r: min((i for i in g if i is not None), default=None) for r, g in ids.items()}
    return [(i, len(s), least[root[k]] if s else i, sum(s == t for t in sets) - 1 if s else 0) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def same(docs, rows):
    key = lambda r: tuple((x is None, x) for x in r)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_copies) for r in jaccard_join.jaccard_components(docs).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    return got


def groups(seed, n_groups, copies, length, edits):
    rng, rows = np.random.default_rng(seed), []
    for g in range(n_groups):
        base = [f"w{x}" for x in rng.integers(0, 3000, length)]
        for _ in range(copies):
            own = list(base)
            for at in rng.integers(0, length, rng.integers(0, edits + 1)):
                own[at] = f"e{rng.integers(0, 10**6)}"
            rows.append(" ".join(own[: length - int(rng.integers(0, 6))]))
            base = own if g % 2 else base
    return rows


@pytest.mark.parametrize("few, lot", [(8, 2048), (0, 5)])
def test_against_all_pairs(spark, monkeypatch, few, lot):
    """Edited copies about the least similarity, chains, short texts, a passage that all of some texts have, and repeated rows."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "LOT", lot)
    rng = np.random.default_rng(8)
    texts = groups(1, 6, 25, 160, 9) + groups(2, 4, 12, 40, 2) + groups(3, 2, 12, 900, 30) + groups(6, 10, 6, 14, 1)
    passage = " ".join(f"p{x}" for x in range(60))
    texts += [passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 3000, 80)) for _ in range(60)]
    texts += ["a b c", "A  b c", "a b", "a b c d", "A b c d\n", "a b c e", "", None, " \t", "a", "a"] + texts[:9] * 2
    rows = [(int(k * 7 % 1009), t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, "nobody else"), (None, None), (3, texts[3])]
    docs = spark.createDataFrame([(*r, "k", 1, b"s") for r in rows], "doc_id long, text string, key string, u int, set_id binary").repartition(7)
    got = same(docs, rows)
    assert 60 < len({c for *_, c, _ in got}) < len(rows) - 100


def test_all_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    same(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_and_no_rows(spark):
    odd = odd_documents(spark)
    same(odd, [(r.doc_id, r.text) for r in odd.collect()])
    assert jaccard_join.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_linked_sets_share_a_segment():
    """Sets at the least similarity, of all small sizes and some large ones."""
    rng = np.random.default_rng(4)
    for size in [*range(1, 60), 200, 900, 3000]:
        for _ in range(6):
            x = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
            for gone in range(jaccard_join.most_apart(2 * size) + 1):
                new = max(0, (100 * (size - gone)) // 85 - size)
                y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 1 << 64, rng.integers(0, new + 1), np.uint64)]))
                common = len(np.intersect1d(x, y))
                if size > 60 and gone % 9:
                    continue
                if 100 * common >= 85 * (len(x) + len(y) - common):
                    assert np.intersect1d(jaccard_join.segment_keys(x), jaccard_join.segment_keys(y)).size, (size, gone)


def test_sets_of_texts():
    texts = ["A b  c\td é", "\n", None, "x", "a a a a a a", "  b c d", "b\x0bc d e f g"]
    for text, got in zip(texts, jaccard_join.shingle_sets(pa.array(texts)), strict=True):
        assert len(got) == len(plain_set(text)) and (np.diff(got.astype(object)) > 0).all()
    x, y = jaccard_join.shingle_sets(pa.array(["one two three four five", "ONE two three four six"]))
    assert len(np.intersect1d(x, y)) == 1
