"""What SQL cannot express, against plain versions of the definitions."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
import xxhash
from helpers_llm import FOLDER, low, near_copies_of, slow_components, words
from pyspark.sql import functions as F

import corpus_pipeline
from orderflow import llm
from orderflow.llm import components, decontaminate, knn_quality, pieces, quality_rules, secret_scan, simhash, url_lists, warc
from orderflow.llm._shared import scratch_path


def documents():
    rows = pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in rows}


def slow_fingerprint(text):
    w = words(low(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query(spark):
    docs = documents()
    prints = {i: slow_fingerprint(r["text"]) for i, r in docs.items()}
    links = [(a, b) for a, b in combinations(docs, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    wanted = {(i, f"{prints[i]:016x}", c) for i, c in slow_components(links, docs).items()}
    assert {tuple(r) for r in llm.queries()["op1_simhash_near_dedup"](spark, FOLDER).collect()} == wanted


@pytest.mark.parametrize("hot_bucket", [1, 64])
def test_near_links_lose_nothing(spark, hot_bucket):
    """Clusters around a few centres, through hot buckets (1) and joined ones (64)."""
    rng, prints = np.random.default_rng(1), set()
    for centre in rng.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(40):
            x = int(centre)
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            prints.add(x - (1 << 64) if x >> 63 else x)
    rows = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {(r.u, r.v) for r in simhash.near_links(rows, hot_bucket).collect()}
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(bits(a, b) <= 2 for a, b in found)
    wanted = [(a, b) for a, b in combinations(prints, 2) if bits(a, b) <= 2]
    assert slow_components(found, prints) == slow_components(wanted, prints)


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionByName(spark.createDataFrame([(900, 901), (900, 900), (901, 900)], "u long, v long"))
    got = {r.node: r.root for r in components.connected_components(edges).collect() if r.node != r.root}
    assert got == {**{i: 0 for i in range(1, 301)}, 901: 900}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_sentencepiece_query_and_spans(spark):
    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    wanted = set()
    for i, r in documents().items():
        ids = sp.encode(r["text"] or "", add_bos=True, add_eos=True)
        size = len((r["text"] or "").encode())
        places = [(0, 0), *((p.begin, p.end) for p in sp.encode(r["text"] or "", return_type="proto").pieces), (size, size)]
        digest = lambda x: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
        wanted.add((i, len(ids), digest(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), digest(places)))
    got = llm.queries()["op3_sentencepiece"](spark, FOLDER)
    assert {tuple(r) for r in got.collect()} == wanted
    own = pieces.Model.read(pieces.model_bytes())
    for text in ("", " ", "a  b \n c", "▁x ▁ y", "日本 😀 x", "é\0 <s>", "  ", "a ", documents()[0]["text"]):
        ids = own.ids([text], {})[0]
        assert ids.tolist() == sp.encode(text)
        begins, ends = own.spans(text, ids)
        places = [(p.begin, p.end) for p in sp.encode(text, return_type="proto").pieces]  # in bytes
        assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == places


def test_character_map_takes_the_longest_prefix():
    """A map compiled by hand in the double-array form: a -> x, ab -> yz."""

    def unit(step, label=0, leaf=False):
        return step << 10 | leaf << 8 | label

    units = [0] * 512
    units[0] = unit(1)
    units[1 ^ 97] = unit(200, 97, True)  # after "a", its value, and on
    at = (1 ^ 97) ^ 200
    units[at] = 0 | 1 << 31
    units[at ^ 98] = unit(300, 98, True)
    units[at ^ 98 ^ 300] = 2 | 1 << 31
    blob = np.array([4 * len(units), *units], "<u4").tobytes() + b"x\0yz\0"
    own = pieces.CharacterMap(blob)
    assert own.longest(b"abc", 0) == (2, b"yz") and own.longest(b"ac", 0) == (1, b"x") and own.longest(b"c", 0) is None
    model = pieces.Model(None, own, True, True, True, np.zeros(1), False, b"")
    text, way = model.normalised("  ab a")
    assert text.decode() == "▁yz▁x" and way.tolist() == [2, 2, 2, 2, 2, 4, 4, 4, 5, 6]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_compiled_maps_of_the_library(rule):
    """Normal forms and the way back to original bytes, by the library's own compiled maps."""
    kept = {"add_dummy_prefix": True, "escape_whitespaces": True, "remove_extra_whitespaces": True}
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **kept)
    spec = dict(pieces._fields(dict(pieces._fields(library.serialized_model_proto()))[3]))
    own = pieces.Model(None, pieces.CharacterMap(spec[2]), True, True, True, np.zeros(1), False, b"")
    assert own.charmap.units
    texts = ["", " ", "  a  b ", "ＡＢＣ　①②", "ﬁn ½ ㍿ x", "e\u0301té İstanbul STRASSE ß", "\u200bx\ufeffy\tz\nw", "カ\u3099 ｶﾞ 한글 \u1112\u1161", "😀 a\u0300\u0301", "ﷺ"]
    for text in texts + [r["text"] or "" for r in documents().values()]:
        normal, offsets = library.normalize(text, with_offsets=True)
        mine, way = own.normalised(text)
        assert mine.decode() == normal
        # the library counts code points, and names the begin of each
        before, at = np.cumsum([0, *(len(c.encode()) for c in normal)]), np.cumsum([0, *(len(c.encode()) for c in text)])
        assert not normal or [int(way[k]) for k in before] == [int(at[k]) for k in offsets]


def test_quality_ablation(spark):
    book = quality_rules.ledger(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    bits = [r.fail_bits for r in book.collect()]
    for r in quality_rules.ablation(book, "v1").collect():
        bit, mask = quality_rules.mask([r.rule]), quality_rules.mask(quality_rules.POLICIES["v1"])
        assert r.n_docs == len(bits) and r.n_failed == sum(b & bit != 0 for b in bits)
        assert r.n_failed_alone == sum(b & mask == bit for b in bits)
        assert (r.n_kept, r.n_kept_without) == (sum(b & mask == 0 for b in bits), sum(b & mask & ~bit == 0 for b in bits))


def test_quality_policy_follows_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    got = [(labels[r.doc_id], r.kept, r.n_words) for r in llm.queries()["op4_quality_rules"](spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels]
    assert all(k for q, k, n in got if q == 1 and n >= 50) and not any(k for q, k, _ in got if q == 0)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_exact_and_near_passages(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 40)
    rng = np.random.default_rng(3)
    texts = {i: " ".join(rng.choice(list("abcde"), rng.integers(0, 30))) for i in range(40)}
    items = {100: "a b", 7: "c", 20: " ".join("abcdeabcdeab"), 21: "e E, d-d", 22: "x y z", 23: None, 24: "1 a", None: "x q"}
    texts |= {50: " ".join("abcdexabcdeab"), 51: " ".join("zabcdeabcdeabz"), 52: " ".join("abcdeabcdea"), 53: "x q a", 54: "q x"}
    slop = 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for i, t in items.items():
        w = words(low(t), pattern)
        size = min(10, len(w))
        windows[i] = [w[k : k + size] for k in range(len(w) - size + 1)] if w else []
    wanted = {}
    for d, t in texts.items():
        w, hit, exact, near = words(low(t), pattern), set(), set(), set()
        for i, ws in windows.items():
            for x in ws:
                for s in range(-slop, len(w) + slop):
                    fits = [any(0 <= s + k + e < len(w) and w[s + k + e] == y for e in range(-slop, slop + 1)) for k, y in enumerate(x)]
                    if s >= 0 and w[s : s + len(x)] == x:
                        hit |= set(range(s, s + len(x)))
                        exact.add(i)
                    elif all(fits):
                        near.add(i)
        exact.discard(None)  # an item without an id hits, and is named nowhere
        near.discard(None)
        wanted[d] = (len(w), len(hit), sorted(exact), sorted(near - exact))
    got = decontaminate.benchmark_matches(docs, bench, slop).withColumn("n_hit", decontaminate._n_hit())
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(set(r.item_ids)), sorted(set(r.near_ids))) for r in got.collect()} == wanted


def test_knn_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    rows = llm.queries()["op8_knn_quality"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_scores_are_those_of_plain_votes(spark):
    """Every document against every labelled vector, one at a time; equal neighbours at the edge vote all."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "text")).unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a")], "doc_id long, text string"))
    labels = docs.where("doc_id >= 0").selectExpr("doc_id", "CAST(length(text) % 2 AS INT) AS quality")
    model = knn_quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in knn_quality.score(docs, model).collect()}
    assert 60 < len(model.labels) < 120
    for r in docs.collect():
        x = np.zeros(knn_quality.TERMS)
        for term, n in knn_quality.terms_of((r.text or "").encode()).items():
            x[term] = n
        x = x * model.weights
        x = (x / (np.linalg.norm(x) or 1)) @ model.axes.astype(float)
        x = x / (np.linalg.norm(x) or 1)
        near = [float(v @ x) for v in model.vectors.astype(float)]
        edge = sorted(near, reverse=True)[knn_quality.NEIGHBOURS - 1]
        votes = [(max(c, 0.0) ** 4, y) for c, y in zip(near, model.labels, strict=True) if c >= edge - 1e-6]
        total = sum(v for v, _ in votes)
        assert abs(got[r.doc_id] - (sum(v * y for v, y in votes) / total if total else 0.5)) < 2e-3, r.doc_id
    empty = knn_quality.fit(docs.limit(0), labels)
    assert {r.score for r in knn_quality.score(docs, empty).collect()} == {0.5}


def test_common_and_live_secrets(spark):
    value = "A1b2C3d4E5f6G7h8J9k0"
    rows = [(i, f"x token={value} y", "en", f"s{i}") for i in range(3)] + [(9, "token=Z9y8X7w6V5u4T3s2 token=short-one", "en", "s0"), (10, "no", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (len(r.found), r.n_common, r.n_live) for r in secret_scan.scan(docs).collect()}
    assert got == {0: (1, 1, 0), 1: (1, 1, 0), 2: (1, 1, 0), 9: (2, 0, 1), 10: (0, 0, 0)}
    text = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert text == {0: "x token=<EXAMPLE> y", 1: "x token=<EXAMPLE> y", 2: "x token=<EXAMPLE> y", 9: "token=<SECRET> token=<SECRET>", 10: "no"}


def test_a_value_in_a_third_of_the_rows_and_null_owners(spark):
    """Counts by owners and repositories against plain ones; values are in no stored table."""
    rng, rows = np.random.default_rng(2), []
    values = [f"A1b2C3d4E5f6G7h8J9{k:02d}" for k in range(12)]
    for i in range(300):
        value = values[0] if i % 3 == 0 else values[int(rng.integers(1, 12))]
        owner = None if i % 7 == 0 else f"s{rng.integers(0, 2 if value < values[6] else 5)}"
        rows.append((i if i % 5 else None, f"token={value};", f"p{rng.integers(0, 4)}", owner))
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string, source string")
    owners, repos = {v: set() for v in values}, {v: set() for v in values}
    for _, t, path, owner in rows:
        owners[t[6:-1]].add(owner)
        repos[t[6:-1]].add((owner, path))
    common = {v: len(owners[v]) >= 3 or len(repos[v]) >= 6 for v in values}
    assert len(set(common.values())) == 2 or all(common.values())
    repo = F.to_json(F.struct("source", "path"))
    got = secret_scan.scan(docs, repo=repo)
    assert sorted((r.doc_id or -1, r.n_common, r.n_live) for r in got.collect()) == sorted((i or -1, int(common[t[6:-1]]), int(not common[t[6:-1]])) for i, t, _, _ in rows)
    assert "value" not in got.schema["found"].dataType.elementType.names
    masked = secret_scan.redact(docs, repo=repo).collect()
    assert sorted((r.doc_id or -1, r.text) for r in masked) == sorted((i or -1, "token=<EXAMPLE>;" if common[t[6:-1]] else "token=<SECRET>;") for i, t, _, _ in rows)
    assert secret_scan.redact(docs.drop("path")).count() == 300  # without a language the owner is the repository


def test_many_secrets_in_one_text(spark):
    text = "é " + "token=abcdef%d; " * 1200 % tuple(range(1200))
    row = secret_scan.scan(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).first()
    wanted = [(m.start(), m.end()) for m in re.finditer(r"token=[a-z0-9]+", text)]
    assert [(s.start, s.end) for s in row.found] == wanted


def test_license_texts(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT ..."
    docs = spark.createDataFrame([(1, mit), (2, "abc\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0. More"), (3, "the permission")], "doc_id long, text string")
    from orderflow.llm import licenses

    got = {r.doc_id: (r.licenses, r.n_matches, r.n_leftover) for r in licenses.license_matches(docs).collect()}
    assert got == {1: ("MIT", 1, 0), 2: ("MIT,CC-BY-NC-4.0", 2, 0), 3: ("", 0, 0)}
    assert all(any(w in s for w in licenses.WORDS) for s in licenses.SENTENCES.values())


def test_intervals(spark):
    rows = [("a", 1, "add"), ("a", 3, "add"), ("a", 5, "remove"), ("a", 7, "remove"), ("a", 9, "add"), ("b", 2, "remove"), ("c", 4, "add"), ("c", 4, "remove")]
    entries = spark.createDataFrame(rows, "pattern string, n int, action string").withColumn("listed_on", F.expr("date_add(date'2024-01-01', n)"))
    got = [(r.pattern, r.valid_from.day, r.valid_to and r.valid_to.day) for r in url_lists.validity_intervals(entries).orderBy("pattern", "valid_from").collect()]
    assert got == [("a", 2, 6), ("a", 10, None)]


def test_archives_are_the_same_each_time(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    runs = []
    for parts in (1, 5):
        out = scratch_path(spark, "test-warc")
        rows = warc.write_archives(pages.repartition(parts), out, shard_bytes=100_000, roll_bytes=20_000).collect()
        runs.append(sorted((r.name, r.records, r.bytes, r.sha256, r.first_id, r.last_id) for r in rows))
        assert warc.read_archives(spark, out).count() == pages.count()
    assert runs[0] == runs[1] and len(runs[0]) > 3


def test_pipeline(spark):
    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    docs = {i: r for i, r in documents().items() if quality_rules.measured(r["text"] or "")}
    kept = {}
    for i, r in docs.items():
        m = dict(zip(quality_rules.MEASURES, quality_rules.measured(r["text"]), strict=True))
        if not any(eval(rule.replace(" OR ", " or "), {}, m) for rule in quality_rules.RULES.values()):  # noqa: S307
            kept[i] = r["text"]
    first = {i: kept[i] for i, root in near_copies_of(kept).items() if i == root}
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    passages = set()
    for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist():
        w = words(low(r["text"]), pattern)
        passages |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    clean = {}
    for i, t in first.items():
        w = words(low(t), pattern)
        if not any(tuple(w[k : k + 10]) in passages for k in range(len(w))):
            clean[i] = t
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == set(clean)
    for i, t in clean.items():
        plain = sp.decode(got[i].ids)
        if not re.search(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA|[0-9a-f]{24}", t):
            assert got[i].ids == sp.encode(t, add_bos=True, add_eos=True)
        assert not re.search(r"token = \"[0-9a-f]{40}|[0-9a-f]{24}", plain)
