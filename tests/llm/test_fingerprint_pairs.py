"""The fingerprints of the pipeline's near copies: pigeonring of six bits against all pairs, and links by fingerprints alone."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from orderflow.llm import near_copies, simhash


def _apart(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def test_pairs_within_six_bits(spark):
    """Random fingerprints, each with a few that differ in up to nine bits, the sign bit among them."""
    rng, fps = np.random.default_rng(3), set()
    for base in rng.integers(-(1 << 63), (1 << 63) - 1, 120):
        fps.add(int(base))
        for bits in rng.integers(1, 10, 3):
            mask = sum(1 << int(b) for b in rng.choice(64, bits, False))
            fps.add(int(np.uint64((int(base) & (1 << 64) - 1) ^ mask).view(np.int64)))
    got = [(r.u, r.v) for r in simhash.wide_pairs(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    wanted = {(max(p), min(p)) for p in combinations(fps, 2) if _apart(*p) <= 6}
    assert len(wanted) > 200 and len(got) == len(set(got)) and set(got) == wanted


def test_a_large_bucket_is_not_squared(spark):
    """Each of 300 fingerprints within three bits of one meets a few others, and all are connected."""
    base, rng = 0x0123456789ABCDEF, np.random.default_rng(4)
    fps = {base} | {base ^ sum(1 << int(b) for b in rng.choice(60, 3, False)) for _ in range(300)}
    got = {(r.u, r.v) for r in simhash.wide_pairs(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert all(_apart(u, v) <= 6 for u, v in got) and len(got) < len(fps) * (len(fps) - 1) // 4
    reached, edge = {base}, {base}
    while edge:
        edge = {y for p in got for x, y in (p, p[::-1]) if x in edge} - reached
        reached |= edge
    assert reached == fps


def test_links_come_from_fingerprints(spark):
    """Without any band, long texts that differ in a few words are linked; a text of the same fingerprint that has other words is not."""
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 5000, 600)]
    edited = [f"e{k}" if k % 150 == 75 else w for k, w in enumerate(base)]
    texts = [" ".join(base), " ".join(edited), " ".join([*base, "more"]), " ".join(f"z{k}" for k in range(600))]
    rows = [(k, simhash.fingerprint_of(texts[0 if k == 3 else k].encode(), near_copies.WIDTH), t) for k, t in enumerate(texts)]
    assert simhash.MAX_BITS < max(_apart(rows[0][1], r[1]) for r in rows) <= simhash.WIDE_BITS
    docs = spark.createDataFrame(rows, "text_hash long, fp long, text string")

    def sets_of(wanted):
        return docs.join(wanted, "text_hash").select("text_hash", near_copies.shingle_sets("text").alias("shingles"))

    none = docs.select("text_hash", "fp", F.array().cast("array<long>").alias("keys"))
    links = {frozenset((r.u, r.v)) for r in near_copies.similar_links(none, sets_of).collect()}
    assert links and set().union(*links) == {0, 1, 2}
    assert {r.fp for r in docs.where("text_hash < 3").select(near_copies.marks("text").fp.alias("fp")).collect()} == {r[1] for r in rows[:3]}
