"""Text quality by nearest neighbours among labelled latent-semantic vectors.

A text becomes counts of hashed terms: the shapes of its words and of neighbouring words, its repeats, and its
size. No word enters as such: quality shows in form, in any language, and what a text is about is none of it. A bounded sample of labelled rows gives the term weights, and by a truncated singular value
decomposition the latent space; the sample's own vectors there are the neighbours. Model and neighbours
have a fixed size, so they are shipped to all tasks, and every document is compared with every neighbour, a block of
documents at a time. The neighbours' labels are weighted by cosine similarity.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm._shared import table, text_slices

TERMS = 2048
DIMENSIONS = 64
PER_LABEL = 1000  # labelled rows of each label in the sample
NEIGHBOURS = 15
THRESHOLD = 0.3
BLOCK = 512  # documents compared at once
EDGE = 1e-9  # cosines this near the last neighbour's are its equals, and vote too

_SHAPE = bytes(
    65 if 65 <= b <= 90 else 97 if b >= 128 or 97 <= b <= 122 else 48 if 48 <= b <= 57 else 32 if b <= 32 else b for b in range(256)
)


def terms_of(text: bytes) -> dict[int, float]:
    """Weighted counts of a text's hashed terms; an empty text has terms too."""
    words = text.split()
    raw = np.frombuffer(text.translate(_SHAPE), np.uint8)
    kept = raw[np.concatenate(([True], raw[1:] != raw[:-1]))] if len(raw) else raw
    shapes = kept.tobytes().split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(shapes)
    counts |= {b" ".join(pair): n for pair, n in Counter(zip(shapes, shapes[1:], strict=False)).items()}
    found = {b"=word": sum(map(eq, words, words[1:])), b"=line": len(lines) - len(set(lines))}
    found[b"=size %d" % len(words).bit_length()] = 1
    found[b"=distinct %d" % (8 * len(set(words)) // len(words) if words else 8)] = 1
    out: dict[int, float] = {}
    for term, n in (*counts.items(), *found.items()):
        if n:
            at = zlib.crc32(term) % TERMS
            out[at] = out.get(at, 0.0) + 1 + float(np.log(n))
    return out


def _dense(rows: list[dict[int, float]]) -> np.ndarray:
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, row in enumerate(rows):
        x[i, list(row)] = list(row.values())
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


@dataclass
class Model:
    """Term weights, the way into the latent space, and the labelled vectors there."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @staticmethod
    def fit(rows: list[dict[int, float]], labels: list[int]) -> Model:
        x = _dense(rows)
        weights = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.5).astype(np.float32)
        x = _unit(x * weights)
        rng, want = np.random.default_rng(0), min(DIMENSIONS, *x.shape) if len(x) else 0
        q = np.linalg.qr(x.T @ rng.standard_normal((len(x), want + 8)))[0] if want else np.zeros((TERMS, 0))
        for _ in range(4):
            q = np.linalg.qr(x.T @ (x @ q))[0] if want else q
        _, _, v = np.linalg.svd(x @ q, full_matrices=False) if want else (0, 0, np.zeros((0, 0)))
        axes = (q @ v.T[:, :want]).astype(np.float32) if want else np.zeros((TERMS, 0), np.float32)
        # rows of the same terms have one and the same vector, whatever order their products were added up in
        first: dict[tuple, int] = {}
        same = [first.setdefault(tuple(sorted(row.items())), i) for i, row in enumerate(rows)]
        return Model(weights, axes, _unit(x @ axes)[same], np.array(labels, np.float32))

    def __post_init__(self):
        self.different, self.which = np.unique(self.vectors.astype(float), axis=0, return_inverse=True) if self.vectors.size else (self.vectors, np.zeros(0, int))

    def scores(self, rows: list[dict[int, float]]) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, by similarity; 0.5 if nothing is similar.

        Cosines are doubles, and one for each different labelled vector, so equals stay equal on any machine.
        """
        out = np.full(len(rows), 0.5)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(rows), BLOCK):
            own = _unit(_unit(_dense(rows[at : at + BLOCK]).astype(float) * self.weights) @ self.axes.astype(float))
            cosine = (own @ self.different.T)[:, self.which] if self.vectors.size else np.zeros((len(own), len(self.labels)))
            least = np.partition(cosine, len(self.labels) - k, axis=1)[:, -k, None]
            vote = np.where(cosine >= least - EDGE, np.maximum(cosine, 0), 0)
            vote *= vote
            vote *= vote
            total = vote.sum(axis=1, dtype=np.float64)
            out[at : at + BLOCK] = np.where(total > 0, vote @ self.labels / np.where(total > 0, total, 1), 0.5)
        return np.clip(np.round(out, 6), 0, 1)


def _held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Terms and label of at most ``PER_LABEL`` rows of each label, the first by hash of their id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where(~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    first = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_LABEL) for y in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                rows = [terms_of(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("label"),
                        pa.array([list(r) for r in rows], pa.list_(pa.int32())),
                        pa.array([list(r.values()) for r in rows], pa.list_(pa.float64())),
                    ],
                    ["doc_id", "label", "terms", "counts"],
                )

    got = texts.join(chosen, "doc_id").select("doc_id", "label", "text")
    found = got.mapInArrow(run, "doc_id long, label int, terms array<int>, counts array<double>")
    # repeats of an id are one neighbour, so that the sample keeps its bound
    return found.groupBy("doc_id").agg(F.min(F.struct("label", "terms", "counts")).alias("r")).select("doc_id", "r.*")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled sample. Only rows that are not held out take part; a null label does not."""
    rows = _sample(docs, labels).orderBy("doc_id").collect()
    return Model.fit([dict(zip(r.terms, r.counts, strict=True)) for r in rows], [r.label for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``docs`` by its whole text; null is empty. Null ids and repeats stay."""

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "text"):
                rows = [terms_of(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(rows), pa.float64())], ["doc_id", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double")


def op8_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
