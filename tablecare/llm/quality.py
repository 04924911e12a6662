"""Quality scores by the vote of nearest neighbours among labelled latent-semantic vectors.

A text is the counts of its byte trigrams, hashed to ``BUCKETS``, and of words that repeat the
word before, given weight by taking up ``ECHOES`` places. Logarithms of the counts are
weighted by inverse document frequency, counted over all documents, and projected to ``RANK``
directions by a singular value decomposition of the labelled rows' vectors. Those rows' latent
vectors, at most ``ROWS_PER_LABEL`` of either label, are what tasks get (about 1 MB). Every
document is compared with all of them by exact cosines, in blocks; its ``NEIGHBOURS`` nearest
vote with their similarity as weight, a label's votes being scaled to how many rows it has.

Learned from: rows of ``labels`` with a label, whose crc32(doc_id) mod ``FOLDS`` is not
``HELD_OUT``; of more than ``ROWS_PER_LABEL``, those with the smallest hash of doc_id. Of rows with
the same doc_id one is learned from, that whose text has the smallest hash.

Defined cases: null text is the empty text; a text without any neighbour of positive similarity,
such as the empty one, scores the share of label 1; so does every text if there is one label
only, and 0.5 if there is none; rows whose labels contradict each other are not learned from;
repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecare.llm.common import crc_remainder, documents, least_hashed, one_text, staged, text_of

FOLDS, HELD_OUT = 3, 1
BUCKETS, ECHOES, RANK = 4096, 16, 48
TERMS = BUCKETS + ECHOES
ROWS_PER_LABEL, NEIGHBOURS = 1500, 15
#: Documents compared at a time.
BLOCK = 256


def counts_of(text: str) -> np.ndarray:
    """Hashed counts of the byte trigrams of a text, whose end is padded by two zero bytes; in the
    last ``ECHOES`` places, how many words repeat the one before."""
    out = np.zeros(TERMS, np.int64)
    if text:
        b = np.frombuffer(text.encode() + b"\0\0", np.uint8).astype(np.uint32)
        mixed = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> 20
        out[:BUCKETS] = np.bincount(mixed, minlength=BUCKETS)
        words = text.split()
        out[BUCKETS:] = sum(map(eq, words, words[1:]))
    return out


def learnable(labels: DataFrame, name: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from, one row a document."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .where(crc_remainder("doc_id", folds) != held_out)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where(F.col("label") == F.col("most"))
        .drop("most")
    )


def sample(texts: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(doc_id, label, text), staged: at most ``most`` documents of either label, one text of each.

    ``known`` (doc_id, label) has a document once; of those with more texts than one, the text with
    the smallest hash is taken, so a doc_id that many rows have counts as one.
    """
    chosen = F.broadcast(least_hashed(known, "label", "doc_id", lambda groups: most))
    return staged(one_text(texts.join(chosen, "doc_id"), "doc_id", "label"), "sample")


@dataclass
class Model:
    """Inverse document frequencies, projection, labelled unit vectors, labels, weights, share of label 1."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(set(self.labels.tolist())) < 2:
            return np.full(len(texts), self.prior)
        found = latent(np.array([counts_of(t) for t in texts]), self.idf) @ self.projection
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
        near = found @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(near, best, 1), 0) * self.weights[best]
        total = votes.sum(1)
        share = (votes * self.labels[best]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, share, self.prior), 0, 1)


def latent(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of weighted logarithms of counts."""
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def directions(x: np.ndarray, rank: int) -> np.ndarray:
    """The first right singular vectors of ``x``, by iterating on a random subspace."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(3).normal(size=(x.shape[1], min(rank + 8, *x.shape))).astype(np.float32)
    for _ in range(5):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T[:, :rank]).astype(np.float32)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and rows that have each bucket, over all of ``texts`` (text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                total += counts_of(text.as_py()) > 0
            n += batch.num_rows
        yield pa.RecordBatch.from_pylist([{"n": n, "df": total.tolist()}])

    parts = texts.mapInArrow(counted, "n long, df array<long>")
    rows = (
        parts.select(F.posexplode(F.concat(F.array("n"), F.col("df"))).alias("k", "n"))
        .groupBy("k")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    out = np.zeros(TERMS + 1, np.int64)
    for r in rows:
        out[r["k"]] = r["n"]
    return int(out[0]), out[1:]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n, df = document_frequencies(texts.select("text"))
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(1)
    known = learnable(labels, "quality", FOLDS, HELD_OUT)
    share = known.agg(F.avg("label")).first()[0]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [counts_of(t.as_py()).astype(np.uint32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(counts, pa.binary())],
                ["doc_id", "label", "counts"],
            )

    rows = (
        sample(texts, known, ROWS_PER_LABEL)
        .select("doc_id", "label", "text")
        .mapInArrow(vectors, "doc_id long, label int, counts binary")
        .collect()
    )
    rows.sort(key=lambda r: r.doc_id)
    own = np.array([r.label for r in rows], np.int64)
    counts = np.array([np.frombuffer(bytes(r.counts), np.uint32) for r in rows]).reshape(-1, TERMS)
    x = latent(counts, idf)
    projection = directions(x, RANK) if len(rows) else np.zeros((TERMS, 1), np.float32)
    z = x @ projection
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    weights = 1 / np.maximum(np.bincount(own, minlength=2), 1)[own] if len(rows) else np.empty(0)
    return Model(idf, projection, z, own, weights, 0.5 if share is None else float(share))


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    model = fit(docs, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                score = model.scores(part.column("text").to_pylist()).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(scored, "doc_id long, score double").select(
        "doc_id",
        (crc_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
