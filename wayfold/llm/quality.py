"""Quality by nearest-neighbour voting in a latent-semantic space (operator 3).

Terms are hashed byte trigrams, 4-grams of byte classes (case, digit, space, mark) and ranges of the share of repeated words, counted over whole texts. Document frequencies
come from all documents. The labelled sample's tf-idf vectors are reduced by a randomised singular value decomposition; its latent
vectors and labels are broadcast (``SAMPLE`` x ``RANK`` floats, whatever the corpus). Every document's exact cosine with every labelled vector is
computed in blocks, and its ``NEIGHBOURS`` nearest vote with weights that grow with similarity. The sample is half of each label where there are enough; a neighbour's vote is weighted by its
label's share of all learning labels over its share of the sample, which corrects for that.

Defined cases: a null or very short text has no terms and gets the share of label 1 among the learning labels; without labelled documents every score is 0.5; of rows that share a doc_id each is
scored, and all that are labelled teach; among neighbours equally near those first in the order of doc_id and counts vote; no documents give no scores; a text of any length is counted whole, in
stretches; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .labels import learning, remainder, sampled
from .words import word_hashes

SAMPLE, RANK, NEIGHBOURS, SHARP = 4096, 64, 7, 30.0
HALF, STRETCH = 2048, 4 << 20
#: After the two kinds of grams: a term for each range of the share of words that repeat the one before, as heavy as the text is long.
SHARES = (0.0, 0.02, 0.1, 0.3)
DIMS = 2 * HALF + len(SHARES)
MODULUS, HELD_OUT = 3, 1

_CLASS = np.full(256, 1, np.uint32)  # control characters and other
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10], _CLASS[128:] = 2, 3, 4, 5, 6, 7
for _i, _c in enumerate(b".,!?#$%&*|-"):
    _CLASS[_c] = 8 + min(_i, 7)


def term_counts(data: np.ndarray, at: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
    """A row of ``DIMS`` term counts for each text (bytes at[i] to at[i + 1]); bytes are looked through in stretches, so a long text takes no more room than they do."""
    docs = len(at) - 1
    out = np.zeros((docs, DIMS), np.float32)
    for a in range(int(at[0]), int(at[-1]), stretch):
        z = min(int(at[-1]), a + stretch)
        for k, low in ((3, 0), (4, HALF)):
            d = data[a : min(int(at[-1]), z + k - 1)]
            n = min(z - a, len(d) - k + 1)
            if n <= 0:
                continue
            codes = d.astype(np.uint32) if k == 3 else _CLASS[d]
            code = codes[:n].copy()
            for j in range(1, k):
                code = (code << np.uint32(8 if k == 3 else 4)) | codes[j : n + j]
            code = (code * np.uint32(2654435761)) >> np.uint32(21)
            first, last = np.searchsorted(at, [a, a + len(d) - 1], side="right") - 1
            row = np.repeat(np.arange(last - first + 1), np.diff(np.clip(at[first : last + 2], a, a + len(d))))
            same = row[:n] == row[k - 1 : n + k - 1]
            some = last - first + 1
            out[first : last + 1, low : low + HALF] += np.bincount((row[:n] * HALF + code)[same], minlength=some * HALF).reshape(some, HALF)
    words, ends = word_hashes(data, at)
    of = np.repeat(np.arange(docs), np.diff(ends))
    again = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    n = np.diff(ends)
    share = np.bincount(of[1:][again], minlength=docs) / np.maximum(n, 1)
    out[np.arange(docs), 2 * HALF + np.searchsorted(SHARES, share, side="right") - 1] = n
    return out


def _blocks(texts: pa.Array, rows: int = 256, most: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
    at, data = common.utf8(texts)
    i = 0
    while i < len(texts):
        j = min(len(texts), i + rows, max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1))
        yield i, j, term_counts(data, at[i : j + 1])
        i = j


def _statistics(docs: DataFrame, chosen: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, document frequencies over all of them, and the sample's counts and labels: one pass."""
    label = dict(chosen.collect())  # at most SAMPLE rows
    held = docs.sparkSession.sparkContext.broadcast(label)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(DIMS, np.int64)
        ids: list[int | None] = []
        found: list[bytes] = []

        def out(total: int, df: np.ndarray | None) -> pa.RecordBatch:
            rows = len(ids) + (df is not None)
            own = [None] * len(ids)
            columns = [ids + [None] * (rows - len(ids)), found + [None] * (rows - len(ids)), own + ([total] if df is not None else []), own + ([df] if df is not None else [])]
            types = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "counts", "total", "df"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, counts in _blocks(batch.column(1)):
                total += j - i
                df += (counts > 0).sum(0)
                for k in range(i, j):
                    if names[k] in held.value:
                        ids.append(names[k])
                        found.append(counts[k - i].astype("<u4").tobytes())
            if len(ids) >= 256:
                yield out(0, None)
                ids.clear(), found.clear()
        yield out(total, df)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).mapInArrow(count, "doc_id long, counts binary, total long, df array<long>")
    rows = common.stored(rows, "term-statistics")
    total = rows.agg(F.sum("total")).first()[0] or 0
    df = np.zeros(DIMS, np.int64)
    for r in rows.filter("df IS NOT NULL").select(F.posexplode("df").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).collect():  # DIMS rows
        df[r["term"]] = r["n"]
    seen = sorted((r["doc_id"], bytes(r["counts"])) for r in rows.filter("counts IS NOT NULL").select("doc_id", "counts").collect())  # the sample
    return total, df, np.array([np.frombuffer(c, "<u4") for _, c in seen], np.float32).reshape(-1, DIMS), np.array([label[i] for i, _ in seen], np.float32)


class Model:
    """Latent vectors of the sample, their labels, and what turns counts into latent vectors."""

    def __init__(self, docs: int, df: np.ndarray, counts: np.ndarray, y: np.ndarray, share: float | None = None, rank: int = RANK):
        self.idf = np.log((1 + docs) / (1 + df)).astype(np.float32) + np.float32(1)
        self.y = y
        own = float(y.mean()) if len(y) else 0.5
        self.share = own if share is None else share
        # what a vote for label 0 and for label 1 weighs
        self.vote = np.array([(1 - self.share) / (1 - own), self.share / own]) if 0 < own < 1 else np.ones(2)
        x = self.weigh(counts)
        rng = np.random.default_rng(7)
        k = min(rank, *x.shape) if len(x) else 0
        if k:
            q = x.T @ (x @ rng.standard_normal((DIMS, k + 16)).astype(np.float32))
            for _ in range(3):
                q = x.T @ (x @ np.linalg.qr(q)[0])
            q = np.linalg.qr(q)[0]
            _, _, v = np.linalg.svd(x @ q, full_matrices=False)
            self.to_latent = np.ascontiguousarray((q @ v.T)[:, :k])
        else:
            self.to_latent = np.zeros((DIMS, 1), np.float32)
        self.latent = self.project(x)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def project(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.to_latent
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS, sharp: float = SHARP) -> np.ndarray:
        if not len(self.y):
            return np.full(len(counts), 0.5)
        empty = counts.sum(1) == 0
        near = self.project(self.weigh(counts)) @ self.latent.T
        k = min(neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        sim = np.take_along_axis(near, top, 1)
        weight = np.exp(sharp * (sim - sim.max(1, keepdims=True))) + 1e-9
        y = self.y[top]
        weight = weight * self.vote[y.astype(np.int64)]
        vote = (weight * y).sum(1) / weight.sum(1)
        return np.where(empty, self.share, vote).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    begun = common.mark(docs.sparkSession)
    share = learning(labels, "quality", MODULUS, HELD_OUT).agg(F.avg("y")).first()[0]
    chosen = common.stored(sampled(labels, "quality", MODULUS, HELD_OUT, sample), "quality-sample")
    model = Model(*_statistics(docs, chosen), share)
    common.release(docs.sparkSession, begun)
    return model


def scorer(spark: SparkSession, model: Model):
    """A column function: text to score."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array(np.concatenate([np.zeros(0), *[held.value.score(c) for _, _, c in _blocks(t)]]), pa.float64())

    return lambda column: score(column)


def quality_score(docs: DataFrame, labels: DataFrame, column: str | Column = "text") -> Column:
    """Fits on ``labels`` and gives the column of scores of ``column``."""
    return scorer(docs.sparkSession, fit(docs, labels))(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))


def op3_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = docs.select("doc_id", (remainder(MODULUS) == HELD_OUT).alias("held_out"), quality_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
