"""Toxicity by a factorization machine over hashed terms (operator 4).

A document's terms are the 64-bit hashes of its distinct words in lower case, from its whole text, and one each for a beginning of ``STEM`` bytes that two, three, ``REPEATED`` or more of its
words have: inflected insults that are rare by themselves share it. On a bounded sample of labelled
documents the machine learns a bias, a weight for each term and ``RANK`` factors for each term; the inner product of two terms' factors is the
weight of meeting both, which a linear model can't hold. Weights and factors are learnt by AdaGrad with proximal steps that bring those
without evidence to nought, so that a long text isn't judged by the noise of its many words.

The machine knows two kinds of terms, of those in ``LEAST_DOCUMENTS`` sampled documents or more. First the most telling by themselves, ``TERMS`` at most: a chi-square against the label of
``EVIDENCE`` or more, which one term of ten thousand reaches by chance. Second those of the ``FREQUENT`` most frequent that take part in a pair whose joint chi-square is ``PAIR_EVIDENCE`` or more
above either one's own: they may tell nothing by themselves. Terms are counted and ranked by Spark; the driver gets these terms and, of each sampled document, which of them it holds, and
counts pairs by a product of bounded matrices. The machine is broadcast ((``TERMS`` + ``FREQUENT``) x (``RANK`` + 2) numbers at most, whatever the corpus).

Defined cases: a null text or one without known terms gets the score of the bias alone; without labelled documents every score is 0, with one label alone it is that label; of rows that
share a doc_id each is scored, and one (the least list of terms) teaches; ties among terms go to the lesser hash; no documents give no scores; a text of any length is scored whole,
in stretches; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .labels import remainder, sampled
from .words import LETTERS, word_hashes

SAMPLE, TERMS, RANK, LEAST_DOCUMENTS = 8192, 16_384, 8, 3
FREQUENT, EVIDENCE, PAIR_EVIDENCE = 1024, 15.0, 30.0
STEM, REPEATED = 6, 4
MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.3


def documents_terms(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, offsets) of successive texts: the hashes of the terms of each, each once, in order of hash."""
    at, data = common.utf8(texts)
    i = 0
    while i < len(texts):
        j = min(len(texts), max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1))
        h, row, _ = _counted(data, at[i : j + 1], None)
        stem, of, times = _counted(data, at[i : j + 1], STEM)
        for k in range(2, REPEATED + 1):
            again = times >= k
            h, row = np.concatenate([h, common.mix64(stem[again] + np.uint64(k))]), np.concatenate([row, of[again]])
        order = np.lexsort((h, row))
        yield h[order], np.searchsorted(row[order], np.arange(j - i + 1))
        i = j


def _counted(data: np.ndarray, at: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, count) of the distinct words, or their beginnings, of each text."""
    h, ends = word_hashes(data, at, LETTERS, most=most)
    row = np.repeat(np.arange(len(at) - 1), np.diff(ends))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return h[first], row[first], np.diff(np.append(first, len(h)))


class Machine:
    """Terms (sorted hashes), their weights and factors, and the bias."""

    def __init__(self, terms: np.ndarray, rank: int = RANK):
        self.terms = terms
        self.bias = 0.0
        self.weight = np.zeros(len(terms))
        self.factor = np.random.default_rng(11).normal(0, 0.05, (len(terms), rank))
        self.empty = len(terms) == 0

    def known(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the known terms of each text, and their offsets."""
        if self.empty:
            return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
        k = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        have = self.terms[k] == h
        return k[have], np.concatenate([[0], np.cumsum(have)])[ends]

    def raw(self, k: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each text, and the sums of its factors."""
        def per_text(x: np.ndarray) -> np.ndarray:
            total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])
            return total[ends[1:]] - total[ends[:-1]]

        v = self.factor[k]
        sums = per_text(v)
        return self.bias + per_text(self.weight[k]) + 0.5 * ((sums**2).sum(1) - per_text((v**2).sum(1))), sums

    def score(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.known(h, ends))[0], -30, 30)))


def learn(terms: np.ndarray, k: np.ndarray, at: np.ndarray, y: np.ndarray, rank: int = RANK, steps: int = 3000, rate: float = 0.3, shrink: float = 1e-3, batch: int = 64) -> Machine:
    """The machine over ``terms`` (sorted hashes) for texts whose terms are ``terms[k[at[i]:at[i + 1]]]`` and labels y; the rarer label counts up to eight times."""
    if not len(y) or y.min() == y.max():
        out = Machine(np.zeros(0, np.uint64), rank)
        out.bias = 20.0 if len(y) and y[0] else -20.0
        return out
    p = y.mean()
    m = Machine(terms, rank)
    m.bias = float(np.log(p / (1 - p)))
    gw, gv, gb = np.full(len(m.terms), 1e-8), np.full((len(m.terms), rank), 1e-8), 1e-8
    rng = np.random.default_rng(13)
    lean = float(np.clip((1 - p) / p, 1, 8))
    for _ in range(-(-steps * batch // len(y))):
        order = rng.permutation(len(y))
        for b in range(0, len(y), batch):
            rows = order[b : b + batch]
            sizes = at[rows + 1] - at[rows]
            e = np.concatenate([[0], np.cumsum(sizes)])
            i = k[np.repeat(at[rows] - e[:-1], sizes) + np.arange(e[-1])]
            raw, sums = m.raw(i, e)
            miss = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) * np.where(y[rows] > 0, lean, 1) / len(rows)
            each = np.repeat(miss, sizes)
            gb += miss.sum() ** 2
            m.bias -= rate * miss.sum() / np.sqrt(gb)
            u, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, weights=each, minlength=len(u))
            part = each[:, None] * (np.repeat(sums, sizes, 0) - m.factor[i])
            dv = np.stack([np.bincount(back, weights=part[:, f], minlength=len(u)) for f in range(rank)], 1)
            gw[u] += dw**2
            gv[u] += dv**2
            step = rate / np.sqrt(gw[u])
            w = m.weight[u] - step * dw
            m.weight[u] = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
            step = rate / np.sqrt(gv[u])
            v = m.factor[u] - step * dv
            m.factor[u] = np.sign(v) * np.maximum(np.abs(v) - step * shrink, 0)
    # what every text of the sample shares or what has no evidence is nought by now
    live = (np.abs(m.weight) > 1e-6) | (np.abs(m.factor) > 1e-6).any(1)
    m.terms, m.weight, m.factor = m.terms[live], m.weight[live], m.factor[live]
    m.empty = not live.any()
    return m


def sample_terms(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, y, terms) of at most ``sample`` labelled documents, half of them toxic if there are so many: scores lean to toxic, as the low threshold wants."""
    chosen = common.stored(sampled(labels, "toxic", MODULUS, HELD_OUT, sample), "toxic-sample")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h[a:b].view(np.int64) for h, e in documents_terms(batch.column(2)) for a, b in zip(e[:-1], e[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "y", "terms"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(each, "doc_id long, y int, terms array<long>")  # at most ``sample`` rows are broadcast
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("terms").alias("terms"))


def ranked_terms(held: DataFrame, most: int = TERMS, frequent: int = FREQUENT, least: int = LEAST_DOCUMENTS, evidence: float = EVIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """(terms, own): the sorted terms with evidence of their own and the most frequent ones, and which of them are of the first kind. At most ``most`` + ``frequent`` reach the driver."""
    n, hits = held.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not hits or hits == n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    p = hits / n
    per = held.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("hit")).filter(F.col("n") >= least)
    per = common.stored(per.withColumn("chi", F.pow(F.col("hit") - F.col("n") * p, 2) / (F.col("n") * p * (1 - p))), "term-counts")
    own = {r["term"] for r in per.filter(F.col("chi") >= evidence).orderBy(F.desc("chi"), "term").limit(most).select("term").collect()}
    often = {r["term"] for r in per.orderBy(F.desc("n"), "term").limit(frequent).select("term").collect()}
    terms = np.sort(np.array(list(own | often), np.int64).view(np.uint64))
    return terms, np.array([t in own for t in terms.view(np.int64).tolist()], bool)


def in_telling_pairs(known: np.ndarray, row: np.ndarray, y: np.ndarray, own: np.ndarray, evidence: float = PAIR_EVIDENCE, block: int = 1024) -> np.ndarray:
    """``own`` and the terms that take part in a pair, with any term, that tells more than either does. ``known`` and ``row`` say which text holds which term; pairs are counted in blocks."""
    p, rest = y.mean(), np.flatnonzero(~own)
    place = np.full(len(own), -1)

    def matrix(columns: np.ndarray) -> np.ndarray:
        place[:] = -1
        place[columns] = np.arange(len(columns))
        some = place[known] >= 0
        x = np.zeros((len(y), len(columns)), np.float32)
        x[row[some], place[known[some]]] = 1
        return x

    def chi(both: np.ndarray, hit: np.ndarray) -> np.ndarray:
        return np.where(both >= LEAST_DOCUMENTS, (hit - both * p) ** 2 / np.maximum(both * p * (1 - p), 1e-12), 0)

    own_chi = chi(np.bincount(known, minlength=len(own)), np.bincount(known, weights=y[row], minlength=len(own)))
    x, out = matrix(rest), own.copy()
    for a in range(0, len(own), block):
        columns = np.arange(a, min(a + block, len(own)))
        z = matrix(columns)
        joint = chi((x.T @ z).astype(float), (x.T @ (z * y[:, None].astype(np.float32))).astype(float))
        out[rest] |= (joint >= np.maximum(own_chi[rest, None], own_chi[None, columns]) + evidence).any(1)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    spark = docs.sparkSession
    begun = common.mark(spark)
    held = common.stored(sample_terms(docs, labels, sample), "sample-terms")
    terms, own = ranked_terms(held)
    known = spark.sparkContext.broadcast(terms)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h in batch.column(2):
                h = np.array(h.as_py(), np.int64).view(np.uint64)
                k = np.minimum(np.searchsorted(known.value, h), max(0, len(known.value) - 1))
                found.append(k[known.value[k] == h].astype("<u2").tobytes() if len(known.value) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "y", "known"])

    rows = sorted(held.mapInArrow(prune, "doc_id long, y int, known binary").collect())  # at most ``sample`` rows of at most TERMS + FREQUENT numbers
    common.release(spark, begun)
    y = np.array([r["y"] for r in rows], float)
    each = [np.frombuffer(r["known"], "<u2").astype(np.int64) for r in rows]
    k, row = np.concatenate([np.zeros(0, np.int64), *each]), np.repeat(np.arange(len(rows)), [len(x) for x in each])
    if len(terms):
        keep = in_telling_pairs(k, row, y, own)
        stay = keep[k]
        k, row, terms = (np.cumsum(keep) - 1)[k[stay]], row[stay], terms[keep]
    return learn(terms, k, np.searchsorted(row, np.arange(len(rows) + 1)), y)


def scorer(spark: SparkSession, machine: Machine):
    held = spark.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array(np.concatenate([np.zeros(0), *[held.value.score(h, e) for h, e in documents_terms(t)]]), pa.float64())

    return lambda column: score(column)


def toxicity_score(docs: DataFrame, labels: DataFrame, column: str | Column = "text") -> Column:
    """Fits on ``labels`` and gives the column of scores of ``column``."""
    return scorer(docs.sparkSession, fit(docs, labels))(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = docs.select("doc_id", (remainder(MODULUS) == HELD_OUT).alias("held_out"), toxicity_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
