"""Benchmark decontamination by q-gram lemma filtering (operator 8).

Texts are folded (ASCII lower case, white space to a space). An item of n bytes that occurs in a document with at most e edits shares at
least n - q + 1 - q e of its q-grams with it, all on diagonals (place in the document less place in the item) within e of each other's. So
shared q-grams are counted in bands of 2 (2 e + 1) diagonals, each half over the next; bands that reach the bound are retained, and a banded
alignment of the item with that region verifies that it takes e edits at most.

The items are broadcast in blocks of ``BLOCK`` bytes of text, whose index has a fixed bound; a larger benchmark takes a pass over the texts for each block, one after the other, so that
one block is in memory at a time.

Defined cases: null text is empty; null or empty items match nothing; items of fewer than q bytes are looked for as they are; items alike are
found under each of their ids; a text of any length is searched whole, in overlapping stretches; rows alike in doc_id and text are one document in ``leaks``, and stay or go together in
``clean``; without documents or items nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

Q, RATE, BLOCK, STRETCH = 8, 0.08, 2 << 20, 2 << 20
HITS = "array<struct<item_id:long,start:long,end:long,edits:int>>"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[9:14] = 32
_BITS = 22


def _grams(d: np.ndarray) -> np.ndarray:
    """The Q bytes from each place on, as one number."""
    d = np.ascontiguousarray(d)
    return np.ndarray((len(d) - Q + 1,), "<u8", d, strides=(1,)).copy() if len(d) >= Q else np.zeros(0, np.uint64)


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


def budget(n: int, rate: float = RATE) -> int:
    """Edits allowed for an item of n bytes: ``rate`` of it, and few enough for the lemma to ask for a quarter of its q-grams."""
    return max(0, min(int(rate * n), (3 * (n - Q + 1) // 4) // Q))


def aligned(item: np.ndarray, region: np.ndarray, edits: int, width: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of ``item`` in ``region`` within the budget; cells further than ``width`` diagonals right of the first are left out.

    Row i of the band holds the cells of item[:i] with region ends i - edits to i + width. The place where an occurrence starts is carried along.
    """
    n, m, far = len(item), len(region), edits + 1
    w = edits + width + 1
    columns = np.arange(w)
    ends = columns - edits  # of row 0
    cost = np.where((ends >= 0) & (ends <= m), 0, far).astype(np.int64)
    start = np.clip(ends, 0, m)
    padded = np.concatenate([np.zeros(edits + 1, np.uint8), region, np.zeros(width + n + 2, np.uint8)])
    for i in range(1, n + 1):
        ends = columns - edits + i
        letters = padded[i : i + w]  # region[ends - 1]
        diagonal = cost + ((letters != item[i - 1]) | (ends < 1) | (ends > m))
        up = np.append(cost[1:], far) + 1
        better = up < diagonal
        new, from_ = np.where(better, up, diagonal), np.where(better, np.append(start[1:], m), start)
        new = np.where((ends < 0) | (ends > m), far, new)
        run = np.minimum.accumulate(new - columns)  # leaving out letters of the region
        left = run + columns
        origin = np.maximum.accumulate(np.where(new - columns == run, columns, 0))
        from_ = np.where(left < new, from_[origin], from_)
        cost, start = np.minimum(np.minimum(new, left), far), from_
        if cost.min() >= far:
            return None
    k = int(np.argmin(cost))
    return (int(cost[k]), int(start[k]), int(k - edits + n)) if cost[k] <= edits else None


class Index:
    """The q-grams of a block of items, and for each the items and places that have it."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.ids = [i for i, _ in items]
        self.texts = [_FOLD[np.frombuffer(t.encode(), np.uint8)] for _, t in items]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(n, rate) for n in self.size.tolist()], np.int64)
        self.step = 2 * self.edits + 1
        self.least = np.maximum(self.size - Q + 1 - Q * self.edits, 1)
        grams = [_grams(t) for t in self.texts]
        g = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(x) for x in grams])
        place = np.concatenate([*[np.arange(len(x)) for x in grams], np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(g, kind="stable")
        self.grams, first = np.unique(g[order], return_index=True)
        self.first = np.append(first, len(g)).astype(np.int64)
        self.item, self.place = item[order].astype(np.int64), place[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[_slot(self.grams)] = True
        self.short = [(i, t.tobytes()) for i, t in enumerate(self.texts) if 0 < len(t) < Q]
        self.reach = int(self.size.max() + 3 * self.step.max()) if len(items) else 0

    def search(self, d: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) for the folded texts d[at[i]:at[i + 1]]."""
        if len(self.grams) and len(d) >= Q:
            g = _grams(d)
            where = np.flatnonzero(self.bits[_slot(g)])
            k = np.minimum(np.searchsorted(self.grams, g[where]), len(self.grams) - 1)
            text = np.searchsorted(at, where, side="right") - 1
            good = (self.grams[k] == g[where]) & (where + Q <= at[text + 1])
            where, k, text = where[good], k[good], text[good]
            n = self.first[k + 1] - self.first[k]
            post = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            item, where, text = self.item[post], np.repeat(where, n), np.repeat(text, n)
            # bands begin at most an item before the text
            diagonal = where - at[text] - self.place[post] + self.size[item]
            band = diagonal // self.step[item] + 1
            most = int(band.max()) + 2 if len(band) else 1
            key = (text * len(self.ids) + item) * most + band
            keys, count = np.unique(key, return_counts=True)
            both = np.concatenate([keys, keys - 1])
            order = np.argsort(both, kind="stable")
            both, count = both[order], np.concatenate([count, count])[order]
            keys, first = np.unique(both, return_index=True)
            count = np.add.reduceat(count, first) if len(first) else count
            item = keys // most % max(1, len(self.ids))
            for key, i in zip(keys[(enough := count >= self.least[item])].tolist(), item[enough].tolist(), strict=True):
                t, b = key // most // len(self.ids), key % most
                low = (b - 1) * int(self.step[i]) - int(self.size[i])  # first diagonal of the band
                e, step, n = int(self.edits[i]), int(self.step[i]), int(self.size[i])
                a, z = max(0, low - e), min(int(at[t + 1] - at[t]), low + 2 * step + n + e)
                region = d[at[t] + a : at[t] + z]
                exact = region.tobytes().find(self.texts[i].tobytes())
                found = (0, exact, exact + n) if exact >= 0 else aligned(self.texts[i], region, e, 2 * step + 2 * e) if e else None
                if found:
                    yield t, i, a + found[1], a + found[2], found[0]
        for i, word in self.short:
            for t in range(len(at) - 1):
                raw, k = d[at[t] : at[t + 1]].tobytes(), -1
                while (k := raw.find(word, k + 1)) >= 0:
                    yield t, i, k, k + len(word), 0


def _stretches(at: np.ndarray, overlap: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, from, to) of about STRETCH bytes; a longer text is in several, each beginning ``overlap`` before the last one's end."""
    group, size = [], 0
    for t, n in enumerate(np.diff(at).tolist()):
        a = 0
        while True:
            z = min(n, a + STRETCH + overlap)
            group.append((t, a, z))
            size += z - a
            if size >= STRETCH:
                yield group
                group, size = [], 0
            if z == n:
                break
            a = z - overlap
    if group:
        yield group


def hits(index: Index, texts: pa.Array) -> list[list[tuple]]:
    """For each text the occurrences of items, each once: (item_id, start, end, edits), bytes of the text."""
    at, data = common.utf8(texts)
    best: list[dict] = [{} for _ in range(len(texts))]
    for group in _stretches(at, index.reach):
        d = np.concatenate([_FOLD[data[at[t] + a : at[t] + z]] for t, a, z in group])
        ends = np.concatenate([[0], np.cumsum([z - a for _, a, z in group])])
        for k, i, start, end, edits in index.search(d, ends):
            t, a, _ = group[k]
            found = best[t]
            same = next((x for x in found if x[0] == i and found[x][0] < a + end and a + start < found[x][1]), None)  # overlapping bands
            if same is None:
                found[i, len(found)] = (a + start, a + end, edits)
            elif found[same][2] > edits:
                found[same] = (a + start, a + end, edits)
    return [sorted((index.ids[i], *v) for (i, _), v in found.items()) for found in best]


def blocks(benchmark: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items, by item_id, in blocks of about ``size`` bytes of text; the driver holds one block at a time."""
    block, held = [], 0
    for r in benchmark.filter("text IS NOT NULL AND text <> ''").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        held += len(r["text"].encode())
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, key, hits) of each document in which an item occurs: hits are (item_id, start, end, edits). A text is searched once for each block of items, and only hits leave the task."""
    spark, passes = docs.sparkSession, []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key().alias("key"), common.text_or_empty().alias("text"))

    def searched(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = hits(held.value, batch.column(2))
                some = pa.array([i for i, x in enumerate(found) if x], pa.int64())
                if len(some):
                    each = [[dict(zip(("item_id", "start", "end", "edits"), h, strict=True)) for h in x] for x in found if x]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(each, KIND)], ["doc_id", "key", "hits"])

        return rows.mapInArrow(run, f"doc_id long, key long, hits {HITS}")

    for n, block in enumerate(blocks(benchmark)):
        held = spark.sparkContext.broadcast(Index(block, rate))
        passes.append(common.stored(searched(held).groupBy("doc_id", "key").agg(F.first("hits").alias("hits")).withColumn("pass", F.lit(n)), "leaks"))
        held.destroy()
    if not passes:
        return spark.createDataFrame([], f"doc_id long, key long, hits {HITS}")
    if len(passes) == 1:
        return passes[0].drop("pass")
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    return every.groupBy("doc_id", "key").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the documents in which an item occurs: each pass drops those of its block of items, and no column is touched."""
    def searched(docs: DataFrame, held) -> DataFrame:
        place = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not x for x in hits(held.value, batch.column(place))], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    waiting = None
    for block in blocks(benchmark):
        if waiting is not None:
            docs = common.stored(docs, "clean-documents")
            waiting.destroy()
        waiting = docs.sparkSession.sparkContext.broadcast(Index(block, rate))
        docs = searched(docs, waiting)
    return docs


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document in which a benchmark item occurs: the items, and the least edits of any occurrence."""
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", F.array_sort(F.array_distinct(F.col("hits.item_id"))).alias("item_ids"), F.size("hits").cast("long").alias("n_hits"),
        F.array_min(F.col("hits.edits")).alias("least_edits"), F.array_min(F.col("hits.start")).alias("first_start"),
    )
