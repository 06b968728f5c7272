"""Removal of long repeated strings by a run-length index (operator 5).

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere in the corpus (in the same text or another) goes.

1. Each window of LENGTH bytes is dealt to the place of the least hash among its ``GRAM``-byte grams, which its content alone decides. The windows
   dealt to one place are consecutive: a *context* is the text they cover. Two equal windows have places with equal grams, so only contexts whose
   gram occurs twice matter; they are counted, with partial aggregation, by a hash of the gram.
2. Different contexts, each with the number of its occurrences, are brought together by gram in collections of bounded size. A collection holds a context once: its copies would add nothing
   but equal suffixes, so a context that occurs several times is an entry with that multiplicity, and a suffix of it matches the whole rest of it.
3. For each collection a Burrows-Wheeler transform is built (suffixes ranked by doubling) and held as runs, with the suffix-array samples at the run
   ends. Only there are matches with the neighbouring suffixes measured; matching statistics of all other places follow by
   streaming through the text, as within a run a match is one shorter than at the place before. A place with LENGTH or more starts a repeated window. Each window is
   whole in one place of a context only, so a match never is with itself.
4. The marked windows go back to all occurrences of their contexts, are merged for each text, and cut.

Texts are told apart by hashes only where 128 bits (of gram and context) say that two contexts are one; which windows different contexts share is what the index says, but for one case: a gram
with more than ``CROWD`` different contexts would outgrow a collection, and its windows are counted by a 128-bit hash instead, each window a row, which spreads over tasks and is as exact.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; windows never cross texts; rows that share a doc_id are texts of
their own (two rows with one long text are copies of each other); a null doc_id is kept; an empty table gives no rows; a text of any length is looked through whole, in stretches; other columns aren't read.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 200, 64
WINDOW = LENGTH - GRAM + 1
CROWD, MANY, COLLECTION = 3000, 200, 1_000_000
STRETCH = 1 << 20
END = 255  # in no UTF-8 text
_INDEX_BITS = 21
_BYTE = common.mix64(np.arange(77, 77 + 256))


def _gram_hashes(d: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling."""
    h, k, power = _BYTE[d], 1, 0x9E3779B97F4A7C15
    while k < GRAM:
        h = h[:-k] * np.uint64(power) + h[k:]
        power = power * power & (1 << 64) - 1
        k *= 2
    return common.mix64(h)


def _least_places(h: np.ndarray) -> np.ndarray:
    """For each window of WINDOW grams the place of the least (the first of equals)."""
    place_bits = 22
    x = (h >> np.uint64(place_bits) << np.uint64(place_bits)) | np.arange(len(h), dtype=np.uint64)
    k = 1
    while 2 * k <= WINDOW:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    x = np.minimum(x[: len(h) - WINDOW + 1], x[WINDOW - k : WINDOW - k + len(h) - WINDOW + 1])
    return (x & np.uint64((1 << place_bits) - 1)).astype(np.int64)


def contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start in it, number of starts, gram hash, context hash) of the contexts of the texts data[at[i]:at[i + 1]]."""
    out: list[tuple] = []
    for t0, t1, a, z in _stretches(at):
        d = data[a:z]
        if len(d) < LENGTH:
            continue
        h = _gram_hashes(d)
        place = _least_places(h)
        starts = np.arange(len(place))
        text = np.searchsorted(at, starts + a, side="right") - 1
        good = starts + a + LENGTH <= at[text + 1]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | ~good[:-1]
        first = np.flatnonzero(new & good)
        if not len(first):
            continue
        bounds = np.append(np.flatnonzero(new | ~good), len(place))
        n = bounds[np.searchsorted(bounds, first, side="right")] - first
        raw = d.tobytes()
        digest = np.fromiter((xxhash.xxh3_64_intdigest(raw[i : i + k]) for i, k in zip(first.tolist(), (n + LENGTH - 1).tolist(), strict=True)), np.uint64, len(first))
        out.append((text[first], first + a - at[text[first]], n, h[place[first]], digest))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _stretches(at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Pieces of the bytes to look through at once; a text longer than STRETCH is in several, which overlap by LENGTH - 1."""
    t = 0
    while t < len(at) - 1:
        u = max(t + 1, int(np.searchsorted(at, at[t] + STRETCH, side="right")) - 1)
        a = int(at[t])
        while True:
            z = min(int(at[u]), a + max(STRETCH, 4 * LENGTH))
            if u > t + 1:
                z = int(at[u])
            yield t, u, a, z
            if z == at[u]:
                break
            a = z - LENGTH + 1
        t = u


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, by their first ``depth`` bytes at least; ranks are doubled where they tie."""
    n = len(text)
    wide = n >= (1 << _INDEX_BITS) - 1
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = (key << np.uint64(8)) | padded[k : n + k]

    def ordered(key: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if wide:
            perm = np.argsort(key, kind="stable")
            return key[perm], items[perm]
        s = np.sort((key << np.uint64(_INDEX_BITS)) | items.astype(np.uint64))  # a sort of values is the fast one
        return s >> np.uint64(_INDEX_BITS), (s & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)

    bits = np.uint64(32 if wide else _INDEX_BITS)
    key, order = ordered(key, np.arange(n))
    rank = np.zeros(n + 1, np.int64)
    slots, done = np.arange(n), 5
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))] + 1
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = slots[tied]
        if not len(slots) or done >= depth:
            return order
        items = order[slots]
        key = (rank[items].astype(np.uint64) << bits) | rank[np.minimum(items + done, n)].astype(np.uint64)
        key, order[slots] = ordered(key, items)
        done *= 2


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to ``most``."""
    padded = np.concatenate([text, np.full(most + 16, END, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    length, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(0, most, 8):
        x = words[a[open_] + k] ^ words[b[open_] + k]
        differ = x != 0
        lowest = x[differ] & (~x[differ] + np.uint64(1))
        length[open_[differ]] = k + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8
        open_ = open_[~differ]
        if not len(open_):
            break
    length[open_] = most
    return length


def matching_statistics(text: np.ndarray, most: int) -> np.ndarray:
    """For each place of ``text`` the length of the longest match of its suffix with another (``most`` at most, or more).

    The transform is kept as its runs and the samples at their ends; a match is measured at these alone.
    """
    order = suffix_order(text, most)
    n = len(text)
    before = np.where(order > 0, text[order - 1], END)
    turn = (before[1:] != before[:-1]) | (before[1:] == END)
    heads, tails = np.flatnonzero(np.concatenate([[True], turn])), np.flatnonzero(np.concatenate([turn, [True]]))
    places, best = np.arange(n), np.zeros(n, np.int64)
    for ends, other in ((heads[heads > 0], -1), (tails[tails < n - 1], 1)):
        sample = order[ends]
        reach = np.zeros(n, np.int64)
        reach[sample] = sample + _common(text, sample, order[ends + other], most)
        best = np.maximum(best, np.maximum.accumulate(reach) - places)
    return best


def repeated_starts(found: list[bytes], starts: list[int], twice: list[bool] | None = None, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context (its number of starts given) the runs (first, last) of starts whose window occurs in another context or start, or again with its whole context (``twice``: multiplicity over one)."""
    if not found:
        return []
    sizes = np.array([len(c) for c in found])
    text = np.frombuffer(bytes([END]).join(found) + bytes([END]), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    match = matching_statistics(text, int(sizes.max()))
    out = []
    for b, size, n, several in zip(begin.tolist(), sizes.tolist(), starts, twice or [False] * len(found), strict=True):
        rest = size - np.arange(n)
        good = (rest if several else np.minimum(match[b : b + n], rest)) >= length
        edge = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
        out.append(list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)))
    return out


RUNS = "array<struct<a:int,b:int>>"
_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _runs(each: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in x] for x in each], _RUNS)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch, "text", 4 << 20):
            at, data = common.utf8(part.column(1))
            text, start, n, gram, digest = contexts(data, at)
            refs = part.column(0).to_numpy(zero_copy_only=False)[text]
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array((start << 8) | n), pa.array(gram.view(np.int64)), pa.array(digest.view(np.int64))], ["ref", "place", "gram", "ctx"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, data = common.utf8(batch.column(0))
        raw = data[at[0] : at[-1]].tobytes()
        columns: list[list] = [[], [], [], [], [], []]
        for base, wanted in zip((at[:-1] - at[0]).tolist(), batch.column(1), strict=True):
            for w in wanted.as_py():
                start, n = base + (w["place"] >> 8), w["place"] & 255
                for c, v in zip(columns, (w["gram"], w["ctx"], n, w["twice"], w["own"], raw[start : start + n + LENGTH - 1]), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()), strict=True)], ["gram", "ctx", "n", "twice", "own", "bytes"])


def _index(table: pa.Table) -> pa.Table:
    order = np.lexsort([table["ctx"].to_numpy(), table["gram"].to_numpy()])
    table = table.take(pa.array(order))
    runs = repeated_starts(table["bytes"].to_pylist(), table["n"].to_pylist(), table["twice"].to_pylist())
    keep = pa.array([bool(r) for r in runs], pa.bool_())
    return pa.table([table["gram"], table["ctx"], _runs(runs)], ["gram", "ctx", "runs"]).filter(keep)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for gram, ctx, n, twice, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)), strict=True):
            digest = [xxhash.xxh3_128_digest(raw[i : i + LENGTH]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([gram] * n, pa.int64()), pa.array([ctx] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([1 + twice] * n, pa.int32()), pa.array(digest, pa.binary())], ["gram", "ctx", "start", "times", "window"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        at, data = common.utf8(batch.column(1))
        for i, spans in enumerate(batch.column(2)):
            raw = data[at[i] : at[i + 1]].tobytes()
            merged: list[list[int]] = []
            for s in sorted((x["a"], x["b"]) for x in spans.as_py() or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            kept, last = [], 0
            for a, b in merged:
                kept.append(raw[last:a])
                last = b
            kept.append(raw[last:])
            rows.append((len(raw), sum(b - a for a, b in merged), len(merged), b"".join(kept), merged))
        n, gone, spans, kept, where = zip(*rows, strict=True) if rows else ([],) * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(where, pa.list_(pa.list_(pa.int64())))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def _freed(spark: SparkSession) -> None:
    """Shuffle files of finished steps go once the driver has collected its references; here, not whenever that happens by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (from, to in bytes) of each text."""
    spark = docs.sparkSession
    begun = common.mark(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    if rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows = rows.withColumn("ref", F.coalesce("doc_id", F.lit(-(1 << 63))))
    else:
        rows = common.stored(rows.withColumn("ref", F.monotonically_increasing_id()), "numbered-texts")
    every = common.stored(rows.filter(F.octet_length("text") >= LENGTH).select("ref", "text").mapInArrow(_find, "ref long, place long, gram long, ctx long"), "all-contexts")
    twice = common.stored(every.groupBy("gram").count().filter("count > 1").select("gram"), "repeated-grams")
    held = common.stored(every.join(twice, "gram").select("ref", "place", "gram", "ctx"), "contexts")
    common.release(spark, begun, (rows, held))
    _freed(spark)
    # different contexts, how often each occurs, and how many there are of each gram
    distinct = common.stored(held.groupBy("gram", "ctx").agg(F.count("*").alias("m"), F.first("ref").alias("ref"), F.first("place").alias("place")), "different-contexts")
    many = common.stored(distinct.groupBy("gram").agg(F.count("*").alias("k")).filter(F.col("k") > min(crowd, MANY)), "frequent-grams")
    crowded = many.filter(F.col("k") > crowd)
    _freed(spark)
    asked = distinct.select("ref", F.struct("place", "gram", "ctx", (F.col("m") > 1).alias("twice")).alias("w"), "gram")
    asked = common.joined(asked, many, "gram", "left")
    wanted = asked.filter(F.coalesce("k", F.lit(0)) <= crowd)
    total = wanted.agg(F.sum(F.col("w.place").bitwiseAND(F.lit(255)) + LENGTH)).first()[0] or 0

    def texts_of(some: DataFrame) -> DataFrame:
        ask = some.groupBy("ref").agg(F.collect_list(F.struct("w.*", F.col("k").isNotNull().alias("own"))).alias("wanted"))
        return rows.select("ref", "text").join(ask, "ref").select("text", "wanted").mapInArrow(_extract, "gram long, ctx long, n int, twice boolean, own boolean, bytes binary")

    marks = spark.createDataFrame([], f"gram long, ctx long, runs {RUNS}")
    if total:
        collections = max(1, -(-total // COLLECTION))
        # a gram with many contexts is a collection by itself, so that none holds much more than COLLECTION
        own = -1 - F.shiftrightunsigned(F.xxhash64("gram"), 1)
        dealt = texts_of(wanted).withColumn("collection", F.when(F.col("own"), own).otherwise(F.pmod(F.xxhash64("gram"), F.lit(collections))))
        marks = dealt.groupBy("collection").applyInArrow(lambda t: _index(t), f"gram long, ctx long, runs {RUNS}")
    if not crowded.isEmpty():
        windows = common.stored(texts_of(asked.filter(F.col("k") > crowd)).mapInArrow(_windows, "gram long, ctx long, start int, times int, window binary"), "crowded-windows")
        again = common.stored(windows.groupBy("window").agg(F.sum("times").alias("n")).filter("n > 1").select("window"), "crowded-repeats")
        one = F.struct(F.col("start").alias("a"), F.col("start").alias("b"))
        marks = marks.unionByName(windows.join(again, "window").groupBy("gram", "ctx").agg(F.collect_list(one).alias("runs")))
    marks = common.stored(marks, "marks")
    _freed(spark)
    spans = held.join(marks, ["gram", "ctx"]).select("ref", F.shiftright("place", 8).alias("at"), F.inline("runs"))
    spans = spans.groupBy("ref").agg(F.collect_list(F.struct((F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b") + LENGTH).alias("b"))).alias("spans"))
    spans = common.stored(spans, "spans")
    common.release(spark, begun, (rows, spans))
    _freed(spark)
    return rows.join(spans, "ref", "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


def op5_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("spans")
