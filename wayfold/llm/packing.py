"""Best-fit packing with certified bounds (operator 6).

Documents become pieces of at most ``capacity`` ids; pieces are dealt over partitions of bounded size and packed best-fit
decreasing. Dual feasible functions bound from below how many bins any packing of a partition's lengths needs. A partition whose
bins meet its bound is certified; one that isn't first repacks a few of its own bins at a time, its emptiest among them, filling each bin by subset sums (``repaired``), so that a corpus of one
partition, or the last one of an exchange, is repacked too. Bins with room from partitions that aren't, and the emptiest bin of every other, give their
documents back; these are dealt anew over fewer partitions and packed again, until the corpus as a whole meets its bound, a round gains nothing (what was given back then stays as it was) or
``ROUNDS`` exchanges are done.

Defined cases: null text counts as empty, a piece of one end id; a null doc_id and rows that share a doc_id or are repeated are documents of their own; ties in length are broken by doc_id,
piece and checksum; an empty table gives no rows; a text of any length is encoded whole, in stretches, and cut; columns besides doc_id and text aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY, ROUNDS = 2048, 4
#: Repackings within a partition (fewer where it has many bins), and bins and pieces that one takes.
TRIES, BINS, POOL = 2000, 9, 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", part long, bin long, offset long, fill long, certified boolean"


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Ids of every whole text, cut: all pieces but the first hold ``capacity`` ids. Null text: empty (one end id)."""
    path = tokenizer or tokens.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            for part in common.slices(batch, "text", 4 << 20):
                rows: list[tuple] = []
                flat, ends = encoder.encode(*reversed(common.utf8(part.column(1))), end_id)
                flat, ends = flat.astype("<u4"), ends.tolist()
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    ids = flat[ends[i] : ends[i + 1]]
                    bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    rows += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).mapInArrow(cut, PIECES)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing needs fewer bins. ``counts[n]`` pieces have length n.

    The largest of the bounds by the identity and two families of dual feasible functions: u_k(x) = x where (k+1)x is whole, else
    floor((k+1)x)/k, for k up to 100; and the threshold functions that round lengths over capacity - e up to a bin and those under e down to 0.
    """
    n = np.arange(len(counts), dtype=np.int64)
    most = -(-int((counts * n).sum()) // capacity)
    for k in range(1, 101):
        scaled, exact = (k + 1) * n // capacity, (k + 1) * n % capacity == 0
        # in units of 1 / (k * capacity)
        value = int((counts * np.where(exact, k * n, scaled * capacity)).sum())
        most = max(most, -(-value // (k * capacity)))
    whole = np.concatenate([[0], np.cumsum(counts[::-1])])  # whole[j]: pieces longer than len - 1 - j
    mass = np.concatenate([[0], np.cumsum(counts * n)])
    for e in range(1, capacity // 2 + 1):
        large = int(whole[len(counts) - 1 - (capacity - e)]) if capacity - e + 1 <= len(counts) - 1 else 0
        middle = int(mass[capacity - e + 1] - mass[e])
        most = max(most, large + -(-middle // capacity))
    return most


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; bins are numbered from 0. A bit for each room that some bin has finds the tightest in one step."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    have, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := have >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                have &= ~(1 << room)
        else:
            room, b, bins = capacity, bins, bins + 1
        where[i], offset[i] = b, capacity - room
        if left := room - n:
            rooms[left].append(b)
            have |= 1 << left
    return where, offset


def _filled(pool: list[int], lengths: np.ndarray, capacity: int, draw: np.random.Generator) -> list[list[int]]:
    """Bins of the pieces ``pool`` (longest first): each takes the longest left and those that fill the rest of it best, by subset sums kept as bits; which of equals, ``draw`` says."""
    bins, rest, whole = [], pool, (1 << (capacity + 1)) - 1
    while rest:
        first, rest = rest[0], [rest[k] for k in draw.permutation(len(rest) - 1) + 1]
        room = capacity - int(lengths[first])
        bits, seen = 1, []
        for i in rest:
            seen.append(bits)
            bits |= (bits << int(lengths[i])) & whole
        left = (bits & ((1 << (room + 1)) - 1)).bit_length() - 1
        taken = set()
        for k in range(len(rest) - 1, -1, -1):
            if left and not (seen[k] >> left) & 1:
                taken.add(k)
                left -= int(lengths[rest[k]])
        bins.append([first, *[rest[k] for k in sorted(taken)]])
        rest = sorted((i for k, i in enumerate(rest) if k not in taken), key=lambda i: (-int(lengths[i]), i))
    return bins


def repaired(lengths: np.ndarray, where: np.ndarray, least: int, capacity: int = CAPACITY, tries: int = TRIES) -> np.ndarray:
    """``where`` with as many bins or fewer, down to ``least``: the emptiest bin and a few others, drawn by a fixed seed, are packed anew, and stay so if that takes a bin less, or
    leaves as much of the room in one."""
    bins: list[list[int]] = [[] for _ in range(int(where.max()) + 1 if len(where) else 0)]
    for i, b in enumerate(where.tolist()):
        bins[b].append(i)
    fill = [int(lengths[b].sum()) for b in bins]
    draw = np.random.default_rng(len(lengths))
    for _ in range(min(tries, max(200, 1_000_000 // max(1, len(bins))))):
        if len(bins) <= least:
            break
        room = [b for b in range(len(bins)) if fill[b] < capacity]
        low = min(room, key=lambda b: (fill[b], b), default=None)
        # bins with room first; full ones too, as what fills them may fit better elsewhere
        others = [b for b in (room if draw.random() < 0.5 and len(room) > 2 else range(len(bins))) if b != low]
        if low is None or not others:
            break
        few = [low, *(others[k] for k in draw.permutation(len(others))[: int(draw.integers(1, BINS))])]
        pool = sorted((i for b in few for i in bins[b]), key=lambda i: (-int(lengths[i]), i))
        if len(pool) > POOL:
            few = few[:2]
            pool = sorted((i for b in few for i in bins[b]), key=lambda i: (-int(lengths[i]), i))
            if len(pool) > 8 * POOL:
                continue
        made = _filled(pool, lengths, capacity, draw)
        sums = [int(lengths[b].sum()) for b in made]
        before = sum(fill[b] ** 2 for b in few)
        if len(made) < len(few) or len(made) == len(few) and sum(x * x for x in sums) >= before:
            keep = set(few)
            bins = [b for k, b in enumerate(bins) if k not in keep] + made
            fill = [f for k, f in enumerate(fill) if k not in keep] + sums
    out = np.zeros(len(lengths), np.int64)
    for b, members in enumerate(bins):
        out[members] = b
    return out


def _offsets(lengths: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Places in their bins, gapless, in the order of the pieces."""
    order = np.argsort(where, kind="stable")
    upto = np.cumsum(lengths[order]) - lengths[order]
    begins = np.flatnonzero(np.diff(where[order], prepend=-1))
    out = np.zeros(len(lengths), np.int64)
    out[order] = upto - np.repeat(upto[begins], np.diff(np.append(begins, len(order))))
    return out


def _packed(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    n = frame["length"].to_numpy()
    b, off = best_fit_decreasing(n, capacity)
    least = lower_bound(np.bincount(n, minlength=capacity + 1), capacity)
    if int(b.max()) + 1 > least:
        b = repaired(n, b, least, capacity)
        off = _offsets(n, b)
    fill = np.bincount(b, weights=n).astype(np.int64)
    return frame.assign(bin=b, offset=off, fill=fill[b], certified=len(fill) == least)


def pack(rows: DataFrame, capacity: int = CAPACITY, per_part: int = 65_536, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (see PIECES) with sequence_id and offset. ``per_part`` bounds what one task packs; ``rounds`` the exchanges."""
    spark = rows.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    least, best = lower_bound(counts, capacity), int(counts[capacity])
    full = rows.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    open_, done = rows.filter(F.col("length") < capacity), []
    n = int(counts[:capacity].sum())
    given, given_bins = None, 0
    for k in range(rounds + 1):
        if not n:
            break
        parts = max(1, math.ceil(n / per_part))
        dealt = open_.withColumn("part", F.pmod(F.xxhash64(F.lit(k), "doc_id", "piece", "start", "ids_crc32"), F.lit(parts)))
        packed = common.stored(dealt.groupBy("part").applyInPandas(lambda f: _packed(f, capacity), PACKED), f"packed-{k}").withColumn("round", F.lit(k))
        per = packed.select("part", "bin", "fill", "certified").distinct()
        low = common.stored(per.groupBy("part").agg(F.count("*").alias("bins"), F.min(F.when(F.col("fill") < capacity, F.col("fill"))).alias("low")), "bins")
        bins = low.agg(F.sum("bins")).first()[0]
        if given is not None and bins >= given_bins:
            done.append(given)
            break
        if k == rounds or parts == 1 or bins + best <= least:
            done.append(packed)
            break
        # what has room in partitions without a certificate, and the emptiest bins of the others
        back = F.coalesce((F.col("fill") < capacity) & (~F.col("certified") | (F.col("fill") <= F.col("low"))), F.lit(False))
        marked = common.joined(packed, low.select("part", "low"), "part")
        done.append(marked.filter(~back).drop("low"))
        given = marked.filter(back).drop("low")
        open_ = given.select("doc_id", "piece", "start", "length", "ids_crc32")
        n, given_bins = open_.count(), given.select("part", "bin").distinct().count()
        best += done[-1].select("part", "bin").distinct().count()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = full.select(names)
    for d in done:
        out = out.unionByName(d.withColumn("sequence_id", F.shiftleft(F.col("round").cast("long"), 58) + F.shiftleft("part", 24) + F.col("bin")).select(names))
    return out


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and offset. A text is encoded once; the cut pieces are stored."""
    return pack(common.stored(pieces(docs, tokenizer, capacity=capacity), "pieces"), capacity)
