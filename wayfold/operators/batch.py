"""Batch planning: cost, order, trim windows and names that don't collide."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

MAX_NAMES = 1000
#: Sampled jobs for each range of places.
SAMPLED = 40


def longest_first(jobs: DataFrame, cost: str = "cost", ord_: str = "ord") -> DataFrame:
    """Jobs by cost, highest first; equals keep their input order."""
    return jobs.orderBy(F.desc(cost), F.asc(ord_))


def places(jobs: DataFrame, cost: str = "cost", ord_: str = "ord") -> DataFrame:
    """``place`` (from 1) of every job in the order of ``longest_first``.

    Sampled jobs cut the order into ranges; each is numbered by itself and begins after the counts of those before it, so no task holds all.
    Ranges are by cost and input order, so equal costs don't pile up in one.
    """
    spark, ranges = jobs.sparkSession, int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(cost)
    keyed = jobs.withColumn("_key", F.struct(value.isNull().alias("none"), (~F.coalesce(F.isnan(value), F.lit(False))).alias("number"), (-value).alias("cost"), F.col(ord_).alias("ord")))
    share = min(1.0, SAMPLED * ranges / max(1, jobs.count()))
    sample = [r["_key"] for r in keyed.select("_key").sample(share, 7).orderBy("_key").collect()]
    step = max(1, len(sample) // ranges)
    bounds = spark.createDataFrame([(sample[step - 1 :: step],)], T.StructType([T.StructField("_bounds", T.ArrayType(keyed.schema["_key"].dataType))]))
    placed = keyed.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("_key")))).drop("_bounds")
    counts = placed.groupBy("_range").count()
    before = counts.select("_range", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    return placed.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_own")).select(*jobs.columns, "place")


def trim_window(start: Column, end: Column, duration: Column) -> Column:
    """Struct (start, end, status) of a span in clip seconds; null start or end is open, an end of 0 too. Status: ok, outside or inverted."""
    open_end = end.isNull() | (end == 0)
    a = F.coalesce(start, F.lit(0.0))
    outside = (duration > 0) & ((a >= duration) | (~open_end & (end < 0)))
    inverted = ~open_end & (end <= a)
    b = F.when(open_end, F.lit(0.0)).otherwise(F.when((duration > 0) & (end > duration), duration).otherwise(end))
    return F.struct(F.greatest(a, F.lit(0.0)).alias("start"), b.alias("end"), F.when(outside, "outside").when(inverted, "inverted").otherwise("ok").alias("status"))


def instant_seconds(instant: Column, creation: Column, offset: Column) -> Column:
    """Clip seconds of an instant: less the creation time and the clock offset, all in microseconds."""
    return (instant - creation - offset) / 1_000_000


def valid_bounds(start_kind: Column, end_kind: Column, start: Column, end: Column) -> Column:
    """Bounds of different kinds can't be compared; those of one kind must be in order."""
    return (start_kind != end_kind) | start.isNull() | end.isNull() | (end > start)


def calibration_start(start: Column, duration: Column) -> Column:
    """Struct (start, status): past the end is an error, before the start is the start."""
    return F.struct(F.greatest(start, F.lit(0.0)).alias("start"), F.when((duration > 0) & (start >= duration), "outside").otherwise("ok").alias("status"))


def named(jobs: DataFrame, taken: DataFrame) -> DataFrame:
    """``path`` for each job (ord, dir, stem, slugs, extension): the base name, or the first free number after it, in input order.

    No path repeats, and none is in ``taken`` (path); numbers go to a thousand, beyond them path is null. An extension is empty or begins with a dot.
    Names that are alike but for numbers at their end may be one another's numbered form, so these are claimed together, in input order; all others
    are independent. Of jobs that share a base name only the first 1001 can get one, so no more are looked at.
    """
    root = lambda path: F.regexp_replace(path, r"( - [0-9]+)+(?=\.|\z)", "")
    base = jobs.withColumn("name", F.concat(F.col("dir"), F.lit("/"), text.output_name(F.col("stem"), F.col("slugs"), F.lit("")))).withColumn("_root", root(F.concat("name", "extension")))
    base = base.withColumn("_k", F.row_number().over(Window.partitionBy("_root", "name", "extension").orderBy("ord")))
    asking = base.filter(F.col("_root").isNotNull() & (F.col("_k") <= MAX_NAMES + 1)).select("_root", "ord", "name", "extension", "_k")
    used = taken.select(root(F.col("path")).alias("_root"), F.col("path").alias("_p"))
    claims = asking.groupBy("_root").cogroup(used.groupBy("_root")).applyInPandas(_claimed, "name string, extension string, _k int, path string")
    return base.join(claims, ["name", "extension", "_k"], "left").select(*jobs.columns, "path")


def _claimed(jobs: pd.DataFrame, used: pd.DataFrame) -> pd.DataFrame:
    """Names given one after the other; what is taken stays so, hence a name's numbers are tried once."""
    jobs = jobs.sort_values(["ord", "_k"], na_position="first")
    taken, tried, out = set(used["_p"]), {}, []
    for name, extension in zip(jobs["name"], jobs["extension"], strict=True):
        no = tried.get((name, extension), 0)
        path = None
        while path is None and no <= MAX_NAMES:
            path = f"{name} - {no}{extension}" if no else f"{name}{extension}"
            path = None if path in taken else path
            no += 1
        tried[name, extension] = no
        taken.add(path)
        out.append(path)
    return jobs[["name", "extension", "_k"]].assign(path=pd.Series(out, jobs.index, object))


def duplicates(effects: DataFrame, key: str = "effect") -> DataFrame:
    return effects.groupBy(key).count().filter("count > 1")


def suggestion(points: DataFrame, target: float, *by: str) -> DataFrame:
    """The first quality, ascending, whose score reaches the target (of each ``by``); null if none does."""
    return points.groupBy(*by).agg(F.min(F.when(F.col("score") >= target, F.col("quality"))).alias("quality"))


def tally(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("jobs"), F.count("error").alias("failed"))


def short_analyses(series: DataFrame, tolerance: int = 2) -> DataFrame:
    """Analyses that miss more than ``tolerance`` of the source's frames."""
    return series.filter(F.col("source_frames") - F.col("frames") > tolerance)


def distinct_messages(log: DataFrame) -> DataFrame:
    return log.dropDuplicates(["message"])


def trailing_rate(reports: DataFrame, window: int = 10) -> DataFrame:
    """done per second over the last ``window`` reports (series_id, t, done), and the ETA to ``total``."""
    w = Window.partitionBy("series_id").orderBy("t", "done").rowsBetween(-window, 0)
    dt = (F.col("t") - F.first("t").over(w)) / 1_000_000
    rate = (F.col("done") - F.first("done").over(w)) / F.when(dt > 0, dt)
    return reports.withColumn("rate", rate).withColumn("eta", F.greatest(F.col("total") - F.col("done"), F.lit(0)) / F.when(F.col("rate") > 0, F.col("rate")))


#: Descriptors of either side that meet at once.
CHUNK = 2048
#: Substrings of a descriptor that are looked up, and bits of one that may differ there: every neighbour up to ``RADIUS`` shares a substring within that.
PARTS, FLIPS = 4, 1
RADIUS = PARTS * (FLIPS + 1) - 1


def near_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """(block, d, other, n, id, distance): for each different descriptor of ``a`` those of ``b`` in its block that share a 16-bit substring with it, one bit aside, once each; ``n`` rows of ``b`` have it, ``id`` is the
    least of them. By the pigeonhole principle all within ``RADIUS`` bits are among them."""
    sub = lambda k: F.shiftrightunsigned("d", 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("int")
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), sub(k).alias("s")) for k in range(PARTS)]))
    own = a.select("block", "d").distinct().select("block", "d", parts.alias("p"))
    flips = F.explode(F.array(F.lit(0), *[F.lit(1 << i) for i in range(16)]))
    asks = own.select("block", "d", "p.k", F.col("p.s").alias("s"), flips.alias("f")).select("block", "d", "k", F.col("s").bitwiseXOR(F.col("f")).alias("s"))
    index = b.groupBy("block", "d").agg(F.count("*").alias("n"), F.min("id").alias("id")).select("block", F.col("d").alias("other"), "n", "id", "d").select("block", "other", "n", "id", parts.alias("p"))
    met = asks.join(index.select("block", "other", "n", "id", "p.k", "p.s"), ["block", "k", "s"])
    return met.select("block", "d", "other", "n", "id").distinct().withColumn("distance", F.bit_count(F.col("d").bitwiseXOR(F.col("other"))))


def nearest_pairs(a: DataFrame, b: DataFrame, ratio: float = 0.75, chunk: int = CHUNK) -> DataFrame:
    """Descriptor matches (block, a, b, distance) with Hamming distance to the nearest (the least id of equals) no more than ``ratio`` of that to the second. Frames are (block, id, d BIGINT bits).

    A ratio test needs both distances exactly, or bounds that decide it. A block's ``a`` is dealt to tasks, ``SPREAD`` chunks to each; a task looks its descriptors up by substrings of the bits that vary,
    within more and more bits (``_looked_up``), and only those that this doesn't decide meet all of the block's ``b``, a chunk against a chunk. No pair is a row, and what a task holds is its part of ``a``
    and the block's ``b``, which is that of one picture.
    """
    a, b = (x.filter("d IS NOT NULL") for x in (a, b))
    parts = a.groupBy("block").agg(F.ceil(F.count("*") / (SPREAD * chunk)).cast("int").alias("_n"))
    left = a.select("block", "id", "d").join(parts, "block").withColumn("_k", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).drop("_n")
    right = b.select("block", "id", "d").join(parts, "block").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")

    def match(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = x.reset_index(drop=True), y.sort_values("id").reset_index(drop=True)
        if len(x) == 0 or len(y) < 2:
            return pd.DataFrame({"block": x["block"][:0], "a": x["id"][:0], "b": x["id"][:0], "distance": np.zeros(0, np.int32)})
        own, other = x["d"].to_numpy(np.int64).view(np.uint64), y["d"].to_numpy(np.int64).view(np.uint64)
        best, good, rest = _looked_up(own, other, ratio)
        for k in range(0, len(rest), chunk):
            rows = rest[k : k + chunk]
            best[rows] = _all_pairs(own[rows], other, chunk)
        distance, at = best // PLACES, best % PLACES
        good[rest] = distance[rest, 0] <= ratio * distance[rest, 1]
        return pd.DataFrame({"block": x["block"][good], "a": x["id"][good], "b": y["id"].to_numpy()[at[good, 0]], "distance": distance[good, 0].astype(np.int32)})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return left.groupBy("block", "_k").cogroup(right.groupBy("block", "_k")).applyInPandas(match, f"block {kind(a, 'block')}, a {kind(a, 'id')}, b {kind(b, 'id')}, distance int")


#: Chunks of ``a`` in a task. A neighbour is a number: its distance times PLACES, plus its place in order of ids.
SPREAD, PLACES = 8, 1 << 40
#: Bits of a substring, bits of one that may differ, and neighbours that are looked at at once.
SUBSTRING, MOST_FLIPS, AT_ONCE = 16, 3, 1 << 20


def _nearer(best: np.ndarray, more: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate([best, more], 1), 1)[:, :2]


def _all_pairs(own: np.ndarray, other: np.ndarray, chunk: int) -> np.ndarray:
    """The two nearest of ``other`` for each of ``own``."""
    best = np.full((len(own), 2), 255 * PLACES, np.int64)
    rows = np.arange(len(own))
    for k in range(0, len(other), chunk):
        far = np.bitwise_count(own[:, None] ^ other[None, k : k + chunk])
        two = []
        for _ in range(2):
            near = far.argmin(1)
            two.append(far[rows, near].astype(np.int64) * PLACES + near + k)
            far[rows, near] = 255
        best = _nearer(best, np.stack(two, 1))
    return best


def _looked_up(own: np.ndarray, other: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two nearest found for each of ``own``, which of them pass the ratio test, and the places of those that are undecided.

    The bits that vary are cut into substrings, and a neighbour is met where one of them differs in no more than f bits: with n substrings that finds all within n (f + 1) - 1. What is found bounds the
    second distance from above and that radius bounds it from below, so most are decided before both neighbours are within it. f grows while that costs less than all pairs.
    """
    low = other[0]
    varying = np.bitwise_or.reduce(other ^ low) | np.bitwise_or.reduce(own ^ low)
    bits = [k for k in range(64) if int(varying) >> k & 1]
    best, good, open_ = np.full((len(own), 2), 255 * PLACES, np.int64), np.zeros(len(own), bool), np.arange(len(own))
    if not bits:
        return best, good, open_
    count = -(-len(bits) // SUBSTRING)
    groups = [bits[k::count] for k in range(count)]
    cut = lambda d, g: sum((d >> np.uint64(k) & np.uint64(1)) << np.uint64(j) for j, k in enumerate(g)).astype(np.int64)
    index = []
    for g in groups:
        sub = cut(other, g)
        index.append((sub, np.argsort(sub, kind="stable"), np.append(0, np.cumsum(np.bincount(sub, minlength=1 << len(g))))))
    mine = [cut(own, g) for g in groups]
    for f in range(MOST_FLIPS + 1):
        masks = [np.array([sum(1 << k for k in c) for c in combinations(range(len(g)), f)], np.int64) for g in groups]
        expected = sum(len(m) * (1 + len(other) / (1 << len(g))) for m, g in zip(masks, groups, strict=True))
        if 8 * expected > len(other) or not len(open_):
            break
        size = max(1, int(AT_ONCE / expected))
        for k in range(0, len(open_), size):
            rows = open_[k : k + size]
            for p, (_, order, starts) in enumerate(index):
                keys = (mine[p][rows][:, None] ^ masks[p][None, :]).ravel()
                sizes = starts[keys + 1] - starts[keys]
                row = np.repeat(np.repeat(np.arange(len(rows)), len(masks[p])), sizes)
                if not len(row):
                    continue
                met = order[np.repeat(starts[keys] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(row))]
                # a neighbour counts once: at the first of its substrings that differ least
                apart = [np.bitwise_count(mine[q][rows][row] ^ index[q][0][met]) for q in range(count)]
                once = np.logical_and.reduce([apart[q] > f if q < p else apart[q] >= f for q in range(count)])
                row, met = row[once], met[once]
                if not len(row):
                    continue
                code = np.bitwise_count(own[rows][row] ^ other[met]).astype(np.int64) * PLACES + met
                begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                first = np.minimum.reduceat(code, begin)
                code = np.where(code == np.repeat(first, np.diff(np.append(begin, len(row)))), 255 * PLACES, code)
                at = rows[row[begin]]
                best[at] = _nearer(best[at], np.stack([first, np.minimum.reduceat(code, begin)], 1))
        radius = count * (f + 1) - 1
        one, two = best[open_, 0] // PLACES, best[open_, 1] // PLACES
        passes = (one <= radius) & (one <= ratio * np.minimum(two, radius + 1))
        fails = (np.minimum(one, radius + 1) > ratio * two) & (two < 255)
        good[open_[passes]] = True
        open_ = open_[~passes & ~fails]
    return best, good, open_
