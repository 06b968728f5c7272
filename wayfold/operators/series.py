"""Irregular time series: ordering, gaps, as-of interpolation, grids, smoothing and calculus.

A series frame has ``series_id``, ``t`` (BIGINT microseconds since the epoch), ``tie`` (unique within a series, orders equal times) and ``value``.
Every window is partitioned by series, so series spread over tasks; nothing collects a series. Where one series is too long for a task, a ``width`` (microseconds of its axis, see
``chunks.width_for``) cuts it into cells: sums, carried values and positions then go over two levels, and smoothing always goes by chunks of positions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import chunks

SECOND = 1_000_000
#: Fixed values of the domain.
MAX_INTERPOLATION_GAP, MAX_GRID_GAP, GRID_STEP = 3 * SECOND, 2 * SECOND, SECOND
METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON = 111_132.0, 111_320.0
MIN_DISPLACEMENT, MAX_RATE = 0.5, 200.0


def typed(df: DataFrame, series_id: str, ts: str, tie: str, value: str) -> DataFrame:
    """A series frame from any table; a zone-less timestamp is read as UTC."""
    return df.select(F.col(series_id).alias("series_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).alias("tie"), F.col(value).cast("double").alias("value"))


def ordered(*more: str) -> WindowSpec:
    return Window.partitionBy("series_id", *more).orderBy("t", "tie")


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def runs(df: DataFrame, gap: int, width: int | None = None) -> DataFrame:
    """``run_id`` counts up where a point comes more than ``gap`` microseconds after the one before."""
    return chunks.running(df, {"run_id": lambda before, own: F.when(own("t") - before("t") > gap, 1).otherwise(0)}, ("t",), width=width)


def grid_runs(df: DataFrame, step: int = GRID_STEP, width: int | None = None) -> DataFrame:
    """``run_id`` counts up where the step isn't exactly ``step``."""
    return chunks.running(df, {"run_id": lambda before, own: F.when(own("t") - before("t") != step, 1).otherwise(0)}, ("t",), width=width)


def at(probes: DataFrame, data: DataFrame, max_gap: int = MAX_INTERPOLATION_GAP, values: tuple[str, ...] = ("value",), width: int | None = None) -> DataFrame:
    """``probes`` (series_id, t, probe) with the data's values at t: an exact hit wins, else linear between neighbours no more than ``max_gap`` apart, else null.

    One union, sorted forward and backward; no range join. Never extrapolates.
    """
    point = F.struct("t", *[F.col(v) for v in values])
    rows = data.select("series_id", "t", F.lit(0).alias("kind"), F.col("tie").cast("string").alias("tie"), point.alias("p"), F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"))
    asks = probes.select("series_id", "t", F.lit(1).alias("kind"), F.lit("").alias("tie"), F.lit(None).cast(rows.schema["p"].dataType).alias("p"), "probe")
    # forward: the last point at or before the probe. Backward: the first at or after it, as points at a probe's own time come before it; of several at one time both stand for the first
    forward, back = [F.col("t"), F.col("kind"), F.col("tie")], [F.desc("t"), F.col("kind"), F.desc("tie")]
    both = chunks.around(rows.unionByName(asks), "p", forward, back, width=width).filter("kind = 1")
    both = both.withColumn("e", F.when(F.col("_b.t") == F.col("t"), F.col("_b")))
    gap = F.col("_b.t") - F.col("_a.t")
    part = (F.col("t") - F.col("_a.t")).cast("double") / gap
    out = [F.when(F.col("e").isNotNull(), F.col(f"e.{v}")).when((gap > 0) & (gap <= max_gap), F.col(f"_a.{v}") + part * (F.col(f"_b.{v}") - F.col(f"_a.{v}"))).alias(v) for v in values]
    return both.select("series_id", "t", "probe", *out)


def snapped(probes: DataFrame, data: DataFrame, max_gap: int = MAX_INTERPOLATION_GAP) -> DataFrame:
    """As ``at``, but a probe in a gap over ``max_gap`` gets the nearest point (the earlier of two as near) with that point's own time: ``found_t``, which else is the probe's."""
    own = data.select("series_id", "t", "tie", "value", F.col("t").alias("own"))
    both = at(probes, own, max_gap, ("value",)).alias("v").select("series_id", "t", "probe", "value")
    asks = both.filter("value IS NULL").select("series_id", "t", F.struct("probe").alias("probe"))
    w = Window.partitionBy("series_id")
    rows = own.select("series_id", "t", F.lit(0).alias("kind"), F.struct("own", "value").alias("p"), F.lit(None).cast(asks.schema["probe"].dataType).alias("probe"))
    every = rows.unionByName(asks.select("series_id", "t", F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["p"].dataType).alias("p"), "probe"))
    every = every.withColumn("a", F.last("p", ignorenulls=True).over(w.orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    every = every.withColumn("b", F.last("p", ignorenulls=True).over(w.orderBy(F.desc("t"), "kind").rowsBetween(Window.unboundedPreceding, 0))).filter("kind = 1")
    near = F.when(F.col("t") - F.col("a.own") <= F.col("b.own") - F.col("t"), F.col("a")).otherwise(F.col("b"))
    inside = F.col("a").isNotNull() & F.col("b").isNotNull()
    gaps = every.withColumn("n", F.when(inside, near)).select("series_id", "t", "probe.probe", F.col("n.value").alias("value"), F.col("n.own").alias("found_t"))
    return both.filter("value IS NOT NULL").withColumn("found_t", F.col("t")).unionByName(gaps)


def steps(data: DataFrame, step: int) -> DataFrame:
    """The grid of each series: first to last time by ``step``."""
    ends = data.groupBy("series_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return ends.select("series_id", F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("t")).withColumn("probe", F.col("t"))


def resample(data: DataFrame, step: int = GRID_STEP, max_gap: int = MAX_GRID_GAP, values: tuple[str, ...] = ("value",), width: int | None = None) -> DataFrame:
    """Values on the grid (see ``steps``), as ``at`` gives them; grid points in gaps over ``max_gap`` are left out.

    Each point makes the grid's points up to the next one, so only the data are sorted, and the grid is neither sorted nor shuffled."""
    points = data.filter("t IS NOT NULL").select("series_id", "t", F.col("tie").cast("string").alias("tie"), F.struct("t", *[F.col(v) for v in values]).alias("_a"))
    rows = chunks.followed(points, "_a", width=width).withColumnRenamed("_next", "_b")
    gap = F.col("_b.t") - F.col("t")
    place = lambda c: F.expr(f"({c} - _lo) div {int(step)}L")
    after, upto = place("t") + 1, place("_b.t")
    hit = F.col("_lo") + upto * step == F.col("_b.t")
    none = F.array().cast("array<bigint>")
    made = F.when(upto >= after, F.when(gap <= max_gap, F.sequence(after, upto)).when(hit, F.array(upto)))
    at_first = F.when(F.col("_first"), F.array(F.lit(0).cast("long"))).otherwise(none)
    rows = rows.select("series_id", "_a", "_b", "_lo", F.explode(F.concat(at_first, F.coalesce(made, none))).alias("_k")).withColumn("t", F.col("_lo") + F.col("_k") * step)
    part = (F.col("t") - F.col("_a.t")).cast("double") / (F.col("_b.t") - F.col("_a.t"))
    between = lambda v: F.col(f"_a.{v}") + part * (F.col(f"_b.{v}") - F.col(f"_a.{v}"))
    found = [F.when(F.col("t") == F.col("_a.t"), F.col(f"_a.{v}")).when(F.col("t") == F.col("_b.t"), F.col(f"_b.{v}")).otherwise(between(v)).alias(v) for v in values]
    return rows.select("series_id", "t", F.col("t").alias("tie"), *found).filter(F.col(values[0]).isNotNull())


def covered_index(probes: DataFrame, data: DataFrame, width: int | None = None) -> DataFrame:
    """Index of the last point at or before each probe, -1 if none."""
    rows = data.select("series_id", "t", F.lit(0).alias("kind"), F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"))
    both = rows.unionByName(probes.select("series_id", "t", F.lit(1).alias("kind"), "probe"))
    counted = chunks.running(both, {"idx": lambda before, own: 1 - own("kind")}, order=("t", "kind"), width=width)
    return counted.filter("kind = 1").select("series_id", "t", "probe", (F.col("idx") - 1).alias("idx"))


def project(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``east`` and ``north`` metres from the series' mean position, of finite fixes."""
    fixes = df.filter(is_finite(F.col(lat)) & is_finite(F.col(lon)))
    w = Window.partitionBy("series_id")
    fixes = fixes.withColumn("_lat0", F.avg(lat).over(w)).withColumn("_lon0", F.avg(lon).over(w))
    east = (F.col(lon) - F.col("_lon0")) * METRES_PER_DEGREE_LON * F.cos(F.radians("_lat0"))
    return fixes.withColumn("east", east).withColumn("north", (F.col(lat) - F.col("_lat0")) * METRES_PER_DEGREE_LAT).drop("_lat0", "_lon0")


def kernel(sigma: float, multiple: float = 3.0) -> list[float]:
    """A normalised Gaussian kernel of radius ceil(multiple sigma), one at least; [1] for no sigma."""
    if sigma <= 0:
        return [1.0]
    r = max(1, math.ceil(multiple * sigma))
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def smooth(df: DataFrame, sigma: float, boundary: str, values: tuple[str, ...] = ("value",), keys: tuple[str, ...] = (), multiple: float = 3.0, width: int | None = None, order: tuple[str, ...] = ("t", "tie"), at: str = "t", tasks: int | None = None) -> DataFrame:
    """Gaussian smoothing by position. ``boundary`` says what stands beyond the ends: ``reflect``, ``extrapolate`` (linear fits of the end rows) or ``clamp``.

    A series of one point is copied under ``reflect``. Chunks of positions borrow the kernel's radius from their neighbours and are convolved by themselves, so a task holds a chunk, whatever the
    length of a series; all ``values`` go at once. A null in reach makes a null. ``order`` and ``at`` name the axis, ``tasks``
    is how many share the chunks (see ``chunks.windowed``).
    """
    if boundary not in ("reflect", "extrapolate", "clamp"):
        raise ValueError(f"unknown boundary {boundary!r}")
    if sigma <= 0:
        return df
    weights = np.array(kernel(sigma, multiple))
    return chunks.windowed(df, len(weights) // 2, values, chunks.weighted(weights, boundary), ("series_id", *keys), order, at, width, tasks=tasks)


def integrate(df: DataFrame, delta: Column, name: str = "total", width: int | None = None) -> DataFrame:
    """Running sum of ``delta``; a null delta counts as 0 and keeps its row."""
    rows = chunks.running(df.withColumn("_delta", delta.cast("double")), {name: lambda before, own: F.coalesce(own("_delta"), F.lit(0.0))}, width=width)
    return rows.drop("_delta")


def running_max(df: DataFrame, radius: int, value: str = "value", name: str = "high", width: int | None = None) -> DataFrame:
    """``name``, the largest ``value`` within ``radius`` rows, by block maxima: constant work a row. NaN and null are passed over."""
    return chunks.windowed(df.withColumn(name, F.col(value).cast("double")), radius, (name,), chunks.highest(radius), width=width)


def upper_envelope(df: DataFrame, sigma: float, value: str = "value", name: str = "envelope", width: int | None = None, order: tuple[str, ...] = ("t", "tie"), at: str = "t", tasks: int | None = None) -> DataFrame:
    """Dilated by a running maximum, smoothed, and never below the value itself. Both in one pass over chunks that borrow twice the kernel's radius."""
    weights = np.array(kernel(sigma))
    r = len(weights) // 2
    top, soft = chunks.highest(r), chunks.weighted(weights, "extrapolate")
    both = lambda v, i, n, starts: soft(top(v, i, n, starts), i, n, starts)
    return chunks.windowed(df.withColumn(name, F.col(value).cast("double")), 2 * r, (name,), both, order=order, at=at, width=width, tasks=tasks).withColumn(name, F.greatest(name, value))


def trapezoid(df: DataFrame, value: str = "value", name: str = "area", width: int | None = None) -> DataFrame:
    """Cumulative trapezoid in value-seconds."""
    part = lambda before, own: 0.5 * (own(value) + before(value)) * ((own("t") - before("t")) / SECOND)
    return chunks.running(df, {name: lambda before, own: F.coalesce(part(before, own), F.lit(0.0))}, ("t", value), width=width)


def best_window(df: DataFrame, span: int, value: str = "value", width: int | None = None) -> DataFrame:
    """Largest absolute net area within ``span`` (end exclusive) of any point; the first of equals. One row a series: net, from_t, to_t.

    Each point asks for the last one before its window's end, by its place in one sort of points and ends together: the work doesn't depend on how many points a window holds.
    """
    area = trapezoid(df, value, width=width)
    points = area.select("series_id", "t", F.lit(0).alias("kind"), "tie", F.struct("t", "area").alias("p"))
    ends = area.select("series_id", (F.col("t") + span - 1).alias("t"), F.lit(1).alias("kind"), "tie", F.lit(None).cast(points.schema["p"].dataType).alias("p"), F.struct("t", "area").alias("own"))
    both = points.withColumn("own", F.lit(None).cast(points.schema["p"].dataType)).unionByName(ends)
    order = [F.col("t"), F.col("kind"), F.col("tie")]
    rows = chunks.around(both, "p", order, [F.desc("t"), F.desc("kind"), F.desc("tie")], width=width).filter("kind = 1").withColumn("net", F.abs(F.col("_a.area") - F.col("own.area")))
    # the largest net, then the earliest start
    best = rows.groupBy("series_id").agg(F.max(F.struct("net", (-F.col("own.t")).alias("m"), F.col("_a.t").alias("to_t"))).alias("x"))
    return best.select("series_id", F.col("x.net").alias("net"), (-F.col("x.m")).alias("from_t"), F.col("x.to_t").alias("to_t")).filter("net > 0")


def unwrap(df: DataFrame, angle: str = "value", name: str = "unwrapped", width: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Shortest-arc phase unwrap: the corrections of raw steps, summed. A step of exactly pi is left alone."""

    def turns(before, own) -> Column:
        step = own(angle) - before(angle)
        return F.when(step > math.pi, -F.ceil((step - math.pi) / (2 * math.pi))).when(step < -math.pi, F.ceil((-step - math.pi) / (2 * math.pi))).otherwise(0)

    return chunks.running(df, {"_k": turns}, (angle,), ("series_id", *keys), width=width).withColumn(name, F.col(angle) + 2 * math.pi * F.col("_k")).drop("_k")


def rates(df: DataFrame, value: str, scale: float = 1.0, limit: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Forward difference per second at the midpoint; ``status`` says ``bad`` where a rate is NaN or beyond ``limit`` (the strict reading is an error)."""
    w = ordered(*keys)
    dt = (F.lead("t").over(w) - F.col("t")) / SECOND
    out = df.withColumn("_dt", dt).withColumn("rate", (F.lead(value).over(w) - F.col(value)) / F.when(F.col("_dt") > 0, F.col("_dt")) * scale).withColumn("mid", F.col("t") + F.floor((F.lead("t").over(w) - F.col("t")) / 2))
    bad = F.isnan("rate") | (F.abs("rate") > limit) if limit is not None else F.isnan("rate")
    return out.filter("_dt > 0").withColumn("status", F.when(bad, "bad").otherwise("ok")).drop("_dt")


def heading_rates(fixes: DataFrame, sigma: float = 2.0, step: int = GRID_STEP, max_gap: int = MAX_GRID_GAP) -> DataFrame:
    """series_id, run_id, t, rate (degrees a second), status: resample, split at gaps, project, smooth, central bearing of moves over half a metre, unwrap, differentiate.

    The grid may be many times the fixes: a job over their first and last times says how long it can get, and tasks are dealt by that."""
    known = fixes.filter(is_finite(F.col("lat")) & is_finite(F.col("lon")))
    spans = known.groupBy("series_id").agg((F.max("t") - F.min("t")).alias("_s"))
    tasks = chunks.tasks_of(known, spans.agg(F.sum(F.floor(F.col("_s") / step) + 1)).first()[0] or 0)
    # runs before the projection, as both windows then share one sort
    grid = project(grid_runs(resample(known.repartition(tasks, "series_id"), step, max_gap, ("lat", "lon")), step)).select("series_id", "run_id", "t", "tie", "east", "north")
    soft = smooth(grid, sigma, "reflect", ("east", "north"), ("run_id",), tasks=tasks).repartition(tasks, "series_id")
    w = ordered("run_id")
    de, dn = F.lead("east").over(w) - F.lag("east").over(w), F.lead("north").over(w) - F.lag("north").over(w)
    heads = soft.withColumn("_e", de).withColumn("_n", dn).filter(F.hypot("_e", "_n") >= MIN_DISPLACEMENT).withColumn("value", F.atan2("_e", "_n"))
    turned = unwrap(heads.select("series_id", "run_id", "t", "tie", "value"), keys=("run_id",))
    out = rates(turned, "unwrapped", 180 / math.pi, MAX_RATE, ("run_id",))
    return out.select("series_id", "run_id", F.col("mid").alias("t"), "rate", "status")


def centred(df: DataFrame, value: str, name: str = "velocity") -> DataFrame:
    """Mean of a value and the one before; at an end or beside a null, the one there is."""
    before = F.lag(value).over(ordered())
    return df.withColumn(name, F.coalesce((before + F.col(value)) / 2, before, F.col(value)))
