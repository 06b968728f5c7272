"""Motion trajectories: integration, corrections, zoom plans, rolling-shutter fits, meshes and orientations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import maths
from . import chunks, series, stats

#: Fixed values of the domain.
MAX_ZOOM_SEARCH, FIT_EPS = 3.0, 1e-6


def trajectory(motion: DataFrame, width: int | None = None) -> DataFrame:
    """Prefix sums of dx, dy, rotation and log scale over (series_id, frame); a failed row moves nothing, a scale <= 0 scales nothing. Frame 0 is the origin. ``width`` frames are a cell (see ``chunks``)."""

    def good(c: str):
        return lambda before, own: F.when(F.coalesce(own("ok"), F.lit(False)), F.coalesce(own(c), F.lit(0.0))).otherwise(0.0)

    rows = motion.withColumn("_log", F.when(F.col("scale") > 0, F.log("scale")).otherwise(0.0))
    steps = {"x": good("dx"), "y": good("dy"), "angle": good("rotation"), "log_scale": good("_log")}
    return chunks.running(rows, steps, order=("frame",), at="frame", width=width).drop("_log")


def corrections(path: DataFrame, sigma: float = 20.0, scale_weight: float = 0.0, max_translation: float = 0.0, max_rotation: float = 0.0, channels: tuple[str, ...] = ("x", "y", "angle", "log_scale"), tasks: int | None = None) -> DataFrame:
    """Smoothed path minus path: dx, dy, rotation, scale, clamped. A limit of 0 is none; translation shrinks in proportion, rotation keeps its sign. Of ``channels`` left out nothing is corrected.
    ``tasks``: see ``chunks.windowed``."""
    names = ("x", "y", "angle", "log_scale")
    softened = [c for c in names if c in channels]
    raw = path.select("series_id", "frame", *names, *[F.col(c).alias(f"s_{c}") for c in softened])
    s = series.smooth(raw, sigma, "extrapolate", tuple(f"s_{c}" for c in softened), order=("frame",), at="frame", tasks=tasks)
    s = s.withColumns({f"s_{c}": F.col(c) for c in names if c not in softened})
    d = {c: F.col(f"s_{c}") - F.col(c) for c in names}
    size = F.hypot(d["x"], d["y"])
    far = (size > max_translation) if max_translation > 0 else F.lit(False)
    turned = (F.abs(d["angle"]) > max_rotation) if max_rotation > 0 else F.lit(False)
    factor = F.when(far, max_translation / F.when(size > 0, size)).otherwise(1.0)
    rotation = F.when(turned, F.signum(d["angle"]) * max_rotation).otherwise(d["angle"])
    return s.select("series_id", "frame", *names, *[f"s_{c}" for c in names], (d["x"] * factor).alias("dx"), (d["y"] * factor).alias("dy"), rotation.alias("rotation"), F.exp(d["log_scale"] * scale_weight).alias("scale"), (far | turned).alias("clamped"))


def zoom(corr: DataFrame, width: int, height: int, scale_factor: float = 1.0) -> DataFrame:
    """``required``: least zoom in [1, 3] at which the corrected frame covers the canvas, in closed form (the largest of eight ratios)."""
    return corr.withColumn("required", maths.min_zoom(F.col("dx"), F.col("dy"), F.col("rotation"), F.col("scale"), width, height, scale_factor))


def global_zoom(corr: DataFrame, width: int, height: int, cap: float = 0.0) -> DataFrame:
    """The series' largest required zoom, capped; corrections that don't fit are weakened (``alpha`` < 1) until they do."""
    rows = zoom(corr, width, height)
    z = F.max("required").over(Window.partitionBy("series_id"))
    rows = rows.withColumn("required_zoom", z).withColumn("zoom", F.least(F.col("required_zoom"), F.lit(cap)) if cap > 0 else F.col("required_zoom"))
    return _weakened(rows, width, height)


def zoom_envelope(corr: DataFrame, width: int, height: int, sigma: float, cap: float = 0.0, tasks: int | None = None) -> DataFrame:
    """A zoom for each frame: the upper envelope of what is required, capped; never below the requirement unless capped. ``tasks``: see ``chunks.windowed``."""
    rows = series.upper_envelope(zoom(corr, width, height), sigma, "required", "zoom", order=("frame",), at="frame", tasks=tasks)
    if cap > 0:
        rows = rows.withColumn("zoom", F.least("zoom", F.lit(cap)))
    return _weakened(rows, width, height)


def _weakened(rows: DataFrame, width: int, height: int) -> DataFrame:
    alpha = maths.max_alpha(F.col("dx"), F.col("dy"), F.col("rotation"), F.col("scale"), F.col("zoom"), width, height)
    rows = rows.withColumn("alpha", F.when(F.col("required") <= F.col("zoom"), 1.0).otherwise(alpha))
    return rows.withColumns({"dx": F.col("dx") * F.col("alpha"), "dy": F.col("dy") * F.col("alpha"), "rotation": F.col("rotation") * F.col("alpha"), "scale": 1 + F.col("alpha") * (F.col("scale") - 1), "clamped": F.col("clamped") | (F.col("alpha") < 1)})


def readout_fit(measured: DataFrame, predictor: DataFrame, least: int = 30) -> DataFrame:
    """Rolling-shutter readout ratio of each series: what was observed (shear, stretch) at frame k against half the change of motion from frame k - 1 to k + 1 of ``predictor`` (another
    series of the same frames, or the same). One ratio is fitted through the origin for both axes.

    Frames whose residual (both axes together) is over 3 x 1.4826 x the upper median are left out once, unless fewer than ``least`` would stay. With fewer than ``least`` frames to begin with
    a series has no row. Neighbours are taken before rows that failed are left out, and the shorter of the two series bounds the frames. Columns: ratio, samples, ok, corr, and for each axis
    ratio_h, corr_h, ratio_v, corr_v; median_accel is the upper median of what drove the fit.
    """
    w = Window.partitionBy("series_id").orderBy("frame")
    good = lambda c: F.when(F.coalesce(F.col("ok"), F.lit(False)), F.col(c))
    change = lambda c: (F.lead(good(c)).over(w) - F.lag(good(c)).over(w)) / 2
    driven = predictor.select("series_id", "frame", change("dx").alias("px"), change("dy").alias("py"))
    inner = measured.withColumn("_last", F.max("frame").over(Window.partitionBy("series_id"))).filter("ok AND frame < _last AND shear IS NOT NULL AND stretch IS NOT NULL")
    both = inner.select("series_id", "frame", "shear", "stretch").join(driven, ["series_id", "frame"]).filter("px IS NOT NULL AND py IS NOT NULL")
    ratio = lambda num, den: F.coalesce(F.sum(num) / F.nullif(F.sum(den), F.lit(0.0)), F.lit(0.0))
    x, y, sh, st = F.col("px"), F.col("py"), F.col("shear"), F.col("stretch")
    pooled = ratio(sh * x + st * y, x * x + y * y)
    first = both.groupBy("series_id").agg(pooled.alias("_k"), F.count("*").alias("_n")).filter(F.col("_n") >= least)
    left = both.join(first, "series_id").withColumn("_r", F.hypot(sh - F.col("_k") * x, st - F.col("_k") * y))
    left = stats.with_statistics(left, ["series_id"], _m=("_r", stats.upper())).withColumn("_m", stats.MAD * F.col("_m")).withColumn("_in", (F.col("_m") <= 0) | (F.col("_r") <= 3 * F.col("_m")))
    enough = left.groupBy("series_id").agg((F.sum(F.col("_in").cast("int")) < least).alias("_all"))
    kept = left.join(enough, "series_id").filter("_all OR _in")

    def correlation(pairs: list[tuple[Column, Column]]) -> Column:
        """Pearson's r of all pairs in one; 0 where either side doesn't vary."""
        total = lambda f: sum((F.sum(f(p, o)) for p, o in pairs[1:]), F.sum(f(*pairs[0])))
        n, sp, so = F.count("*") * len(pairs), total(lambda p, o: p), total(lambda p, o: o)
        spp, soo, spo = total(lambda p, o: p * p), total(lambda p, o: o * o), total(lambda p, o: p * o)
        den = F.sqrt(F.greatest((n * spp - sp * sp) * (n * soo - so * so), F.lit(0.0)))
        return F.coalesce((n * spo - sp * so) / F.nullif(den, F.lit(0.0)), F.lit(0.0))

    drive = stats.order_statistics(kept, ["series_id"], {"median_accel": ("sqrt(px * px + py * py)", stats.upper())}).select("series_id", "median_accel")
    fitted = kept.groupBy("series_id").agg(
        pooled.alias("ratio"), F.count("*").alias("samples"), F.lit(True).alias("ok"), correlation([(x, sh), (y, st)]).alias("corr"), ratio(sh * x, x * x).alias("ratio_h"), correlation([(x, sh)]).alias("corr_h"),
        ratio(st * y, y * y).alias("ratio_v"), correlation([(y, st)]).alias("corr_v"),
    )
    return fitted.join(drive, "series_id")


def debias(motion: DataFrame, rho: float, height: int) -> DataFrame:
    """Takes out what the rolling shutter adds: rotation gains shear / 2h, scale loses stretch / 2h, from the neighbours' motion."""
    w = Window.partitionBy("series_id").orderBy("frame")
    shear = rho * (F.lead("dx").over(w) - F.lag("dx").over(w)) / 2
    stretch = rho * (F.lead("dy").over(w) - F.lag("dy").over(w)) / 2
    zero = F.lit(0.0)
    return motion.withColumn("rotation", F.col("rotation") + F.coalesce(shear, zero) / (2 * height)).withColumn("scale", F.col("scale") - F.coalesce(stretch, zero) / (2 * height))


def mesh_corrections(fields: DataFrame, sigma: float, gain: float = 1.0, denoise: float = 0.0) -> DataFrame:
    """What moves each vertex of each frame onto its smoothed path, times ``gain`` (0 or less: no rows).

    fields: (series_id, frame, r, c, vx, vy), the motion from frame to frame + 1; a null one is none. ``denoise`` is the sigma of a smoothing in time of that motion before it is summed up.
    Frame 0 is the origin, so there is a frame more than there are transitions.
    """
    if gain <= 0:
        return fields.select("series_id", "frame", "r", "c", F.col("vx").alias("dx"), F.col("vy").alias("dy")).limit(0)
    zero = F.lit(0.0)
    rows = fields.select("series_id", "r", "c", "frame", F.col("frame").alias("t"), F.col("frame").alias("tie"), F.coalesce("vx", zero).alias("vx"), F.coalesce("vy", zero).alias("vy"))
    steps = series.smooth(rows, denoise, "extrapolate", ("vx", "vy"), ("r", "c")).select("series_id", "r", "c", (F.col("frame") + 1).alias("frame"), "vx", "vy")
    origin = fields.groupBy("series_id", "r", "c").agg(F.min("frame").alias("frame")).select("series_id", "r", "c", "frame", zero.alias("vx"), zero.alias("vy"))
    w = Window.partitionBy("series_id", "r", "c").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    path = origin.unionByName(steps).withColumn("px", F.sum("vx").over(w)).withColumn("py", F.sum("vy").over(w))
    rows = path.select("series_id", "r", "c", "frame", F.col("frame").alias("t"), F.col("frame").alias("tie"), "px", "py", F.col("px").alias("sx"), F.col("py").alias("sy"))
    s = series.smooth(rows, sigma, "extrapolate", ("sx", "sy"), ("r", "c"))
    return s.select("series_id", "frame", "r", "c", ((F.col("sx") - F.col("px")) * gain).alias("dx"), ((F.col("sy") - F.col("py")) * gain).alias("dy"))


def spatial_median(fields: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Averaged median over the 3x3 neighbourhood on the grid, clipped at its edges; each vertex is sent to its nine neighbours."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = fields.select("series_id", "frame", "r", "c", *values, F.inline(near)).select("series_id", "frame", (F.col("r") + F.col("i")).alias("r"), (F.col("c") + F.col("j")).alias("c"), (F.col("i") == 0).alias("_a"), (F.col("j") == 0).alias("_b"), *values)
    out = spread.groupBy("series_id", "frame", "r", "c").agg(F.max(F.col("_a") & F.col("_b")).alias("_own"), *[F.percentile(v, F.lit(0.5)).alias(v) for v in values])
    return out.filter("_own").drop("_own")


def residual_motion(features: DataFrame, fits: DataFrame) -> DataFrame:
    """``features`` (series_id, frame, x, y, to_x, to_y) with mx, my: what a point moved beyond the frame's similarity (series_id, frame, dx, dy, rotation, scale)."""
    a, b = F.col("scale") * F.cos("rotation"), F.col("scale") * F.sin("rotation")
    x, y = F.col("x"), F.col("y")
    both = features.join(fits.select("series_id", "frame", "dx", "dy", "rotation", "scale"), ["series_id", "frame"])
    return both.select(*features.columns, (F.col("to_x") - (a * x - b * y + F.col("dx"))).alias("mx"), (F.col("to_y") - (b * x + a * y + F.col("dy"))).alias("my"))


def mesh_field(features: DataFrame, width: float, height: float, cols: int, rows: int, tasks: int | None = None) -> DataFrame:
    """(series_id, frame, r, c, vx, vy) of every vertex of a frame with features (x, y and their residual motion mx, my): the averaged median of those within a cell diagonal, 0 without any,
    then the averaged median of the 3x3 neighbourhood. Features meet vertices through the grid cell they are in. Only the features are shuffled, once, to ``tasks`` tasks by frame (None: as many
    as the session has); a frame's vertices are one row until they are told apart at the end."""
    cw, ch = width / (cols - 1), height / (rows - 1)
    reach = float(np.hypot(cw, ch))
    span = lambda v, cell, n: F.sequence(F.greatest(F.lit(0), F.ceil((v - reach) / cell).cast("int")), F.least(F.lit(n - 1), F.floor((v + reach) / cell).cast("int")))
    by = ["series_id", "frame"]
    # a frame is in one task from here on, so nothing below is shuffled
    f = features.filter("series_id IS NOT NULL AND frame IS NOT NULL").repartition(*([tasks] if tasks else []), *by)
    f = f.select(*by, "x", "y", "mx", "my", F.posexplode_outer(span(F.col("y"), ch, rows)).alias("_i", "r"))
    f = f.select(*by, "x", "y", "mx", "my", "_i", "r", F.posexplode_outer(span(F.col("x"), cw, cols)).alias("_j", "c"))
    near = F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1) & (F.hypot(F.col("x") - F.col("c") * cw, F.col("y") - F.col("r") * ch) <= reach)
    f = f.withColumn("_v", F.when(near, F.col("r") * cols + F.col("c")))
    f = f.filter("_v IS NOT NULL OR coalesce(_i, 0) + coalesce(_j, 0) = 0")  # a frame with no feature near a vertex keeps a row
    value = lambda c: stats.median_average(F.when(F.col("_v").isNotNull(), F.col(c)))
    found = f.groupBy(*by, "_v").agg(value("mx").alias("vx"), value("my").alias("vy")).filter("_v IS NULL OR vx IS NOT NULL OR vy IS NOT NULL")
    frames = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_v", F.struct("vx", "vy"))))).alias("_m"))
    grid = lambda c: F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda v: F.coalesce(F.col("_m")[v][c], F.lit(0.0)))
    frames = frames.select(*by, grid("vx").alias("_x"), grid("vy").alias("_y"))

    def middle(values: str, r: int, c: int) -> Column:
        around = [F.col(values)[i * cols + j] for i in range(max(0, r - 1), min(rows, r + 2)) for j in range(max(0, c - 1), min(cols, c + 2))]
        s, n = F.sort_array(F.array(*around)), len(around)
        return (s[(n - 1) // 2] + s[n // 2]) / 2

    vertices = [F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), middle("_x", r, c).alias("vx"), middle("_y", r, c).alias("vy")) for r in range(rows) for c in range(cols)]
    return frames.select(*by, F.inline(F.array(*vertices)))


def _turned(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    q = maths.q_mul(new, old)
    return q / np.linalg.norm(q, axis=-1, keepdims=True)


def orientations(motion: DataFrame, width: int = chunks.FRAMES) -> DataFrame:
    """The orientation (series_id, frame, w, x, y, z) of every frame: the first is the identity, and each transition (frame k to k + 1) is composed onto the one before, new times old.

    A transition that failed (``ok``, where there is that column) or has no quaternion turns nothing. Order matters: transitions are multiplied out by cells of ``width`` frames, then over cells.
    """
    names = ["w", "x", "y", "z"]
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in "xyz"), F.col("w") * F.col("w")))
    ok = F.coalesce(F.col("ok"), F.lit(False)) if "ok" in motion.columns else F.lit(True)
    rows = motion.withColumn("v", F.when(ok & (norm > 0) & ~F.isnan(norm), F.array(*[F.col(c).cast("double") / norm for c in names])))
    out = chunks.folded(rows, _turned, np.array([1.0, 0, 0, 0]), width)
    return out.select("series_id", "frame", *[F.col("v")[k].alias(c) for k, c in enumerate(names)])


def _mean_orientations(q: np.ndarray, i: np.ndarray, n: np.ndarray, k: np.ndarray, iterations: int, block: int = 4096) -> np.ndarray:
    """For each row of chunks (positions ``i`` of ``n``) the weighted mean of its neighbours on the rotation group. Where the window hangs off an end of the series, the neighbours' rotation
    vectors go on along the line fitted to those at that end: a line is linear in them, so it is other weights, the same for all rows that hang off by as much."""
    r, mean = len(k) // 2, q.copy()
    before, after = np.maximum(0, r - i), np.maximum(0, i + r - n + 1)
    code = before * (r + 1) + after
    for c in np.unique(code):
        b, a = divmod(int(c), r + 1)
        at = np.arange(b - r, r - a + 1)
        weights = k @ maths.extended(np.eye(len(at)), b, a, r) if b or a else k
        same = np.flatnonzero(code == c)
        for start in range(0, len(same), block):
            rows = same[start : start + block]
            near = q[np.clip(rows[:, None] + at, 0, len(q) - 1)]  # only borrowed rows reach beyond their chunk
            m = q[rows]
            for _ in range(iterations):
                step = (maths.q_log(maths.q_mul(near, maths.q_conj(m)[:, None])) * weights[None, :, None]).sum(1)
                m = maths.q_mul(maths.q_exp(step), m)
                m = m / np.linalg.norm(m, axis=1, keepdims=True)
            mean[rows] = m
    return mean


def smooth_orientations(path: DataFrame, sigma: float, iterations: int = 2, size: int = chunks.CHUNK, width: int | None = None) -> DataFrame:
    """Gaussian mean on the rotation group: at each frame the neighbours' rotation vectors relative to it are averaged and applied, twice over. Ends go on along a line (a steady turn).

    Chunks of ``size`` frames borrow the kernel's radius from their neighbours, so a series spreads over tasks, and a task averages many chunks at once."""
    k = np.array(series.kernel(sigma))
    run = lambda v, i, n, starts: _mean_orientations(v, i, n, k, iterations)
    return chunks.windowed(path.select("series_id", "frame", "w", "x", "y", "z"), len(k) // 2, ("w", "x", "y", "z"), run, order=("frame",), at="frame", width=width, size=size)


def _chained(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    m = new @ old
    corner = m[..., 2:, 2:]
    return np.where(corner == 0, m, m / np.where(corner == 0, 1, corner))


def perspective_paths(motion: DataFrame, sigma: float, strength: float = 1.0, width: int = chunks.FRAMES) -> DataFrame:
    """The correction (series_id, frame, h) of every frame, from the residual 3x3 matrices h (array of 9, row by row) of the transitions.

    Matrices are chained in frame order from the identity (a null one changes nothing), the eight free entries are smoothed as any channel (ends go on along a line), and what carries the
    actual onto the smoothed one (a singular one's inverse is the identity) is blended with the identity: ``strength`` 1 is all of it, 0 or less gives no rows. Chains are multiplied out by cells
    of ``width`` frames, then over cells.
    """
    if strength <= 0:
        return motion.select("series_id", "frame", "h").limit(0)
    part = min(strength, 1.0)
    path = chunks.folded(motion.select("series_id", "frame", F.col("h").cast("array<double>").alias("v")), _chained, np.eye(3), width)
    free = [f"s{k}" for k in range(8)]
    rows = path.select("series_id", "frame", F.col("frame").alias("t"), F.col("frame").alias("tie"), "v", *[F.col("v")[k].alias(c) for k, c in enumerate(free)])
    soft = series.smooth(rows, sigma, "extrapolate", tuple(free))
    keys = ", ".join(f"`{n}` {t}" for n, t in soft.select("series_id", "frame").dtypes)

    def fixed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            wanted = np.concatenate([f[free].to_numpy(float), np.ones((len(f), 1))], 1).reshape(-1, 3, 3)
            fix = _chained(wanted, maths.inverse3(np.array(f["v"].tolist(), float).reshape(-1, 3, 3)))
            fix = np.eye(3) + part * (fix - np.eye(3))
            yield f[["series_id", "frame"]].assign(h=list(_chained(fix, np.eye(3)).reshape(-1, 9)))

    return soft.select("series_id", "frame", "v", *free).mapInPandas(fixed, f"{keys}, h array<double>")


#: Focal lengths to try, as shares of the width, shortest first; the last stands for a flat lens.
FOCAL_RATIOS = (0.20, 0.24, 0.28, 0.32, 0.36, 0.40, 0.44, 0.48, 0.52, 0.56, 0.62, 0.70, 0.80, 0.95, 1.15, 1.55, 2.10, 3.00)


def lens_sweep(pairs: DataFrame, focals: list[float] | None = None, kinds: tuple[str, ...] = ("rectilinear", "equidistant", "equisolid", "stereographic"), width: int = 960, height: int = 540) -> DataFrame:
    """(ord, kind, focal, flat, err) of each candidate lens: the upper median over pairs of the upper median distance, in pixels, between where the best rotation takes a point and where
    it went. ``flat`` marks the longest focal length of a kind.

    pairs: (pair_id, fx, fy, tx, ty). A pair's points are fitted in one task; candidates are a fixed list (``FOCAL_RATIOS`` of the width unless ``focals`` are given).
    """
    focals = focals or [ratio * width for ratio in FOCAL_RATIOS]
    candidates = [(i, k, float(f), n == len(focals) - 1) for i, (k, n, f) in enumerate((k, n, f) for k in kinds for n, f in enumerate(focals))]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        at = [frame[c].to_numpy(float) - (width if c[1] == "x" else height) / 2 for c in ("fx", "fy", "tx", "ty")]
        for i, kind, focal, flat in candidates:
            a, b = maths.rays(at[0], at[1], kind, focal), maths.rays(at[2], at[3], kind, focal)
            x, y, ahead = maths.pixels(a @ maths.fit_rotation(a, b).T, kind, focal)
            off = np.sort(np.hypot(x - at[2], y - at[3])[ahead])
            if len(off):
                out.append((frame["pair_id"].iloc[0], i, kind, focal, flat, float(off[len(off) // 2])))
        return pd.DataFrame(out, columns=["pair_id", "ord", "kind", "focal", "flat", "err"])

    each = pairs.groupBy("pair_id").applyInPandas(fit, f"pair_id {pairs.schema['pair_id'].dataType.simpleString()}, ord int, kind string, focal double, flat boolean, err double")
    return stats.order_statistics(each, ["ord", "kind", "focal", "flat"], {"err": ("err", stats.upper())}).drop("n_err")


def similarity_errors(pairs: DataFrame) -> DataFrame:
    """(pair_id, err): the upper median distance in pixels of a pair's points from their least-squares similarity, by sums alone."""
    n, s = F.count("*"), lambda e: F.sum(e)
    x, y, u, v = (F.col(c).cast("double") for c in ("fx", "fy", "tx", "ty"))
    sums = pairs.groupBy("pair_id").agg(n.alias("n"), s(x).alias("x"), s(y).alias("y"), s(u).alias("u"), s(v).alias("v"), s(x * x + y * y).alias("q"), s(x * u + y * v).alias("c"), s(x * v - y * u).alias("d"))
    g = lambda a: F.col(a)
    den = g("q") - (g("x") * g("x") + g("y") * g("y")) / g("n")
    a = (g("c") - (g("x") * g("u") + g("y") * g("v")) / g("n")) / F.nullif(den, F.lit(0.0))
    b = (g("d") - (g("x") * g("v") - g("y") * g("u")) / g("n")) / F.nullif(den, F.lit(0.0))
    fit = sums.select("pair_id", a.alias("_a"), b.alias("_b"), ((g("u") - a * g("x") + b * g("y")) / g("n")).alias("_tx"), ((g("v") - b * g("x") - a * g("y")) / g("n")).alias("_ty"))
    off = pairs.join(fit, "pair_id").withColumn("_e", F.hypot(F.col("_a") * x - F.col("_b") * y + F.col("_tx") - u, F.col("_b") * x + F.col("_a") * y + F.col("_ty") - v))
    return off.filter("_e IS NOT NULL").groupBy("pair_id").agg(stats.median_upper("_e").alias("err"))


def best_lens(swept: DataFrame) -> DataFrame:
    """kind, focal, err of the least error (the first of equals), and flat_err, that of the longest focal length of its kind."""
    best = swept.agg(F.min_by(F.struct("kind", "focal", "err"), F.struct("err", "ord")).alias("b")).select("b.*")
    flat = swept.filter("flat").select("kind", F.col("err").alias("flat_err"))
    return best.join(F.broadcast(flat), "kind", "left")  # a row a kind


def calibrated_lens(pairs: DataFrame, **sweep) -> DataFrame:
    """One row: the best lens with its error, the flat one's, the similarity's (upper median over pairs) and the number of pairs."""
    base = stats.order_statistics(similarity_errors(pairs).withColumn("_all", F.lit(0)), ["_all"], {"similarity_err": ("err", stats.upper())}).select("similarity_err")
    count = pairs.agg(F.countDistinct("pair_id").alias("pairs"))
    return best_lens(lens_sweep(pairs, **sweep)).crossJoin(F.broadcast(base)).crossJoin(F.broadcast(count))  # one row each


def render_path(rotations: Column, perspective: Column, mesh: Column) -> Column:
    """Which correction owns a render: rotation before homography before mesh before similarity."""
    return F.when(rotations, "rotation").when(perspective, "homography").when(mesh, "mesh").otherwise("similarity")


def _between(motion: DataFrame, values: dict[str, Column]) -> DataFrame:
    """For each frame (one more than there are transitions) the mean of the values of the transitions before and after it, or the one that is there; null without either."""
    moved = motion.select("series_id", "frame", *[v.cast("double").alias(n) for n, v in values.items()])
    ends = motion.groupBy("series_id").agg((F.max("frame") + 1).alias("frame"))
    rows = moved.unionByName(ends, allowMissingColumns=True)
    w = Window.partitionBy("series_id").orderBy("frame")
    return rows.select("series_id", "frame", *[F.coalesce((F.lag(n).over(w) + F.col(n)) / 2, F.lag(n).over(w), F.col(n)).alias(n) for n in values])


def rectifiers(motion: DataFrame, rho: float, height: int) -> DataFrame:
    """kx, ky of each frame, from the mean motion of the transitions beside it; null without either."""
    rows = _between(motion, {c: F.when(F.col("ok"), F.col(c)) for c in ("dx", "dy")})
    kx, ky = maths.rectifier(F.col("dx"), F.col("dy"), rho, height)
    return rows.select("series_id", "frame", kx.alias("kx"), ky.alias("ky"))


def rotation_rectifiers(motion: DataFrame, rho: float) -> DataFrame:
    """rx, ry, rz of each frame: ``rho`` times the mean rotation vector of the transitions (series_id, frame, ok, w, x, y, z) beside it; 0 without either, no rows for a ratio of 0."""
    log = maths.quaternion_log(F.struct("w", "x", "y", "z"))
    usable = F.coalesce(F.col("ok"), F.lit(False)) & F.col("w").isNotNull()
    rows = _between(motion, {n: F.when(usable, c) for n, c in zip(("rx", "ry", "rz"), (log["x"], log["y"], log["z"]), strict=True)})
    out = rows.select("series_id", "frame", *[F.coalesce(F.col(n) * rho, F.lit(0.0)).alias(n) for n in ("rx", "ry", "rz")])
    return out if rho else out.limit(0)


def worst_margin(rects: DataFrame, width: int, height: int) -> DataFrame:
    return rects.groupBy("series_id").agg(F.coalesce(F.max(maths.rectifier_margin(F.col("kx"), F.col("ky"), width, height)), F.lit(0.0)).alias("margin"))


def margin_percentiles(rects: DataFrame, width: int, height: int) -> DataFrame:
    """What rectifying costs in crop: median, p90, p99 and worst margin over the frames of each series."""
    rows = rects.select("series_id", F.coalesce(maths.rectifier_margin(F.col("kx"), F.col("ky"), width, height), F.lit(0.0)).alias("margin"))
    picks = {"median": ("margin", stats.upper()), "p90": ("margin", stats.index(90)), "p99": ("margin", stats.index(99))}
    return stats.order_statistics(rows, ["series_id"], picks).select("series_id", *picks).join(rows.groupBy("series_id").agg(F.max("margin").alias("worst")), "series_id")


def mesh_border_margin(corr: DataFrame, cols: int, rows: int, width: int, height: int, scale_factor: float = 1.0, safety: float = 2.0) -> DataFrame:
    """Crop that hides what border vertices pull inward: twice the larger of the two directions, with a safety factor."""
    inward = lambda edge, v: F.coalesce(F.max(F.when(edge, F.greatest(v, F.lit(0.0)))), F.lit(0.0))
    r, c = F.col("r"), F.col("c")
    x = F.greatest(inward(c == 0, F.col("dx")), inward(c == cols - 1, -F.col("dx")))
    y = F.greatest(inward(r == 0, F.col("dy")), inward(r == rows - 1, -F.col("dy")))
    return corr.groupBy("series_id").agg((2 * F.greatest(safety * x * scale_factor / width, safety * y * scale_factor / height)).alias("margin"))


def motion_summary(motion: DataFrame) -> DataFrame:
    """Transitions, failures, mean and range of tracked points and inliers of each series."""
    return motion.groupBy("series_id").agg(
        F.count("*").alias("n"), F.count(F.when(~F.col("ok"), 1)).alias("failed"), F.avg("tracked").alias("mean_tracked"), F.avg("inliers").alias("mean_inliers"), F.min("inliers").alias("min_inliers"), F.max("inliers").alias("max_inliers")
    )


def every_nth(frames: DataFrame, step: int) -> DataFrame:
    return frames.filter(F.col("frame") % step == 0)


def implied_crop(stats_: DataFrame, width: int, height: int) -> DataFrame:
    """Crop that the largest translation asks for along either side."""
    return stats_.withColumn("crop", F.greatest(F.col("max_translation") / width, F.col("max_translation") / height))


def rotation_corrections(path: DataFrame, sigma: float, reliable: bool = True) -> DataFrame:
    """What turns each orientation into the smoothed one: smoothed times conj(orientation). Without smoothing (sigma 0 or less) or a reliable lens there is nothing to correct: no rows."""
    if sigma <= 0 or not reliable:
        return path.select("series_id", "frame", "w", "x", "y", "z").limit(0)
    soft = smooth_orientations(path, sigma).select("series_id", "frame", F.struct("w", "x", "y", "z").alias("s"))
    q = F.struct("w", (-F.col("x")).alias("x"), (-F.col("y")).alias("y"), (-F.col("z")).alias("z"))
    return path.join(soft, ["series_id", "frame"]).select("series_id", "frame", maths.quaternion_product(F.col("s"), q).alias("q")).select("series_id", "frame", "q.*")


def rotation_zoom_plan(corr: DataFrame, kind: str, focal: float, width: int, height: int, sigma: float, cap: float = 0.0) -> DataFrame:
    """A zoom for each rotation correction (series_id, frame, w, x, y, z): required, its upper envelope, capped; rotations that don't fit under the cap are weakened."""

    def need(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(required=maths.rotation_zoom(f[["w", "x", "y", "z"]].to_numpy(float), kind, focal, width, height))

    def weaken(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            q, alpha = maths.weakened_rotation(f[["w", "x", "y", "z"]].to_numpy(float), f["zoom"].to_numpy(float) + 1e-9, kind, focal, width, height)
            yield f.assign(**dict(zip("wxyz", q.T, strict=True)), alpha=alpha)

    base = corr.select("series_id", "frame", "w", "x", "y", "z")
    names = ", ".join(f"{n} {t}" for n, t in base.dtypes)
    rows = base.mapInPandas(need, f"{names}, required double").withColumn("t", F.col("frame")).withColumn("tie", F.col("frame"))
    rows = series.upper_envelope(rows, sigma, "required", "zoom").select(*base.columns, "required", "zoom")
    if cap > 0:
        rows = rows.withColumn("zoom", F.least("zoom", F.lit(cap)))
    return rows.mapInPandas(weaken, f"{names}, required double, zoom double, alpha double")
