"""Analytic and brute-force checks of the library's own operators."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import maths, text
from wayfold.operators import activity, alignment, batch, governance, series, stats, trajectory
from wayfold.plans import effects
from wayfold.sources import boxes, probe, sidecar, sinks
from wayfold.streaming import sessions

S = series.SECOND


def frame(spark, rows, schema="series_id string, t long, tie long, value double"):
    return spark.createDataFrame(rows, schema)


def points(spark, values, step=S):
    return frame(spark, [("a", i * step, i, float(v)) for i, v in enumerate(values)])


def column(df, name="value"):
    return [r[name] for r in df.orderBy("t", "tie").collect()]


# --- series ---------------------------------------------------------------------------

def test_lookup_interpolates_refuses_gaps_and_never_extrapolates(spark):
    data = frame(spark, [("a", 0, 0, 0.0), ("a", 2 * S, 1, 4.0), ("a", 5 * S, 2, 10.0), ("a", 9 * S, 3, 0.0)])
    asks = spark.createDataFrame([("a", int(x * S), x) for x in (-1.0, 0.0, 1.0, 2.0, 3.5, 5.0, 7.0, 9.0, 9.5)] + [("b", 0, 0.0)], "series_id string, t long, probe double")
    got = {(r["series_id"], r["probe"]): r["value"] for r in series.at(asks, data).collect()}
    assert got["a", 1.0] == 2.0 and got["a", 3.5] == 7.0 and got["a", 2.0] == 4.0  # a gap of exactly three seconds is allowed
    assert all(got[k] is None for k in (("a", -1.0), ("a", 7.0), ("a", 9.5), ("b", 0.0)))


def test_covered_index(spark):
    data = points(spark, [1, 2, 3])
    asks = spark.createDataFrame([("a", x, x) for x in (-1, 0, S, 10 * S)], "series_id string, t long, probe long")
    assert {r["probe"]: r["idx"] for r in series.covered_index(asks, data).collect()} == {-1: -1, 0: 0, S: 1, 10 * S: 2}


@pytest.mark.parametrize("boundary", ["reflect", "clamp", "extrapolate"])
@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_smoothing_matches_its_definition(spark, boundary, n):
    r = random.Random(n)
    v = [r.uniform(-5, 5) for _ in range(n)]
    k = series.kernel(2.0)
    radius = len(k) // 2

    def beyond(i):
        if 0 <= i < n:
            return v[i]
        if boundary == "clamp" or n == 1:
            return v[max(0, min(n - 1, i))]
        if boundary == "reflect":
            while not 0 <= i < n:
                i = -i if i < 0 else 2 * n - 2 - i
            return v[i]
        w = min(radius, n)
        base = 0 if i < 0 else n - w
        if w == 1:
            return v[base]
        slope, cut = np.polyfit(range(w), v[base : base + w], 1)
        return cut + slope * (i - base)

    exp = [sum(w * beyond(i + j - radius) for j, w in enumerate(k)) for i in range(n)]
    assert np.allclose(column(series.smooth(points(spark, v), 2.0, boundary)), exp)


def test_a_line_survives_extrapolated_smoothing(spark):
    v = [3 * i + 1.0 for i in range(30)]
    assert np.allclose(column(series.smooth(points(spark, v), 4.0, "extrapolate")), v)
    assert not np.allclose(column(series.smooth(points(spark, v), 4.0, "reflect")), v)


def test_unwrap_equals_the_sequential_loop(spark):
    r = random.Random(3)
    a = [r.uniform(-math.pi, math.pi) for _ in range(200)]
    exp = list(a)
    for i in range(1, 200):
        while exp[i] - exp[i - 1] > math.pi:
            exp[i] -= 2 * math.pi
        while exp[i] - exp[i - 1] < -math.pi:
            exp[i] += 2 * math.pi
    assert np.allclose(column(series.unwrap(points(spark, a)), "unwrapped"), exp)


def test_heading_rate_of_a_circle(spark):
    rows = [("a", i * S, i, -33 + 50 * math.sin(0.08 * i) / 111132, 151 + 50 * math.cos(0.08 * i) / (111320 * math.cos(math.radians(-33)))) for i in range(90)]
    got = series.heading_rates(spark.createDataFrame(rows, "series_id string, t long, tie long, lat double, lon double")).collect()
    inner = [r["rate"] for r in got if 15 * S < r["t"] < 75 * S]
    assert len(inner) > 50 and np.allclose(inner, -math.degrees(0.08), atol=0.05) and {r["status"] for r in got} == {"ok"}


def test_envelope_is_never_below(spark):
    r = random.Random(5)
    out = series.upper_envelope(points(spark, [r.random() for _ in range(80)]), 3.0).collect()
    assert all(r["envelope"] >= r["value"] for r in out)


def test_best_window_ends_before_its_width(spark):
    v = [0.0] * 20 + [10.0] * 10 + [0.0] * 20
    r = series.best_window(points(spark, v), 6 * S).first()
    assert r["net"] == 50.0 and r["to_t"] - r["from_t"] == 5 * S and r["from_t"] == 20 * S


# --- statistics -------------------------------------------------------------------------

def test_two_medians_differ(spark):
    df = spark.createDataFrame([(g, float(v)) for g, vs in (("even", [4, 1, 3, 2]), ("odd", [5, 1, 3])) for v in vs], "series_id string, v double")
    got = {r["series_id"]: (r["u"], r["a"]) for r in df.groupBy("series_id").agg(stats.median_upper("v").alias("u"), stats.median_average(F.col("v")).alias("a")).collect()}
    assert got == {"even": (3.0, 2.5), "odd": (3.0, 3.0)}
    r = np.random.default_rng(5)
    sizes = [1, 2, 3, 10, 11, 99, 100, 101, 250]
    rows = {n: r.integers(0, 60, n).tolist() for n in sizes}
    got = spark.createDataFrame([(n, float(v)) for n, vs in rows.items() for v in vs], "n int, v double").groupBy("n").agg(stats.median_upper("v").alias("u"), stats.percentile_index("v", 90).alias("p"), stats.percentile_index("v", 100).alias("q"))
    for x in got.collect():
        v, n = sorted(rows[x["n"]]), x["n"]
        assert (x["u"], x["p"], x["q"]) == (v[n // 2], v[min(n - 1, n * 90 // 100)], v[-1])


def test_trimmed_fit_recovers_a_slope(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=400)
    y = 0.3 * x + r.normal(scale=0.01, size=400)
    y[:40] += 50
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)], "k int, x double, y double")
    got = stats.trimmed_origin_fit(df, ["k"]).first()
    assert abs(got["slope"] - 0.3) < 0.01 and got["ok"] and got["n"] <= 370


def test_plane_and_singular(spark):
    r = np.random.default_rng(2)
    rows = [(1, a, b, 2 + 3 * a - b) for a, b in r.normal(size=(50, 2)).tolist()] + [(2, 1.0, 1.0, 1.0)] * 30
    got = {x["k"]: x for x in stats.plane(spark.createDataFrame(rows, "k int, x double, y double, d double"), ["k"]).collect()}
    assert np.allclose([got[1]["a"], got[1]["b"], got[1]["c"]], [2, 3, -1]) and got[2]["a"] is None
    assert stats.robust_plane(spark.createDataFrame(rows, "k int, x double, y double, d double"), ["k"]).filter("k = 1").count() == 1


def test_ratio_of_zeros(spark):
    r = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 2.0)], "a double, b double").select(stats.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [x["r"] for x in r] == [1.0, math.inf, 0.5]


# --- alignment ----------------------------------------------------------------------------

def bump(centre, amplitude=20.0, seconds=120, step=0.1):
    return [("s", int(round(i * step * S)), i, amplitude * math.exp(-((i * step - centre) ** 2) / (2 * 9))) for i in range(int(seconds / step) + 1)]


def test_a_known_lag_is_found(spark):
    camera = frame(spark, bump(60))
    track = frame(spark, [(s, t, i, v) for s, t, i, v in bump(67.35, step=0.5, seconds=240)])
    got = alignment.estimate(camera, track, window=15.0, step=0.25, rate=2.0).first()
    assert abs(got["tau"] - 7.35) <= 0.3 and got["verdict"] == "confident" and got["edge"] == "" and got["null_share"] is None
    late = frame(spark, [(s, t + 3600 * S, i, v) for s, t, i, v in bump(60)])
    assert alignment.estimate(camera, late, window=15.0, step=0.25, rate=2.0).first()["reason"] == "the track doesn't reach the clip"
    part = frame(spark, [(s, t, i, v) for s, t, i, v in bump(60) if t < 30 * S])
    assert alignment.estimate(camera, part, window=15.0, step=0.25, rate=2.0).first()["reason"] == "the track covers too little of the clip"
    assert alignment.sample_set(camera, 2.0, 60.0, 20.0).agg(F.min("t"), F.max("t"), F.count("*")).first() == (50 * S, 70 * S, 41)


def test_verdicts(spark):
    def verdict(*rows):
        r = alignment.classify(spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rows)], "place int, tau double, score double, energy double, turn double, window double")).first()
        return r["verdict"], r["reason"], r["tau"]

    assert verdict((1, 0.9, 10, 90, 12))[0] == "confident"
    assert verdict((9, 0.9, 10, 90, 12), (2, 0.85, 10, 90, 12)) == ("weak", "", 2.0)
    assert verdict((1, 0.9, 4, 90, 12))[:2] == ("declined", "matched energy under its gate")
    assert verdict((1, 0.9, 10, 50, 12))[:2] == ("declined", "the track turns too little there")
    assert verdict((1, 0.9, 10, 90, 0))[:2] == ("declined", "no track where the turn is matched")


def test_peaks_with_nan_neighbours_and_spacing(spark):
    c = spark.createDataFrame([(i * 1.0, s) for i, s in enumerate([0.1, 0.5, math.nan, 0.2, 0.9, 0.3, 0.8, 0.1])], "tau double, score double")
    peaks = alignment.local_maxima(c, 1.0)
    assert sorted(r["tau"] for r in peaks.collect()) == [1.0, 4.0, 6.0]
    assert [r["tau"] for r in alignment.spaced(peaks, 2.5).orderBy("place").collect()] == [4.0, 1.0]
    assert {r["tau"]: r["fwhm"] for r in alignment.half_width(c.filter("not isnan(score)"), peaks.filter("tau = 4"), 1.0).collect()} == {4.0: 2.0}


# --- trajectories ----------------------------------------------------------------------------

def test_min_zoom_closed_forms(spark):
    rows = [(0.0, 0.0, 0.0, 1.0), (48.0, 0.0, 0.0, 1.0), (0.0, 27.0, 0.0, 1.0), (0.0, 0.0, 0.0, 0.5), (2000.0, 0.0, 0.0, 1.0), (30.0, -10.0, 0.05, 1.02)]
    df = spark.createDataFrame(rows, "dx double, dy double, rotation double, scale double")
    c = [F.col(x) for x in df.columns]
    got = df.withColumn("z", maths.min_zoom(*c, 960, 540)).withColumn("ok", maths.fits(*c, F.col("z") + 1e-9, 960, 540)).withColumn("no", maths.fits(*c, F.col("z") - 1e-4, 960, 540)).collect()
    assert np.allclose([r["z"] for r in got[:5]], [1, 1.1, 1.1, 2, 3], atol=1e-5)
    assert got[5]["ok"] and not got[5]["no"] and not got[1]["no"]


def test_weakened_corrections_fit(spark):
    df = spark.createDataFrame([("a", i, float(10 * i), 5.0, 0.02 * i, 1.0, False) for i in range(20)], "series_id string, frame long, dx double, dy double, rotation double, scale double, clamped boolean")
    out = trajectory.global_zoom(df, 960, 540, 1.1)
    c = [F.col(x) for x in ("dx", "dy", "rotation", "scale")]
    got = out.withColumn("fit", maths.fits(*c, F.col("zoom") + 1e-9, 960, 540)).collect()
    assert all(r["fit"] for r in got) and all(r["zoom"] == 1.1 for r in got) and any(r["alpha"] < 1 for r in got) and any(r["alpha"] == 1 for r in got)


def test_failed_rows_move_nothing(spark):
    df = spark.createDataFrame([("a", i, 1.0, 0.0, 0.0, 0.0 if i == 3 else 2.0, i != 2) for i in range(5)], "series_id string, frame long, dx double, dy double, rotation double, scale double, ok boolean")
    got = trajectory.trajectory(df).orderBy("frame").collect()
    assert [r["x"] for r in got] == [1, 2, 2, 3, 4] and abs(got[-1]["log_scale"] - 3 * math.log(2)) < 1e-12


def test_readout_ratio_is_recovered(spark):
    """Observed is 0.4 of half the change of motion around a frame; failed and wild frames are left out, and short series have no row."""
    i = np.arange(300)
    dx, dy = 6 * np.sin(i / 5), 14 * np.cos(i / 7)
    px, py = np.zeros(300), np.zeros(300)
    px[1:-1], py[1:-1] = (dx[2:] - dx[:-2]) / 2, (dy[2:] - dy[:-2]) / 2
    wild = {20: 90.0, 77: -50.0, 140: 300.0}
    rows = [("a", int(k), float(dx[k]), float(dy[k]), float(0.4 * px[k]) + wild.get(int(k), 0.0), float(0.4 * py[k]), bool(k % 50 != 3)) for k in i] + [("b", k, 1.0 * k * k, 0.0, 1.0, 0.0, True) for k in range(20)]
    df = spark.createDataFrame(rows, "series_id string, frame long, dx double, dy double, shear double, stretch double, ok boolean")
    got = trajectory.readout_fit(df, df).collect()
    assert [r["series_id"] for r in got] == ["a"]
    good = [k for k in range(1, 299) if k % 50 != 3 and (k - 1) % 50 != 3 and (k + 1) % 50 != 3]
    r = got[0]
    assert abs(r["ratio"] - 0.4) < 1e-9 and r["ok"] and r["samples"] <= len(good) - 3 and abs(r["corr"] - 1) < 1e-9 and abs(r["ratio_h"] - 0.4) < 1e-9 and abs(r["ratio_v"] - 0.4) < 1e-9
    # the last frame of the observed series isn't used, whatever the predictor has after it
    short = trajectory.readout_fit(df.filter("series_id = 'a' AND frame < 40").withColumn("shear", F.col("shear")), df).collect()
    assert short[0]["samples"] <= len([k for k in good if k < 39])


def q_mul(a, b):
    w, x, y, z = a
    p, q, r, s = b
    return np.array([w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p])


def about(axis, angle):
    return np.array([math.cos(angle / 2), *(math.sin(angle / 2) * np.array(axis))])


MOTION = "series_id string, frame long, w double, x double, y double, z double, ok boolean"


def test_orientations_compose_new_on_old(spark):
    steps = [about((1, 0, 0), 0.3), about((0, 1, 0), 0.5), about((0, 0, 1), 0.2), about((1, 0, 0), -0.7)]
    rows = [("a", i, *map(float, 2 * q), i != 2) for i, q in enumerate(steps)] + [("b", 0, None, None, None, None, True)]
    got = {(r["series_id"], r["frame"]): np.array([r["w"], r["x"], r["y"], r["z"]]) for r in trajectory.orientations(spark.createDataFrame(rows, MOTION)).collect()}
    assert set(got) == {("a", i) for i in range(5)} | {("b", 0), ("b", 1)}
    q = np.array([1.0, 0, 0, 0])
    for i, step in enumerate(steps):
        assert np.allclose(got["a", i], q)
        q = q_mul(step, q) if i != 2 else q  # the failed one turns nothing
    assert np.allclose(got["a", 4], q) and np.allclose(got["b", 1], [1, 0, 0, 0])


def test_a_steady_turn_needs_no_correction_at_its_ends(spark):
    rows = [("a", i, *map(float, about((0.6, 0, 0.8), 0.05)), True) for i in range(60)]
    path = trajectory.orientations(spark.createDataFrame(rows, MOTION))
    for r in trajectory.rotation_corrections(path, 4.0).collect():
        assert abs(abs(r["w"]) - 1) < 1e-9
    assert trajectory.rotation_corrections(path, 0.0).count() == 0 and trajectory.rotation_corrections(path, 4.0, reliable=False).count() == 0


def test_orientation_means_match_a_plain_evaluation(spark):
    rng = np.random.default_rng(8)
    rows = [("a", i, *map(float, about((1, 0, 0) if i % 2 else (0, 1, 0), rng.normal(0, 0.2))), True) for i in range(25)]
    path = trajectory.orientations(spark.createDataFrame(rows, MOTION))
    q = [np.array(r[1:]) for r in sorted((r["frame"], r["w"], r["x"], r["y"], r["z"]) for r in path.collect())]
    got = {r["frame"]: np.array([r["w"], r["x"], r["y"], r["z"]]) for r in trajectory.rotation_corrections(path, 2.0).collect()}
    k = series.kernel(2.0)
    n, radius = len(q), len(k) // 2
    conj = lambda v: v * np.array([1, -1, -1, -1])

    def log(v):
        v = v if v[0] >= 0 else -v
        m = np.linalg.norm(v[1:])
        return v[1:] * (0 if m < 1e-12 else 2 * math.atan2(m, v[0]) / m)

    for i in range(n):
        mean = q[i]
        for _ in range(2):
            low, high = max(0, i - radius), min(n - 1, i + radius)
            u = np.array([log(q_mul(q[j], conj(mean))) for j in range(low, high + 1)])
            w = min(radius, len(u))
            fit = [np.polyfit(np.arange(w), part, 1) for part in (u[:w], u[-w:])]  # (slope, value at 0) of three axes each
            total = np.zeros(3)
            for o, weight in zip(range(-radius, radius + 1), k, strict=True):
                j = i + o - low
                total += weight * (u[j] if 0 <= j < len(u) else fit[0][1] + fit[0][0] * j if j < 0 else fit[1][1] + fit[1][0] * (j - (len(u) - w)))
            angle = np.linalg.norm(total)
            step = np.array([math.cos(angle / 2), *(total * (math.sin(angle / 2) / angle if angle > 1e-12 else 0.5))])
            mean = q_mul(step, mean)
            mean /= np.linalg.norm(mean)
        assert np.allclose(got[i], q_mul(mean, conj(q[i])), atol=1e-9)


def test_perspective_corrections_match_a_plain_evaluation(spark):
    rng = np.random.default_rng(4)
    steps = [np.eye(3) + rng.normal(0, 0.01, (3, 3)) for _ in range(30)]
    rows = [("a", i, None if i == 7 else (h / h[2, 2]).ravel().tolist()) for i, h in enumerate(steps)]
    df = spark.createDataFrame(rows, "series_id string, frame long, h array<double>")
    got = {r["frame"]: np.array(r["h"]).reshape(3, 3) for r in trajectory.perspective_paths(df, 3.0, 0.5).collect()}
    path = [np.eye(3)]
    for i, h in enumerate(steps):
        m = path[-1] if i == 7 else h @ path[-1]
        path.append(m / m[2, 2])
    path = np.array(path)
    k = np.array(series.kernel(3.0))
    n, r = len(path), len(k) // 2
    flat, x = path.reshape(n, 9), np.arange(r)
    wide = np.array([[*(np.polyval(np.polyfit(x, flat[:r, c], 1), np.arange(-r, 0))), *flat[:, c], *np.polyval(np.polyfit(x, flat[-r:, c], 1), np.arange(r, 2 * r))] for c in range(9)]).T
    assert len(got) == n == 31
    for i in range(n):
        soft = (wide[i : i + 2 * r + 1] * k[:, None]).sum(0).reshape(3, 3)
        soft[2, 2] = 1
        fix = soft @ np.linalg.inv(path[i])
        fix = np.eye(3) + 0.5 * (fix / fix[2, 2] - np.eye(3))
        assert np.allclose(got[i], fix / fix[2, 2], atol=1e-9)
    drift = spark.createDataFrame([("a", i, [1.0, 0.0, 2.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for i in range(40)], "series_id string, frame long, h array<double>")
    assert all(np.allclose(r["h"], np.eye(3).ravel(), atol=1e-9) for r in trajectory.perspective_paths(drift, 3.0).collect())
    assert trajectory.perspective_paths(drift, 3.0, 0.0).count() == 0


def test_mesh_denoising_and_origin(spark):
    rows = [("a", f, 0, 0, 1.0 if f % 2 else -1.0, 0.0) for f in range(30)]
    df = spark.createDataFrame(rows, "series_id string, frame int, r int, c int, vx double, vy double")
    plain, soft = (trajectory.mesh_corrections(df, 3.0, 1.0, denoise).orderBy("frame").collect() for denoise in (0.0, 4.0))
    assert [r["frame"] for r in plain] == list(range(31)) and max(abs(r["dx"]) for r in soft) < 0.3 * max(abs(r["dx"]) for r in plain)
    assert trajectory.mesh_corrections(df, 3.0, 0.0).count() == 0


def test_mesh_field_takes_averaged_medians_of_residual_motion(spark):
    fits = spark.createDataFrame([("a", 0, 3.0, -2.0, 0.0, 1.0)], "series_id string, frame int, dx double, dy double, rotation double, scale double")
    moved = [(10.0, 10.0, 1.0), (12.0, 11.0, 2.0), (14.0, 9.0, 4.0), (11.0, 12.0, 5.0)]  # of vertex (0, 0) alone
    rows = [("a", 0, x, y, x + 3 + m, y - 2 - m) for x, y, m in moved]
    features = spark.createDataFrame(rows, "series_id string, frame int, x double, y double, to_x double, to_y double")
    got = {(r["r"], r["c"]): (r["vx"], r["vy"]) for r in trajectory.mesh_field(trajectory.residual_motion(features, fits), 400, 400, 5, 5).collect()}
    near = {(r, c) for r in range(5) for c in range(5) if any(math.hypot(x - 100 * c, y - 100 * r) <= math.hypot(100, 100) for x, y, _ in moved)}
    first = {(r, c): (float(np.median([m for x, y, m in moved if math.hypot(x - 100 * c, y - 100 * r) <= math.hypot(100, 100)])) if (r, c) in near else 0.0) for r in range(5) for c in range(5)}
    assert len(got) == 25 and first[0, 0] == 3.0
    for (r, c), (x, y) in got.items():
        want = np.median([v for (i, j), v in first.items() if abs(i - r) <= 1 and abs(j - c) <= 1])
        assert abs(x - want) < 1e-9 and abs(y + want) < 1e-9


def test_lens_sweep_picks_the_true_lens(spark):
    r = np.random.default_rng(3)
    rows = []
    for pair in range(6):
        p = r.uniform([100, 60], [860, 480], (60, 2))
        q = maths.q_exp(r.normal(scale=0.03, size=3))
        d = maths.rays(p[:, 0] - 480, p[:, 1] - 270, "equisolid", 540.0) @ maths.q_matrix(q).T
        th = np.arctan2(np.hypot(d[:, 0], d[:, 1]), d[:, 2])
        k = 2 * 540.0 * np.sin(th / 2) / np.hypot(d[:, 0], d[:, 1])
        rows += [(pair, float(x), float(y), float(480 + u * k_), float(270 + v * k_)) for (x, y), u, v, k_ in zip(p, d[:, 0], d[:, 1], k, strict=True)]
    pairs = spark.createDataFrame(rows, "pair_id int, fx double, fy double, tx double, ty double")
    best = trajectory.best_lens(trajectory.lens_sweep(pairs, [400.0, 540.0, 800.0])).first()
    assert (best["kind"], best["focal"]) == ("equisolid", 540.0) and best["err"] < 1e-6 < best["flat_err"]
    whole = trajectory.calibrated_lens(pairs).first()
    assert whole["kind"] == "equisolid" and abs(whole["focal"] - 0.56 * 960) < 1 and whole["pairs"] == 6 and whole["similarity_err"] > whole["err"] < whole["flat_err"]


def test_spatial_median_and_mesh(spark):
    rows = [("a", 0, r, c, float(10 * r + c + (100 if (r, c) == (1, 1) else 0))) for r in range(3) for c in range(3)]
    got = {(x["r"], x["c"]): x["v"] for x in trajectory.spatial_median(spark.createDataFrame(rows, "series_id string, frame int, r int, c int, v double"), ("v",)).collect()}
    v = {(r, c): x for _, _, r, c, x in rows}
    for (r, c), x in got.items():
        assert x == np.median([v[i, j] for i in range(3) for j in range(3) if abs(i - r) <= 1 and abs(j - c) <= 1])
    steady = spark.createDataFrame([("a", f, r, c, 2.0, -1.0) for f in range(20) for r in range(2) for c in range(2)], "series_id string, frame int, r int, c int, vx double, vy double")
    assert all(abs(x["dx"]) < 1e-9 and abs(x["dy"]) < 1e-9 for x in trajectory.mesh_corrections(steady, 3.0).collect())


# --- activities ---------------------------------------------------------------------------------

def track(spark, pairs, series_id="a"):
    return spark.createDataFrame([(series_id, int(t * S), i, float(d), float(d % 50)) for i, (t, d) in enumerate(pairs)], "series_id string, t long, tie long, distance double, elevation double")


def test_laps_need_both_crossings_and_keep_numbers(spark):
    rows = track(spark, [(i * 30, 10200 + i * 100) for i in range(23)])
    got = activity.laps(rows).collect()
    assert [(r["lap"], r["seconds"], r["fastest"]) for r in got] == [(12, 300.0, True)]
    start = track(spark, [(i * 10, i * 100) for i in range(11)])
    assert [r["lap"] for r in activity.laps(start).collect()] == [1]


def test_backwards_distance_is_skipped(spark):
    rows = track(spark, [(0, 0), (10, 600), (20, 400), (30, 500), (40, 1200)])
    got = activity.laps(rows).collect()
    assert len(got) == 1 and abs(got[0]["seconds"] - 30) < 1e-9  # from 600 m at 10 s to 1200 m at 40 s, 1000 m lies at 30 s


def test_rebased_scope_and_windows(spark):
    rows = track(spark, [(i, i * 500) for i in range(121)])
    clips = spark.createDataFrame([("a", 1, 20 * S, 30 * S), ("a", 2, 115 * S, 130 * S), ("a", 3, 200 * S, 210 * S)], "series_id string, clip_id int, start long, end long")
    got = activity.scoped(rows, clips.filter("clip_id = 1"), "rebased").orderBy("t").collect()
    assert len(got) == 11 and got[0]["distance"] == 0 and got[-1]["distance"] == 5000
    assert {r["clip_id"]: r["coverage"] for r in activity.clip_windows(clips, rows).collect()} == {1: "full", 2: "partial", 3: "none"}


def test_timers_leave_out_pauses(spark):
    probes = spark.createDataFrame([("a", 50 * S), ("a", 500 * S), ("a", -5 * S)], "series_id string, t long")
    starts = spark.createDataFrame([("a", 0, 100 * S)], "series_id string, start long, end long")
    pauses = spark.createDataFrame([("a", 10 * S, 20 * S), ("a", 90 * S, 400 * S)], "series_id string, a long, b long")
    assert {r["t"] // S: (r["elapsed"], r["active"]) for r in activity.timers(probes, starts, pauses).collect()} == {50: (50.0, 40.0), 500: (100.0, 80.0), -5: (0.0, 0.0)}


def test_grade_and_gain(spark):
    rows = spark.createDataFrame([("a", i * S, i, i * 10.0, i * 1.0) for i in range(50)], "series_id string, t long, tie long, distance double, elevation double")
    model = activity.elevation_model(rows, 0.0)
    probes = spark.createDataFrame([("a", 200.0)], "series_id string, probe double")
    assert abs(activity.grade(model, probes).first()["grade"] - 0.1) < 1e-9
    assert abs(activity.at_distance(model, probes).first()["gain"] - 20.0) < 1e-9


def test_tuned_sigmas_come_nearest_their_targets(spark):
    rows = [(k, i * S, i, 10.0 * i, 5.0 * (i % 2) * (1 + k)) for k in range(2) for i in range(60)]
    samples = spark.createDataFrame(rows, "series_id int, t long, tie int, distance double, elevation double")
    gain = {s: {r["series_id"]: r["g"] for r in activity.elevation_model(samples, s).groupBy("series_id").agg(F.max("gain").alias("g")).collect()} for s in (0.0, 1.0, 4.0)}
    targets = spark.createDataFrame([(0, gain[1.0][0] + 0.01), (1, gain[0.0][1])], "series_id int, gain double")
    assert {r["series_id"]: r["sigma"] for r in activity.tuned_sigmas(samples, targets, (0.0, 1.0, 4.0)).collect()} == {0: 1.0, 1: 0.0}
    assert activity.tuned_sigma(samples, (gain[4.0][0] + gain[4.0][1]) / 2, (0.0, 1.0, 4.0)) == 4.0
    assert activity.scope_summary(samples, spark.createDataFrame([(0, 1, 10 * S, 20 * S)], "series_id int, clip_id int, start long, end long")).first()["summary"] == "11 samples, 0.10-0.20 km"


def test_thinned_routes(spark):
    assert activity.thinned(points(spark, range(40)), 50).count() == 40
    got = [r["tie"] for r in activity.thinned(points(spark, range(1000)), 50).orderBy("tie").collect()]
    assert got == [math.floor(i * (999 / 49) + 0.5) for i in range(50)]


# --- governance, batches, text ----------------------------------------------------------------------

TAGS = "file string, stream int, key string, value string"


def test_leaks_name_keys_only(spark):
    source = spark.createDataFrame([("f", -1, "location", "+59.3"), ("f", 0, "handler_name", "x"), ("f", 0, "artist", "Ann"), ("f", 0, "encoder", "secret"), ("f", -1, "encoder", "lib"), ("f", -1, "title", "a"), ("f", -1, "creation_time", "2026")], TAGS)
    output = spark.createDataFrame([("f", -1, "comment", "at +59.3/"), ("f", -1, "encoder", "lib"), ("f", -1, "major_brand", "avc1"), ("f", 0, "encoder", "other"), ("f", 0, "x", "")] + [("g", -1, "comment", "Ann")], TAGS)
    got = {(r["file"], r["problem"], r["where"]) for r in governance.report(source, output).collect()}
    # the comment holds the location and an "a"; the encoder of a stream is checked as any key; the survivor's own key isn't named twice
    assert got == {("f", "survived", "container tag location"), ("f", "survived", "container tag title"), ("f", "unexpected", "stream 0 tag encoder"), ("g", "unexpected", "container tag comment")}
    moved = spark.createDataFrame([("f", 1, "note", "it is secret"), ("f", 1, "date", "2026-08")], TAGS)
    assert {(r["problem"], r["where"]) for r in governance.report(source, moved).collect()} == {("survived", "stream 0 tag encoder"), ("survived", "container tag creation_time")}


FILES = ("file string, container string, chapters int, global_tags map<string,string>, streams array<struct<type:string,codec:string,nb_frames:string,attached_pic:boolean,tags:map<string,string>>>,"
         "timestamps array<struct<box:string,creation:long,modification:long>>")


def test_contained_values_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé𝄞") for _ in range(n))
    long = word(300)
    source = [(f"f{i % 3}", i % 2, f"k{i % 7}", v) for i, v in enumerate([word(rng.randint(1, 6)) for _ in range(60)] + [long[i : i + n] for i, n in ((0, 64), (3, 65), (10, 200), (128, 64), (236, 64), (0, 300))] * 2 + ["", None, long[:64] + "x"])]
    output = [(f"f{i % 3}", 0, f"x{i % 5}", v) for i, v in enumerate([word(rng.randint(1, 9)) for _ in range(60)] + [long, word(70) + long + word(5), long[:100]] * 3 + ["", None])]
    schema = "file string, stream int, key string, value string"
    got = governance.matches(spark.createDataFrame(source, schema), spark.createDataFrame(output, schema))
    joins = [n for n in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Contains(" in n and "Join" in n]
    assert all("," in n.split("[")[1].split("]")[0] for n in joins)  # not by the file alone: within one that would be a test for each pair
    want = sorted({(f, s, k, o) for f, s, k, v in source if v for g, _, _, o in output if f == g and o and v in o})
    assert sorted(set(map(tuple, got.collect()))) == want and len(want) > 100
    assert {tuple(r) for r in governance.survived(spark.createDataFrame(source, schema), spark.createDataFrame(output, schema)).collect()} == {x[:3] for x in want}


def test_outputs_are_checked_beyond_their_tags(spark):
    video, audio = ("video", "hevc", "900", False, {"language": "und", "handler_name": "VideoHandler"}), ("audio", "aac", "1", False, {})
    times = [("mvhd", 0, 0)] + [(f"trak[{i}].{b}", 0, 0) for i in range(2) for b in ("tkhd", "mdia.mdhd")]
    rows = [
        ("clean.mp4", "mov,mp4,m4a,3gp,3g2,mj2", 0, {"major_brand": "isom"}, [video, audio], times), ("clean.mkv", "matroska,webm", 0, {"encoder": "Lavf"}, [video], None), ("bare", "matroska,webm", None, None, None, None),
        ("bad.mp4", "mov,mp4,m4a,3gp,3g2,mj2", 2, {"creation_time": "x", "encoder": "SN123"}, [video, ("video", "mjpeg", None, False, {"creation_time": "x", "language": "sv", "handler_name": "GoPro"}), ("video", "png", "1", True, {}), ("data", "bin", None, False, {})], [("trak[0].tkhd", 0, 9)]),
    ]
    df = spark.createDataFrame(rows, FILES)
    got = {(r["file"], r["problem"], r["where"]) for r in governance.shape_problems(df).collect()}
    assert got == {("bad.mp4", *x) for x in [
        ("creation_time", "container"), ("encoder", "container"), ("chapters", "2"), ("no movie header time", "container"), ("too few track header times", "container"), ("creation_time", "stream 1"), ("language", "stream 1"),
        ("handler_name", "stream 1"), ("still image", "stream 1"), ("attached picture", "stream 2"), ("track", "stream 3"), ("header time", "trak[0].tkhd"),
    ]}
    assert {r["file"] for r in governance.verified(df, df).collect()} == {"bad.mp4"}
    kinds = {r["file"]: r["kinds"] for r in governance.source_summary(df).collect()}
    assert kinds["clean.mp4"] == [] and kinds["bad.mp4"] == ["creation_time", "2 chapter(s)", "1 data track(s)", "handlers or languages of streams", "header times"]
    photo = spark.createDataFrame([("p", "mov,mp4", 0, {}, [("video", "mjpeg", None, False, {}), audio], None), ("v", "mov,mp4", 0, {}, [video], None)], FILES)
    assert [r["file"] for r in governance.lone_still(photo).collect()] == ["p"]


def test_containment_finds_needles_in_blocks(spark):
    texts = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, ""), (4, "concatenate")], "id long, text string")
    needles = spark.createDataFrame([("a", "cat"), ("b", "cat"), ("c", "sat"), ("d", None), ("e", "dog")], "needle_id string, needle string")
    for block in (100, 1):
        assert {(r["id"], r["needle_id"]) for r in governance.containing(texts, needles, block=block).collect()} == {(1, "a"), (1, "b"), (1, "c"), (4, "a"), (4, "b")}
    assert governance.containing(texts, spark.createDataFrame([("z", "")], needles.schema)).count() == 3 and governance.containing(texts, needles.limit(0)).count() == 0


def test_names_are_claimed_in_order(spark):
    jobs = spark.createDataFrame([(i, "/o", "clip", ["hud"], ".mp4") for i in range(3)] + [(3, "/o", "b", ["x", "y"], ".mov")], "ord int, dir string, stem string, slugs array<string>, extension string")
    taken = spark.createDataFrame([("/o/clip - hud - 1.mp4",)], "path string")
    assert [r["path"] for r in batch.named(jobs, taken).orderBy("ord").collect()] == ["/o/clip - hud.mp4", "/o/clip - hud - 2.mp4", "/o/clip - hud - 3.mp4", "/o/b - x - y.mov"]


def names_of(spark, stems, taken=()):
    """What naming.ResolveBatch gives, beside the operator's paths."""
    claimed, want = set(taken), []
    for stem in stems:
        want.append(next((p for p in [f"/o/{stem}.mp4"] + [f"/o/{stem} - {i}.mp4" for i in range(1, 1001)] if p not in claimed), None))
        claimed.add(want[-1])
    jobs = spark.createDataFrame([(i, "/o", s, [], ".mp4") for i, s in enumerate(stems)], "ord int, dir string, stem string, slugs array<string>, extension string")
    got = batch.named(jobs, spark.createDataFrame([(p,) for p in taken], "path string")).orderBy("ord").collect()
    assert len(got) == len(stems)
    return [r["path"] for r in got], want


def test_no_two_jobs_get_one_name(spark):
    got, want = names_of(spark, ["x", "x", "x - 1"])
    assert got == want == ["/o/x.mp4", "/o/x - 1.mp4", "/o/x - 1 - 1.mp4"]
    r = random.Random(3)
    stems = ["".join(r.choice(["x", "x", "y"]) + "".join(r.choice(["", " - 1", " - 2", " - 01", " - 1.5", " 1"]) for _ in range(3))) for _ in range(400)]
    got, want = names_of(spark, stems, ["/o/x - 1.mp4", "/o/y.mp4", "/o/y - 2 - 1.mp4"])
    assert got == want and len(set(got)) == 400


def test_jobs_without_a_name_are_rows_with_none(spark):
    got, want = names_of(spark, ["x"] * 1005 + ["x - 7", "y"])
    assert got == want and got[1001:] == [None] * 4 + ["/o/x - 7 - 1.mp4", "/o/y.mp4"]


def test_places_of_all_jobs(spark):
    r = random.Random(4)
    rows = [(i, r.choice([0.0, 0.0, 0.0, 1.0, r.random() * 9, float("nan"), None])) for i in range(3000)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "ord long, cost double")
    got = {r["ord"]: r["place"] for r in batch.places(df).collect()}
    assert got == {r["ord"]: i + 1 for i, r in enumerate(batch.longest_first(df).collect())}
    assert batch.places(df.filter("ord < 0")).count() == 0


def test_trim_windows(spark):
    rows = [(None, None, 10.0), (2.0, 0.0, 10.0), (11.0, None, 10.0), (5.0, 3.0, 10.0), (-4.0, 20.0, 10.0), (-4.0, -1.0, 10.0)]
    df = spark.createDataFrame(rows, "a double, b double, d double").select(batch.trim_window(F.col("a"), F.col("b"), F.col("d")).alias("w"))
    assert [tuple(r["w"]) for r in df.collect()] == [(0, 0, "ok"), (2, 0, "ok"), (11, 0, "outside"), (5, 3, "inverted"), (0, 10, "ok"), (0, -1, "outside")]


def test_time_grammar(spark):
    cases = {
        "12": 12.0, "12.5": 12.5, " 7 ": 7.0, "1e2": 100.0, "1:30": 90.0, "90:00": 5400.0, "1:23:45": 5025.0, "1:30.5": 90.5, "12s": 12.0, "3H": 10800.0, "1h23m45s": 5025.0, "1.5m": 90.0,
        "1:60": None, "1:61:00": None, "-5": None, "NaN": None, "Inf": None, "0x10": None, "1_000": None, "abc": None, "h": None, "1:2:3:4": None, "2026-08-01T09:03:12Z": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["v"] for r in df.select("s", text.time_seconds(F.col("s")).alias("v")).collect()}
    assert got == cases
    kinds = {r["s"]: r["k"] for r in spark.createDataFrame([("",), ("5",), ("2026-08-01T09:03:12+01:00",), ("2026-08-01 09:03:12Z",), ("2026-08-01T09:03:12",), ("-1",)], "s string").select("s", text.time_kind(F.col("s")).alias("k")).collect()}
    assert kinds == {"": "unset", "5": "relative", "2026-08-01T09:03:12+01:00": "absolute", "2026-08-01 09:03:12Z": "absolute", "2026-08-01T09:03:12": "invalid", "-1": "invalid"}


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_formats(spark):
    lit = F.lit
    assert one(spark, text.elapsed(lit(90061.9))) == "25:01:01" and one(spark, text.elapsed(lit(-3.0))) == "0:00:00"
    assert one(spark, text.fixed(lit(-0.04), 1)) == "0.0" and one(spark, text.fixed(lit(-0.06), 1)) == "-0.1"
    assert one(spark, text.axis_label(lit(400.0), lit(900.0), 1)) == "400 m" and one(spark, text.axis_label(lit(400.0), lit(5000.0), 1)) == "0.4 km"
    assert one(spark, text.elevation_axis_labels(lit(400.0), lit(20000.0))) == ["0.4 km", "20.0 km"]
    assert one(spark, text.elevation_range_labels(lit(10.0), lit(10.5))) == ["10.2 m"]
    assert one(spark, text.cadence(lit(86), lit("running"))) == "172 spm" and one(spark, text.cadence(lit(86), lit("cycling"))) == "86 rpm"
    assert one(spark, text.pace(lit(3.0))) == "5:33/km" and one(spark, text.pace(lit(0.0))) == "--:--/km"
    assert one(spark, text.speed(lit(2.5))) == "9.0 km/h" and one(spark, text.speed(lit(3.0))) == "11 km/h"
    assert one(spark, text.heart_rate(lit(None).cast("int"))) == "-- bpm"
    assert one(spark, text.eta(lit(3725.0))) == "1h02m05s" and one(spark, text.eta(lit(59.4))) == "59s"
    assert one(spark, text.position(lit(-33.5), lit(151.25), lit(12.0))) == "-33.5000+151.2500+012.000/"
    assert one(spark, text.utc_offset(lit("+05:30"))) == 19800 and one(spark, text.utc_offset(lit("-3"))) == -10800
    assert one(spark, text.quoted(lit("a b"))) == '"a b"' and one(spark, text.quoted(lit("ab"))) == "ab"
    assert one(spark, text.swap_extension(lit("/a.b/c.mp4"), ".gpx")) == "/a.b/c.gpx"
    assert one(spark, text.rational_rate(lit("60000/1001"))) == 60000 / 1001 and one(spark, text.rational_rate(lit("1/0"))) == 0.0
    assert one(spark, text.iso_family(lit("mov,mp4,m4a"))) and not one(spark, text.iso_family(lit("xmov")))
    assert one(spark, maths.presented_frames(lit(100), lit(1.0), lit(60.0))) == 60 and one(spark, maths.span_fraction(lit(5.0), lit(2.0), lit(10.0))) == 1.0


# --- sources, sinks, effects, streams ---------------------------------------------------------------------

def test_probe_json(spark):
    js = '{"streams":[{"codec_type":"audio"},{"codec_type":"video","width":3840,"height":2160,"avg_frame_rate":"60000/1001","nb_frames":"N/A","side_data_list":[{"rotation":-90}]}],"format":{"format_name":"mov,mp4","duration":"12.5","tags":{"creation_time":"2026-08-01 09:03:12"}}}'
    got = probe.parse(spark.createDataFrame([(js,), ('{"streams":[]}',)], "json string")).collect()
    i = got[0]["info"]
    assert (i["width"], i["rotation"], i["frames"], i["duration"], i["has_audio"], i["naive"]) == (3840, 270, 0, 12.5, True, True) and got[1]["info"] is None


def test_header_timestamps(spark, tmp_path):
    import struct

    mvhd = struct.pack(">I4sB3xII", 20, b"mvhd", 0, boxes.EPOCH + 5, boxes.EPOCH + 6) + b""
    mdhd = struct.pack(">I4sB3xQQ", 28, b"mdhd", 1, 2**40, 7)
    mdia = struct.pack(">I4s", 8 + len(mdhd), b"mdia") + mdhd
    trak = struct.pack(">I4s", 8 + len(mdia), b"trak") + mdia
    moov = struct.pack(">I4s", 8 + len(mvhd + trak), b"moov") + mvhd + trak
    (tmp_path / "a.mp4").write_bytes(struct.pack(">I4s", 8, b"free") + moov)
    (tmp_path / "b.mp4").write_bytes(struct.pack(">I4s", 99, b"moov"))
    got = {(r["path"][-5:], r["box"]): r for r in boxes.header_timestamps(spark, str(tmp_path)).collect()}
    wrong = struct.pack(">I4sB3xQQ", 28, b"mvhd", 2, 5, 7)  # a version that isn't known
    assert boxes.timestamps(wrong + trak) == [("trak[0].mdia.mdhd", 2**40, 7)]
    assert int(got["a.mp4", "mvhd"]["created"]) == boxes.EPOCH + 5 and int(got["a.mp4", "trak[0].mdia.mdhd"]["created"]) == 2**40 and "overruns" in got["b.mp4", None]["error"]


def test_sidecar_round_trip_and_damage(spark, tmp_path):
    headers = spark.createDataFrame([("a", "s1", 4), ("b", "s2", 3)], "clip_id string, source string, frame_count int")
    moves = spark.createDataFrame([("a", i, 1.0, True, [0.5] * 9) for i in range(3)] + [("b", 0, 1.0, True, None)], "clip_id string, frame int, dx double, ok boolean, h array<double>")
    sidecar.write(headers, moves, str(tmp_path / "s"))
    h, t = sidecar.read(spark, str(tmp_path / "s"))
    assert t.count() == 4 and [r["clip_id"] for r in sidecar.damaged(h, t).collect()] == ["b"]
    assert {r["clip_id"]: r["perspective"] for r in sidecar.capabilities(t).collect()} == {"a": True, "b": False}
    assert sidecar.read_for_source(spark, str(tmp_path / "s"), "none")[1].count() == 0


def test_text_sidecars(spark):
    p = spark.createDataFrame([("a", 1, i * S, i * S, 59.0 + i, 18.0, 100.0 * i) for i in (0, 1, 4)], "series_id string, clip_id int, pts long, stamp long, lat double, lon double, distance double")
    gpx = sinks.gpx_documents(p, S).first()["text"]
    assert gpx.count("<trkseg>") == 2 and gpx.count("<trkpt") == 3 and gpx.index("59.0") < gpx.index("60.0") < gpx.index("63.0")
    assert {(r["points"], r["segments"]) for r in activity.track_segments(p).collect()} == {(3, 2)}
    cues = [r["cue"] for r in sinks.srt_cues(p, sinks.readable_body(F.col("distance"), F.lit("x")), S).orderBy("no").collect()]
    assert cues[1].startswith("2\n00:00:01,000 --> 00:00:04,000\n0.10 km | x")


def test_effect_registry_and_chain(spark):
    class Half:
        name = slug = "half"

        def check_strength(self, strength):
            effects.unit_strength(strength)

        def apply(self, df):
            return df.filter("id % 2 = 0")

    effects.register("half-test", Half)
    with pytest.raises(ValueError):
        effects.register("half-test", Half)
    with pytest.raises(KeyError, match="half-test"):
        effects.get("nope")
    with pytest.raises(ValueError):
        effects.resolve(["half-test", "half-test"])
    assert effects.chain(spark.range(10), effects.resolve(["half-test"])).count() == 5 and isinstance(Half(), effects.Effect)


def test_streamed_sessions_equal_batch(spark, tmp_path):
    rows = [(k, datetime(2026, 1, 1) + timedelta(minutes=m)) for k in (1, 2) for m in (0, 5, 9, 40, 44, 90, 300)]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = sessions.sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "10 minutes", "1 minute")
    q = stream.writeStream.outputMode("append").format("memory").queryName("sessions_test").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    closed = {(r["user_id"], r["start"], r["n"]) for r in spark.sql("SELECT * FROM sessions_test").collect()}
    whole = {(r["user_id"], r["start"], r["n"]) for r in sessions.sessions(df, "user_id", "ts", "10 minutes", "1 minute").collect()}
    assert closed < whole and len(whole) == 8 and len(closed) == 6


def test_calibration_in_two_passes(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", 0, 1.0)], "key string, frame long, value double")
    got = sessions.calibrated_batch(df, 5).collect()
    assert len(got) == 10 and {r["level"] for r in got} == {2.0}


def test_rotation_zoom_plan(spark):
    a = [0.0, 0.02, 0.05, 0.1]
    df = spark.createDataFrame([("a", i, math.cos(x / 2), 0.0, math.sin(x / 2), 0.0) for i, x in enumerate(a)], "series_id string, frame long, w double, x double, y double, z double")
    got = trajectory.rotation_zoom_plan(df, "rectilinear", 800.0, 960, 540, 1.0, 1.2).orderBy("frame").collect()
    need = [r["required"] for r in got]
    assert need[0] == 1.0 and need == sorted(need) and need[1] > 1.0
    assert all(r["zoom"] >= min(r["required"], 1.2) - 1e-9 and r["zoom"] <= 1.2 for r in got)
    q = np.array([[r["w"], r["x"], r["y"], r["z"]] for r in got])
    assert maths.rotation_fits(q, np.array([r["zoom"] for r in got]) + 1e-8, "rectilinear", 800.0, 960, 540).all() and got[3]["alpha"] < 1


def test_rectifiers_and_margins(spark):
    df = spark.createDataFrame([("a", i, 4.0, 2.0, i != 1) for i in range(3)], "series_id string, frame long, dx double, dy double, ok boolean")
    got = trajectory.rectifiers(df, 0.5, 100)
    assert [r["kx"] for r in got.orderBy("frame").collect()] == [0.02] * 4
    assert abs(trajectory.worst_margin(got, 200, 100).first()["margin"] - 0.01) < 1e-12
    assert one(spark, F.array(*maths.vertex_counts(F.lit(16), F.lit(1920), F.lit(1080)))) == [17, 10]
    mesh = spark.createDataFrame([("a", 0, r, c, 3.0, 0.0) for r in range(3) for c in range(3)], "series_id string, frame int, r int, c int, dx double, dy double")
    assert abs(trajectory.mesh_border_margin(mesh, 3, 3, 960, 540).first()["margin"] - 2 * 2 * 3 / 960) < 1e-12


# --- settings, own effects, reports ------------------------------------------------------------------------

def test_settings_of_renders_and_estimates():
    assert effects.render_options("homography", {"perspective": 0.0})["perspective"] == 1.0 and effects.render_options("homography", {"perspective": 0.4})["perspective"] == 0.4
    assert effects.render_options("mesh", {"mesh": 3.0})["mesh_strength"] == 1.0 and effects.render_options("mesh", {})["mesh_strength"] == effects.MESH_STRENGTH
    turned = effects.render_options("rotation", {"quality": 55}, True, 0.3, True)
    assert (turned["rotation"], turned["readout_ratio"], turned["rectifiers"], turned["quality"]) == (True, 0.3, False, 55)
    assert effects.render_options("rotation", {}, True, 0.3, False)["rectifiers"] is True
    assert effects.lag_query(45.0, 12.0, 15.0)["centre"] == 12.0
    for bad in ({"window": -1.0}, {"window": 45.0, "centre_width": 14.9}, {"window": float("nan")}):
        with pytest.raises(ValueError):
            effects.lag_query(**bad)


def test_own_effects_are_registered_and_chain(spark):
    from wayfold.plans import steps

    assert {"stabilize", "offset", "strip-metadata", "rotate"} <= set(effects.names())
    assert isinstance(effects.get("stabilize"), effects.Tunable) and isinstance(effects.get("strip-metadata"), effects.DropsTracks) and isinstance(effects.get("stabilize"), effects.Reencodes)
    moved = spark.createDataFrame([("a", i, 1.0, 0.0, 0.0, 1.0, True) for i in range(30)], "series_id string, frame long, dx double, dy double, rotation double, scale double, ok boolean")
    assert all(abs(r["dx"]) < 1e-9 for r in effects.chain(moved, [effects.get("stabilize").with_strength(1.0)]).collect())
    assert [r["t"] for r in effects.chain(frame(spark, [("s", 5, 0, 1.0)]), [steps.Offset(1.5), steps.Offset(-0.5)]).collect()] == [1_000_005]
    with pytest.raises(ValueError):
        steps.Offset().apply(moved)
    tags = spark.createDataFrame([("f", -1, "title", "x"), ("f", 0, "language", "und"), ("f", 0, "artist", "")], TAGS)
    assert {r["key"] for r in steps.StripMetadata().apply(tags).collect()} == {"language", "artist"}
    files = spark.createDataFrame([("clip", ".mp4")], "stem string, extension string")
    assert steps.output_names(files, [effects.get("stabilize"), steps.Offset(3.5)]).first()["name"] == "clip - stabilized - offset +3.5s.mp4"


def test_round_trips_and_reports(spark, tmp_path):
    rows = [("ok", 4, 3, 4, 3, 100, 102, 100, True, True), ("bad", 4, 3, 4, 2, 100, 103, 99, True, False), ("unknown", 4, 3, 4, 3, 100, 0, None, False, False)]
    df = spark.createDataFrame(rows, "file string, width int, height int, out_width int, out_height int, frames int, out_frames int, counted int, audio boolean, out_audio boolean")
    assert {(r["file"], r["problem"]) for r in effects.round_trip_problems(df).collect()} == {("bad", p) for p in ("size", "frames", "count", "audio")}
    found = spark.createDataFrame([("matched energy under its gate",)], "reason string")
    ranked = spark.createDataFrame([(i, 1.5 - i, 0.9, 4.0, 90.0) for i in range(5)], "place int, tau double, score double, energy double, turn double")
    lines = sinks.decline_report(found, ranked).first()["message"].split("\n")
    assert len(lines) == 4 and lines[1] == "candidate 1: offset +1.50s score 0.900 energy 4.0 turn 90.0 degrees"
    out = spark.createDataFrame([("x",)], "line string")
    assert sinks.write_text(out, "line", str(tmp_path / "t")) is False
    with pytest.warns(UserWarning):
        assert sinks.write_text(out, "line", str(tmp_path / "t")) is True
    rects = spark.createDataFrame([("a", i, i / 1000, 0.0) for i in range(100)], "series_id string, frame int, kx double, ky double")
    got = trajectory.margin_percentiles(rects, 960, 540).first()
    assert got["median"] < got["p90"] < got["p99"] <= got["worst"]


def test_probes_in_gaps_snap_to_the_nearest(spark):
    data = frame(spark, [("s", 0, 0, 1.0), ("s", 10 * S, 1, 2.0), ("s", 11 * S, 2, 4.0)])
    probes = spark.createDataFrame([("s", t * S, t) for t in (-1, 0, 4, 5, 6, 10, 12)] + [("s", 10 * S + S // 2, 99)], "series_id string, t long, probe int")
    got = {r["probe"]: (r["value"], r["found_t"]) for r in series.snapped(probes, data).collect()}
    assert got == {-1: (None, None), 0: (1.0, 0), 4: (1.0, 0), 5: (1.0, 0), 6: (2.0, 10 * S), 10: (2.0, 10 * S), 12: (None, None), 99: (3.0, 10 * S + S // 2)}


def test_nearest_pairs_match_all_pairs_in_any_chunks(spark):
    r = random.Random(2)
    a, b = ([(i % 2, i, r.getrandbits(63)) for i in range(n)] for n in (60, 80))
    b += [(k, 1000 + i, d ^ 3) for i, (k, _, d) in enumerate(a[:20])]
    want = set()
    for k, i, d in a:
        near = sorted((bin(d ^ e).count("1"), j) for q, j, e in b if q == k)
        if near[0][0] <= 0.75 * near[1][0]:
            want.add((k, i, near[0][1], near[0][0]))
    schema = "block int, id long, d long"
    for chunk in (7, 2048):
        assert {tuple(x) for x in batch.nearest_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 0.75, chunk).collect()} == want


def test_mesh_field_of_far_features_and_missing_values(spark):
    r = random.Random(11)
    rows = [("a", k % 4, r.uniform(-300, 700), r.uniform(-300, 700), None if k % 9 == 0 else r.random(), r.random()) for k in range(60)] + [("b", 0, 9000.0, 9000.0, 1.0, 1.0), ("b", 1, None, 10.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, frame int, x double, y double, mx double, my double")
    got = {(x["series_id"], x["frame"], x["r"], x["c"]): (x["vx"], x["vy"]) for x in trajectory.mesh_field(df, 400, 300, 5, 4, 3).collect()}
    exp = {}
    for key in {x[:2] for x in rows}:
        def first(i, j, at, key=key):
            near = [x[4 + at] for x in rows if x[:2] == key and x[2] is not None and x[4 + at] is not None and math.hypot(x[2] - j * 100, x[3] - i * 100) <= math.hypot(100, 100)]
            return float(np.median(near)) if near else 0.0
        for i in range(4):
            for j in range(5):
                around = [(p, q) for p in range(max(0, i - 1), min(4, i + 2)) for q in range(max(0, j - 1), min(5, j + 2))]
                exp[*key, i, j] = tuple(float(np.median([first(p, q, at) for p, q in around])) for at in (0, 1))
    assert got.keys() == exp.keys() and all(np.allclose(got[k], exp[k]) for k in exp)
