"""Long series in cells and chunks, ranks by brackets and estimates of many clips: against one task, plain loops and sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import S, bump, frame
from wayfold.functions import maths
from wayfold.operators import alignment, batch, chunks, series, stats, trajectory


def long_series(spark, n=5000, others=40):
    """One series with most rows, some short ones, ties and bursts, a null value here and there."""
    r = random.Random(21)
    rows, t = [], 0
    for i in range(n):
        t += r.choice([0, 1, 1, 2, 5]) * S // 4 if i % 1000 else 900 * S
        rows.append(("long", t, i, r.uniform(-5, 5)))
    rows += [(f"s{k}", r.randint(0, 400) * S, 10_000 + 20 * k + j, r.uniform(-5, 5)) for k in range(others) for j in range(r.randint(1, 12))]
    return spark.createDataFrame(rows, "series_id string, t long, tie long, value double").repartition(4)


def agree(a, b, on=("series_id", "tie"), digits=7):
    key = lambda r: tuple(str(r[c]) for c in on)
    fix = lambda r: {k: round(v, digits) + 0.0 if isinstance(v, float) else v for k, v in r.asDict().items()}
    x, y = ({key(r): fix(r) for r in df.collect()} for df in (a, b))
    assert x.keys() == y.keys() and len(x) > 0
    for k in x:
        for c in x[k]:
            assert x[k][c] == pytest.approx(y[k][c], abs=1e-6) if isinstance(x[k][c], float) else x[k][c] == y[k][c], (k, c)


WIDTH = 100 * S


@pytest.mark.parametrize("name", ["runs", "grid_runs", "integrate", "trapezoid", "unwrap", "smooth", "running_max", "upper_envelope"])
def test_cells_give_what_one_task_gives(spark, name):
    df = long_series(spark)
    call = {
        "runs": lambda w: series.runs(df, 2 * S, w), "grid_runs": lambda w: series.grid_runs(df, S // 4, w), "integrate": lambda w: series.integrate(df, F.col("value"), width=w),
        "trapezoid": lambda w: series.trapezoid(df, width=w), "unwrap": lambda w: series.unwrap(df, width=w), "smooth": lambda w: series.smooth(df, 3.0, "extrapolate", width=w),
        "running_max": lambda w: series.running_max(df, 7, width=w), "upper_envelope": lambda w: series.upper_envelope(df, 2.0, width=w),
    }[name]
    agree(call(None), call(WIDTH))


def test_lookups_over_cells(spark):
    df = long_series(spark)
    probes = df.filter("tie % 3 = 0").select("series_id", (F.col("t") + F.pmod(F.col("tie"), F.lit(7)) * 100_000).alias("t"), F.col("tie").alias("probe"))
    agree(series.at(probes, df), series.at(probes, df, width=WIDTH), ("series_id", "probe"))
    agree(series.covered_index(probes, df), series.covered_index(probes, df, width=WIDTH), ("series_id", "probe"))
    agree(series.best_window(df, 6 * S), series.best_window(df, 6 * S, width=WIDTH), ("series_id",))
    agree(series.resample(df), series.resample(df, width=WIDTH), ("series_id", "t"))


def test_a_hot_series_spreads_over_tasks(spark):
    df = long_series(spark, 20_000, 10)
    width = chunks.width_for(df, rows=1000)
    assert width and chunks.width_for(df, rows=1_000_000) is None
    share = df.withColumn("c", chunks.cell("t", width)).groupBy("series_id", "c").count().agg(F.max("count"), F.count("*")).first()
    assert share[0] < 0.2 * df.count() and share[1] > 15
    pieces = chunks.dealt(chunks.positions(df, width=width), 9, 500)
    per = pieces.groupBy("series_id", "_c").agg(F.count("*").alias("n"), F.sum(F.col("_own").cast("int")).alias("own"))
    assert per.agg(F.max("n")).first()[0] <= 518 and per.agg(F.sum("own")).first()[0] == df.count()


@pytest.mark.parametrize("boundary", ["reflect", "extrapolate", "clamp"])
def test_chunks_of_positions_don_t_show(spark, boundary):
    df = long_series(spark, 700, 20)
    w = np.array(series.kernel(4.0))
    by = lambda size: chunks.windowed(df, len(w) // 2, ("value",), chunks.weighted(w, boundary), size=size)
    agree(by(100_000), by(25))
    agree(by(100_000), by(33))
    top = lambda size: chunks.windowed(df, 6, ("value",), chunks.highest(6), size=size)
    agree(top(100_000), top(13))


def test_smoothing_against_a_plain_sum_with_nulls(spark):
    values = [1.0, 4.0, None, 2.0, -3.0, 5.0, 0.5, 6.0, 1.5, 2.5, 7.0, 8.0]
    df = frame(spark, [("s", i * S, i, v) for i, v in enumerate(values)])
    got = {r["tie"]: r["value"] for r in series.smooth(df, 0.6, "clamp").collect()}
    w = series.kernel(0.6)
    for i in range(len(values)):
        near = [values[min(max(i + o, 0), len(values) - 1)] for o in range(-2, 3)]
        assert got[i] is None if None in near else got[i] == pytest.approx(sum(a * b for a, b in zip(w, near, strict=True)))
    high = {r["tie"]: r["high"] for r in series.running_max(df, 1).collect()}
    assert [high[i] for i in range(4)] == [4.0, 4.0, 4.0, 2.0]


def test_ordered_products_over_cells(spark):
    r = np.random.default_rng(5)
    rows = [(s, i, bool(r.random() > 0.1), *r.normal(size=4).tolist()) for s, n in (("a", 700), ("b", 3), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, frame long, ok boolean, w double, x double, y double, z double").repartition(5)
    agree(trajectory.orientations(df), trajectory.orientations(df, 64), ("series_id", "frame"))
    q, want = np.array([1.0, 0, 0, 0]), []
    for row in rows[:700]:
        want.append(q)
        if row[2]:
            q = maths.q_mul(np.array(row[3:]) / np.linalg.norm(row[3:]), q)
    got = trajectory.orientations(df, 64).filter("series_id = 'a'").orderBy("frame").toPandas()
    assert len(got) == 701 and np.allclose(got[list("wxyz")].to_numpy()[:-1], want, atol=1e-9) and np.allclose(got[list("wxyz")].to_numpy()[-1], q, atol=1e-9)
    path = trajectory.orientations(df)
    agree(trajectory.smooth_orientations(path, 3.0), trajectory.smooth_orientations(path, 3.0, size=40, width=64), ("series_id", "frame"))
    tilt = df.select("series_id", "frame", F.when(F.col("ok"), F.array(*[F.lit(float(e)) + c / 50 for e, c in zip([1, 0, 0, 0, 1, 0, 0, 0, 1], [F.col("x"), F.col("y"), F.col("z"), F.col("w"), F.col("x"), F.col("y"), F.col("z") / 99, F.col("w") / 99, F.lit(0.0)], strict=True)])).alias("h"))
    a, b = (trajectory.perspective_paths(tilt, 3.0, 0.5, w).select("series_id", "frame", *[F.col("h")[k].alias(f"h{k}") for k in range(9)]) for w in (1 << 16, 50))
    agree(a, b, ("series_id", "frame"), 4)


def test_a_singular_matrix_in_a_chain(spark):
    flat = [1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([("s", 0, flat), ("s", 1, None)], "series_id string, frame long, h array<double>")
    rows = trajectory.perspective_paths(df, 1.0).orderBy("frame").collect()
    assert len(rows) == 3 and all(v == v for r in rows for v in r["h"])
    m = spark.range(1).select(maths.matrix_inverse(maths.matrix([[1, 2, 3], [2, 4, 6], [0, 0, 1]])).alias("m")).first()["m"]
    assert m == np.eye(3).ravel().tolist()


@pytest.mark.parametrize("accuracy", [10_000, 400])
def test_ranks_of_groups_of_any_size(spark, accuracy):
    """With a coarse sketch the brackets are what decides; values repeat, are null or NaN."""
    r = random.Random(3)
    groups = {"hot": [r.choice([r.gauss(0, 1e6), 1.0, 2.0, None, -1e-9]) for _ in range(4000)], "one": [5.0], "two": [2.0, 1.0], "same": [3.0] * 300, "none": [None] * 4, "wide": [10.0 ** r.randint(-200, 200) for _ in range(700)], "edge": [float(i) for i in range(201)], None: [4.0, 1.0, 9.0]}
    df = spark.createDataFrame([(k, v, None if v is None else -v) for k, x in groups.items() for v in x], "k string, v double, m double").repartition(6)
    picks = {"u": ("v", stats.upper()), "l": ("v", stats.lower()), "p": ("m", stats.index(90)), "q": ("m", stats.span(0.37)), "top": ("v", stats.index(100))}
    got = {r["k"]: r for r in stats.order_statistics(df, ["k"], picks, accuracy).collect()}
    assert got.keys() == groups.keys() - {"none"}
    for k, x in groups.items():
        s = sorted(v for v in x if v is not None)
        n, neg = len(s), sorted(-v for v in s)
        if n:
            assert (got[k]["u"], got[k]["l"], got[k]["p"], got[k]["q"], got[k]["top"]) == (s[n // 2], s[(n - 1) // 2], neg[min(n - 1, n * 90 // 100)], neg[math.floor((n - 1) * 0.37)], s[n - 1]), k
            assert got[k]["n_u"] == n


@pytest.mark.parametrize("accuracy", [10_000, 400])
def test_ranks_of_groups_sorted_or_bracketed(spark, accuracy):
    """A group gives the same whether it is sorted or bracketed; one has a value that is null in most rows."""
    r = random.Random(4)
    groups = {"a": 3000, "b": 40, None: 700, "c": 1, "d": 260}
    rows = [(k, r.choice([r.gauss(0, 1e3), 1.0, -0.0, None, float("nan")]), r.random() if i % 50 == 0 and k != "c" else None) for k, n in groups.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, v double, m double").repartition(5)
    picks = {"u": ("v", stats.upper()), "l": ("v", stats.lower()), "p": ("m", stats.index(90)), "top": ("v", stats.index(100))}
    plain = lambda whole, tasks: sorted(map(repr, stats.order_statistics(df, ["k"], picks, accuracy, tasks, whole).collect()))
    want = plain(10_000, 3)
    assert len(want) >= 4 and want == plain(250, None) == plain(0, 3)


def test_estimates_of_many_clips_in_one_plan(spark):
    clip = lambda name, rows, shift=0: [(name, t + shift * S, i, v) for _, t, i, v in rows]
    turn, late = bump(60), bump(67.35, step=0.5, seconds=240)
    camera = frame(spark, clip("good", turn) + clip("away", turn) + clip("thin", turn) + clip("bare", turn) + clip("calm", [(s, t, i, 0.0) for s, t, i, v in turn]) + [("lone", 0, 0, 1.0)])
    track = frame(spark, clip("good", late) + clip("away", turn, 3600) + clip("thin", [x for x in turn if x[1] < 30 * S]) + clip("calm", late))
    got = {r["series_id"]: r for r in alignment.estimates(camera, track, window=15.0, step=0.25, rate=2.0, wide=True).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {"good": "confident", "away": "declined", "thin": "declined", "bare": "declined", "calm": "declined", "lone": "error"}
    assert abs(got["good"]["tau"] - 7.35) <= 0.3 and got["good"]["null_share"] is not None and [k for k, r in got.items() if r["null_share"] is not None] == ["good"]
    assert got["away"]["reason"] == got["bare"]["reason"] == "the track doesn't reach the clip" and got["thin"]["reason"] == "the track covers too little of the clip"
    with pytest.raises(ValueError):
        alignment.estimate(frame(spark, [("lone", 0, 0, 1.0)]), track)


def test_near_descriptors_are_found_by_substrings(spark):
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(60)]
    flip = lambda d, n: d ^ sum(1 << k for k in r.sample(range(64), n))
    signed = lambda d: d - (1 << 64) if d >> 63 else d
    a = [(blk, i, signed(d)) for blk in (0, 1) for i, d in enumerate(base[:40])] + [(2, 900, 5), (0, 901, signed(base[0]))]
    b = [(blk, 100 + i, signed(flip(d, i % 9))) for blk in (0, 1) for i, d in enumerate(base)] + [(0, 300, signed(base[3])), (0, 301, signed(base[3])), (0, 302, signed(flip(base[5], 2))), (2, 400, 4)]
    make = lambda rows: spark.createDataFrame(rows, "block int, id int, d long")
    bits = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    want = set()
    for blk, i, d in a:
        near = sorted((bits(d, e), j) for blk2, j, e in b if blk2 == blk)
        if len(near) > 1 and near[0][0] <= 0.75 * near[1][0]:
            want.add((blk, i, near[0][1], near[0][0]))
    got = batch.nearest_pairs(make(a), make(b))
    assert {tuple(x) for x in got.collect()} == want and len(want) > 60
    met = batch.near_candidates(make(a), make(b))
    assert met.count() < 0.1 * sum(1 for x in a for y in b if x[0] == y[0])
    close = {(blk, d, e) for blk, _, d in a for blk2, _, e in b if blk == blk2 and bits(d, e) <= batch.RADIUS}
    assert close <= {(x["block"], x["d"], x["other"]) for x in met.collect()}


def test_nearest_pairs_of_short_descriptors_are_looked_up(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(4)
    own, other = r.integers(0, 1 << 32, 300).astype(np.uint64), r.integers(0, 1 << 32, 40_000).astype(np.uint64)
    other[:50] = own[:50] ^ np.uint64(5)
    other[20_000:20_010] = own[:10] ^ np.uint64(9)
    own[299] = own[0]
    best, good, rest = batch._looked_up(own, other, 0.75)
    want = batch._all_pairs(own, other, 777)
    sure = np.setdiff1d(np.arange(len(own)), rest)
    passed = want[:, 0] // batch.PLACES <= 0.75 * (want[:, 1] // batch.PLACES)
    assert (good[sure] == passed[sure]).all() and (best[good, 0] == want[good, 0]).all() and good.sum() > 30
    assert len(rest) < 0.05 * len(own)  # 32 of the 64 bits vary: substrings of the others would be the same for all
    d = np.bitwise_count(own[:, None] ^ other[None]).astype(np.int64) * batch.PLACES + np.arange(len(other))
    assert (np.sort(d, 1)[:, :2] == want).all()


def test_many_short_series_are_multiplied_and_averaged_at_once(spark):
    import numpy as np

    m = np.random.default_rng(1).normal(size=(9, 2, 2))
    starts = np.array([0, 1, 4])
    got = chunks.prefix_products(m, lambda new, old: new @ old, starts)
    for a, z in ((0, 1), (1, 4), (4, 9)):
        upto = np.eye(2)
        for k in range(a, z):
            upto = m[k] @ upto
            assert np.allclose(got[k], upto)
    rows = [(s, f, 1.0, 0.1 * f, 0.02 * s, 0.0) for s in range(5) for f in range(s + 1)]
    path = trajectory.orientations(spark.createDataFrame(rows, "series_id int, frame long, w double, x double, y double, z double"))
    out = trajectory.rotation_corrections(path, 2.0)
    assert {(r["series_id"], r["frame"]) for r in out.collect()} == {(s, f) for s in range(5) for f in range(s + 2)}
    assert "FlatMap" not in out._jdf.queryExecution().executedPlan().toString()  # no call of Python for each series
