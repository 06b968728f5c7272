"""Robust statistics and small fits. Two medians and two percentile rules differ on purpose: see each.

Exact ranks of groups of any size go by ``order_statistics``: groups of bounded size are sorted in tasks of bounded size; in a larger one a quantile sketch of fixed size brackets each rank, and only
what lies in the bracket is counted by value, with partial aggregation; what is below is one count. So no task holds a large group's values, and a group that is a third of all rows spreads as any
other. The functions of columns (``median_upper`` and others) are for groups whose distinct values fit a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chunks

MAD = 1.4826


def _ranked(v: str, share: float) -> Column:
    """The least value that ``share`` of all values don't exceed. Values are counted with partial aggregation, so a hot key spreads; a task holds a key's distinct values."""
    return F.expr(f"percentile_disc({share!r}) WITHIN GROUP (ORDER BY {v})")


#: Puts a share between two ranks: for groups of up to 10^9 values it is past the first and short of the second.
PAST = 1e-11


def median_upper(v: str) -> Column:
    """The element at n // 2 of the sorted values of the SQL expression ``v``."""
    return _ranked(v, 0.5 + PAST)


def median_average(v: Column) -> Column:
    """The mean of the middle two where the count is even."""
    return F.percentile(v, F.lit(0.5))


def percentile_index(v: str, p: int) -> Column:
    """The element at min(n - 1, n * p // 100) of the sorted values of the SQL expression ``v``."""
    return _ranked(v, min(1.0, p / 100 + PAST))


def percentile_span(v: Column, p: float) -> Column:
    """The element at floor(p (n - 1)) of the sorted values, which takes the values of a key in one row: for keys of bounded size."""
    s = F.array_sort(F.collect_list(v))
    return F.element_at(s, F.floor(p * (F.size(s) - 1)).cast("int") + 1)


#: The sketch's accuracy: ranks within one in so many of a group's rows.
ACCURACY = 10_000
#: Rows of a group up to which it is counted whole, and the share of the ranks on either side that is counted up to ACCURACY rows, where the sketch is exact.
FEW, NEAR = 200, 0.02


def upper() -> tuple[float, Callable[[Column], Column]]:
    """The rank n // 2."""
    return 0.5, lambda n: F.floor(n / 2)


def lower() -> tuple[float, Callable[[Column], Column]]:
    """The rank (n - 1) // 2: with ``upper`` the middle two."""
    return 0.5, lambda n: F.floor((n - 1) / 2)


def index(p: int) -> tuple[float, Callable[[Column], Column]]:
    """The rank min(n - 1, n * p // 100)."""
    return p / 100, lambda n: F.least(n - 1, F.floor(n * p / 100))


def span(p: float) -> tuple[float, Callable[[Column], Column]]:
    """The rank floor(p (n - 1))."""
    return p, lambda n: F.floor((n - 1) * p)


Picks = dict[str, tuple[Column | str, tuple[float, Callable[[Column], Column]]]]


def order_statistics(df: DataFrame, keys: list[str], picks: Picks, accuracy: int = ACCURACY, tasks: int | None = None, whole: int = chunks.ROWS) -> DataFrame:
    """A row for each of ``keys`` with, for each of ``picks`` (name: (value, rank)), the exact value at that rank of the values that aren't null, and ``n_<name>``, how many there are.

    Values are doubles, NaN counts as infinity. Groups of up to ``whole`` rows are sorted, dealt by key into ``tasks`` (see ``chunks.tasks_of``; with None all groups are bracketed). Larger ones, of which
    there are at most one for each ``whole`` rows, are told apart by one broadcast and their rows go nowhere: two passes over ``df`` give sketches, then counts. A group without values has no row.
    """
    values = list({str(v): v for v, _ in picks.values()}.values())
    at = {str(v): i for i, v in enumerate(values)}
    of = {n: at[str(v)] for n, (v, _) in picks.items()}
    column = lambda v: (v if isinstance(v, Column) else F.expr(v)).cast("double")
    flat = [f"_x{i}" for i in range(len(values))]
    clean = df.select(*keys, *[(F.when(F.isnan(column(v)), float("inf")).otherwise(column(v)) + 0.0).alias(x) for v, x in zip(values, flat, strict=True)])
    each = lambda some: some.select(*keys, F.posexplode(F.array(*flat)).alias("_v", "_x")).filter("_x IS NOT NULL")
    if tasks is None:
        return _bracketed(each(clean), keys, picks, of, accuracy, lambda sketches: sketches)
    large = F.broadcast(df.groupBy(*keys).agg(F.count("*").alias("_size")).filter(F.col("_size") > whole))
    rows = chunks.joined(clean, large, keys)
    small = rows.filter("_size IS NULL").select(*keys, *flat)
    small = small.repartition(tasks, *keys)
    return _sorted(each(small), keys, picks, of).unionByName(_bracketed(each(rows.filter("_size IS NOT NULL")), keys, picks, of, accuracy, F.broadcast))


def _sorted(rows: DataFrame, keys: list[str], picks: Picks, of: dict[str, int]) -> DataFrame:
    """``order_statistics`` of rows (keys, _v, _x) dealt by ``keys``."""
    by = Window.partitionBy(*keys, "_v")
    places = rows.withColumn("_i", F.row_number().over(by.orderBy("_x")) - 1).withColumn("_n", F.count("*").over(by))
    own = lambda name, c: F.when(F.col("_v") == of[name], c)
    chosen = {name: F.when(F.col("_i") == rank(F.col("_n")), F.col("_x")) for name, (_, (_, rank)) in picks.items()}
    return places.groupBy(*keys).agg(*[F.min(own(n, x)).alias(n) for n, x in chosen.items()], *[F.max(own(n, F.col("_n"))).alias(f"n_{n}") for n in picks])


def _bracketed(rows: DataFrame, keys: list[str], picks: Picks, of: dict[str, int], accuracy: int, met_by: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``order_statistics`` of rows (keys, _v, _x) of groups of any size: brackets by sketches, then counts within them."""
    by = [*keys, "_v"]
    # a bracket is wider than the sketch may err by three ranks at least, as a rank and its share differ by two at most
    wide, narrow = NEAR, 4 / accuracy
    cut = lambda x: min(1.0, max(0.0, x))
    cuts = sorted({cut(share + d) for _, (share, _) in picks.values() for d in (-wide, -narrow, narrow, wide)})
    sketch = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.percentile_approx("_x", cuts, accuracy).alias("_q"))
    n = F.col("_n")

    def bracket(k: int, share: float, rank: Callable[[Column], Column], value: int) -> list[Column]:
        at = lambda d: F.col("_q")[cuts.index(cut(share + d))]
        end = lambda whole, sign: F.when(n <= FEW, F.col(whole)).when(n <= accuracy, at(sign * wide)).otherwise(at(sign * narrow))
        own = lambda c: F.when(F.col("_v") == value, c)
        return [own(rank(n).cast("long")).alias(f"_r{k}"), own(end("_lo", -1)).alias(f"_low{k}"), own(end("_hi", 1)).alias(f"_high{k}")]

    brackets = [c for k, (name, (_, (share, rank))) in enumerate(picks.items()) for c in bracket(k, share, rank, of[name])]
    met = chunks.joined(rows, met_by(sketch.select(*by, "_n", *brackets)), by).filter("_n IS NOT NULL")
    x, ks = F.col("_x"), range(len(picks))
    bits = lambda test: sum((F.when(test(k), 1 << k).otherwise(0) for k in ks), F.lit(0))
    below, inside = bits(lambda k: x < F.col(f"_low{k}")), bits(lambda k: x.between(F.col(f"_low{k}"), F.col(f"_high{k}")))
    met = met.select(*by, "_n", *[f"_r{k}" for k in ks], below.alias("_below"), inside.alias("_inside"), "_x")
    # values within a bracket one by one, all others by what they are below
    met = met.withColumn("_x", F.when(F.col("_inside") != 0, F.col("_x")))
    counts = met.groupBy(*by, "_x", "_below", "_inside").agg(F.count("*").alias("_c"), F.max("_n").alias("_n"), *[F.max(f"_r{k}").alias(f"_r{k}") for k in ks])
    bit = lambda c, k: F.col(c).bitwiseAND(F.lit(1 << k)) != 0
    each = F.array(*[F.struct(F.lit(k).alias("_k"), F.col(f"_r{k}").alias("_r"), bit("_below", k).alias("_b"), bit("_inside", k).alias("_i")) for k in ks])
    each = counts.select(*by, "_n", "_c", "_x", F.inline(each)).filter("_b OR _i").withColumn("_x", F.when(F.col("_i"), F.col("_x")))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_k").orderBy("_x").rangeBetween(Window.unboundedPreceding, 0))
    found = each.withColumn("_upto", upto).filter(F.col("_x").isNotNull() & (F.col("_upto") > F.col("_r")))
    chosen = lambda k, x: F.when(F.col("_k") == k, x)
    return found.groupBy(*keys).agg(*[F.min(chosen(k, F.col("_x"))).alias(n) for k, n in enumerate(picks)], *[F.max(chosen(k, F.col("_n"))).alias(f"n_{n}") for k, n in enumerate(picks)])


def with_statistics(df: DataFrame, keys: list[str], tasks: int | None = None, **picks) -> DataFrame:
    """``df`` with the ``order_statistics`` of each row's group."""
    return chunks.joined(df, order_statistics(df, keys, picks, tasks=tasks).select(*keys, *picks), keys)


def ratio(a: Column, b: Column) -> Column:
    """a / b with 0/0 = 1 and x/0 = infinity."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(a == 0, 1.0).otherwise(float("inf"))


def exact_median_upper(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median_upper), nulls left out."""
    return order_statistics(df, [key], {"median_upper": (value, upper())}).select(key, "median_upper")


def line(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares y = intercept + slope x; a degenerate x gives slope null and ``degenerate``; one point gives (y, 0)."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"), F.avg(y).alias("_m"), (F.var_pop(x) == 0).alias("degenerate")).select(
        *keys, F.when(F.col("n") == 1, 0.0).otherwise(F.col("slope")).alias("slope"), F.when(F.col("n") == 1, F.col("_m")).otherwise(F.col("intercept")).alias("intercept"), "n", "degenerate"
    )


def through_origin(x: str = "x", y: str = "y") -> tuple[Column, Column]:
    """(slope through the origin, Pearson's r)."""
    return F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x)), F.corr(x, y)


def trimmed_origin_fit(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", knee: float = 3.0, least: int = 30, tasks: int | None = None) -> DataFrame:
    """Slope through the origin, once more without residuals over knee x 1.4826 x their upper median; ``ok`` where ``least`` samples are left."""
    first = df.groupBy(*keys).agg((F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("_k"))
    left = df.join(first, keys).withColumn("_r", F.abs(F.col(y) - F.col("_k") * F.col(x)))
    kept = with_statistics(left, keys, tasks, _m=("_r", upper())).filter(F.col("_r") <= knee * MAD * F.col("_m"))
    slope, r = through_origin(x, y)
    return kept.groupBy(*keys).agg(slope.alias("slope"), r.alias("r"), F.count("*").alias("n")).withColumn("ok", F.col("n") >= least)


def solve3(m: list[list[Column]], b: list[Column]) -> list[Column]:
    """Cramer's rule for three equations; null where the determinant is under 1e-12."""
    def det(a: list[list[Column]]) -> Column:
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    d = det(m)
    return [F.when(F.abs(d) >= 1e-12, det([[b[r] if c == k else m[r][c] for c in range(3)] for r in range(3)]) / F.when(F.abs(d) >= 1e-12, d)) for k in range(3)]


def plane(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", d: str = "d") -> DataFrame:
    """d = a + b x + c y by normal equations, one row a key: a, b, c, n."""
    cols = [F.lit(1.0), F.col(x), F.col(y)]
    sums = df.groupBy(*keys).agg(*[F.sum(p * q).alias(f"_m{i}{j}") for i, p in enumerate(cols) for j, q in enumerate(cols) if j >= i], *[F.sum(p * F.col(d)).alias(f"_b{i}") for i, p in enumerate(cols)], F.count("*").alias("n"))
    m = [[F.col(f"_m{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    a = solve3(m, [F.col(f"_b{i}") for i in range(3)])
    return sums.select(*keys, *[v.alias(n) for v, n in zip(a, "abc", strict=True)], "n")


def robust_plane(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", d: str = "d", knee: float = 2.5, least: int = 20) -> DataFrame:
    """``plane`` fitted once more without residuals over knee x 1.4826 x their upper median; fewer than ``least`` points give no row."""
    fit = plane(df, keys, x, y, d).filter(F.col("n") >= least).select(*keys, F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("c").alias("_c"))
    left = df.join(fit, keys).withColumn("_r", F.abs(F.col(d) - (F.col("_a") + F.col("_b") * F.col(x) + F.col("_c") * F.col(y))))
    return plane(with_statistics(left, keys, _m=("_r", upper())).filter(F.col("_r") <= knee * MAD * F.col("_m")), keys, x, y, d).filter(F.col("n") >= least)


def residual_shake(motion: DataFrame) -> DataFrame:
    """frames, median and 90th percentile of translation, median rotation in degrees, of measured rows (those with a dx and dy); one row for each series."""
    size = "sqrt(dx * dx + dy * dy)"
    found = order_statistics(motion.filter("ok"), ["series_id"], {"median_translation": (size, upper()), "p90_translation": (size, index(90)), "turn": ("abs(rotation)", upper())})
    return found.select("series_id", F.col("n_median_translation").alias("frames"), "median_translation", "p90_translation", F.degrees("turn").alias("median_rotation_deg"))


def correction_stats(corrections: DataFrame, boundary: int, scale: float = 1.0) -> DataFrame:
    """Means, maxima, clamped share and boundary against interior maximum; frame counts from 0 in each series."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    rows = corrections.withColumn("_m", F.hypot("dx", "dy") * scale).withColumn("_edge", (F.col("frame") < boundary) | (F.col("frame") >= n - boundary))
    out = rows.groupBy("series_id").agg(
        F.count("*").alias("frames"), F.avg("_m").alias("mean_translation"), F.max("_m").alias("max_translation"), F.avg(F.abs("rotation")).alias("mean_rotation"), F.max(F.abs("rotation")).alias("max_rotation"),
        F.count(F.when(F.col("clamped"), 1)).alias("clamped"), F.coalesce(F.max(F.when(F.col("_edge"), F.col("_m"))), F.lit(0.0)).alias("boundary_max"), F.coalesce(F.max(F.when(~F.col("_edge"), F.col("_m"))), F.lit(0.0)).alias("interior_max"),
    )
    return out.withColumn("clamped_fraction", F.col("clamped") / F.col("frames")).withColumn("boundary_ratio", ratio(F.col("boundary_max"), F.col("interior_max")))
