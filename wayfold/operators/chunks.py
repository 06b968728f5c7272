"""Long series in pieces: running sums, carried values, ordered products and moving windows without a task that holds a whole series.

A series is cut into cells of ``width`` units of its axis (microseconds or frames). What a cell adds is worked out in the cell, cells are put in order by one short row each, and what came before a
cell is carried back to its rows. Without a ``width`` a series is one task: right for recordings, which their device bounds. ``width_for`` finds one where some series is long.

Rows of a cell are materialised between the two levels (``checkpoint``, in the folder that the cluster names), as both levels read them; without ``width`` all stays one lazy plan.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a chunk of positions, and rows from which a series is worth cutting.
CHUNK = 65_536
#: Frames of a cell, for series by frame.
FRAMES = 65_536
#: Rows of a task where rows are dealt by key (see ``tasks_of``), and rows from which another task is worth its start.
ROWS, LEAST = 250_000, 4096

Step = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def materialised(df: DataFrame) -> DataFrame:
    """``df`` in the session's checkpoint folder. A session on one machine without such a folder makes its own; on a cluster that is an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="wayfold-"))
    return df.checkpoint()


def width_for(df: DataFrame, keys: tuple[str, ...] = ("series_id",), at: str = "t", rows: int = CHUNK) -> int | None:
    """The width at which the densest series of over ``rows`` rows has about ``rows`` a cell; None if no series is so long. One job over two columns, one row comes to the driver."""
    each = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.max(at) - F.min(at) + 1).alias("span")).filter(F.col("n") > rows)
    found = each.agg(F.min(F.col("span") / F.col("n") * rows)).first()[0]
    return None if found is None else max(1, int(found))


def tasks_of(df: DataFrame, rows: int | None = None, most: int = ROWS) -> int:
    """Tasks for ``rows`` rows (those of ``df``, counted by one job, if not given) of at most about ``most`` each, for ``repartition``. Spark's own choice goes by bytes as they are written, and
    rows that compress well are many more in memory than there."""
    rows = df.count() if rows is None else rows
    return max(-(-rows // most), min(df.sparkSession.sparkContext.defaultParallelism, rows // LEAST), 1)


def cell(at: str, width: int | None) -> Column:
    return F.lit(0).cast("long") if width is None else F.coalesce(F.floor(F.col(at) / F.lit(width)), F.lit(-(1 << 62))).cast("long")  # rows without a time come first


def joined(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``cells``, a row for each of ``keys``; a null key is a key."""
    other = cells.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[c for c in cells.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return rows.join(other, on, "left").drop(*[f"_key_{i}" for i in range(len(keys))])


def running(df: DataFrame, steps: dict[str, Step], reads: tuple[str, ...] = (), keys: tuple[str, ...] = ("series_id",), order: tuple[str, ...] = ("t", "tie"), at: str = "t", width: int | None = None) -> DataFrame:
    """``df`` with running sums, in ``order``, of each ``step(before, own)``: ``own("x")`` is a row's x, ``before("x")`` that of the row before it in its series, null at the first. ``reads`` names what
    steps read of the row before. A null step adds nothing."""
    names, upto = list(steps), (Window.unboundedPreceding, 0)
    w = Window.partitionBy(*keys).orderBy(*order)
    own = lambda c: F.col(c)
    if width is None:
        rows = df.withColumns({f"_s_{n}": F.coalesce(f(lambda c: F.lag(c).over(w), own), F.lit(0)) for n, f in steps.items()})
        return rows.withColumns({n: F.sum(f"_s_{n}").over(w.rowsBetween(*upto)) for n in names}).drop(*[f"_s_{n}" for n in names])
    by = [*keys, "_cell"]
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_cell", cell(at, width)).withColumn("_first", F.row_number().over(w) == 1)
    inner = {f"_s_{n}": F.when(F.col("_first"), F.lit(0)).otherwise(F.coalesce(f(lambda c: F.lag(c).over(w), own), F.lit(0))) for n, f in steps.items()}
    rows = materialised(rows.withColumns(inner).withColumns({n: F.sum(f"_s_{n}").over(w.rowsBetween(*upto)) for n in names}).drop(*inner))
    kept, place = F.struct(*[F.col(c) for c in dict.fromkeys([*reads, *df.columns])]), F.struct(*order)
    # the first and last row of each cell; a step over the edge belongs to the cell that it leads to
    ends = rows.groupBy(*by).agg(F.min_by(kept, place).alias("_lo"), F.max_by(kept, place).alias("_hi"), *[F.max_by(n, place).alias(f"_t_{n}") for n in names])
    cells = Window.partitionBy(*keys).orderBy("_cell")
    ends = ends.withColumn("_before", F.lag("_hi").over(cells))
    ends = ends.withColumns({f"_e_{n}": F.coalesce(f(lambda c: F.col(f"_before.{c}"), lambda c: F.col(f"_lo.{c}")), F.lit(0)) for n, f in steps.items()})
    carry = ends.select(*by, *[(F.sum(f"_e_{n}").over(cells.rowsBetween(*upto)) + F.coalesce(F.sum(f"_t_{n}").over(cells.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias(f"_c_{n}") for n in names])
    return joined(rows, carry, by).withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in names}).drop("_cell", "_first", *[f"_c_{n}" for n in names])


def around(df: DataFrame, value: str, forward: list[Column], back: list[Column], keys: tuple[str, ...] = ("series_id",), at: str = "t", width: int | None = None) -> DataFrame:
    """``df`` with ``_a``, the last ``value`` (not null) at or before a row in the order ``forward``, and ``_b``, the last in the order ``back``; both orders sort by ``at``, up and down."""
    by = list(keys) if width is None else [*keys, "_cell"]
    rows = df if width is None else df.withColumn("_cell", cell(at, width))
    known = lambda order: F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_a", known(forward)).withColumn("_b", known(back))
    if width is None:
        return rows
    # within a cell the last of either order is what the next cell begins with
    rows = materialised(rows.withColumn("_nf", F.row_number().over(Window.partitionBy(*by).orderBy(*forward))).withColumn("_nb", F.row_number().over(Window.partitionBy(*by).orderBy(*back))))
    ends = rows.groupBy(*by).agg(F.max_by("_a", "_nf").alias("_pa"), F.max_by("_b", "_nb").alias("_pb"))
    cells, before = Window.partitionBy(*keys), (Window.unboundedPreceding, -1)
    carry = ends.select(*by, F.last("_pa", ignorenulls=True).over(cells.orderBy("_cell").rowsBetween(*before)).alias("_ca"), F.last("_pb", ignorenulls=True).over(cells.orderBy(F.desc("_cell")).rowsBetween(*before)).alias("_cb"))
    return joined(rows, carry, by).withColumns({"_a": F.coalesce("_a", "_ca"), "_b": F.coalesce("_b", "_cb")}).drop("_cell", "_nf", "_nb", "_ca", "_cb")


def followed(df: DataFrame, value: str, keys: tuple[str, ...] = ("series_id",), order: tuple[str, ...] = ("t", "tie"), at: str = "t", width: int | None = None) -> DataFrame:
    """``df`` with ``_next``, the ``value`` (never null) of the row after a row in its series, null at the last; ``_lo``, the series' least ``at``; and ``_first``, which says that it is the first row."""
    by = list(keys) if width is None else [*keys, "_cell"]
    w, upto = Window.partitionBy(*by).orderBy(*order), (Window.unboundedPreceding, 0)
    rows = df if width is None else df.withColumn("_cell", cell(at, width))
    rows = rows.withColumn("_next", F.lead(value).over(w)).withColumn("_lo", F.min(at).over(w.rowsBetween(*upto))).withColumn("_first", F.row_number().over(w) == 1)
    if width is None:
        return rows
    rows = materialised(rows)
    cells = Window.partitionBy(*keys).orderBy("_cell")
    ends = rows.groupBy(*by).agg(F.min_by(value, F.struct(*order)).alias("_head"), F.min(at).alias("_low"))
    carry = ends.select(*by, F.lead("_head").over(cells).alias("_then"), F.min("_low").over(cells.rowsBetween(*upto)).alias("_start"))
    rows = joined(rows, carry, by).withColumns({"_next": F.coalesce("_next", "_then"), "_first": F.col("_first") & (F.col(at) == F.col("_start")), "_lo": F.col("_start")})
    return rows.drop("_cell", "_then", "_start")


def positions(df: DataFrame, keys: tuple[str, ...] = ("series_id",), order: tuple[str, ...] = ("t", "tie"), at: str = "t", width: int | None = None) -> DataFrame:
    """``df`` with ``_i``, the place of a row in its series from 0, and ``_n``, the series' rows."""
    if width is None:
        w = Window.partitionBy(*keys)
        return df.withColumn("_i", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("_n", F.count("*").over(w))
    rows = materialised(running(df, {"_i": lambda before, own: F.lit(1)}, keys=keys, order=order, at=at, width=width))
    return joined(rows, rows.groupBy(*keys).agg(F.max("_i").alias("_n")), list(keys)).withColumn("_i", F.col("_i") - 1)


def dealt(rows: DataFrame, radius: int, size: int = CHUNK) -> DataFrame:
    """``rows`` (with ``_i`` and ``_n``) by chunks of ``size`` positions: ``_c``, and ``_own``, which is false for the ``radius`` rows that a chunk borrows from its neighbours on either side."""
    size = max(size, 2 * radius + 1)
    of = lambda i: F.floor(i / size).cast("long")
    i, n = F.col("_i"), F.col("_n")
    spread = rows.withColumn("_c", F.explode(F.sequence(of(F.greatest(i - radius, F.lit(0))), of(F.least(i + radius, n - 1)))))
    return spread.withColumn("_own", F.col("_c") == of(i))


def by_groups(done: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over rows sorted by group, whose first column is the group's number: ``done(table, starts)`` gets many whole groups at once, and where each begins."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            g = held.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            if last := int(starts[-1]):  # the last group may go on in the next batch
                yield done(held.slice(0, last), starts[:-1])
                held = held.slice(last)
        if held is not None:
            yield done(held, np.zeros(1, np.int64))

    return work


def windowed(df: DataFrame, radius: int, values: tuple[str, ...], run: Callable[..., np.ndarray], keys: tuple[str, ...] = ("series_id",), order: tuple[str, ...] = ("t", "tie"), at: str = "t", width: int | None = None, size: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """``df`` with ``values`` replaced by ``run(values, i, n, starts)``: arrays of (rows x values), positions, lengths of series, and where groups begin. A group is a chunk of one series with
    ``radius`` rows about it, in order; what is returned for borrowed rows isn't used. A row's other columns pass by as they are.
    ``tasks`` is how many share the chunks (see ``tasks_of``); None leaves that to the session."""
    names = df.columns
    others = [c for c in names if c not in values]
    rows = dealt(positions(df, keys, order, at, width), radius, size)
    rows = rows.select(
        *keys, "_c", F.xxhash64(*keys, "_c").alias("_g"), "_i", "_n", *[F.col(v).cast("double").alias(f"_v_{v}") for v in values], F.when(F.col("_own"), F.struct(*[F.col(c) for c in others])).alias("_row")
    )
    rows = rows.repartition(*([tasks] if tasks else []), *keys, "_c").sortWithinPartitions(*keys, "_c", "_i").select("_g", "_i", "_n", "_row", *[f"_v_{v}" for v in values])
    first = 4

    def done(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        i, n = table.column(1).to_numpy(), table.column(2).to_numpy()
        got = run(np.stack([table.column(first + k).to_numpy() for k in range(len(values))], 1), i, n, starts)
        own = pc.is_valid(table.column(3))
        keep = own.to_numpy()
        out = table.column(3).filter(own).combine_chunks()
        if isinstance(out, pa.ChunkedArray):
            out = out.chunk(0) if out.num_chunks else pa.array([], out.type)
        return pa.RecordBatch.from_arrays([out, *[pa.array(got[keep, k], from_pandas=table.column(first + k).null_count > 0) for k in range(len(values))]], ["_row", *[f"_v_{v}" for v in values]])

    schema = rows.select("_row", *[f"_v_{v}" for v in values]).schema
    out = rows.mapInArrow(by_groups(done), schema)
    return out.select(*[F.col(f"_v_{c}").alias(c) if c in values else F.col(f"_row.`{c}`").alias(c) for c in names])


def weighted(weights: np.ndarray, boundary: str) -> Callable[..., np.ndarray]:
    """For ``windowed``: sums of a row's neighbours by ``weights``. Beyond a series' ends stand its mirrored rows (``reflect``), its end rows (``clamp``) or the lines fitted to its ``radius`` end rows (``extrapolate``)."""
    r = len(weights) // 2

    def run(v: np.ndarray, i: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sizes = np.diff(np.append(starts, len(i)))
        begin = np.repeat(starts, sizes)
        low, high = begin, begin + np.repeat(sizes, sizes) - 1
        base = begin - i[begin]
        lines = fits(v, i, n, starts, sizes) if boundary == "extrapolate" else None
        out = np.zeros_like(v)
        for o, weight in zip(range(-r, r + 1), weights, strict=True):
            s = i + o
            if boundary == "reflect":
                period = np.maximum(2 * (n - 1), 1)
                s = np.mod(s, period)
                s = np.where(n == 1, 0, np.minimum(s, period - s))
            near = v[np.clip(base + np.clip(s, 0, n - 1), low, high)]
            if lines is not None:
                a, b, c, d = lines
                near = np.where((s < 0)[:, None], a + b * s[:, None], np.where((s >= n)[:, None], c + d * (s - n)[:, None], near))
            out += weight * near
        return out

    def fits(v: np.ndarray, i: np.ndarray, n: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Lines of the first and last rows of a series, for each row of its group: value at 0 and slope, value at n and slope."""
        found = []
        wide = np.minimum(r, n)
        for mask, x in ((i < wide, i), (i >= n - wide, i - n)):
            x, y = np.where(mask, x, 0).astype(float)[:, None], np.where(mask[:, None], v, 0.0)
            m, sx, sy, sxx, sxy = (np.add.reduceat(c, starts) for c in (mask.astype(float)[:, None], x, y, x * x, x * y))
            det = m * sxx - sx * sx
            slope = np.where(det == 0, 0.0, (m * sxy - sx * sy) / np.where(det == 0, 1.0, det))
            level = (sy - slope * sx) / np.where(m == 0, 1.0, m)
            found += [np.repeat(level, sizes, 0), np.repeat(slope, sizes, 0)]
        return found

    return run


def highest(radius: int) -> Callable[..., np.ndarray]:
    """For ``windowed``: the largest value within ``radius`` rows, from prefix and suffix maxima of blocks of the window's length: the work doesn't depend on ``radius``. NaN and null are passed over."""
    size = 2 * radius + 1

    def run(v: np.ndarray, i: np.ndarray, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.empty_like(v)
        for a, z in zip(starts, np.append(starts[1:], len(i)), strict=True):
            rows = z - a
            wide = np.full((-(-(rows + 2 * radius) // size) * size, v.shape[1]), -np.inf)
            wide[radius : radius + rows] = np.where(np.isnan(v[a:z]), -np.inf, v[a:z])
            blocks = wide.reshape(-1, size, v.shape[1])
            ahead = np.maximum.accumulate(blocks, 1).reshape(wide.shape)
            behind = np.maximum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(wide.shape)
            out[a:z] = np.maximum(behind[:rows], ahead[2 * radius : 2 * radius + rows])
        return np.where(np.isneginf(out), np.nan, out)

    return run


def prefix_products(m: np.ndarray, product: Callable[[np.ndarray, np.ndarray], np.ndarray], starts: np.ndarray | None = None) -> np.ndarray:
    """m[k] after ... after the first of its group, for every k, by doubling: as many products of whole arrays as the longest group's length has binary digits. Groups begin at ``starts`` (one, at 0)."""
    starts = np.zeros(1, np.int64) if starts is None else starts
    sizes = np.diff(np.append(starts, len(m)))
    place = np.arange(len(m)) - np.repeat(starts, sizes)
    out, d = m.copy(), 1
    while d < sizes.max(initial=0):
        later = np.flatnonzero(place >= d)
        out[later] = product(out[later], out[later - d])
        d *= 2
    return out


def folded(rows: DataFrame, product: Callable[[np.ndarray, np.ndarray], np.ndarray], identity: np.ndarray, width: int = FRAMES) -> DataFrame:
    """(series_id, frame, v) of every state: the identity at a series' first frame, and after each transition (series_id, frame, v array<double>; null turns nothing) what ``product(new, old)`` makes
    of it, at the frame of the next transition; the last state is at the last frame + 1.

    The product needn't commute. Cells of ``width`` frames are multiplied out apart, their products are put in order (a row a cell), and each cell's states begin from what came before it. A task
    multiplies many cells out at once.
    """
    spec = rows.select("series_id", "frame", "v").schema
    cells = rows.select("series_id", "frame", "v", F.floor(F.col("frame") / width).cast("long").alias("_cell"))
    size = identity.size

    def values(column: pa.ChunkedArray) -> np.ndarray:
        out = np.tile(identity.ravel().astype(float), (len(column), 1))
        out[pc.is_valid(column).to_numpy()] = pc.list_flatten(column).to_numpy().reshape(-1, size)
        return out.reshape(-1, *identity.shape)

    def lists(m: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(0, m.size + 1, size, dtype=np.int32), m.ravel())

    def flat(column: pa.ChunkedArray) -> pa.Array:
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)

    def whole(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ends = np.append(starts[1:], table.num_rows) - 1
        last = prefix_products(values(table["v"]), product, starts)[ends]
        return pa.RecordBatch.from_arrays([flat(table[c].take(ends)) for c in ("series_id", "_cell")] + [lists(last), flat(table["frame"].take(ends))], ["series_id", "_cell", "v", "last"])

    def begun(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        upto = prefix_products(values(table["v"]), product, starts)
        before, end = np.empty_like(upto), np.full(len(upto), -1)
        before[1:] = upto[:-1]
        before[starts] = identity
        at = np.append(starts[1:], table.num_rows) - 1
        end[at] = table["last"].to_numpy()[at]
        return pa.RecordBatch.from_arrays([flat(table["series_id"]), flat(table["_cell"]), lists(before), pa.array(end)], ["series_id", "_cell", "_before", "_end"])

    def states(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(starts, table.num_rows))
        first = starts + np.arange(len(starts))  # each cell's row of what came before it
        own = np.ones(table.num_rows + len(starts), bool)
        own[first] = False
        m = np.empty((len(own), *identity.shape))
        m[own], m[first] = values(table["v"]), values(table["_before"].take(starts))
        upto = prefix_products(m, product, first)
        row = np.repeat(starts, sizes + 1) + np.minimum(np.arange(len(own)) - np.repeat(first, sizes + 1), np.repeat(sizes, sizes + 1) - 1)
        frame, final = table["frame"].to_numpy()[row], first + sizes
        end = table["_end"].to_numpy()[starts]
        frame[final] = end + 1
        keep = np.ones(len(own), bool)
        keep[final] = end >= 0
        return pa.RecordBatch.from_arrays([flat(table["series_id"].take(row[keep])), pa.array(frame[keep], table["frame"].type), lists(upto[keep])], ["series_id", "frame", "v"])

    def run(df: DataFrame, by: list[str], order: str, done: Callable, schema: str | T.StructType) -> DataFrame:
        return df.repartition(*by).sortWithinPartitions(*by, order).select(F.xxhash64(*by).alias("_g"), *df.columns).mapInArrow(by_groups(done), schema)

    kind = spec["series_id"].dataType.simpleString()
    by, at = ["series_id", "_cell"], spec["frame"].dataType.simpleString()
    totals = run(cells, by, "frame", whole, f"series_id {kind}, _cell long, v array<double>, last {at}")
    carry = run(totals, ["series_id"], "_cell", begun, f"series_id {kind}, _cell long, _before array<double>, _end long")
    return run(joined(cells, carry, by), by, "frame", states, spec)
