"""Points in spans, without comparing every point of a series with every span of it.

A span of length up to 2^k lies in two neighbouring cells of width 2^k at most. So spans are put in the cells of their own size, points in the cell of each size that some span has (64 at most, as lengths
are longs), and the two meet on (series, size, cell); only what shares a cell is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunks


def _cell(t: Column, level: Column) -> Column:
    return F.floor(t / F.pow(F.lit(2.0), level)).cast("long")


def within(points: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("series_id",), t: str = "t", start: str = "start", end: str = "end") -> DataFrame:
    """Every point with every span of its ``keys`` whose closed interval holds it: the columns of both. A span that ends before it starts, and nulls, hold nothing."""
    good = spans.filter(F.col(start) <= F.col(end))
    level = F.ceil(F.log2((F.col(end) - F.col(start) + 1).cast("double"))).cast("int")
    sized = good.withColumn("_level", level)
    cells = sized.withColumn("_cell", F.explode(F.sequence(_cell(F.col(start), F.col("_level")), _cell(F.col(end), F.col("_level")))))
    levels = sized.select("_level").distinct()  # 64 rows at most
    placed = points.filter(F.col(t).isNotNull()).crossJoin(F.broadcast(levels)).withColumn("_cell", _cell(F.col(t), F.col("_level")))
    met = placed.join(cells, [*keys, "_level", "_cell"]).drop("_level", "_cell")
    return met.filter(F.col(t).between(F.col(start), F.col(end)))


def covered(probes: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("series_id",), t: str = "t", start: str = "a", end: str = "b", name: str = "covered", width: int | None = None) -> DataFrame:
    """``probes`` with how much of all spans of their ``keys`` lies before ``t``, overlaps counted as often as they are.

    That is a line with a bend at each end of a span: its slope and level are running sums over ends and probes in order, so no probe meets a span.
    """
    rows = probes.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_s"), F.lit(0).cast("decimal(38,0)").alias("_p"), F.struct(*[F.col(c) for c in probes.columns]).alias("_row"))
    ends = [spans.filter(F.col(start) <= F.col(end)).select(*keys, F.col(c).alias("_t"), F.lit(0).alias("_kind"), F.lit(s).cast("long").alias("_s"), (F.col(c) * -s).cast("decimal(38,0)").alias("_p")) for c, s in ((start, 1), (end, -1))]
    both = rows.unionByName(ends[0].unionByName(ends[1]), allowMissingColumns=True)
    summed = chunks.running(both, {"_slope": lambda before, own: own("_s"), "_level": lambda before, own: own("_p")}, keys=keys, order=("_t", "_kind"), at="_t", width=width)
    amount = (F.col("_t") * F.col("_slope") + F.col("_level")).cast("long")
    return summed.filter("_kind = 1").select("_row.*", amount.alias(name))
