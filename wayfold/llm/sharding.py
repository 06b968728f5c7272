"""Sharding along a Hilbert curve (operator 13).

Several metadata of a row are quantised to 2^``bits`` steps of about equal weight each, the steps make a cell of a grid, and rows are sorted by the cell's place on the Hilbert curve. Runs of that
order are the shards: neighbours on the curve are neighbours in every dimension, so a shard covers a narrow range of each, and a filter on any of them leaves most files unread (``manifest``, ``touched``).

The sort is a range partitioning of the keys alone (no text); each range is numbered by itself and begins after the counts of those before it. Runs are cut by rank, so the number of rows differs by one at
most from shard to shard, whatever cells are crowded: rows of one cell are ordered by doc_id, a checksum and their place in the scan, so that a cell can be cut anywhere.

Defined cases: null text has no bytes (size 1, checksum 0); a null of any dimension is below all values; a null doc_id, rows that share one and repeated rows are rows of their own, in an order that is settled once;
equal texts with equal metadata are neighbours; fewer rows than shards leave shards empty; an empty table gives no rows; a text of any length counts by its bytes; columns of any name are carried as one struct by ``sharded``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS, BITS = 16, 8
DIMENSIONS = ("lang", "source", "size", "doc_id")
#: Accuracy of the quantiles that steps are cut at: a sketch of this size for each dimension.
ACCURACY = 10_000


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``axes`` (rows x dimensions, 0 to 2^bits - 1), by Skilling's transposition (2004); dimensions x bits up to 62."""
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    if n * bits > 62:
        raise ValueError(f"{n} dimensions of {bits} bits don't fit a long")
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def ordinal(column: Column, kind: str) -> Column:
    """A long in the order of the column's values: a string by its first seven bytes, a time by its microseconds, a number times 1024."""
    if kind in ("string", "binary"):
        return F.conv(F.rpad(F.hex(F.substring(column.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(column.cast("timestamp"))
    if kind == "boolean":
        return column.cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return column.cast("long")
    return F.floor(F.least(F.greatest(column.cast("double"), F.lit(-9e15)), F.lit(9e15)) * 1024).cast("long")


def _keys(docs: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """id, size, text_crc32, seq (the row's place in the scan) and d0, d1, ...: the dimensions as longs; and the row, as one struct."""
    kinds = dict(docs.dtypes)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    axis = lambda c: size if c == "size" else ordinal(F.col(f"`{c}`"), kinds[c])
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), size.alias("size"), F.crc32(common.text_or_empty().cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("seq"),
        *[axis(c).alias(f"d{i}") for i, c in enumerate(dimensions)], common.packed(docs),
    )


def _steps(keys: DataFrame, n: int, bits: int) -> list[list[int]]:
    """Where the steps of each dimension are cut: its 2^bits - 1 quantiles, of one pass with a sketch each. A frequent value is several of them, so that a dimension of few values spans its axis too."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    got = keys.agg(*[F.percentile_approx(f"d{i}", shares, ACCURACY).alias(f"c{i}") for i in range(n)]).first()
    return [sorted(got[f"c{i}"] or []) for i in range(n)]


def ranked(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, carry: bool = False) -> tuple[DataFrame, int]:
    """(id, size, text_crc32, d0.., curve, rank) of every row in the order of the curve, ranks gapless from 0, and the number of rows; with ``carry`` the row as well. Stored, so ranks stand."""
    spark, n = docs.sparkSession, len(dimensions)
    keys = _keys(docs, dimensions) if carry else _keys(docs, dimensions).drop("row")
    cuts = _steps(keys, n, bits)

    @F.pandas_udf("long")
    def curve(*axes: pd.Series) -> pd.Series:
        # a null is step 0; another value's step is the number of cuts that it reaches
        step = [np.where(a.isna(), 0, np.searchsorted(np.array(c, np.int64), a.fillna(-(1 << 62)).to_numpy(np.int64), side="right")) for a, c in zip(axes, cuts, strict=True)]
        return pd.Series(hilbert_index(np.minimum(np.stack(step, 1), (1 << bits) - 1), bits))

    order = ["curve", "id", "text_crc32", "size", "seq"]
    placed = keys.withColumn("curve", curve(*[F.col(f"d{i}") for i in range(n)]))
    parts = common.partitions_for(placed) if carry else int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    runs = common.stored(runs, "curve")
    part = F.shiftright("at", 33)
    counts = sorted((r["part"], r["count"]) for r in runs.groupBy(part.alias("part")).count().collect())  # a row for each range
    begins, total = {}, 0
    for p, c in counts:
        begins[p], total = total, total + c
    before = spark.createDataFrame(list(begins.items()), "part long, begin long")
    out = runs.withColumn("part", part).join(F.broadcast(before), "part")  # a row for each range
    return out.withColumn("rank", F.col("begin") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "begin", "at", "seq"), total


def _cut(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """shard and slot of each rank: shard s has the ranks from ceil(s n / shards) on."""
    rows = rows.withColumn("shard", F.expr(f"CAST(rank * {shards}L div {max(1, total)}L AS INT)"))
    return rows.withColumn("slot", F.expr(f"rank - (shard * {total}L + {shards - 1}L) div {shards}L"))


def shards(docs: DataFrame, count: int = SHARDS, **how) -> DataFrame:
    """(id, size, text_crc32, shard, slot, ...) of every row."""
    rows, total = ranked(docs, **how)
    return _cut(rows, total, count)


def write_shards(docs: DataFrame, path: str, count: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Whole rows as Parquet in ``path``/rows, a folder for each shard, in the order of the curve. Returns the manifest: shard, rows, bytes, and the bounds of each dimension, ``low_<name>`` and ``high_<name>``, as longs of ``ordinal``."""
    rows, total = ranked(docs, dimensions, bits, carry=True)
    rows = _cut(rows, total, count)
    flat = rows.select("shard", "slot", "row.*") if not {"shard", "slot"} & set(docs.columns) else rows.select("shard", "slot", "row")
    flat.repartitionByRange(max(count, common.partitions_for(flat)), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/rows")
    bounds = [f(f"d{i}").alias(f"{n}_{c}") for i, c in enumerate(dimensions) for n, f in (("low", F.min), ("high", F.max))]
    rows.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *bounds).write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.parquet(f"{path}/manifest")


def touched(manifest: DataFrame, **ranges: tuple) -> DataFrame:
    """The rows of ``manifest`` whose shards may hold rows with each dimension within its (low, high); an end that is None is open. Values are as in the table."""
    spark = manifest.sparkSession
    for name, ends in ranges.items():
        for end, column, below in zip(ends, (f"high_{name}", f"low_{name}"), (True, False), strict=True):
            if end is not None:
                kind = spark.createDataFrame([(end,)], ["v"])
                place = kind.select(ordinal(F.col("v"), dict(kind.dtypes)["v"])).first()[0]
                manifest = manifest.filter(F.col(column) >= place if below else F.col(column) <= place)
    return manifest


def op13_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("curve"))

