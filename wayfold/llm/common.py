"""Small helpers that the text operators share."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the one given to ``SparkContext.setCheckpointDir``, with the scheme of the file system that Spark has it on.

    Without either a session on one machine (master ``local``) makes its own; on a cluster that is an error, as each executor would write to its own disk.
    """
    if not (found := getattr(spark, "_wayfold_dir", None)):
        context = spark.sparkContext
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = spark._jvm.org.apache.hadoop.fs.Path(named or "file://" + tempfile.mkdtemp(prefix="wayfold-"))
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
        found = found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found
        spark._wayfold_dir = found
    return found


def _paths(spark: SparkSession) -> list[str]:
    if not hasattr(spark, "_wayfold_paths"):
        spark._wayfold_paths = []
    return spark._wayfold_paths


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths(spark).append(path)
    return path


def mark(spark: SparkSession) -> int:
    """For ``release``: what is stored from now on."""
    return len(_paths(spark))


def release(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the tables stored after ``mark`` gave ``since``, but for those of ``keep``. Only frames that don't read them may still be used."""
    paths, kept = _paths(spark), {getattr(df, "_wayfold_path", None) for df in keep}
    for path in [p for p in paths[since:] if p not in kept]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        paths.remove(path)


def clean_up(spark: SparkSession) -> None:
    """Deletes all tables that this session has stored. Call it when their results have been written: frames made from them can't be read after it."""
    release(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage is cut there, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._wayfold_path = path
    return out


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (file sizes for a scan); no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, mb: int = 64) -> int:
    """Partitions of about ``mb`` MB of the plan's estimated size, and no fewer than the session's shuffle partitions (which hold alone where Catalyst has no estimate)."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    return max(least, math.ceil(size / (mb << 20))) if size < 1 << 55 else least


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def row_key(column: str = "text"):
    """Tells rows that share a doc_id apart; rows alike in doc_id and text get the same decision."""
    return F.xxhash64(text_or_empty(column))


def packed(docs: DataFrame):
    """All columns as one struct: beside it an operator's own columns clash with none of them, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def unpacked(rows: DataFrame) -> DataFrame:
    """The columns that ``packed`` has put together."""
    return rows.select("row.*")


#: Rows of a keyed table that a broadcast may have.
SMALL = 200_000


def joined(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner", small: int = SMALL) -> DataFrame:
    """``rows`` with the columns of ``keyed`` (a stored table, one short row a key). Up to ``small`` rows are broadcast, so that a hot key's rows stay where they are; a larger table
    is joined by two plain exchanges, which adaptive execution splits where a key is hot."""
    return rows.join(F.broadcast(keyed) if keyed.count() <= small else keyed, key, how)


def plain(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without copying the text; a null is an empty text."""
    array = plain(array)
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(len(array) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(batch: pa.RecordBatch, column: str, most: int):
    """Pieces of ``batch`` whose ``column`` holds at most ``most`` bytes of text (one row at least): bounds a worker's memory."""
    at, _ = utf8(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
