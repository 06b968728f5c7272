"""Motion sidecars as Parquet: one header row a clip, and its transitions. Format version, source and counts are checked on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
HEADER = "clip_id string, version int, source string, width int, height int, fps double, frame_count int, sigma double, lens struct<kind:string,focal:double>"
TRANSITION = """clip_id string, frame int, dx double, dy double, rotation double, scale double, tracked int, inliers int, ok boolean, h array<float>, rs struct<shear:double,stretch:double>,
q struct<w:double,x:double,y:double,z:double>, mesh array<float>"""


def write(headers: DataFrame, transitions: DataFrame, path: str) -> None:
    """Narrows optional arrays to 32 bits; transitions lie by clip."""
    t = transitions.withColumns({c: F.col(c).cast("array<float>") for c in ("h", "mesh") if c in transitions.columns})
    headers.withColumn("version", F.lit(VERSION)).write.mode("overwrite").parquet(f"{path}/headers")
    t.repartition("clip_id").sortWithinPartitions("clip_id", "frame").write.mode("overwrite").parquet(f"{path}/transitions")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, transitions) of this version, with the schemas above."""
    headers = spark.read.schema(HEADER).parquet(f"{path}/headers").filter(F.col("version") == VERSION)
    return headers, spark.read.schema(TRANSITION).parquet(f"{path}/transitions").join(headers.select("clip_id"), "clip_id", "left_semi")


def read_for_source(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Those that belong to ``source``; empty frames where there are none."""
    headers, transitions = read(spark, path)
    mine = headers.filter(F.col("source") == source)
    return mine, transitions.join(mine.select("clip_id"), "clip_id", "left_semi")


def damaged(headers: DataFrame, transitions: DataFrame) -> DataFrame:
    """Clips whose transitions aren't frames 0 .. frame_count - 2, each once: (clip_id, declared, found)."""
    got = transitions.groupBy("clip_id").agg(F.count("*").alias("found"), F.countDistinct("frame").alias("_d"), F.max("frame").alias("_m"))
    both = headers.join(got, "clip_id", "left").withColumn("declared", F.greatest(F.col("frame_count") - 1, F.lit(0))).withColumn("found", F.coalesce("found", F.lit(0)))
    return both.filter((F.col("declared") != F.col("found")) | (F.col("_d") != F.col("found")) | (F.col("_m") >= F.col("declared"))).select("clip_id", "declared", "found")


def capabilities(transitions: DataFrame) -> DataFrame:
    """Which optional measurements a clip carries."""
    has = lambda c: F.bool_or(F.col(c).isNotNull())
    return transitions.groupBy("clip_id").agg(has("q").alias("rotations"), has("h").alias("perspective"), has("mesh").alias("mesh"), has("rs").alias("rolling_shutter"))
