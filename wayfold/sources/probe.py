"""Container facts from probe JSON, listings and tool logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths, text

SCHEMA = """streams array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,nb_frames:string,r_frame_rate:string,avg_frame_rate:string,duration:string,
disposition:struct<attached_pic:int>,tags:map<string,string>,side_data_list:array<struct<rotation:double>>>>, format struct<format_name:string,duration:string,tags:map<string,string>>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, json): one row a file of probe output, of any length."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("json"))


def parse(df: DataFrame, column: str = "json") -> DataFrame:
    """Adds ``info``: the first video stream's size, rate, frames and rotation, whether there is audio, duration and creation time. N/A is unknown (0); no video stream gives null."""
    p = F.from_json(column, SCHEMA)
    rows = df.withColumn("_p", p)
    streams = F.col("_p.streams")
    video = F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), F.lit(0))
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    rate = F.when(text.rational_rate(F.coalesce(video["avg_frame_rate"], F.lit("0/0"))) > 0, text.rational_rate(video["avg_frame_rate"])).otherwise(text.rational_rate(F.coalesce(video["r_frame_rate"], F.lit("0/0"))))
    rotation = F.pmod(F.round(F.coalesce(F.get(F.filter(video["side_data_list"], lambda d: d["rotation"].isNotNull()), F.lit(0))["rotation"], video["tags"]["rotate"].try_cast("double"), F.lit(0.0))), F.lit(360)).cast("int")
    duration = F.when(number(F.col("_p.format.duration")) > 0, number(F.col("_p.format.duration"))).otherwise(number(video["duration"]))
    created = F.coalesce(F.col("_p.format.tags")["creation_time"], video["tags"]["creation_time"])
    info = F.struct(
        video["width"].alias("width"), video["height"].alias("height"), rate.alias("fps"), number(video["nb_frames"]).cast("long").alias("frames"), duration.alias("duration"), rotation.alias("rotation"),
        F.exists(streams, lambda s: s["codec_type"] == "audio").alias("has_audio"), F.col("_p.format.format_name").alias("container"), creation(created).alias("created"), is_naive(created).alias("naive"),
    )
    return rows.withColumn("info", F.when(video.isNotNull(), info)).drop("_p")


def creation(raw: Column) -> Column:
    """The instant of a creation time; one without a zone is read as UTC."""
    return F.coalesce(text.time_instant(raw), F.when(is_naive(raw), F.concat(F.replace(F.trim(raw), F.lit(" "), F.lit("T")), F.lit("Z")).try_cast("timestamp")))


def is_naive(raw: Column) -> Column:
    return F.trim(raw).rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?$")


def presented(info: str = "info") -> Column:
    return maths.presented_frames(F.col(f"{info}.frames"), F.col(f"{info}.duration"), F.col(f"{info}.fps"))


def problems(listing: DataFrame, extensions: tuple[str, ...] = (".mp4", ".mov", ".m4v")) -> DataFrame:
    """Every problem of a listing (path, length, is_dir) at once: (path, problems)."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    found = F.array_compact(F.array(F.when(F.col("is_dir"), "is a directory"), F.when(F.col("length") == 0, "is empty"), F.when(~suffix.isin(*extensions), "has an unknown extension")))
    return listing.withColumn("problems", found).filter(F.size("problems") > 0).select("path", "problems")


def progress(lines: DataFrame, column: str = "value") -> DataFrame:
    """frame numbers of progress output (batch or stream of text lines)."""
    return lines.select(F.regexp_extract(column, r"^frame=\s*(\d+)", 1).alias("frame")).filter("frame <> ''").select(F.col("frame").cast("long").alias("frame"))


def scores(logs: DataFrame, column: str = "value") -> DataFrame:
    return logs.withColumn("score", text.score_in(F.col(column)))
