"""Sinks: diagnostics CSV, GPX and SRT sidecars, reports and structured log lines. Text sinks are written in order, a file for each part."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import documents

DIAGNOSTICS = ("frame", "raw_x", "raw_y", "raw_rotation", "raw_scale", "smoothed_x", "smoothed_y", "smoothed_rotation", "smoothed_scale", "correction_dx", "correction_dy", "correction_rotation", "correction_scale", "clamped")


def diagnostics(corrections: DataFrame) -> DataFrame:
    """The fourteen columns of the report; scales are the exponent of their logarithms."""
    c = {
        "frame": F.col("frame"), "raw_x": F.col("x"), "raw_y": F.col("y"), "raw_rotation": F.col("angle"), "raw_scale": F.exp("log_scale"), "smoothed_x": F.col("s_x"), "smoothed_y": F.col("s_y"), "smoothed_rotation": F.col("s_angle"),
        "smoothed_scale": F.exp("s_log_scale"), "correction_dx": F.col("dx"), "correction_dy": F.col("dy"), "correction_rotation": F.col("rotation"), "correction_scale": F.col("scale"), "clamped": F.col("clamped"),
    }
    return corrections.select("series_id", *[c[n].alias(n) for n in DIAGNOSTICS])


def write_csv(df: DataFrame, path: str) -> None:
    """By series, in frame order, with a header in each file."""
    df.repartitionByRange("series_id").sortWithinPartitions("series_id", "frame").write.mode("overwrite").csv(path, header=True)


def gpx_points(points: DataFrame, cadence: int) -> DataFrame:
    """(series_id, clip_id, seg, ord, line): a track point a row; a new segment where the step is over the cadence."""
    w = Window.partitionBy("series_id", "clip_id").orderBy("pts")
    new = F.when(F.col("pts") - F.lag("pts").over(w) > cadence, 1).otherwise(0)
    rows = points.withColumn("_n", new).withColumn("seg", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    when = F.date_format(F.timestamp_micros("stamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.select("series_id", "clip_id", "seg", F.col("pts").alias("ord"), F.format_string('<trkpt lat="%.7f" lon="%.7f"><time>%s</time></trkpt>', "lat", "lon", when).alias("line"))


#: What stands around the points of a GPX document, fixed by the format.
GPX_HEAD, GPX_TAIL = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk>\n', "\n</trk></gpx>\n"


def gpx_pieces(points: DataFrame, cadence: int, document: Column) -> DataFrame:
    """Pieces (document, ord, text) for ``documents.write``: a point a piece, with what opens and closes its segment and its document. ``document`` names the file of a clip."""
    lines = gpx_points(points, cadence).withColumn("_d", document)
    w = Window.partitionBy("series_id", "clip_id", "seg").orderBy("ord")
    opened = F.when(F.lag("ord").over(w).isNull(), "<trkseg>\n").otherwise("")
    closed = F.when(F.lead("ord").over(w).isNull(), "\n</trkseg>").otherwise("")
    lines = lines.withColumn("line", F.concat(opened, F.col("line"), closed))
    return documents.joined_pieces(lines, F.col("_d"), [F.col("seg"), F.col("ord")], F.col("line"), GPX_HEAD, GPX_TAIL)


def cue_pieces(cues: DataFrame, document: Column) -> DataFrame:
    """Pieces (document, ord, text) of numbered cues (no, cue), which end with their own blank line."""
    return documents.joined_pieces(cues, document, [F.col("no")], F.col("cue"))


def gpx_documents(points: DataFrame, cadence: int) -> DataFrame:
    """(series_id, clip_id, text): one document a clip, as a row, for clips of bounded length; ``gpx_pieces`` has those of any length."""
    lines = gpx_points(points, cadence)
    segs = lines.groupBy("series_id", "clip_id", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("body"))
    segs = segs.select("series_id", "clip_id", "seg", F.concat(F.lit("<trkseg>\n"), F.col("body"), F.lit("\n</trkseg>")).alias("part"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "part"))), lambda x: x["part"]), "\n")
    return segs.groupBy("series_id", "clip_id").agg(F.concat(F.lit(GPX_HEAD), parts, F.lit(GPX_TAIL)).alias("text"))


def _stamp(us: Column) -> Column:
    ms = F.floor(us / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(F.pmod(ms, F.lit(3600000)) / 60000), F.floor(F.pmod(ms, F.lit(60000)) / 1000), F.pmod(ms, F.lit(1000)))


def srt_cues(points: DataFrame, body: Column, cadence: int) -> DataFrame:
    """(series_id, clip_id, no, cue): numbered cues that last to the next."""
    w = Window.partitionBy("series_id", "clip_id").orderBy("pts")
    end = F.coalesce(F.lead("pts").over(w), F.col("pts") + cadence)
    return points.withColumn("no", F.row_number().over(w)).withColumn("_e", end).select("series_id", "clip_id", "no", F.concat_ws("\n", F.col("no").cast("string"), F.concat(_stamp(F.col("pts")), F.lit(" --> "), _stamp(F.col("_e"))), body, F.lit("")).alias("cue"))


def dji_cues(points: DataFrame, cadence: int) -> DataFrame:
    """(series_id, clip_id, no, cue): cues of points (pts, stamp, lat, lon, elevation) with time and position in brackets, as cameras of drones write them. A point without a position has no cue;
    height above the start isn't known, and reads 0."""
    fix = points.filter("lat IS NOT NULL AND lon IS NOT NULL")
    w = Window.partitionBy("series_id", "clip_id").orderBy("pts")
    number = lambda c, d: text.fixed(F.col(c), d)
    when = F.date_format(F.timestamp_micros("stamp"), "yyyy-MM-dd HH:mm:ss.SSS")
    rows = fix.withColumn("no", F.row_number().over(w)).withColumn("_e", F.coalesce(F.lead("pts").over(w), F.col("pts") + cadence))
    body = F.concat(
        F.lit('<font size="28">FrameCnt: '), F.col("no").cast("string"), F.lit(f", DiffTime: {cadence // 1000}ms "), when, F.lit(" [latitude: "), number("lat", 6), F.lit("] [longitude: "), number("lon", 6),
        F.lit("] [rel_alt: 0.000 abs_alt: "), F.coalesce(number("elevation", 3), F.lit("0.000")), F.lit("] </font>"),
    )
    return rows.select("series_id", "clip_id", "no", F.concat_ws("\n", F.col("no").cast("string"), F.concat(_stamp(F.col("pts")), F.lit(" --> "), _stamp(F.col("_e"))), body, F.lit("")).alias("cue"))


def readable_body(distance: Column, rest: Column) -> Column:
    """Distance first, then the other fields, parted by bars."""
    return F.concat_ws(" | ", F.concat(text.fixed(distance / 1000, 2), F.lit(" km")), rest)


def first_cues(srt: Column, n: int) -> Column:
    """The first n cues of an SRT text."""
    return F.array_join(F.slice(F.split(srt, "\n\n"), 1, n), "\n\n")


def write_text(df: DataFrame, column: str, path: str) -> bool:
    """One line (or document) a row. What was there is replaced, with a warning; whether there was anything is returned."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    if there:
        warnings.warn(f"replacing an existing sidecar: {path.rstrip('/').rsplit('/', 1)[-1]}", stacklevel=2)
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
    return bool(there)


def log_lines(events: DataFrame) -> DataFrame:
    """(ts, level, message, fields MAP) as lines with fields in order of key, quoted where needed."""
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), text.quoted(e["value"])))
    return events.select(F.concat_ws(" ", F.date_format("ts", "HH:mm:ss.SSS"), F.rpad(F.upper("level"), 5, " "), "message", F.array_join(pairs, " ")).alias("value"))


def candidate_report(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy("place").select((F.col("place") + 1).alias("rank"), text.signed_offset(F.col("tau")).alias("offset"), F.format_string("%.3f", "score").alias("score"), F.format_string("%.1f", "energy").alias("energy"), F.format_string("%.0f", "turn").alias("turn"))


def quality_report(points: DataFrame) -> DataFrame:
    return points.orderBy("quality").select("quality", F.format_string("%.2f", "score").alias("score"), F.format_string("%.1f", F.col("bytes") / 1e6).alias("mb"))


def decline_report(found: DataFrame, candidates: DataFrame, n: int = 3) -> DataFrame:
    """One row, ``message``: why an estimate was declined, and its first ``n`` candidates, a line each."""
    line = F.format_string("candidate %d: offset %+.2fs score %.3f energy %.1f turn %.1f degrees", F.col("place") + 1, "tau", "score", "energy", "turn")
    lines = candidates.filter(F.col("place") < n).agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("l"))
    head = F.concat(F.lit("declined: "), F.col("reason"))
    return found.crossJoin(F.broadcast(lines)).select(F.concat_ws("\n", head, F.transform("l", lambda x: x["line"])).alias("message"))  # one row each
