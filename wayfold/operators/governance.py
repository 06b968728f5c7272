"""Metadata governance: tags in containers and streams, identifying values, and a check that none survived in an output.

Findings are rows (file, stream, key, value); stream -1 is the container. Reports name keys, never values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Keys that describe a container, not a person or place; names and codecs that a muxer gives by itself.
TECHNICAL_KEYS = ("major_brand", "minor_version", "compatible_brands", "vendor_id", "handler_name", "language", "DURATION")
HANDLERS = ("VideoHandler", "SoundHandler", "SubtitleHandler", "TimeCodeHandler", "DataHandler")
HANDLER_OF = {"video": "VideoHandler", "audio": "SoundHandler", "subtitle": "SubtitleHandler", "timecode": "TimeCodeHandler", "data": "DataHandler"}
STILL_CODECS = ("mjpeg", "png", "bmp", "gif", "tiff", "webp", "targa")
ENCODER = "Lavf"
QUICKTIME_LOCATION = "com.apple.quicktime.location.ISO6709"


def tags(files: DataFrame) -> DataFrame:
    """Rows of files (file, global_tags MAP, streams ARRAY<STRUCT<tags MAP>>)."""
    own = files.select("file", F.lit(-1).alias("stream"), F.explode("global_tags").alias("key", "value"))
    each = files.select("file", F.posexplode("streams").alias("stream", "s")).select("file", "stream", F.explode("s.tags").alias("key", "value"))
    return own.unionByName(each)


def telling(found: DataFrame) -> DataFrame:
    """Without empty values and technical keys."""
    return found.filter((F.col("value") != "") & ~F.col("key").isin(*TECHNICAL_KEYS))


def own_key(key: Column, stream: Column) -> Column:
    """Keys of an output that a check of their own looks at: ``creation_time`` anywhere, ``encoder`` in the container only."""
    return F.when(key == "encoder", stream < 0).otherwise(key == "creation_time")


def identifying(found: DataFrame) -> DataFrame:
    """What a source tells, in order of stream and key. Nothing is left out for the keys an output writes itself: a value under one of them may turn up elsewhere in the output."""
    return telling(found).select("file", "stream", "key", "value").orderBy("file", "stream", "key")


def values(output: DataFrame) -> DataFrame:
    """(file, value), each once, of an output's keys but technical ones and those with a check of their own."""
    return telling(output).filter(~own_key(F.col("key"), F.col("stream"))).select("file", "value").distinct()


#: Characters of an identifying value that are looked up. A longer one is looked up by its first ones, and then compared.
ANCHOR = 64


def contained(source: DataFrame, output: DataFrame) -> DataFrame:
    """(file, value, found): each different identifying source value with each different output value of its file that contains it.

    The output's values are cut into their substrings of the lengths that the file's source values have, ``ANCHOR`` characters at most, and these are an equi-join key with the file: the work grows
    with the characters of the output, not with pairs of values. Texts go by their SHA-256 until they are compared.
    """
    needles = telling(source).select("file", "value").distinct().withColumn("_k", F.substring("value", 1, ANCHOR))
    lengths = needles.groupBy("file").agg(F.collect_set(F.char_length("_k")).alias("_l"))
    texts = values(output).select("file", F.col("value").alias("found"), F.unhex(F.sha2("value", 256)).alias("_t"))
    # pieces of two anchors' length, one anchor apart: a substring belongs to the piece in whose first half it begins
    at = F.explode(F.sequence(F.lit(0), F.floor((F.char_length("found") - 1) / ANCHOR).cast("int")))
    pieces = texts.join(lengths, "file").select("file", "_t", "_l", "found", at.alias("_i")).select("file", "_t", "_l", F.col("found").substr(F.col("_i") * ANCHOR + 1, F.lit(2 * ANCHOR)).alias("_p"))
    size = F.char_length("_p")
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.least(F.lit(ANCHOR), size - n + 1)), lambda i: F.col("_p").substr(i, n))
    spread = pieces.select("file", "_t", F.explode(F.flatten(F.transform(F.filter("_l", lambda n: n <= size), of_length))).alias("_k"))
    hits = spread.join(needles.select("file", "_k"), ["file", "_k"], "left_semi").distinct()
    both = hits.join(needles, ["file", "_k"]).join(texts, ["file", "_t"])
    return both.filter(F.col("found").contains(F.col("value"))).select("file", "value", "found")


def matches(source: DataFrame, output: DataFrame) -> DataFrame:
    """(file, stream, key, found): each identifying source value with every output value of its file that contains it."""
    return telling(source).join(contained(source, output), ["file", "value"]).select("file", "stream", "key", "found")


def survived(source: DataFrame, output: DataFrame) -> DataFrame:
    """One row for each identifying source value that some output value of the same file contains."""
    return telling(source).join(contained(source, output).select("file", "value"), ["file", "value"], "left_semi").select("file", "stream", "key").distinct()


def unexpected(output: DataFrame, named: DataFrame) -> DataFrame:
    """Output keys that are neither technical nor checked by themselves, but for those whose value (file, value in ``named``) a survivor's row has named already."""
    rest = telling(output).filter(~own_key(F.col("key"), F.col("stream")))
    return rest.join(named.select("file", "value"), ["file", "value"], "left_anti").select("file", "stream", "key").distinct()


def report(source: DataFrame, output: DataFrame) -> DataFrame:
    """(file, problem, where): an error for each survived value and for each unexpected key. Says which key, not what it held."""
    from ..functions import text

    kept, more = survived(source, output), unexpected(output, contained(source, output).select("file", F.col("found").alias("value")).distinct())
    where = text.describe_key(F.col("stream"), F.col("key"))
    return kept.select("file", F.lit("survived").alias("problem"), where.alias("where")).unionByName(more.select("file", F.lit("unexpected").alias("problem"), where.alias("where")))


def shape_problems(outputs: DataFrame) -> DataFrame:
    """(file, problem, where) of what else an output still tells, from rows (file, container, chapters INT, global_tags MAP,
    streams ARRAY<STRUCT<type, codec, nb_frames, attached_pic, tags MAP>>, timestamps ARRAY<STRUCT<box, creation, modification>>): creation times, languages and handlers that aren't the
    muxer's, tracks that are neither picture nor sound, still pictures beside a video, an encoder value, chapters, and header times that are missing or not zero. Nulls count as empty."""
    from ..functions import text

    maps = lambda c: F.coalesce(c, F.create_map().cast("map<string,string>"))
    streams, times = F.coalesce("streams", F.array().cast(outputs.schema["streams"].dataType)), F.coalesce("timestamps", F.array().cast(outputs.schema["timestamps"].dataType))
    own = outputs.select("file", F.coalesce("container", F.lit("")).alias("container"), F.coalesce("chapters", F.lit(0)).alias("chapters"), maps(F.col("global_tags")).alias("g"), streams.alias("s"), times.alias("t"))
    videos = F.size(F.filter("s", lambda s: s["type"] == "video"))
    count = lambda end: F.size(F.filter("t", lambda t: t["box"].endswith(end)))
    iso, tracks = text.iso_family(F.col("container")), F.size("s")
    problem = lambda cond, name, where: F.when(cond, F.struct(F.lit(name).alias("problem"), where.alias("where")))
    whole = [
        problem(F.map_contains_key("g", F.lit("creation_time")), "creation_time", F.lit("container")),
        problem(F.coalesce(F.col("g")["encoder"] != ENCODER, F.lit(False)), "encoder", F.lit("container")),
        problem(F.col("chapters") > 0, "chapters", F.col("chapters").cast("string")),
        problem(iso & (count("mvhd") == 0), "no movie header time", F.lit("container")),
        problem(iso & ((count(".tkhd") < tracks) | (count(".mdia.mdhd") < tracks)), "too few track header times", F.lit("container")),
    ]

    def of_stream(s: Column, i: Column) -> Column:
        tags, at = maps(s["tags"]), F.format_string("stream %d", i)
        picture = F.coalesce(s["attached_pic"], F.lit(False))
        still = (videos > 1) & (s["type"] == "video") & (F.coalesce(s["codec"].isin(*STILL_CODECS), F.lit(False)) | F.coalesce(s["nb_frames"] == "1", F.lit(False)))
        return F.array(
            problem(F.map_contains_key(tags, F.lit("creation_time")), "creation_time", at), problem(F.coalesce(tags["language"] != "und", F.lit(False)), "language", at),
            problem(F.coalesce(~tags["handler_name"].isin(*HANDLERS), F.lit(False)), "handler_name", at), problem(~F.coalesce(s["type"].isin("video", "audio"), F.lit(False)), "track", at),
            problem(picture, "attached picture", at), problem(~picture & still, "still image", at),
        )

    each = F.flatten(F.transform("s", of_stream))
    stamps = F.transform("t", lambda t: problem((t["creation"] != 0) | (t["modification"] != 0), "header time", t["box"]))
    found = F.filter(F.concat(F.array(*whole), each, stamps), lambda x: x.isNotNull())
    return own.select("file", F.inline(found))


def verified(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """(file, problem, where) of every way in which outputs (see ``shape_problems``) still tell where or when a clip was recorded; a clean file has no row."""
    return report(tags(sources), tags(outputs)).unionByName(shape_problems(outputs))


def summary(found: DataFrame) -> DataFrame:
    """file, n, keys: what a source tells, as text."""
    return telling(found).groupBy("file").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("keys"))


def source_summary(files: DataFrame) -> DataFrame:
    """(file, kinds): the kinds of things a source (see ``shape_problems``) tells, in a fixed order; empty where it tells nothing."""
    maps = lambda c: F.coalesce(c, F.create_map().cast("map<string,string>"))
    g = maps(F.col("global_tags"))
    told = F.map_filter(g, lambda k, v: (v != "") & ~k.isin(*TECHNICAL_KEYS))
    some = lambda test: F.exists(F.map_keys(told), test)
    own = lambda test: F.coalesce(F.exists("streams", lambda s: F.coalesce(test(maps(s["tags"])), F.lit(False))), F.lit(False))
    others = F.filter(F.transform("streams", lambda s: s["type"]), lambda t: ~t.isin("video", "audio"))
    tracks = F.transform(F.array_sort(F.array_distinct(others)), lambda t: F.format_string("%d %s track(s)", F.size(F.filter(others, lambda o: o == t)), t))
    kinds = F.array(
        F.when(F.map_contains_key(g, F.lit("creation_time")) | own(lambda t: F.map_contains_key(t, F.lit("creation_time"))), "creation_time"),
        F.when(some(lambda k: (F.lower(k) == "location") | F.lower(k).startswith("location-") | (k == QUICKTIME_LOCATION)), "location"),
        F.when(some(lambda k: F.lower(k) == "title"), "title"),
        *[F.when(F.map_contains_key(g, F.lit(k)), k) for k in ("make", "model", "artist", "comment")],
        F.when(F.col("chapters") > 0, F.format_string("%d chapter(s)", "chapters")),
    )
    more = F.array(
        F.when(own(lambda t: (t["language"] != "und") | ~F.coalesce(t["handler_name"], F.lit(HANDLERS[0])).isin(*HANDLERS)), "handlers or languages of streams"),
        F.when(F.exists("timestamps", lambda t: (t["creation"] != 0) | (t["modification"] != 0)), "header times"),
    )
    every = F.concat(kinds, F.coalesce(tracks, F.array().cast("array<string>")), more)
    return files.select("file", F.filter(every, lambda x: x.isNotNull()).alias("kinds"))


def lone_still(files: DataFrame) -> DataFrame:
    """Files whose only video stream is a still image: one frame, or an unknown number of them from a still codec."""
    videos = F.filter("streams", lambda s: s["type"] == "video")
    s = F.get(videos, F.lit(0))
    frames = F.coalesce(s["nb_frames"], F.lit(""))
    return files.filter((F.size(videos) == 1) & ((frames == "1") | ((frames == "") & F.coalesce(s["codec"].isin(*STILL_CODECS), F.lit(False))))).select("file")


#: Characters of needles that are looked for in one pass over the texts.
BLOCK = 4 << 20


def containing(texts: DataFrame, needles: DataFrame, key: str = "text", block: int = BLOCK) -> DataFrame:
    """Texts (id, text) that contain a needle (needle_id, needle): the containment join, with both ids.

    Needles are broadcast in blocks of ``block`` characters at most (or one needle), each an automaton that finds all of its needles in one pass over a text, so a text's cost doesn't grow
    with their number, and only pairs that match leave a task. The passes of several blocks are tasks of their own. An empty needle is in every text; nulls match nothing.
    """
    spark = texts.sparkSession
    kinds = [(c, f[k].dataType) for c, f, k in (("id", texts.schema, "id"), ("needle_id", needles.schema, "needle_id"))]
    schema = T.StructType([T.StructField(c, t) for c, t in kinds])
    arrow = pa.schema([(c, to_arrow_type(t)) for c, t in kinds])

    def searched(found: dict[str, list]) -> DataFrame:
        held = spark.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for needle in held.value:
                if needle:
                    machine.add_word(needle, needle)
            machine.make_automaton()
            everywhere = held.value.get("", [])
            for batch in batches:
                ids, needle_ids = [], []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if t is not None:
                        hits = {n for _, n in machine.iter(t)} if len(machine) else ()
                        each = [*everywhere, *(x for n in hits for x in held.value[n])]
                        ids += [i] * len(each)
                        needle_ids += each
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow.types[0]), pa.array(needle_ids, arrow.types[1])], schema=arrow)

        return texts.select("id", key).mapInArrow(run, schema)

    passes: list[DataFrame] = []
    found: dict[str, list] = {}
    size = 0
    for r in needles.filter("needle IS NOT NULL").select("needle_id", "needle").toLocalIterator():
        if found and size + len(r["needle"]) > block:
            passes.append(searched(found))
            found, size = {}, 0
        found.setdefault(r["needle"], []).append(r["needle_id"])
        size += len(r["needle"])
    passes.append(searched(found))
    return reduce(DataFrame.unionByName, passes)


def option_mismatches(was: DataFrame, now: DataFrame, keys: list[str], options: list[str]) -> DataFrame:
    """(keys, option, was, now) where a cached analysis and a request differ; null equals null."""
    both = was.alias("a").join(now.alias("b"), keys)
    each = F.array(*[F.struct(F.lit(o).alias("option"), F.col(f"a.{o}").cast("string").alias("was"), F.col(f"b.{o}").cast("string").alias("now")) for o in options])
    return both.select(*keys, F.inline(each)).filter(~F.col("was").eqNullSafe(F.col("now")))
