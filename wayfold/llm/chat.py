"""Chat formatting by cumulative-snapshot collapse (operator 1), DataFrame functions only.

A conversation that was logged again after each turn leaves snapshots that are prefixes of the longest one. The hash of a prefix is
rolled from turn to turn: two 60-bit lanes of SHA-256 over (position, role, text), summed. A conversation whose last prefix hash is
an inner prefix hash of another is a snapshot, and an anti-join takes it away; of equal conversations the least conv_id stays.

Turns are held in blocks of ``BLOCK`` turn numbers, so that one conversation with a large share of all turns is hashed and collapsed by many tasks:
only its blocks, not its turns, meet in one window. Blocks change no result: the blocks of a conversation that is kept are joined to one text.

Defined cases: null role or text counts as empty; turns are ordered by turn (nulls first), role, text; repeated rows count once; a null
conv_id is one conversation; every kept conversation is one row, whatever its number of turns and the gaps in their numbers (``piece`` is 0), unless ``chat_format(whole=False)`` asks for a row a
block, for conversations too long for a row; an empty table gives no rows;
columns besides conv_id, turn, role and text are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, blk, turns): the ordered distinct turns of each block."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.select("conv_id", F.floor(F.col("turn") / block).alias("blk"), row.alias("row")).groupBy("conv_id", "blk").agg(F.array_sort(F.collect_set("row")).alias("turns"))


def prefix_hashes(held: DataFrame) -> DataFrame:
    """(conv_id, p, total, a, b): for each turn, the hash of the conversation's first p turns, and its number of turns."""
    sizes = held.select("conv_id", "blk", F.size("turns").cast("long").alias("n"))
    order = Window.partitionBy("conv_id").orderBy(F.col("blk").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.select(
        "conv_id", "blk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("conv_id")).alias("total")
    )
    same = lambda x, y: F.col(f"{x}.conv_id").eqNullSafe(F.col(f"{y}.conv_id")) & F.col(f"{x}.blk").eqNullSafe(F.col(f"{y}.blk"))
    rows = held.select("conv_id", "blk", F.posexplode(F.transform("turns", lambda t: F.concat_ws("\x1f", t["role"], F.sha2(t["text"], 256)))).alias("r", "turn"))
    rows = rows.alias("t").join(at.alias("o"), same("t", "o")).select("t.conv_id", "t.blk", "r", "total", (F.col("offset") + F.col("r") + 1).alias("p"), "turn")
    hashed = F.sha2(F.concat_ws("\x1e", F.col("p").cast("string"), "turn"), 256)
    lane = lambda k: F.conv(F.substring("hash", k, 15), 16, 10).cast("decimal(20,0)")
    rows = rows.withColumn("hash", hashed).select("conv_id", "blk", "r", "total", "p", lane(1).alias("a"), lane(16).alias("b"))
    inner = Window.partitionBy("conv_id", "blk").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("conv_id", "blk").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)")
    sums = sums.select("conv_id", "blk", total("sa").alias("sa"), total("sb").alias("sb"))
    rolled = rows.select("conv_id", "blk", "p", "total", F.sum("a").over(inner).alias("a"), F.sum("b").over(inner).alias("b"))
    wide = lambda x, y: (F.col(x) + F.col(y)).cast("decimal(38,0)")
    return rolled.alias("t").join(sums.alias("o"), same("t", "o")).select("t.conv_id", "p", "total", wide("a", "sa").alias("a"), wide("b", "sb").alias("b"))


def maximal(hashes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that no longer one begins with, one of each set of equals."""
    inner = hashes.filter("p < total").select("p", "a", "b").distinct()
    last = hashes.filter("p = total").groupBy("p", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    return last.join(inner, ["p", "a", "b"], "left_anti").select("conv_id", F.col("p").alias("n_turns"), "n_copies")


def render(held: DataFrame, kept: DataFrame, whole: bool = True) -> DataFrame:
    """Each kept conversation in chat markup, its blocks joined in order (or, if not ``whole``, a row each, in the order of ``piece``); a marker within a text is broken up by a space."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(OPEN), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(CLOSE + "\n"))), "")
    rows = held.join(kept.withColumnRenamed("conv_id", "kept_id"), F.col("conv_id").eqNullSafe(F.col("kept_id"))).select("conv_id", "n_turns", "n_copies", "blk", text.alias("text"))
    if not whole:
        piece = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("blk").asc_nulls_first())) - 1
        return rows.select("conv_id", piece.cast("long").alias("piece"), "n_turns", "n_copies", "text")
    first = F.coalesce(F.max(F.when(F.col("blk").isNull(), F.col("text"))), F.lit(""))
    rest = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("blk").isNotNull(), F.struct("blk", "text")))), lambda b: b["text"]), "")
    return rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.concat(first, rest).alias("text")).select("conv_id", F.lit(0).cast("long").alias("piece"), "n_turns", "n_copies", "text")


def chat_format(turns: DataFrame, block: int = BLOCK, whole: bool = True) -> DataFrame:
    """conv_id, piece, n_turns, n_copies, text of every maximal conversation."""
    spark = turns.sparkSession
    begun = common.mark(spark)
    held = common.stored(blocks(turns.select("conv_id", "turn", "role", "text"), block), "turn-blocks")
    kept = common.stored(maximal(common.stored(prefix_hashes(held), "prefix-hashes")), "maximal-conversations")
    common.release(spark, begun, (held, kept))
    return render(held, kept, whole)


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP1_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, list(role || chr(31) || text ORDER BY p) AS turns,
             string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY p) AS text FROM n GROUP BY conv_id),
i AS (SELECT DISTINCT c.turns[1:k] AS pre FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c) AS c),
f AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns)
SELECT f.conv_id, 0::BIGINT AS piece, c.n_turns, f.n_copies, c.text FROM f JOIN c ON c.conv_id = f.conv_id WHERE f.turns NOT IN (SELECT pre FROM i)
"""
