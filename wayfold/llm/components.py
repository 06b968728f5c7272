"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Parts of a node's edges in a join, so that a hub's don't meet in one task.
SALTS = 16


def _with_least(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` (u, v) with m of ``low`` (u, m): a node's edges are dealt over ``SALTS`` parts, and its one row of ``low`` goes to each."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return dealt.join(low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "salt"]).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = _with_least(edges, low).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(u, v): for each node that isn't the least of its component, that least node. ``edges`` (u, v) join different nodes, in any direction.

    Each step is stored; steps go on until one changes nothing, and their number grows with the logarithm of the largest component (squared at worst). Only a count and a
    checksum reach the driver.
    """
    edges = common.stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    sum_ = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    seen = sum_(edges)
    while seen[0]:
        edges = common.stored(_small(_large(edges)), "edges")
        if (now := sum_(edges)) == seen:
            break
        seen = now
    return edges
