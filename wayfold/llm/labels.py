"""A bounded sample of labelled documents, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int):
    """crc32 of the doc_id as text, modulo ``modulus``: tells learning from held-out rows."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def learning(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, y) of all labelled documents but those of the held-out remainder. A doc_id with several labels counts once (the largest); null labels and ids are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    return rows.filter(remainder(modulus) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))


def sampled(labels: DataFrame, column: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """At most ``most`` rows of ``learning``, half of them of each label if there are so many.

    The sample is the rows with the least hash of doc_id, so it is the same at every run. ``most`` bounds what is broadcast and learnt from.
    """
    rows = learning(labels, column, modulus, held_out)
    half = lambda y: rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
    return half(0).unionByName(half(1))
