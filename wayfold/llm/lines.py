"""Line dedup over overlapping three-line windows (operator 7).

Every three consecutive lines of a text are hashed (128 bits); a window met before, in the order of doc_id and then line, is a later
occurrence, and the lines that later occurrences cover are removed. The first occurrence of every window stays.

Defined cases: a text of fewer than three lines is left alone; null text stays null; rows that share a doc_id count as documents
ordered by a hash of their text, and rows alike in doc_id and text get one decision, so neither is the other's later occurrence;
null doc_ids come first; an empty table gives no rows; a text of any length is taken whole; columns of any name are carried through.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPAN = 3
KEPT = "text string, n_lines int, n_removed int"


def windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, key, i, h): a row for each window of ``span`` lines."""
    lines = docs.select("doc_id", common.row_key().alias("key"), F.split(common.text_or_empty(), "\n", -1).alias("lines")).filter(F.size("lines") >= span)
    # lines hold no line feed, so the joined window is unambiguous
    hashed = F.transform(F.sequence(F.lit(0), F.size("lines") - span), lambda i: F.struct(i.alias("i"), F.unhex(F.md5(F.array_join(F.slice("lines", i + 1, span), "\n"))).alias("h")))
    return lines.select("doc_id", "key", F.inline(hashed))


def later(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, key, hits): the first lines of windows that are later occurrences, for each document that has any.

    Windows are counted with partial aggregation, so a window that a third of all lines form arrives as one row a task. The
    repeated ones are stored; the join that finds their later occurrences then reads two plain exchanges, which adaptive
    execution splits where one window is hot.
    """
    every = windows(docs, span)
    first = every.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "i")).alias("first")).filter("n > 1").select("h", "first")
    first = common.stored(first, "repeated-windows")
    hits = every.join(first, "h").filter(~F.struct("doc_id", "key", "i").eqNullSafe(F.col("first")))
    return hits.groupBy("doc_id", "key").agg(F.collect_set("i").alias("hits"))


def _keeper(span: int):
    @F.pandas_udf(KEPT)
    def keep(text: pd.Series, hits: pd.Series) -> pd.DataFrame:
        out = []
        for t, h in zip(text, hits, strict=True):
            if t is None or h is None:
                out.append((None, 0, 0))
                continue
            lines, kept, at = t.split("\n"), [], 0
            for i in sorted(h):  # merge what the windows cover
                kept += lines[at:i]
                at = max(at, i + span)
            kept += lines[at:]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    return keep


def dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``kept`` (text, n_lines, n_removed): the text without lines that later occurrences cover."""
    hits = later(docs, span).select(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"), "hits")
    left = docs.select(common.packed(docs), F.col("doc_id").alias("id"), common.row_key().alias("key"))
    both = left.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left").withColumn("own", F.col("row").getField("text"))  # the text is exchanged once, in the row
    cut = _keeper(span)(F.when(F.col("hits").isNotNull(), F.col("own")), F.col("hits"))
    whole = F.struct(F.col("own").alias("text"), F.size(F.split(common.text_or_empty("own"), "\n", -1)).alias("n_lines"), F.lit(0).alias("n_removed"))
    return both.withColumn("cut", cut).select("row", F.when(F.col("hits").isNull(), whole).otherwise(F.col("cut")).alias("kept"))


def line_dedup(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs``, same columns and rows, with the text (and n_chars, where there is one) of what is kept."""
    new = {"text": F.col("kept.text")} | ({"n_chars": F.length("kept.text").cast("long")} if "n_chars" in docs.columns else {})
    return dedup(docs, span).select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("row.doc_id", F.col("kept.n_lines").cast("long").alias("n_lines"), F.col("kept.n_removed").cast("long").alias("n_removed"), F.coalesce("kept.text", F.lit("")).alias("text"))


OP7_SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM w),
c AS (SELECT DISTINCT doc_id, i + s AS j FROM r, (VALUES (0), (1), (2)) AS v(s) WHERE k > 1),
x AS (SELECT doc_id, j, line FROM (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS j, unnest(ls) AS line FROM l)),
k AS (SELECT x.doc_id, count(*) AS n_lines, count(c.j) AS n_removed, string_agg(x.line, chr(10) ORDER BY x.j) FILTER (WHERE c.j IS NULL) AS text
      FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.j = c.j GROUP BY x.doc_id)
SELECT doc_id, n_lines, n_removed, coalesce(text, '') AS text FROM k
"""
