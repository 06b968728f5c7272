"""A corpus made ready for training: five stages, each reading what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``docs``. ``run`` deletes a stage's input and working tables once its output is written.

Defined cases: a null text is empty in every stage; rows that share a doc_id are documents of their own; of rows alike in doc_id and text one stays (they are near duplicates); a null
doc_id is kept as any other; without documents there are no rows; ties are broken by doc_id, then a hash of the text; columns of any name are carried through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import common, decontamination, lines, near_dup, packing, quality

#: No SQL trains a classifier, aligns or packs; tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours vote for quality; the labels are those of ``sf_dir``, learnt from the documents at hand."""
    return docs.filter(quality.quality_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")) >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines of three-line windows that came before."""
    return lines.line_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences and offsets."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = common.mark(spark)
    for name, stage in STAGES[:-1]:
        out = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        common.release(spark, begun, (out,))
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
