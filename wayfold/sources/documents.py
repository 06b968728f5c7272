"""A data source that writes text documents piece by piece: ``df.write.format("ordered_documents")`` after ``register``, or ``write``.

Rows (document, ord, text) of a document become one file, named by ``document``, in the order of ``ord``. A task streams its documents to files one after the other, so what it holds is a batch of rows,
never a document. Writing is in two phases: tasks write beside the target, under a name of their own attempt, and say what they wrote; only when all have done so are files moved to their places. A
failed task, or a failed job, leaves nothing at the target.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import files


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"].rstrip("/"), options.get("suffix", ""), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = files.located(self.path)
        context = TaskContext.get()
        own = f"{at}/{self.staging}/{context.taskAttemptId() if context else uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        moves, now, out = [], None, None
        try:
            for batch in iterator:
                names, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("document", "text"))
                for name, text in zip(names, texts, strict=True):
                    if name is None or "/" in name or name in ("", ".", ".."):
                        raise ValueError("a document needs a plain name")
                    if name != now:
                        if out is not None:
                            out.close()
                        now, temporary = name, f"{own}/{len(moves)}"
                        out = system.open_output_stream(temporary)
                        moves.append((temporary, f"{at}/{name}{self.suffix}"))
                    out.write((text or "").encode())
        finally:
            if out is not None:
                out.close()
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = files.located(self.path)
        moves = [m for message in messages if message is not None for m in message.moves]
        targets = [b for _, b in moves]
        if len(set(targets)) != len(targets):
            self.abort(messages)
            raise ValueError("a document was dealt to several tasks: partition rows by document")
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(at)):
                if not info.base_name.startswith("_staging-"):
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        for a, b in moves:
            if system.get_file_info(b).type != fs.FileType.NotFound:
                system.delete_file(b)
            system.move(a, b)
        system.delete_dir(f"{at}/{self.staging}")

    def abort(self, messages: list[Written | None]) -> None:
        system, at = files.located(self.path)
        if system.get_file_info(f"{at}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.staging}")


class OrderedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_documents"

    def schema(self) -> str:
        return "document string, ord long, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return DocumentWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OrderedDocuments)


def write(pieces: DataFrame, path: str, suffix: str = "", overwrite: bool = True) -> bool:
    """Writes pieces (document, ord, text) as a file for each document; rows are partitioned by document and sorted here. What was there is replaced, with a warning; whether there was anything is returned.
    Names end with ``suffix``; equal ``ord`` are in no certain order."""
    register(pieces.sparkSession)
    system, at = files.located(path)
    there = system.get_file_info(at).type == fs.FileType.Directory and bool(system.get_file_info(fs.FileSelector(at)))
    if there:
        warnings.warn(f"replacing existing sidecars: {path.rstrip('/').rsplit('/', 1)[-1]}", stacklevel=2)
    rows = pieces.select(F.col("document").cast("string").alias("document"), F.col("ord").cast("long").alias("ord"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("document").sortWithinPartitions("document", "ord")
    rows.write.format("ordered_documents").mode("overwrite" if overwrite else "append").option("suffix", suffix).save(path)
    return there


def joined_pieces(lines: DataFrame, document: Column, order: list[Column], line: Column, head: str = "", tail: str = "", between: str = "\n") -> DataFrame:
    """Pieces (document, ord, text) of documents whose lines are rows: ``head`` stands before the first line and ``tail`` after the last, in their pieces, so that no row holds more than a line."""
    rows = lines.select(document.cast("string").alias("document"), F.struct(*order).alias("_o"), line.alias("_l"))
    w = Window.partitionBy("document").orderBy("_o")
    rows = rows.withColumn("ord", F.row_number().over(w).cast("long")).withColumn("_last", F.lead("_o").over(w).isNull())
    text = F.concat(F.when(F.col("ord") == 1, head).otherwise(""), F.col("_l"), F.when(F.col("_last"), tail).otherwise(between))
    return rows.select("document", "ord", text.alias("text"))
