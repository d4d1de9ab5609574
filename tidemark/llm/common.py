"""What the corpus operators share: reading tables, cutting lineage, mapping texts in Arrow."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tokens import chunks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors share: the session's spark.checkpoint.dir.

    Where that is unset a folder of this machine serves only if Spark runs in this one process, as in tests; on a cluster that would lose data.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: the executors need a folder that all of them share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "tidemark-checkpoints"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


#: Rows of ids that one file of a checkpoint is to hold at least, where their number is known beforehand.
FILE_ROWS = 500_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written to the shared checkpoint folder: later steps don't recompute it and lost executors don't lose it.

    The folder is the session's spark.checkpoint.dir; see shared_folder. rows: how many there are at most, for frames of ids that are
    cheap to make: as few tasks then make as few files.
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).checkpoint(eager=True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: for frames that hold texts. discard() removes it when it has served."""
    path = path or new_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a folder in the shared one that nothing else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def let_go(spark: SparkSession) -> None:
    """Asks the driver for a garbage collection: only then does Spark remove the shuffle files of frames that nobody holds any more.

    Worth its tenths of a second after a step whose shuffles are as large as the corpus.
    """
    gc.collect()
    spark._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def map_texts(
    df: DataFrame, columns: list[str], schema: str, work: Callable[[pa.RecordBatch, list[bytes]], Iterator[dict[str, pa.Array]]], text: str = "text"
) -> DataFrame:
    """Runs work over the rows in pieces of bounded bytes.

    work gets the batch (columns, then "text") and the texts as UTF-8 (null: empty), and yields
    columns for schema. Other columns never reach Python, so their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()]
            for part in chunks([len(t) + 64 for t in texts]):
                for out in work(batch.slice(part.start, part.stop - part.start), texts[part]):
                    yield pa.RecordBatch.from_pydict(out)

    rows = df.select(*[F.col(c) for c in columns], F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


def filter_texts(df: DataFrame, keep: Callable[[list[bytes]], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of df whose text (UTF-8, null: empty) keep() marks, with all columns as they are."""
    names = [f"c{i}" for i in range(len(df.columns))]  # the caller's own names may clash
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(at).cast(pa.large_binary()).to_pylist()]
            for part in chunks([len(t) + 64 for t in texts]):
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(keep(texts[part]), pa.bool_()))

    rows = df.toDF(*names)
    return rows.mapInArrow(run, rows.schema).toDF(*df.columns)
