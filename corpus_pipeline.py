"""The corpus pipeline: five stages, each a DataFrame of documents to the next.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The last one
returns the packed pieces with their texts; the others return the columns of documents, other columns as they
are, whatever their names. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard_join, packing, pii, quality_model
from tidemark.llm.common import discard, let_go, new_folder, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality model keeps.

    Null and empty texts are judged by their measures (no words: poor); texts of any length are read whole; repeated rows
    are kept or dropped alike; a tail probability of just KEEP keeps. Without two different grades in labels all stay.
    """
    return quality_model.keep_sound(docs, quality_model.train(docs, quality_model.grades_of(table(spark, sf_dir, "labels"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8.

    The one with the smallest doc_id stays, null first; of rows tied in it, repeated ones among them, one stays. Null and
    empty texts link with nothing and stay; texts of any length are one set.
    """
    return jaccard_join.one_of_each(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none and stay; texts of any length are searched whole; repeated rows go or stay alike; overlaps
    of just the least length count. An empty benchmark drops nothing.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind.

    Null texts stay null and empty ones empty; texts of any length are masked whole; repeated rows are masked alike; of
    overlapping spans the first, then longest, names the kind. n_chars follows the new text.
    """
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces by bin, with their texts.

    A null or empty text is one empty piece; a text of any length is cut into pieces that make it up whole; repeated rows are
    packed each; ties go by id, text and piece.
    """
    return packing.packed_texts(docs)


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over the table documents, each stage but the last written as Parquet and read again.

    What a stage read is removed once its own result is written; the last stage's input stays in the shared folder, for its rows are yet to be read.
    """
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            written = new_folder(spark, name)
            docs = stored(docs, written)
            if read:
                discard(spark, read)
            read = written
            let_go(spark)
    return docs
