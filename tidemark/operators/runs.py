"""Windows over hot keys: a key's rows are cut into runs of their order, each a task's work, and what goes over from run to run is
a table of one row for each run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import times

#: Rows that a run holds, about, if a key's rows are spread evenly.
RUN_ROWS = 1_000_000


def position(rows: DataFrame, column: str) -> Column:
    """A column's place in order as a whole number: microseconds of times, floors of numbers; null comes first."""
    kind = dict(rows.dtypes)[column]
    place = times.micros(F.col(column)) if kind.startswith(("timestamp", "date")) else F.floor(F.col(column))
    return place.cast("long")


def cut_in_runs(rows: DataFrame, column: str, run_rows: int | None = None) -> tuple[DataFrame, int]:
    """(rows with __run, how many runs there are): equal stretches of the column's order, as many as the rows need."""
    placed = rows.withColumn("__pos", position(rows, column))
    low, high, n = placed.agg(F.min("__pos"), F.max("__pos"), F.count("*")).first()
    runs = -(-n // (run_rows or RUN_ROWS))
    if low is None or runs < 2:
        return placed.withColumn("__run", F.lit(0).cast("long")).drop("__pos"), 1
    width = -(-(high - low + 1) // runs)
    return placed.withColumn("__run", F.coalesce(F.floor((F.col("__pos") - low) / width), F.lit(-1)).cast("long")).drop("__pos"), runs


def joined(rows: DataFrame, by_run: DataFrame, key: str) -> DataFrame:
    """rows with what by_run (key, __run, ...) tells of their run; a null key is a key."""
    other = by_run.withColumnsRenamed({key: "__key", "__run": "__r"})
    return rows.join(other, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__run") == F.col("__r"))).drop("__key", "__r")


def over_runs(key: str) -> Window:
    return Window.partitionBy(key).orderBy("__run")
