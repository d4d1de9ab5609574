"""Catalogs and their upkeep: creating and dropping queues, throttle settings, headroom, per-event metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times, values


def created(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """The catalog with new queues; those that are there stay as they are."""
    return catalog.unionByName(new.dropDuplicates(["queue_name"]).join(catalog.select("queue_name"), "queue_name", "left_anti"))


def dropped(catalog: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue_name, existed) of each queue to drop, and the catalog without them."""
    there = catalog.select("queue_name", F.lit(True).alias("there"))
    told = gone.join(there, "queue_name", "left").select("queue_name", F.coalesce("there", F.lit(False)).alias("existed"))
    return told, catalog.join(gone, "queue_name", "left_anti")


def pattern_flag(streams: DataFrame, rules: DataFrame, default: bool) -> DataFrame:
    """streams with flag: whether a rule, an exact name or a regex, names them; without any rule the default."""
    own = streams.select("stream_name").distinct()
    exact = own.join(rules.select(F.col("rule").alias("stream_name")), "stream_name", "left_semi")
    regex = own.join(rules.where("is_regex"), F.regexp_like("stream_name", F.col("rule")), "left_semi")
    named = exact.unionByName(regex).distinct().withColumn("__hit", F.lit(True))
    return streams.join(named, "stream_name", "left").withColumn("flag", F.coalesce("__hit", F.lit(default))).drop("__hit")


def with_health(queues: DataFrame, stats: DataFrame) -> DataFrame:
    """Live and dead rows of each queue's table and its archive's; tables without counts are left out."""
    names = queues.select(F.explode(F.array(F.concat(F.lit("q_"), "queue_name"), F.concat(F.lit("a_"), "queue_name"))).alias("table_name"))
    rows = names.join(stats, "table_name", "left").where("live IS NOT NULL OR dead IS NOT NULL").fillna(0, ["live", "dead"])
    return rows.withColumn("bloat", values.ratio(F.col("dead"), F.col("live") + F.col("dead")))


#: Fixed value: milliseconds between notifications of a queue whose throttle has no interval of its own.
DEFAULT_THROTTLE_MS = 250


def throttles_after(settings: DataFrame, wanted: DataFrame, disabled: DataFrame) -> DataFrame:
    """Throttle settings (queue_name, interval_ms) after new ones, null meaning the default, and queues whose throttle is off. An interval below 0 is refused: it changes nothing."""
    good = wanted.select("queue_name", F.coalesce("interval_ms", F.lit(DEFAULT_THROTTLE_MS)).alias("interval_ms")).where("interval_ms >= 0")
    rest = settings.join(disabled, "queue_name", "left_anti").join(good.select("queue_name"), "queue_name", "left_anti")
    return rest.select("queue_name", "interval_ms").unionByName(good.join(disabled, "queue_name", "left_anti"))


def headroom(connections: DataFrame, most: int) -> DataFrame:
    """Connections in use, how many listeners among them, and what is left."""
    return connections.agg(
        F.count("*").alias("used"),
        F.countDistinct(F.when(F.col("query").startswith("LISTEN"), F.col("pid"))).alias("listeners"),
        (F.lit(most) - F.count("*")).alias("free"),
    )


def event_metrics(events: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """Metric values by event name: counters add up, gauges keep the last value, histograms their sum and count.

    kinds: event name -> (metric, 'counter' | 'gauge' | 'histogram'); other events are left out.
    """
    table = F.create_map(*[F.lit(x) for name, (metric, kind) in kinds.items() for x in (name, f"{kind} {metric}")])
    marked = events.withColumn("__m", F.try_element_at(table, F.col("name"))).where("__m IS NOT NULL")
    parts = F.split("__m", " ", 2)
    rows = marked.select(F.element_at(parts, 1).alias("kind"), F.element_at(parts, 2).alias("metric"), "tag", "value", "at")
    value = F.when(F.first("kind") == "gauge", F.max_by("value", "at")).when(F.first("kind") == "counter", F.count("*").cast("double")).otherwise(F.sum("value"))
    return rows.groupBy("kind", "metric", "tag").agg(value.alias("value"), F.count("*").alias("n"))


def utilisation(busy: Column, capacity: Column) -> Column:
    return values.ratio(busy, capacity)


def rates_text(parts: dict[str, Column]) -> Column:
    """'3.0 done/s · 1.0 failed/s' of the rates that are above zero."""
    shown = F.array(*[F.when(rate > 0, F.concat(F.format_string("%.1f", rate), F.lit(f" {name}/s"))) for name, rate in parts.items()])
    return F.array_join(F.filter(shown, lambda x: x.isNotNull()), " · ")


def missed_run(due: DataFrame, runs: DataFrame, as_of: str, interval_s: int) -> DataFrame:
    """By task the last due time that did not run, if it is within the interval. due, runs: key, run_at."""
    last_due = due.where(F.col("run_at") <= times.moment(as_of)).groupBy("key").agg(F.max("run_at").alias("due_at"))
    last_run = runs.groupBy("key").agg(F.max("run_at").alias("ran_at"))
    rows = last_due.join(last_run, "key", "left")
    fresh = times.seconds_between(times.moment(as_of), F.col("due_at")) <= interval_s
    return rows.where(fresh & (F.col("ran_at").isNull() | (F.col("ran_at") < F.col("due_at")))).select("key", "due_at")
