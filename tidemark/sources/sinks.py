"""Rows as text for other systems: Prometheus, StatsD, server-sent events, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """Whole values without a point, others as they are."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def escaped(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def prometheus_lines(metrics: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """line by row: name{label="..."} value; rows without a value give none."""
    line = F.concat(F.lit(f'{name}{{{label}="'), escaped(F.col(label)), F.lit('"} '), number(F.col(value)))
    return metrics.where(F.col(value).isNotNull()).select(line.alias("line"))


def prometheus_family(metrics: DataFrame, name: str, kind: str, text: str, label: str, value: str) -> DataFrame:
    """(place, line) of a family with its two comment lines; a family without samples is left out."""
    lines = prometheus_lines(metrics, name, label, value).select(F.lit(2).alias("place"), "line")
    head = lines.limit(1).select(F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit(f"# HELP {name} {text}").alias("line")), F.struct(F.lit(1).alias("place"), F.lit(f"# TYPE {name} {kind}").alias("line")))).alias("h"))
    return head.select("h.*").unionByName(lines)


def label_set(labels: Column) -> Column:
    """A map of labels as {a="x",b="y"}, by name and escaped; labels without a value are left out, and no label gives nothing."""
    pairs = F.filter(F.array_sort(F.map_entries(labels)), lambda e: e["value"].isNotNull())
    text = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), ",")
    return F.when(text == "", "").otherwise(F.concat(F.lit("{"), text, F.lit("}")))


def prometheus_registry(points: DataFrame) -> DataFrame:
    """(name, place, line) of a registry's text: by metric a TYPE line and its samples; histograms as summaries of sum and count.

    points: kind, metric, labels (map), value and n, one row for each metric and set of labels.
    """
    kind = F.when(F.col("kind") == "histogram", "summary").otherwise(F.col("kind"))
    types = points.select("metric", kind.alias("kind")).distinct().select(F.col("metric").alias("name"), F.lit(0).alias("place"), F.concat(F.lit("# TYPE "), "metric", F.lit(" "), "kind").alias("line"))
    labels = label_set(F.col("labels"))
    simple = F.array(F.concat("metric", labels, F.lit(" "), number(F.col("value"))))
    summary = F.array(F.concat("metric", F.lit("_sum"), labels, F.lit(" "), number(F.col("value"))), F.concat("metric", F.lit("_count"), labels, F.lit(" "), F.col("n").cast("string")))
    samples = points.select(F.col("metric").alias("name"), F.lit(1).alias("place"), F.explode(F.when(F.col("kind") == "histogram", summary).otherwise(simple)).alias("line"))
    return types.unionByName(samples)


def prometheus_families(rows: DataFrame, families: dict[str, tuple[str, str]], labels: list[str]) -> DataFrame:
    """(name, place, line) of gauges: by family (name -> (column, help)) its two comment lines and a sample for each row with a value; empty ones are left out."""
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(text).alias("help"), F.col(column).cast("double").alias("value")) for name, (column, text) in families.items()])
    points = rows.select(F.create_map(*[x for c in labels for x in (F.lit(c), F.col(c).cast("string"))]).alias("labels"), F.explode(each).alias("s")).select("labels", "s.*").where("value IS NOT NULL")
    heads = points.select("name", "help").distinct()
    lines = heads.select("name", F.posexplode(F.array(F.concat(F.lit("# HELP "), "name", F.lit(" "), "help"), F.concat(F.lit("# TYPE "), "name", F.lit(" gauge")))).alias("place", "line"))
    return lines.unionByName(points.select("name", F.lit(2).alias("place"), F.concat("name", label_set(F.col("labels")), F.lit(" "), number(F.col("value"))).alias("line")))


def sse_retry(milliseconds: Column) -> Column:
    """How long a client waits before it comes again, as a line of its own."""
    return F.concat(F.lit("retry: "), milliseconds.cast("string"), F.lit("\n\n"))


def json_bundle(parts: dict[str, DataFrame]) -> DataFrame:
    """(name, json): each of some small reports as a JSON array of its rows, in the order of their text. They are reports: a row for each class, queue or minute."""
    out = None
    for name, rows in parts.items():
        one = json_rows(rows).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("json")), ","), F.lit("]")).alias("json")).select(F.lit(name).alias("name"), "json")
        out = one if out is None else out.unionByName(one)
    return out


def statsd_line(name: Column, value: Column, kind: Column, tags: Column) -> Column:
    """name:value|kind|#k:v,k:v; tags is an array of k:v."""
    return F.concat(name, F.lit(":"), number(value), F.lit("|"), kind, F.when(F.size(tags) > 0, F.concat(F.lit("|#"), F.array_join(tags, ","))).otherwise(""))


def sse_frame(msg_id: Column, data: Column, event: Column | None = None) -> Column:
    """One server-sent event: id, event if any, a data line for each line of data, and a blank line."""
    lines = F.array_join(F.transform(F.split(data, r"\r\n|\r|\n"), lambda x: F.concat(F.lit("data: "), x)), "\n")
    name = F.when(event.isNotNull(), F.concat(F.lit("event: "), event, F.lit("\n"))).otherwise("") if event is not None else F.lit("")
    return F.concat(F.lit("id: "), msg_id.cast("string"), F.lit("\n"), name, lines, F.lit("\n\n"))


def sse_comment(text: Column) -> Column:
    return F.concat(F.lit(": "), F.regexp_replace(text, r"[\r\n]+", " "), F.lit("\n\n"))


def json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
