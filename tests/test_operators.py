"""Edge cases of operators that the registered queries don't reach."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names, times, topics, values
from tidemark.operators import claims, metrics, schedules, state
from tidemark.sources import queues, sinks

NOW = "2024-01-01 00:00:00"
SCHEMA = "msg_id long, queue_name string, read_ct int, enqueued_at timestamp_ntz, vt timestamp_ntz, group_key string, message string"


@pytest.fixture(scope="module")
def inbox(spark):
    rows = [
        (1, "q", 0, "2023-12-31 23:00:00", "2023-12-31 23:00:00", "a"),
        (2, "q", 1, "2023-12-31 23:10:00", "2024-01-01 00:10:00", "b"),  # in flight: blocks group b
        (3, "q", 0, "2023-12-31 23:20:00", "2023-12-31 23:20:00", "b"),
        (4, "q", 0, "2023-12-31 23:30:00", "2024-01-01 00:00:00", "a"),  # claimable just now
        (5, "q", 0, "2023-12-31 23:40:00", "2023-12-31 23:40:00", None),
        (6, "q", 0, "2023-12-31 23:50:00", "2024-01-01 00:00:01", None),
    ]
    raw = spark.createDataFrame([(*r, '{"k": 1}') for r in rows], "msg_id long, queue_name string, read_ct int, enqueued_at string, vt string, group_key string, message string")
    return raw.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("enqueued_at", "vt")})


def ids(df):
    return [r.msg_id for r in df.collect()]


def test_read_takes_vt_of_now(inbox):
    assert ids(claims.read(inbox, "q", NOW, 10)) == [1, 3, 4, 5]


def test_grouped_reads_stop_at_what_is_in_flight(inbox):
    assert ids(claims.read_grouped(inbox, "q", NOW, 10)) == [1, 4, 5]
    assert ids(claims.read_grouped_round_robin(inbox, "q", NOW, 10)) == [1, 5, 4]
    assert ids(claims.read_grouped_heads(inbox, "q", NOW, 10)) == [1, 5]


def test_pop_and_claim_change_the_table(inbox):
    taken, rest = claims.pop(inbox, "q", NOW, 2)
    assert ids(taken) == [1, 3] and sorted(ids(rest)) == [2, 4, 5, 6]
    row = claims.read(inbox, "q", NOW, 1, vt_secs=45).first()
    assert str(row.vt) == "2024-01-01 00:00:45" and row.read_ct == 1


def test_empty_tables(spark, inbox):
    none = inbox.where("false")
    assert ids(claims.read_grouped(none, "q", NOW, 5)) == []
    assert metrics.queue_metrics(none, NOW).count() == 0
    assert metrics.queue_metrics(none, NOW, spark.createDataFrame([("q",)], "queue_name string")).first().length == 0
    assert metrics.dashboard(metrics.queue_metrics(none, NOW)).first().queues == 0


def test_batch_needs_messages_and_as_many_headers():
    with pytest.raises(ValueError):
        queues.checked_batch([], None)
    with pytest.raises(ValueError):
        queues.checked_batch(["a"], ["h", "i"])


def test_topics(spark):
    rows = spark.createDataFrame([("logs.#", "logs"), ("logs.#", "logs.a"), ("a.*", "a.b.c"), ("a.*", "a.b"), ("a", "a\n")], "pattern string, key string")
    got = [r[0] for r in rows.select(topics.matches(F.col("key"), topics.pattern_regex(F.col("pattern")))).collect()]
    assert got == [False, True, False, True, False]


def test_names(spark):
    row = spark.range(1).select(names.normalize(F.lit("--A.b:c  d__e--")).alias("n"), names.valid_name(F.lit("x" * 48)).alias("v"), names.valid_name(F.lit(None).cast("string")).alias("z")).first()
    assert (row.n, row.v, row.z) == ("A_b_cd_e", False, False)


def test_age_rounds_half_to_even(spark):
    rows = spark.createDataFrame([("2023-12-31 23:59:57.5",), ("2023-12-31 23:59:58.5",)], "t string")
    assert [r[0] for r in rows.select(times.age_seconds(NOW, F.col("t").cast("timestamp_ntz"))).collect()] == [2, 2]


def test_percent_of_an_empty_batch(spark):
    assert spark.range(1).select(values.percent_done(F.lit(0), F.lit(0))).first()[0] == 100


def test_cron_fields():
    assert schedules.field_values("*/20", 0, 59) == [0, 20, 40]
    assert schedules.field_values("5,7", 0, 6) == [0, 5]
    with pytest.raises(ValueError):
        schedules.parsed("* * *")
    with pytest.raises(ValueError):
        schedules.field_values("61", 0, 59)


def test_semaphore_and_merge(spark):
    rows = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3)], "key string, id int")
    assert [r.granted for r in state.semaphore_grants(rows, 2, "id").orderBy("id").collect()] == [True, True, False]
    assert state.merge(rows, rows.where("id = 1"), ["key", "id"]).count() == 3


def test_sse_and_escapes(spark):
    row = spark.range(1).select(sinks.sse_frame(F.lit(3), F.lit("a\r\nb")).alias("f"), sinks.escaped(F.lit('x"\\\n')).alias("e")).first()
    assert row.f == "id: 3\ndata: a\ndata: b\n\n" and row.e == 'x\\"\\\\\\n'


def test_empty_family_has_no_head(spark):
    none = spark.createDataFrame([], "q string, v long")
    assert sinks.prometheus_family(none, "m", "gauge", "t", "q", "v").count() == 0
