"""Rules that queries over tables reach only in part: masking, caches, ids, pools, schedules, windows."""

from __future__ import annotations

import datetime
import json
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names, payloads, times, topics
from tidemark.operators import admin, claims, metrics, runs, schedules, state, stats
from tidemark.sources import queues, sinks
from tidemark.sources.views import Source
from tidemark.streaming import fanout, live

START = datetime.datetime(2024, 1, 1)


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", column(F.col("x")).alias("y"))
    return [r.y for r in sorted(rows.collect())]


def test_masks_whole_values_under_secret_keys(spark):
    texts = ['{"token": {"a": 1, "b": 2}, "x": 3}', '{"a":{"PassWord":["s",{"t":1}],"id":4}}', '{"secret":null,"key":"k","my_key":1}', '[{"api_key":1},"token"]', '"token"', "nope {", None, "", '{"note":"\\"token\\": 1"}', '{"é":1.0}']
    want = ['{"token":"[FILTERED]","x":3}', '{"a":{"PassWord":"[FILTERED]","id":4}}', '{"secret":"[FILTERED]","key":"k","my_key":"[FILTERED]"}', '[{"api_key":"[FILTERED]"},"token"]', '"token"', "nope {", None, "", '{"note":"\\"token\\": 1"}', '{"é":1.0}']
    assert one(spark, payloads.filtered, *texts) == want


def test_redacts_leaves_and_enters_the_rest(spark):
    texts = ['{"message":"m","headers":null,"id":1}', '{"message":{"payload":"p","id":2}}', '{"arguments":[{"payload":[1]},"x"]}', '[[{"message":false}]]']
    want = ['{"message":"[redacted]","headers":null,"id":1}', '{"message":{"payload":"[redacted]","id":2}}', '{"arguments":[{"payload":[1]},"x"]}', '[[{"message":"[redacted]"}]]']
    assert one(spark, payloads.redacted, *texts) == want


def held(whole, part):
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and held(whole[k], v) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(held(w, p) for w in whole) for p in part)
    return type(whole) is type(part) and whole == part or {type(whole), type(part)} == {int, float} and whole == part


def test_containment_against_plain_values(spark):
    bodies = [{"k": 7}, {"k": "7"}, {"k": 7.0}, {"k": True}, {"k": None}, {"a": {"k": 7, "b": [1, {"c": 2, "d": 3}]}}, [1, 2], {"a": {"b": [1]}}, {"a": []}, {"it's": 1}]
    wanted = [{"k": 7}, {"k": "7"}, {"k": True}, {"k": None}, {"a": {"b": [{"c": 2}]}}, {"a": {"b": [1]}}, {"a": {}}, {"a": []}, {}, {"it's": 1}, {"k": {"x": 1}}]
    rows = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, m string")
    got = sorted(rows.select("i", *[payloads.holds(F.col("m"), w).alias(str(j)) for j, w in enumerate(wanted)]).collect())
    for r, body in zip(got, bodies, strict=True):
        assert [r[str(j)] for j in range(len(wanted))] == [held(body, w) or not w for w in wanted], body


@pytest.mark.parametrize(("ttl", "size"), [(300, 10_000), (50, 4), (10**6, 1), (0, 3)])
def test_dedup_cache_against_a_plain_one(spark, ttl, size):
    rng = random.Random(size)
    rows = [(p, f"k{rng.randrange(9)}", START + datetime.timedelta(seconds=rng.randrange(3000)), i) for i in range(400) for p in [f"p{i % 3}"]]
    events = spark.createDataFrame([(p, k, str(t), i) for p, k, t, i in rows], "p string, k string, t string, i int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    want = set()
    for process in ("p0", "p1", "p2"):
        marks = OrderedDict()
        for _, k, t, i in sorted((r for r in rows if r[0] == process), key=lambda r: (r[2], r[1], r[3])):
            if k in marks and (t - marks[k]).total_seconds() <= ttl:
                continue
            if k in marks:
                del marks[k]
            while len(marks) >= size:
                marks.popitem(last=False)
            marks[k] = t
            want.add(i)
    assert {r.i for r in state.dedup_cache(events, "p", "k", "t", ttl, size).collect()} == want


def test_a_key_passes_again_after_its_ttl(spark):
    events = spark.createDataFrame([("p", "k", f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}", n) for n, s in ((1, 0), (2, 200), (3, 400), (4, 700), (5, 701))], "p string, k string, t string, n int")
    got = state.dedup_cache(events.withColumn("t", F.col("t").cast("timestamp_ntz")), "p", "k", "t", 300)
    assert sorted(r.n for r in got.collect()) == [1, 3, 5]


def test_moved_messages_get_ids_beyond_the_last(spark, monkeypatch):
    monkeypatch.setattr(claims, "RUN", 3)  # ids are ranked over many runs
    rows = [(i, "a", 9, f"m{i}", f"h{i}") for i in range(1, 11)] + [(5, "a_dlq", 9, "old", None)]
    inbox = spark.createDataFrame(rows, "msg_id long, queue_name string, read_ct int, message string, headers string").withColumns({"enqueued_at": F.lit(str(START)).cast("timestamp_ntz"), "vt": F.lit(str(START)).cast("timestamp_ntz")})
    moved, rest = claims.dead_letter(inbox, "2024-01-02 00:00:00")
    got = sorted((r.msg_id, r.queue_name, r.read_ct, r.message, r.headers) for r in moved.collect())
    assert got == [(5 + i, "a_dlq", 0, f"m{i}", f"h{i}") for i in range(1, 11)]
    assert [(r.msg_id, r.message) for r in rest.collect()] == [(5, "old")]
    marks = spark.createDataFrame([("a_dlq", 40)], "queue_name string, last_id long")
    assert min(r.msg_id for r in claims.dead_letter(inbox, "2024-01-02 00:00:00", marks=marks)[0].collect()) == 41
    back, kept = claims.retry_dead_letters(rest.unionByName(moved), "2024-01-03 00:00:00")
    assert sorted((r.msg_id, r.queue_name) for r in back.collect()) == [(i, "a") for i in range(1, 12)] and kept.count() == 0
    gone, stay = claims.reroute(inbox, "a", "b", "2024-01-02 00:00:00", F.lit("{}"))
    assert {r.queue_name for r in stay.collect()} == {"a_dlq"} and sorted(r.msg_id for r in gone.collect()) == list(range(1, 11))


def test_names_that_are_good_stay(spark):
    assert one(spark, names.normalize, "a__b", "_a", "a-b.c", "user:note", "--a--", "gid://app/Foo/1", "é x") == ["a__b", "_a", "a_b_c", "user_note", "a", "gid_appFoo1", "x"]
    assert one(spark, names.handler_queue, "OrderPlacedHandler", "Billing::HTTPNotifier", "A1Job", "HTMLToPDF") == ["order_placed_handler", "billing_http_notifier", "a1_job", "html_to_pdf"]


def test_filters_that_end_in_a_hash_lead_everywhere(spark):
    assert one(spark, lambda c: topics.overlaps(F.lit("orders.#"), c), "orders.*", "users.x") == [True, True]
    assert one(spark, lambda c: topics.overlaps(F.lit("orders"), c), "orders.*", "users.x", "orders") == [True, False, True]


@pytest.mark.parametrize(
    ("size", "available", "limit", "used", "peers", "baseline", "most", "shrink", "want"),
    [
        (10, 10, 100, 96, 1, 5, 20, True, ("emergency_shrink", 5)),
        (5, 0, 100, 96, 1, 5, 20, True, ("hold", 5)),
        (5, 0, 100, 20, 1, 5, None, True, ("grow", 9)),
        (5, 0, 100, 20, 8, 5, None, True, ("grow", 6)),
        (5, 0, 100, 20, 30, 5, None, True, ("hold", 5)),
        (5, 0, 100, 20, 1, 5, 7, True, ("grow", 7)),
        (5, 0, 100, 80, 1, 5, 20, True, ("hold", 5)),
        (1, 0, 100, 20, 1, 1, 20, True, ("hold", 1)),
        (12, 12, 100, 20, 1, 5, 20, True, ("shrink", 8)),
        (6, 6, 100, 20, 1, 5, 20, True, ("shrink", 5)),
        (12, 12, 100, 20, 1, 5, 20, False, ("hold", 12)),
        (10, 5, 100, 20, 1, 5, 20, True, ("hold", 10)),
        (10, 0, None, 20, 1, 5, 20, True, ("hold", 10)),
        (None, None, 100, 20, 1, 5, 20, True, ("hold", None)),
    ],
)
def test_pool_steps(spark, size, available, limit, used, peers, baseline, most, shrink, want):
    c = lambda v: F.lit(v).cast("int")
    row = spark.range(1).select(metrics.autoscale(c(size), c(available), c(limit), c(used), c(peers), c(baseline), c(most), F.lit(shrink)).alias("s")).first().s
    assert tuple(row) == want


def test_verdicts(spark):
    queue = "queue_name string, length long, visible long, visible_unread long, paused boolean"
    streams, nobody = spark.createDataFrame([("st",)], "queue_name string"), spark.createDataFrame([], "kind string, status string")

    def verdict(rows, crew=(), drained=None, **more):
        processes = spark.createDataFrame(list(crew), "kind string, status string") if crew else nobody
        own = spark.createDataFrame([(q,) for q in drained], "queue_name string") if drained is not None else None
        r = metrics.verdict(spark.createDataFrame(rows, queue), processes, streams, own, **more).first()
        return r.status, r.reasons

    busy = [("a", 3, 3, 3, False)]
    assert verdict([("a", 0, 0, 0, False)]) == ("OK", [])
    assert verdict(busy) == ("OK", [])  # nobody alive, nothing wedged
    assert verdict(busy, [("worker", "stalled")])[0] == "STALLED"
    assert verdict(busy, [("consumer", "healthy")])[1] == ["1 queue(s) have visible messages with read_ct=0 (never claimed) while 1 draining process(es) are alive: a"]
    assert verdict([("a", 3, 3, 0, False)], [("worker", "healthy")]) == ("OK", [])
    assert verdict([("a", 3, 3, 3, True)], [("worker", "stalled")])[1] == ["1 paused queue(s) holding a backlog: a"]
    assert verdict(busy, [("worker", "healthy")], drained=["b"])[1] == ["1 queue(s) hold messages but no capsule is configured to drain them: a"]
    assert verdict([("st", 3, 3, 3, False), ("a_dlq", 2, 2, 2, False)], [("worker", "healthy")]) == ("DEGRADED", ["1 dead-letter queue(s) hold messages"])
    assert verdict([("a", 0, 0, 0, False)], [("worker", "stale")], oldest_transaction_s=F.lit(301), unregistered=F.lit(2))[0] == "DEGRADED"
    many = [(f"q{i:02d}", 1, 1, 1, False) for i in range(12)]
    assert verdict(many, [("worker", "stalled")])[1][0].endswith(": " + ", ".join(f"q{i:02d}" for i in range(10)) + " (+2 more)")


def test_labels_hide_what_they_don_t_know(spark):
    rows = one(spark, lambda c: fanout.visible_to(c, {"a": F.lit(True), "b": F.lit(None).cast("boolean")}), None, "a", "b", "c")
    assert rows == [True, True, False, False]


def test_windows_open_with_their_first_frame(spark):
    frames = [("k", t, i) for i, t in enumerate((0, 40, 49, 50, 90, 101, 260))]
    rows = spark.createDataFrame(frames, "k string, ms int, i int").withColumn("at", F.timestamp_millis("ms").cast("timestamp_ntz"))
    got = sorted((r.i, r.flushed_at.microsecond // 1000) for r in fanout.coalesced(rows, ["k"], "at", "i", 0.05).collect())
    assert got == [(2, 50), (4, 100), (5, 151), (6, 310)]


def test_semaphores_count_what_is_held(spark):
    held_ = spark.createDataFrame([("a", 2, 3, "2024-01-01 00:00:00"), ("b", 3, 3, "2023-01-01 00:00:00")], "key string, value long, max_value long, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))
    asks = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "key string, id long")
    granted = state.semaphore_grants(asks, 3, "id", held_)
    assert {r.id: r.granted for r in granted.collect()} == {1: True, 2: False, 3: False, 4: True}  # b has expired but still counts
    new = granted.where("granted").select("key", F.lit("2024-06-01 00:00:00").cast("timestamp_ntz").alias("expires_at"))
    assert {r.key: (r.value, str(r.expires_at)[:4]) for r in state.semaphores_after(held_, new, 3).collect()} == {"a": (3, "2024"), "b": (3, "2023"), "c": (1, "2024")}
    blocked = spark.createDataFrame([(1, "b", 5, "2024-01-01 00:00:00", "2025-01-01 00:00:00"), (2, "b", 1, "2024-01-02 00:00:00", "2025-01-01 00:00:00"), (3, "b", 0, "2024-01-01 00:00:00", "2023-01-01 00:00:00")], "id long, concurrency_key string, priority int, created_at string, expires_at string")
    blocked = blocked.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "expires_at")})
    gone, stay, free = state.semaphores_expired(held_, blocked, "2023-06-01 00:00:00")
    assert [r.key for r in gone.collect()] == ["b"] and [r.key for r in stay.collect()] == ["a"] and [r.id for r in free.collect()] == [2]


def test_uniqueness_strategies(spark):
    asks, taken = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "lock_key string, id long"), spark.createDataFrame([("b",)], "lock_key string")
    outcome = lambda **k: {r.id: r.outcome for r in state.uniqueness(asks, taken, "id", **k).collect()}
    assert outcome() == {1: "enqueued", 2: "rejected", 3: "rejected"}
    assert outcome(on_conflict="log") == {1: "enqueued", 2: "logged", 3: "logged"}
    assert set(outcome(until="executing").values()) == {"enqueued"}
    with pytest.raises(ValueError):
        outcome(until="later")


@pytest.mark.parametrize("cron", ["5 * * * *", "*/20 9-11 * * mon-tue", "0 6 1,15 jan *", "30 23 13 * fri", "0 0 29 2 *"])
def test_neighbouring_due_times(spark, cron):
    moments = [START + datetime.timedelta(minutes=m, seconds=s) for m, s in ((0, 0), (5, 0), (5, 1), (9 * 60, 0), (700, 30), (60 * 24 * 17, 59), (60 * 24 * 58, 0))]
    rows = spark.createDataFrame([(i, str(t)) for i, t in enumerate(moments)], "i int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = sorted(rows.select("i", "t", schedules.next_due(F.col("t"), cron).alias("n"), schedules.previous_due(F.col("t"), cron).alias("p")).collect())
    minute, hour, day, month, week = schedules.parsed(cron)
    either = cron.split()[2] != "*" and cron.split()[4] != "*"

    def due(t):
        a, b = t.day in day, (t.weekday() + 1) % 7 in week
        return t.minute in minute and t.hour in hour and t.month in month and ((a or b) if either else (a and b))

    for r in got:
        step = datetime.timedelta(minutes=1)
        t = r.t.replace(second=0) + step
        while not due(t) and (t - r.t).days < 400:
            t += step
        assert r.n == t or not due(t), (cron, r)
        t = r.t.replace(second=0) if r.t.second else r.t - step
        while not due(t) and (r.t - t).days < 400:
            t -= step
        assert r.p == t or not due(t), (cron, r)


def test_a_look_at_the_clock_fires_one_due_time(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(("2024-01-01 00:05:00", "2024-01-01 00:05:01", "2024-01-01 00:06:00", "2024-01-01 00:06:01"))], "i int, t string")
    got = sorted(rows.select("i", schedules.run_time(F.col("t").cast("timestamp_ntz"), "5 * * * *", 60).alias("r")).collect())
    assert [str(r.r)[11:16] for r in got] == ["00:05", "00:05", "00:05", "None"[11:16]] and got[3].r is None
    assert schedules.canonical("*/30 9-10 * jan mon") == "0,30 9,10 * 1 1"
    with pytest.raises(ValueError):
        schedules.parsed("61 * * * *")


def test_partitions_of_a_queue_are_folders(spark, tmp_path):
    rows = spark.range(2500).select(F.col("id").alias("msg_id"), F.lit("q").alias("queue_name"))
    queues.write_partitioned(rows, f"{tmp_path}/q", "1000")
    back = spark.read.parquet(f"{tmp_path}/q")
    assert back.count() == 2500 and back.where("partition = 2").count() == 500
    assert len(list((tmp_path / "q").glob("partition=*"))) == 3


def test_settings_below_zero_are_refused(spark):
    schema = "queue_name string, interval_ms int"
    old = spark.createDataFrame([("a", 100), ("b", 200)], schema)
    new = spark.createDataFrame([("a", -1), ("c", None)], schema)
    got = admin.throttles_after(old, new, spark.createDataFrame([("b",)], "queue_name string")).collect()
    assert sorted(tuple(r) for r in got) == [("a", 100), ("c", 250)]


def test_polling_loop_hands_over_each_batch(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen = []
    query = live.polled(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), lambda rows, n: seen.extend(r.id for r in rows.collect()), f"{tmp_path}/state")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(seen) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize(("seconds", "every"), [(5, 100), (2.5, 400), (1, 7)])
def test_polling_goes_on_until_its_time_is_over(spark, seconds, every):
    """Against the tries one by one, three messages a call."""
    rng = random.Random(every)
    waits = {i: rng.randrange(-(10**6), 6 * 10**6) for i in range(300)} | {300: 0, 301: 1, 302: 10**5, 303: 10**5 + 1, 304: int(seconds * 10**6), 305: int(seconds * 10**6) + 1}
    at = lambda us: str(START + datetime.timedelta(microseconds=us))
    rows = [(i, q, 0, at(us)) for i, us in waits.items() for q in ("q", "r")] + [(306, "q", 0, None)]
    messages = spark.createDataFrame(rows, "msg_id long, queue_name string, read_ct int, vt string").withColumn("vt", F.col("vt").cast("timestamp_ntz"))
    want, now, end = {}, 0, int(seconds * 10**6)
    while len(want) < sum(us <= end for us in waits.values()):
        batch = sorted(i for i, us in waits.items() if us <= now and i not in want)[:3]
        want |= {i: (START + datetime.timedelta(microseconds=now), START + datetime.timedelta(microseconds=now, seconds=45), 1) for i in batch}
        now = now if batch else min(now + every * 1000, end)
    got = claims.read_while_polling(messages, "q", str(START), vt_secs=45, max_poll_s=seconds, every_ms=every).collect()
    assert len(got) == len(want) and {r.msg_id: (r.last_read_at, r.vt, r.read_ct) for r in got} == want
    odd = claims.read_while_polling(messages, "q", str(START), F.col("msg_id") % 2 == 1, max_poll_s=seconds, every_ms=every)
    assert {r.msg_id for r in odd.collect()} == {i for i in want if i % 2}


def test_one_poll_ends_with_its_first_find_or_in_vain(spark):
    rows = [(i, "q", 0, f"2024-01-01 00:00:{wait:06.3f}") for i, wait in enumerate((6, 4.95, 5, 4.85, 4.9, 4.801))]
    messages = spark.createDataFrame(rows, "msg_id long, queue_name string, read_ct int, vt string").withColumn("vt", F.col("vt").cast("timestamp_ntz"))
    poll = lambda rows, qty: [(r.msg_id, str(r.last_read_at)[17:22]) for r in claims.read_with_poll(rows, "q", str(START), qty).collect()]
    assert poll(messages, 2) == [(3, "04.90"), (4, "04.90")] and poll(messages, 9) == [(3, "04.90"), (4, "04.90"), (5, "04.90")]
    assert poll(messages.where("msg_id < 3"), 9) == [] and poll(messages.where("msg_id = 0"), 9) == []
    assert sorted(r.msg_id for r in claims.read_while_polling(messages, "q", str(START)).collect()) == [1, 2, 3, 4, 5]


def test_throttle_takes_rows_an_interval_apart(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 100, 250, 260, 499, 500, 900)], "k string, ms int").withColumn("at", F.timestamp_millis("ms").cast("timestamp_ntz"))
    assert sorted(r.at.microsecond // 1000 for r in live.throttled_batch(rows, "k", "at", 250).collect()) == [0, 250, 500, 900]


def test_a_steady_child_starts_a_new_streak(spark):
    rows = spark.createDataFrame([("a", i, crash, float(up)) for i, (crash, up) in enumerate([(True, 1), (True, 2), (True, 31), (True, 3), (False, 50), (True, 1), (True, 40)])], "k string, i int, crash boolean, up double")
    got = state.restart_delays(rows, "k", ["i"], F.col("crash"), uptime=F.col("up")).orderBy("i").collect()
    assert [(r.streak, r.delay_s) for r in got] == [(1, 1.0), (2, 2.0), (1, 1.0), (2, 2.0), (0, 0.0), (1, 1.0), (1, 1.0)]


def test_statistics_are_written_and_streamed(spark, tmp_path):
    rows = spark.createDataFrame([("q", "success", 12.6, 1), ("q", "failed", 3.2, 0)], "queue_name string, status string, elapsed_ms double, read_ct int")
    stats.write_stats(stats.consumer_rows(rows), f"{tmp_path}/stats")
    stats.write_stats(stats.consumer_rows(rows), f"{tmp_path}/stats")
    back = spark.read.parquet(f"{tmp_path}/stats")
    assert back.count() == 4 and {(r.job_class, r.duration_ms, r.enqueue_latency_ms, r.retry_count) for r in back.collect()} == {("EventConsumer", 13, None, 0), ("EventConsumer", 3, None, 0)}
    stream = spark.readStream.schema(back.schema).parquet(f"{tmp_path}/stats")
    query = stats.stream_stats_to(stream, f"{tmp_path}/out", f"{tmp_path}/state", "100 milliseconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_all_reports_of_the_overview(spark, small):
    source = Source(spark, small)
    bundle = stats.insights(source.job_stats, source.stream_stats, "2024-01-31 00:00:00", 10**6)
    assert list(bundle) == ["summary", "throughput", "status_counts", "slowest", "latency_trend", "latency_by_queue", "live_streams"]
    rows = {r.name: json.loads(r.json) for r in sinks.json_bundle(bundle).collect()}
    assert set(rows) == set(bundle) and len(rows["summary"]) == 1 and sum(r["n"] for r in rows["status_counts"]) == rows["summary"][0]["total"]
    assert "latency_trend" not in stats.insights(source.job_stats.drop("enqueue_latency_ms"), source.stream_stats, "2024-01-31 00:00:00", 60)


def test_labels_are_sorted_and_escaped(spark):
    labels = F.create_map(F.lit("b"), F.lit('x"y\n\\'), F.lit("a"), F.lit("1"), F.lit("c"), F.lit(None).cast("string"))
    got = spark.range(1).select(sinks.label_set(labels).alias("l"), sinks.label_set(F.expr("CAST(map() AS map<string,string>)")).alias("none")).first()
    assert got.l == '{a="1",b="x\\"y\\n\\\\"}' and got.none == ""
    numbers = spark.range(1).select(sinks.number(F.lit(2.0)).alias("a"), sinks.number(F.lit(0.123456789)).alias("b"), sinks.sse_retry(F.lit(500)).alias("c")).first()
    assert tuple(numbers) == ("2", "0.123456789", "retry: 500\n\n")


def test_window_labels():
    assert [times.range_label(m) for m in (30, 60, 360, 1440, 10080, 90)] == ["30m", "1h", "6h", "1d", "7d", "90m"]


@pytest.mark.parametrize(("run", "width"), [(10, 0.05), (3, 0.2), (10**6, 0.05), (1, 0.001), (5, 3.0)])
def test_windows_in_runs_against_a_plain_fold(spark, run, width):
    rng = random.Random(run)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(3000) * rng.choice([1, 1, 50]) * 1000, i) for i in range(500)]
    events = spark.createDataFrame(rows, "k string, us long, i int").withColumn("at", F.timestamp_micros("us").cast("timestamp_ntz"))
    want = {}
    for key in {r[0] for r in rows}:
        start = None
        for _, us, i in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            if start is None or us - start >= width * 1e6:
                start = us
            want[i] = start
    assert {r.i: r.window for r in fanout.windows(events, ["k"], "at", width, run).collect()} == want
    assert fanout.windows(events.where("false"), ["k"], "at", width).count() == 0


@pytest.mark.parametrize("size", [7, 40, 10**6])
def test_hot_keys_are_gone_through_in_runs(spark, monkeypatch, size):
    """Streaks, sessions and drop-oldest give the same however many runs a key's rows are cut into."""
    monkeypatch.setattr(runs, "RUN_ROWS", size)
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.random() < 0.9, rng.randrange(5), i * 60 + rng.randrange(60) + 3000 * (i // 37)) for i in range(300)]
    table = spark.createDataFrame(rows, "k string, i long, bad boolean, frames int, s long").withColumn("at", F.timestamp_seconds("s").cast("timestamp_ntz"))
    streak, sessions, fits = {}, [], set()
    for key in {r[0] for r in rows}:
        own, n, last = [r for r in rows if r[0] == key], 0, None
        for _, i, bad, _, sec in own:
            n = n + 1 if bad else 0
            streak[i] = n
            if last is None or sec - last >= 600:
                sessions.append([key, sec, sec, 0])
            last = sessions[-1][2] = sec
            sessions[-1][3] += 1
        total = 0
        for _, i, _, frames, _ in reversed(own):
            total += frames
            if total <= 20 or i == own[-1][1]:
                fits.add(i)
    assert {r.i: r.streak for r in state.streaks(table, "k", ["i"], F.col("bad")).collect()} == streak
    got = fanout.sessions(table, "k", "at", 600).collect()
    epoch = datetime.datetime(1970, 1, 1)
    assert sorted(((r.k or "", (r.start - epoch).total_seconds(), (r.end - epoch).total_seconds(), r.n) for r in got)) == sorted((k or "", a, b, n) for k, a, b, n in sessions)
    assert {r.i for r in fanout.newest_within(table, "k", "i", "frames", 20).collect()} == fits
