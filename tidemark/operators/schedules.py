"""Cron schedules as columns: due times of many tasks without a loop over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times

#: Bounds of the five fields: minute, hour, day of month, month, day of week (0: Sunday), and the names of the last two.
FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")


def _number(text: str, low: int, high: int) -> int:
    names = {(1, 12): MONTHS, (0, 6): DAYS}.get((low, high), ())
    name = text.lower()[:3]
    return names.index(name) + low if name in names else int(text)


def field_values(field: str, low: int, high: int) -> list[int]:
    """The numbers a field stands for: *, n, a-b, names of months and days, steps and lists of them."""
    out: set[int] = set()
    for part in field.split(","):
        span, _, step = part.partition("/")
        first, _, last = span.partition("-")
        lo = low if first == "*" else _number(first, low, high)
        hi = high if first == "*" or (step and not last) else _number(last or first, low, high)
        out |= set(range(lo, hi + 1, int(step or 1)))
    bad = [n for n in out if not low <= n <= high and not (high == 6 and n == 7)]
    if bad or not out:
        raise ValueError(f"{field!r} is outside {low}-{high}")
    return sorted({n % 7 for n in out} if high == 6 else out)


def parsed(cron: str) -> list[list[int]]:
    parts = cron.split()
    if len(parts) != 5:
        raise ValueError(f"{cron!r} needs five fields")
    return [field_values(part, *bounds) for part, bounds in zip(parts, FIELDS, strict=True)]


def _ours(cron: str) -> tuple[list[list[int]], bool]:
    """The fields, and whether day and weekday are both limited, when either will do."""
    parts = cron.split()
    return parsed(cron), parts[2] != "*" and parts[4] != "*"


def due_day(day: Column, cron: str) -> Column:
    """Whether a date or time is on a day of the schedule's."""
    fields, either = _ours(cron)
    in_month, in_week = F.dayofmonth(day).isin(fields[2]), (F.dayofweek(day) - 1).isin(fields[4])
    return F.month(day).isin(fields[3]) & ((in_month | in_week) if either else (in_month & in_week))


def due(minute: Column, cron: str) -> Column:
    """Whether a minute is one of the schedule's."""
    fields, _ = _ours(cron)
    return F.minute(minute).isin(fields[0]) & F.hour(minute).isin(fields[1]) & due_day(minute, cron)


def _minutes(cron: str) -> Column:
    """The schedule's minutes of a day, counted from midnight, in order."""
    fields, _ = _ours(cron)
    return F.array(*[F.lit(60 * h + m) for h in fields[1] for m in fields[0]])


def _runs(days: Column, cron: str) -> Column:
    """The due times of an array of dates."""
    on = F.filter(days, lambda d: due_day(d, cron))
    return F.flatten(F.transform(on, lambda d: F.transform(_minutes(cron), lambda m: d.cast("timestamp_ntz") + F.make_dt_interval(mins=m))))


def due_runs(tasks: DataFrame, crons: dict[str, str], start: str, end: str, schedule: str = "key") -> DataFrame:
    """(key, run_at) of every due minute from start to end, both included. tasks: key, and a column that names the schedule in crons.

    Days and the minutes of a day come from the fields, so nothing but due times is ever made.
    """
    first, last = times.moment(start), times.moment(end)
    days = F.sequence(first.cast("date"), last.cast("date"))
    runs = F.lit(None).cast("array<timestamp_ntz>")
    for name, cron in crons.items():
        runs = F.when(F.col(schedule) == name, _runs(days, cron)).otherwise(runs)
    return tasks.select("key", F.explode(runs).alias("run_at")).where(F.col("run_at").between(first, last))


def next_due(at: Column, cron: str, days: int = 1500) -> Column:
    """The first due minute after a time, null if there is none within days."""
    day = at.cast("date")
    minute = F.hour(at) * 60 + F.minute(at)
    today = F.filter(_minutes(cron), lambda m: m > minute)
    later = F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, days)), lambda d: due_day(d, cron))
    start = lambda d: d.cast("timestamp_ntz")
    here = F.when(due_day(day, cron) & (F.size(today) > 0), start(day) + F.make_dt_interval(mins=F.get(today, F.lit(0))))
    return F.coalesce(here, start(F.get(later, F.lit(0))) + F.make_dt_interval(mins=F.get(_minutes(cron), F.lit(0))))


def previous_due(at: Column, cron: str, days: int = 1500) -> Column:
    """The last due minute before a time, null if there is none within days."""
    day = at.cast("date")
    start = lambda d: d.cast("timestamp_ntz")
    today = F.filter(_minutes(cron), lambda m: start(day) + F.make_dt_interval(mins=m) < at)
    earlier = F.filter(F.sequence(F.date_sub(day, 1), F.date_sub(day, days), F.expr("INTERVAL -1 DAY")), lambda d: due_day(d, cron))
    here = F.when(due_day(day, cron) & (F.size(today) > 0), start(day) + F.make_dt_interval(mins=F.try_element_at(today, F.lit(-1))))
    return F.coalesce(here, start(F.get(earlier, F.lit(0))) + F.make_dt_interval(mins=F.element_at(_minutes(cron), -1)))


def run_time(at: Column, cron: str, interval_s: int) -> Column:
    """The due time that a look at the clock fires: this minute's if the time is right on it, else the last one if it is within the interval."""
    last = previous_due(at, cron)
    exact = (at == F.date_trunc("minute", at).cast("timestamp_ntz")) & due(at, cron)
    return F.when(exact, at).when(times.seconds_between(at, last) <= interval_s, last)


def canonical(cron: str) -> str:
    """The schedule in plain numbers, a * for a field without limit."""
    return " ".join("*" if own == list(range(lo, hi + 1)) else ",".join(map(str, own)) for own, (lo, hi) in zip(parsed(cron), FIELDS, strict=True))


def last_runs(tasks: DataFrame, executions: DataFrame) -> DataFrame:
    """Tasks with the time of their last run, null if none."""
    return tasks.join(executions.groupBy(F.col("task_key").alias("key")).agg(F.max("run_at").alias("last_run_at")), "key", "left")


def missed(last_due: Column, last_run: Column, as_of: str, interval_s: int) -> Column:
    """The due time to make up for: the last one, if it did not run and is within the interval."""
    recent = times.seconds_between(times.moment(as_of), last_due) <= interval_s
    return F.when(recent & (last_run.isNull() | (last_run < last_due)), last_due)
