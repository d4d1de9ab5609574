"""Ages, windows and how the reports print times."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: str | datetime | Column) -> Column:
    """as_of as a timestamp without zone."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact seconds as a double."""
    return (micros(later) - micros(earlier)) / 1e6


def age_seconds(as_of: str | Column, ts: Column) -> Column:
    """Whole seconds from ts to as_of, rounded half to even as the store's integer cast does."""
    return F.bround(seconds_between(moment(as_of), ts), 0).cast("long")


def ago(as_of: str | Column, seconds: int | Column) -> Column:
    return moment(as_of) - F.make_dt_interval(secs=seconds if isinstance(seconds, Column) else F.lit(seconds))


def since(as_of: str | Column, ts: Column, minutes: int) -> Column:
    """Inside the window of the last minutes, its start included."""
    return ts >= ago(as_of, minutes * 60)


def clamp_minutes(minutes: int, default: int = 60, most: int = 43_200) -> int:
    return min(max(int(minutes), 1), max(default, most))


def clamp_page(page: int, most: int = 1000) -> int:
    return min(max(int(page), 1), most)


def time_ago(seconds: Column) -> Column:
    """Age in words: 5s, 3m, 2h or 4d ago; null stays null."""
    whole = lambda n: F.floor(seconds / n).cast("string")
    return (
        F.when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit("s ago")))
        .when(seconds < 3600, F.concat(whole(60), F.lit("m ago")))
        .when(seconds < 86_400, F.concat(whole(3600), F.lit("h ago")))
        .when(seconds >= 86_400, F.concat(whole(86_400), F.lit("d ago")))
    )


def ms_duration(ms: Column) -> Column:
    """123ms, 4.5s or 2m 3s."""
    s = ms / 1000
    return (
        F.when(ms < 1000, F.concat(F.round(ms, 0).cast("long").cast("string"), F.lit("ms")))
        .when(s < 60, F.concat(F.format_string("%.1f", s), F.lit("s")))
        .when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), F.floor(s % 60).cast("string"), F.lit("s")))
    )


def range_label(minutes: int) -> str:
    """The name of a window of the last minutes: 30m, 6h, 7d."""
    for size, unit in ((1440, "d"), (60, "h")):
        if minutes >= size and minutes % size == 0:
            return f"{minutes // size}{unit}"
    return f"{minutes}m"


def short_number(n: Column) -> Column:
    """1234 as 1.2K, 3400000 as 3.4M."""
    return (
        F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M")))
        .when(n >= 1_000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("K")))
        .when(n.isNotNull(), n.cast("long").cast("string"))
    )
