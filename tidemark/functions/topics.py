"""Topic patterns and routing keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = r"([\\.^$+?()\[\]{}|])"


def pattern_regex(pattern: Column) -> Column:
    """A pattern as an anchored regex: * is one segment, # is anything; a # keeps its dot, so 'logs.#' needs 'logs.'."""
    escaped = F.regexp_replace(pattern, _META, r"\\$1")
    parts = F.replace(F.replace(escaped, F.lit("*"), F.lit("[^.]+")), F.lit("#"), F.lit(".*"))
    return F.concat(F.lit("^"), parts, F.lit("$"))


def valid_routing_key(key: Column) -> Column:
    """1 to 255 of [A-Za-z0-9._-], no dot at an edge, no two in a row."""
    return F.coalesce((F.length(key) <= 255) & key.rlike(r"^[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*\z"), F.lit(False))


def valid_pattern(pattern: Column) -> Column:
    """As a routing key, but * and # too, no two of them next to each other."""
    good = pattern.rlike(r"^[A-Za-z0-9_*#-]+(\.[A-Za-z0-9_*#-]+)*\z") & ~pattern.rlike(r"[*#][*#]")
    return F.coalesce((F.length(pattern) <= 255) & good, F.lit(False))


def matches(key: Column, regex: Column) -> Column:
    """Only valid keys match: a key that ends in a newline would else pass the regex's end."""
    return valid_routing_key(key) & F.regexp_like(key, regex)


def overlaps(topic_filter: Column, subscription: Column) -> Column:
    """Whether a consumer's filter may lead to a subscription: it ends in #, which covers them all, or the subscription starts with it."""
    return topic_filter.endswith("#") | F.startswith(subscription, topic_filter)
