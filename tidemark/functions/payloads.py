"""JSON payloads: containment, and masking at any depth.

Containment is a typed test on variants, in generated code. Masking rewrites documents of any
shape, which no built-in expression does: it is a vectorised function that parses each text once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of keys whose values are secrets, and keys that hold message bodies, with their masks.
SECRETS = ("password", "passphrase", "secret", "token", "authorization", "api_key", "private_key", "access_key", "secret_key")
SECRET_ENDS = r"(_|-)key$"
BODIES = ("message", "headers", "payload", "arguments")
FILTERED, REDACTED = "[FILTERED]", "[redacted]"


def contains(value: Column, wanted: object) -> Column:
    """Whether a variant holds wanted, a plain Python value: objects by key, arrays if each element is held by some element,
    scalars by type and value. Extra keys and elements don't matter.
    """
    kind = F.schema_of_variant(value)
    if isinstance(wanted, dict):
        own = kind.startswith("OBJECT")
        for key, inner in wanted.items():
            plain = re.fullmatch(r"[^'\\]*", key)  # no path can name other keys
            inside = F.variant_get(value, f"$['{key}']", "variant") if plain else F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(key))
            own = own & contains(inside, inner)
        return F.coalesce(own, F.lit(False))
    if isinstance(wanted, list):
        own = kind.startswith("ARRAY")
        for inner in wanted:
            own = own & F.exists(F.try_variant_get(value, "$", "array<variant>"), _holding(inner))
        return F.coalesce(own, F.lit(False))
    if wanted is None:
        return F.coalesce(kind == "VOID", F.lit(False))
    if isinstance(wanted, bool):
        return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == wanted), F.lit(False))
    if isinstance(wanted, int | float):
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return F.coalesce(number & (F.try_variant_get(value, "$", "double") == float(wanted)), F.lit(False))
    return F.coalesce((kind == "STRING") & (F.try_variant_get(value, "$", "string") == str(wanted)), F.lit(False))


def _holding(wanted: object) -> Callable[[Column], Column]:
    return lambda x: contains(x, wanted)


def holds(body: Column, wanted: dict) -> Column:
    """Whether a JSON text holds wanted; nothing wanted holds everywhere, even where the text is no JSON."""
    return contains(F.try_parse_json(body), wanted) if wanted else F.lit(True)


def _rewritten(walk: Callable[[object], object]) -> Callable[[Column], Column]:
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            try:
                return json.dumps(walk(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
            except (ValueError, RecursionError):  # no JSON: shown as it is
                return text

        return texts.map(one)

    return F.pandas_udf(run, "string")


def filtered(payload: Column, parts: tuple[str, ...] = SECRETS, ends: str = SECRET_ENDS) -> Column:
    """JSON text with the whole value, null too, under each key that holds one of parts (in any case) or matches ends masked, at any depth."""
    secret = re.compile("|".join(["(?i:" + re.escape(p) + ")" for p in parts] + ([ends] if ends else [])))

    def walk(value: object) -> object:
        if isinstance(value, dict):
            return {k: FILTERED if secret.search(k) else walk(v) for k, v in value.items()}
        return [walk(v) for v in value] if isinstance(value, list) else value

    return _rewritten(walk)(payload)


def redacted(payload: Column, keys: tuple[str, ...] = BODIES) -> Column:
    """JSON text with the leaf under each of the keys masked; objects and lists under them are entered, and null stays."""

    def walk(value: object) -> object:
        if isinstance(value, dict):
            return {k: REDACTED if k in keys and v is not None and not isinstance(v, dict | list) else walk(v) for k, v in value.items()}
        return [walk(v) for v in value] if isinstance(value, list) else value

    return _rewritten(walk)(payload)
