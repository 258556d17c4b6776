"""JSON functions that Spark lacks, as Arrow-batched UDFs over JSON text: containment, set, remove, append."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STEP = re.compile(r"\.?([^.\[\]]+)|\[(\d+)\]")


def path_steps(path: str) -> list[str | int]:
    """Steps of a path such as $.a.b[0].c or a.b[0]."""
    return [int(i) if i else k for k, i in _STEP.findall(path.removeprefix("$"))]


def parsed(text):
    try:
        return True, json.loads(text)
    except (TypeError, ValueError):
        return False, None


def contains(whole, part) -> bool:
    """Whether part is in whole: objects by key, arrays as sets, other values by equality."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and contains(whole[k], v) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(contains(w, p) for w in whole) for p in part)
    return type(whole) is type(part) and whole == part or (
        isinstance(whole, (int, float)) and isinstance(part, (int, float)) and not isinstance(whole, bool) and not isinstance(part, bool) and whole == part
    )


def dumped(value) -> str:
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def put(value, steps: list, new):
    """value with new at the path: objects on the way are made, arrays are lengthened with null."""
    if not steps:
        return new
    step, rest = steps[0], steps[1:]
    if isinstance(step, int):
        out = list(value) if isinstance(value, list) else []
        out.extend([None] * (step + 1 - len(out)))
        out[step] = put(out[step], rest, new)
        return out
    out = dict(value) if isinstance(value, dict) else {}
    out[step] = put(out.get(step), rest, new)
    return out


def take_out(value, steps: list):
    """value without what is at the path; unchanged where the path leads nowhere."""
    step, rest = steps[0], steps[1:]
    if isinstance(step, int) and isinstance(value, list) and step < len(value):
        out = list(value)
        out[step : step + 1] = [take_out(out[step], rest)] if rest else []
        return out
    if isinstance(step, str) and isinstance(value, dict) and step in value:
        out = dict(value)
        if rest:
            out[step] = take_out(out[step], rest)
        else:
            del out[step]
        return out
    return value


def loosely(text):
    """A value argument: JSON where it parses, else the text itself."""
    ok, value = parsed(text)
    return value if ok else text


@F.pandas_udf(T.BooleanType())
def json_contains(whole: pd.Series, part: pd.Series) -> pd.Series:
    def one(w, p):
        (a, x), (b, y) = parsed(w), parsed(p)
        return contains(x, y) if a and b else None

    return pd.Series([one(w, p) for w, p in zip(whole, part, strict=True)], dtype="object")


@F.pandas_udf(T.StringType())
def json_set(text: pd.Series, path: pd.Series, value: pd.Series) -> pd.Series:
    def one(t, p, v):
        ok, x = parsed(t)
        return dumped(put(x, path_steps(p), loosely(v))) if ok else None

    return pd.Series([one(*r) for r in zip(text, path, value, strict=True)], dtype="object")


@F.pandas_udf(T.StringType())
def json_remove(text: pd.Series, path: pd.Series) -> pd.Series:
    def one(t, p):
        ok, x = parsed(t)
        steps = path_steps(p)
        return dumped(take_out(x, steps) if steps else x) if ok else None

    return pd.Series([one(*r) for r in zip(text, path, strict=True)], dtype="object")


@F.pandas_udf(T.StringType())
def json_array_append(text: pd.Series, value: pd.Series) -> pd.Series:
    def one(t, v):
        ok, x = parsed(t)
        return dumped([*x, loosely(v)]) if ok and isinstance(x, list) else None

    return pd.Series([one(*r) for r in zip(text, value, strict=True)], dtype="object")


UDFS = {f"tessera_{f.__name__}": f for f in (json_contains, json_set, json_remove, json_array_append)}


def register(spark: SparkSession) -> None:
    for name, fn in UDFS.items():
        spark.udf.register(name, fn)
