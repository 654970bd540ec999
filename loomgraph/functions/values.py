"""A compiled expression: a Column, its type where known, and what else is known of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T


@dataclass
class Val:
    col: Column
    type: T.DataType | None = None
    #: seconds of a duration (year 365 days, month 30 days), for comparison with time differences
    seconds: float | None = None
    #: entries of a map literal
    entries: dict[str, Val] | None = None
    #: what the value stands for: node, edge, path, nodes (ids of a path), value
    kind: str = "value"
    binding: Any = None
    literal: Any = None
    items: list[Val] | None = None


def is_text(v: Val) -> bool:
    return isinstance(v.type, T.StringType)


def is_list(v: Val) -> bool:
    return isinstance(v.type, T.ArrayType)


def is_number(v: Val) -> bool:
    return isinstance(v.type, T.NumericType)


def is_time(v: Val) -> bool:
    return isinstance(v.type, T.DateType | T.TimestampType | T.TimestampNTZType)


def is_null(v: Val) -> bool:
    return isinstance(v.type, T.NullType)


Builder = Callable[..., Val]
