"""Every function name of the language: how many arguments it takes and the Column that it becomes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.errors import QueryError, UnsupportedError, did_you_mean
from loomgraph.functions.values import Val, is_list, is_text

_S, _L, _D, _B, _I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()
#: Days that a year and a month count for where a duration is compared with a number of seconds.
_SECONDS = {"years": 365 * 86400, "months": 30 * 86400, "weeks": 7 * 86400, "days": 86400, "hours": 3600, "minutes": 60, "seconds": 1}
_ISO = re.compile(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$")


def _double(v: Val) -> Column:
    return v.col if isinstance(v.type, T.DoubleType) else v.col.cast("double")


def _simple(fn, out: T.DataType | None):
    return lambda *a: Val(fn(*(x.col for x in a)), out)


def _math(fn):
    return lambda *a: Val(fn(*(_double(x) for x in a)), _D)


def _same(fn):
    return lambda a, *r: Val(fn(a.col, *(x.col for x in r)), a.type)


def _size(v: Val) -> Val:
    return Val(F.length(v.col), _I) if is_text(v) else Val(F.when(v.col.isNotNull(), F.size(v.col)), _I)


def _length(v: Val) -> Val:
    if v.kind == "path":
        return Val(v.col["length"], _I)
    return _size(v)


def _range(a: Val, b: Val, step: Val | None = None) -> Val:
    s = step.col if step is not None else F.lit(1)
    ends = (s > 0) & (a.col <= b.col) | (s < 0) & (a.col >= b.col)
    # a branch that isn't taken must not see a sequence with the wrong sign
    safe = F.when(ends, b.col).otherwise(a.col)
    return Val(F.when(ends, F.sequence(a.col.cast("bigint"), safe.cast("bigint"), F.when(ends, s).otherwise(F.lit(1)).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), T.ArrayType(_L))


def _entry(v: Val, name: str, default: int) -> Column:
    return v.entries[name].col if name in v.entries else F.lit(default)


def _date(v: Val | None = None) -> Val:
    if v is None:
        return Val(F.current_date(), T.DateType())
    if v.entries is not None:
        return Val(F.make_date(_entry(v, "year", 1970), _entry(v, "month", 1), _entry(v, "day", 1)), T.DateType())
    return Val(F.to_date(v.col), T.DateType())


def _datetime(v: Val | None = None) -> Val:
    if v is None:
        return Val(F.current_timestamp(), T.TimestampType())
    if v.entries is not None:
        parts = [_entry(v, n, d) for n, d in (("year", 1970), ("month", 1), ("day", 1), ("hour", 0), ("minute", 0))]
        return Val(F.make_timestamp(*parts, _entry(v, "second", 0).cast("double")), T.TimestampType())
    return Val(F.to_timestamp(v.col), T.TimestampType())


def _time(v: Val | None = None) -> Val:
    if v is None:
        return Val(F.date_format(F.current_timestamp(), "HH:mm:ss"), _S)
    if v.entries is not None:
        return Val(F.format_string("%02d:%02d:%02d", *(_entry(v, n, 0).cast("int") for n in ("hour", "minute", "second"))), _S)
    return Val(F.date_format(F.to_timestamp(v.col), "HH:mm:ss"), _S)


def _duration(v: Val) -> Val:
    if v.entries is not None:
        wrong = [k for k in v.entries if k not in _SECONDS]
        if wrong:
            raise QueryError(f"duration has no part {wrong[0]!r}{did_you_mean(wrong[0], list(_SECONDS))}")
        cols = {k: v.entries[k].col for k in v.entries}
        plain = all(isinstance(e.literal, int | float) for e in v.entries.values())
        seconds = sum(_SECONDS[k] * e.literal for k, e in v.entries.items()) if plain else None
    elif isinstance(v.literal, str):
        m = _ISO.match(v.literal)
        if not m or v.literal in ("P", "PT"):
            raise QueryError(f"{v.literal!r} is not an ISO-8601 duration")
        got = {k: float(x) if k == "seconds" else int(x) for k, x in zip(_SECONDS, m.groups(), strict=True) if x is not None}
        cols, seconds = {k: F.lit(x) for k, x in got.items()}, sum(_SECONDS[k] * x for k, x in got.items())
    else:
        raise UnsupportedError("duration takes a map or a literal string")
    part = lambda k: cols[k].cast("int") if k in cols else F.lit(0)
    interval = F.make_interval(part("years"), part("months"), part("weeks"), part("days"), part("hours"), part("minutes"), (cols["seconds"] if "seconds" in cols else F.lit(0)).cast("decimal(18,6)"))
    return Val(interval, T.CalendarIntervalType() if hasattr(T, "CalendarIntervalType") else None, seconds=seconds)


def _between(a: Val, b: Val) -> Val:
    return Val(F.datediff(b.col, a.col), _I)


def _truncate(unit: Val, v: Val) -> Val:
    if not isinstance(unit.literal, str):
        raise UnsupportedError("date.truncate takes a literal unit")
    return Val(F.date_trunc(unit.literal, v.col), T.TimestampType())


def _sign(v: Val) -> Val:
    return Val(F.signum(_double(v)), _D)


def _round(v: Val, places: Val | None = None) -> Val:
    return Val(F.round(v.col) if places is None else F.round(v.col, places.literal if isinstance(places.literal, int) else places.col), v.type)


def _coalesce(*vs: Val) -> Val:
    kinds = [v.type for v in vs if v.type is not None and not isinstance(v.type, T.NullType)]
    return Val(F.coalesce(*(v.col for v in vs)), kinds[0] if kinds and all(k == kinds[0] for k in kinds) else None)


def _nodes(v: Val) -> Val:
    if v.kind != "path":
        raise QueryError("nodes() takes a path")
    return Val(v.col["nodes"], v.type["nodes"].dataType, kind="nodes", binding=v.binding)


def _relationships(v: Val) -> Val:
    if v.kind == "path":
        return Val(v.col["rels"], v.type["rels"].dataType)
    if is_list(v):
        return v
    raise QueryError("relationships() takes a path")


def _substring(v: Val, start: Val, n: Val | None = None) -> Val:
    return Val(F.substring(v.col, start.col + 1, n.col if n is not None else F.length(v.col)), _S)


def _element(v: Val) -> T.DataType | None:
    return v.type.elementType if is_list(v) else None


def _reverse(v: Val) -> Val:
    return Val(F.reverse(v.col), v.type)


#: name: (fewest arguments, most, builder). None for most: any number.
FUNCTIONS = {
    "tofloat": (1, 1, lambda v: Val(v.col.try_cast("double"), _D)),
    "todouble": (1, 1, lambda v: Val(v.col.try_cast("double"), _D)),
    "tostring": (1, 1, lambda v: Val(v.col.cast("string"), _S)),
    "toboolean": (1, 1, lambda v: Val(v.col.try_cast("boolean"), _B)),
    "tointeger": (1, 1, lambda v: Val(v.col.try_cast("bigint"), _L)),
    "tolong": (1, 1, lambda v: Val(v.col.try_cast("bigint"), _L)),
    "startswith": (2, 2, _simple(F.startswith, _B)),
    "endswith": (2, 2, _simple(F.endswith, _B)),
    "contains": (2, 2, _simple(F.contains, _B)),
    "left": (2, 2, _simple(F.left, _S)),
    "right": (2, 2, _simple(F.right, _S)),
    "trim": (1, 1, _simple(F.trim, _S)),
    "ltrim": (1, 1, _simple(F.ltrim, _S)),
    "rtrim": (1, 1, _simple(F.rtrim, _S)),
    "toupper": (1, 1, _simple(F.upper, _S)),
    "tolower": (1, 1, _simple(F.lower, _S)),
    "coalesce": (1, None, _coalesce),
    "range": (2, 3, _range),
    "size": (1, 1, _size),
    "length": (1, 1, _length),
    "nodes": (1, 1, _nodes),
    "relationships": (1, 1, _relationships),
    "rels": (1, 1, _relationships),
    "abs": (1, 1, _same(F.abs)),
    "ceil": (1, 1, _simple(F.ceil, _L)),
    "ceiling": (1, 1, _simple(F.ceil, _L)),
    "floor": (1, 1, _simple(F.floor, _L)),
    "round": (1, 2, _round),
    "sqrt": (1, 1, _math(F.sqrt)),
    "sign": (1, 1, _sign),
    "log": (1, 1, _math(F.ln)),
    "ln": (1, 1, _math(F.ln)),
    "log10": (1, 1, _math(F.log10)),
    "exp": (1, 1, _math(F.exp)),
    "sin": (1, 1, _math(F.sin)),
    "cos": (1, 1, _math(F.cos)),
    "tan": (1, 1, _math(F.tan)),
    "asin": (1, 1, _math(F.asin)),
    "acos": (1, 1, _math(F.acos)),
    "atan": (1, 1, _math(F.atan)),
    "atan2": (2, 2, _math(F.atan2)),
    "degrees": (1, 1, _math(F.degrees)),
    "radians": (1, 1, _math(F.radians)),
    "rand": (0, 0, lambda: Val(F.rand(), _D)),
    "random": (0, 0, lambda: Val(F.rand(), _D)),
    "pi": (0, 0, lambda: Val(F.pi(), _D)),
    "e": (0, 0, lambda: Val(F.e(), _D)),
    "date": (0, 1, _date),
    "datetime": (0, 1, _datetime),
    "timestamp": (0, 1, _datetime),
    "localdatetime": (0, 1, _datetime),
    "time": (0, 1, _time),
    "localtime": (0, 1, _time),
    "duration": (1, 1, _duration),
    "duration.between": (2, 2, _between),
    "year": (1, 1, _simple(F.year, _I)),
    "month": (1, 1, _simple(F.month, _I)),
    "day": (1, 1, _simple(F.day, _I)),
    "hour": (1, 1, _simple(F.hour, _I)),
    "minute": (1, 1, _simple(F.minute, _I)),
    "second": (1, 1, _simple(F.second, _I)),
    "week": (1, 1, _simple(F.weekofyear, _I)),
    "dayofweek": (1, 1, _simple(F.dayofweek, _I)),
    "quarter": (1, 1, _simple(F.quarter, _I)),
    "date.truncate": (2, 2, _truncate),
    # common names beyond the required ones
    "substring": (2, 3, _substring),
    "split": (2, 2, lambda v, d: Val(F.split(v.col, F.concat(F.lit("\\Q"), d.col, F.lit("\\E"))), T.ArrayType(_S))),
    "replace": (3, 3, _simple(F.replace, _S)),
    "concat": (1, None, lambda *v: Val(F.concat(*(x.col if is_list(x) else x.col.cast("string") for x in v)), v[0].type if is_list(v[0]) else _S)),
    "head": (1, 1, lambda v: Val(F.get(v.col, 0), _element(v))),
    "last_of": (1, 1, lambda v: Val(F.get(v.col, F.size(v.col) - 1), _element(v))),
    "tail": (1, 1, lambda v: Val(F.when(F.size(v.col) > 0, F.slice(v.col, 2, F.greatest(F.size(v.col), F.lit(1)))).otherwise(v.col), v.type)),
    "reverse": (1, 1, _reverse),
}

#: Aggregates; stdev and percentile forms included.
AGGREGATES = frozenset(("count", "sum", "avg", "min", "max", "first", "last", "stdev", "stddev", "stdevp", "stddevp", "collect", "percentilecont", "percentiledisc"))

#: Names that the compiler itself gives meaning: a directive and accessors of nodes and edges.
SPECIAL = frozenset(("is_terminator", "id", "labels", "type", "keys", "properties", "startnode", "endnode", "exists"))


def call(name: str, args: list[Val], query: str = "", at: int | None = None) -> Val:
    if name not in FUNCTIONS:
        raise UnsupportedError(f"unknown function {name!r}{did_you_mean(name, [*FUNCTIONS, *AGGREGATES, *SPECIAL])}", query, at)
    low, high, build = FUNCTIONS[name]
    if len(args) < low or (high is not None and len(args) > high):
        raise QueryError(f"{name} takes {low if low == high else f'{low} to {high or "any number of"}'} arguments, not {len(args)}", query, at)
    return build(*args)


def aggregate(name: str, args: list[Val], distinct: bool, order: list[tuple[Val, bool]], query: str = "", at: int | None = None) -> Val:
    """An aggregate's Column. order is of collect(x ORDER BY y)."""
    if not args:
        raise QueryError(f"{name} needs an argument", query, at)
    v = args[0]
    if name == "count":
        return Val(F.count_distinct(v.col) if distinct else F.count(v.col), _L)
    if name == "sum":
        out = _D if isinstance(v.type, T.DoubleType | T.FloatType) else _L if isinstance(v.type, T.IntegralType) else None
        return Val(F.sum_distinct(v.col) if distinct else F.sum(v.col), out)
    if name == "avg":
        c = v.col.cast("double")
        return Val(F.sum_distinct(c) / F.count_distinct(c) if distinct else F.avg(c), _D)
    if name in ("min", "max", "first", "last"):
        return Val({"min": F.min, "max": F.max, "first": lambda c: F.first(c, True), "last": lambda c: F.last(c, True)}[name](v.col), v.type)
    if name in ("stdev", "stddev"):
        return Val(F.stddev_samp(v.col), _D)
    if name in ("stdevp", "stddevp"):
        return Val(F.stddev_pop(v.col), _D)
    if name == "collect":
        out = T.ArrayType(v.type) if v.type is not None else None
        if order:
            return Val(_ordered(v, order, distinct), out)
        return Val(F.collect_set(v.col) if distinct else F.collect_list(v.col), out)
    if len(args) != 2 or not isinstance(args[1].literal, int | float):
        raise QueryError(f"{name} takes a value and a literal share", query, at)
    return Val(F.percentile(v.col, F.lit(float(args[1].literal))), _D)


def _ordered(v: Val, order: list[tuple[Val, bool]], distinct: bool) -> Column:
    rows = F.collect_list(F.when(v.col.isNotNull(), F.struct(v.col.alias("v"), *(o.col.alias(f"k{i}") for i, (o, _) in enumerate(order)))))

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i in range(len(order) - 1, -1, -1):
            x, y = a[f"k{i}"], b[f"k{i}"]
            sign = -1 if order[i][1] else 1
            # nulls last ascending, first descending
            one = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), sign).when(y.isNull(), -sign).when(x < y, -sign).when(x > y, sign).otherwise(0)
            out = F.when(one != 0, one).otherwise(out)
        return out.cast("int")

    values = F.transform(F.array_sort(rows, compare), lambda r: r["v"])
    return F.array_distinct(values) if distinct else values
