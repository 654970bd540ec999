"""Expressions to Columns, by the types of their operands."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.errors import BindingError, QueryError, UnsupportedError, did_you_mean
from loomgraph.functions import registry
from loomgraph.functions.values import Val, is_list, is_null, is_number, is_text, is_time
from loomgraph.lang import ast as A
from loomgraph.operators.frames import HIDDEN, common
from loomgraph.plans.scope import Binding

_B = T.BooleanType()
_DATE_PARTS = {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second, "week": F.weekofyear, "quarter": F.quarter, "dayOfWeek": F.dayofweek}


def literal(v: Any) -> Val:
    """A Python value as a literal of its Spark type."""
    if v is None:
        return Val(F.lit(None), T.NullType())
    if isinstance(v, bool):
        return Val(F.lit(v), _B, literal=v)
    if isinstance(v, int):
        return Val(F.lit(v), T.IntegerType() if -(1 << 31) <= v < 1 << 31 else T.LongType(), literal=v)
    if isinstance(v, float):
        return Val(F.lit(v), T.DoubleType(), literal=v)
    if isinstance(v, str):
        return Val(F.lit(v), T.StringType(), literal=v)
    if isinstance(v, list | tuple):
        return listed([literal(x) for x in v])
    if isinstance(v, dict):
        return mapped({k: literal(x) for k, x in v.items()})
    c = F.lit(v)
    import datetime

    kind = T.TimestampType() if isinstance(v, datetime.datetime) else T.DateType() if isinstance(v, datetime.date) else T.BinaryType() if isinstance(v, bytes) else None
    return Val(c, kind, literal=v)


def listed(items: list[Val]) -> Val:
    if not items:
        return Val(F.array().cast("array<string>"), T.ArrayType(T.StringType()), items=[])
    kinds = [i.type for i in items if not is_null(i)]
    if kinds and all(k is not None for k in kinds):
        kind = common(kinds)
        return Val(F.array(*(i.col if i.type == kind else i.col.cast(kind) for i in items)), T.ArrayType(kind), items=items)
    return Val(F.array(*(i.col for i in items)), None if not kinds else None, items=items)


def mapped(entries: dict[str, Val]) -> Val:
    known = all(v.type is not None for v in entries.values())
    kind = T.StructType([T.StructField(k, v.type) for k, v in entries.items()]) if known else None
    return Val(F.struct(*(v.col.alias(k) for k, v in entries.items())) if entries else F.struct(F.lit(None).alias("_")), kind, entries=entries)


class Expressions:
    """Compiles expressions over a scope. locals are lambda variables; args are Python values of parameters."""

    def __init__(self, scope: dict[str, Binding], args: dict[str, Any], text: str, df=None, locals: dict[str, Val] | None = None):
        self.scope, self.args, self.text, self.df, self.locals = scope, args, text, df, locals or {}

    def within(self, **more: Val) -> Expressions:
        return Expressions(self.scope, self.args, self.text, self.df, {**self.locals, **more})

    def col(self, e: A.Node) -> Column:
        return self.val(e).col

    def val(self, e: A.Node) -> Val:
        v = getattr(self, f"_{type(e).__name__.lower()}")(e)
        if v.type is None and self.df is not None and not self.locals:
            v.type = self.df.select(v.col.alias("x")).schema["x"].dataType
        return v

    # leaves

    def _lit(self, e: A.Lit) -> Val:
        return literal(e.value)

    def _param(self, e: A.Param) -> Val:
        if e.name not in self.args:
            raise BindingError(f"no value for parameter ${e.name}{did_you_mean(e.name, list(self.args))}")
        return literal(self.args[e.name])

    def _var(self, e: A.Var) -> Val:
        if e.name in self.locals:
            return self.locals[e.name]
        b = self.scope.get(e.name)
        if b is None:
            raise BindingError(f"unknown variable {e.name!r}{did_you_mean(e.name, [n for n in self.scope if n[0] != ' '])}", self.text, e.at)
        return Val(b.col, b.type, kind=b.kind, binding=b)

    def _prop(self, e: A.Prop) -> Val:
        v = self.val(e.base)
        if v.entries is not None:
            if e.name not in v.entries:
                return Val(F.lit(None), T.NullType())
            return v.entries[e.name]
        if v.kind == "pathnode":
            if v.binding is not None and e.name == v.binding.id_name:
                return Val(v.col, v.type)
            raise UnsupportedError(f"nodes of a path have only their id here, not {e.name!r}", self.text, e.at)
        if is_time(v) and e.name in _DATE_PARTS:
            return Val(_DATE_PARTS[e.name](v.col), T.IntegerType())
        if isinstance(v.type, T.MapType):
            return Val(v.col[e.name], v.type.valueType)
        if not isinstance(v.type, T.StructType):
            if v.type is None:
                return Val(v.col[e.name])
            raise BindingError(f"{v.type.simpleString()} has no property {e.name!r}", self.text, e.at)
        names = [n for n in v.type.names if n not in HIDDEN]
        if e.name not in names:
            raise BindingError(f"unknown property {e.name!r}{did_you_mean(e.name, names)}", self.text, e.at)
        return Val(v.col[e.name], v.type[e.name].dataType)

    def _listof(self, e: A.ListOf) -> Val:
        return listed([self.val(i) for i in e.items])

    def _mapof(self, e: A.MapOf) -> Val:
        return mapped({k: self.val(v) for k, v in e.items})

    # operators

    def _unary(self, e: A.Unary) -> Val:
        v = self.val(e.arg)
        return Val(~v.col, _B) if e.op == "NOT" else Val(-v.col, v.type)

    def _isnull(self, e: A.IsNull) -> Val:
        v = self.val(e.arg)
        return Val(v.col.isNotNull() if e.negated else v.col.isNull(), _B)

    def _haslabels(self, e: A.HasLabels) -> Val:
        v = self.val(e.arg)
        if v.kind == "node":
            return Val(v.col["__label"].isin(list(e.labels)) if len(e.labels) == 1 else F.lit(False), _B)
        if v.kind == "edge":
            return Val(v.col["__type"].isin(list(e.labels)), _B)
        raise QueryError("a label test takes a node or a relationship")

    def _binary(self, e: A.Binary) -> Val:
        op = e.op
        if op == "IN":
            return self._in(e)
        a, b = self.val(e.left), self.val(e.right)
        if op in ("AND", "OR"):
            return Val(a.col & b.col if op == "AND" else a.col | b.col, _B)
        if op == "XOR":
            return Val((a.col & ~b.col) | (~a.col & b.col), _B)
        if op in ("STARTS WITH", "ENDS WITH", "CONTAINS"):
            return Val({"STARTS WITH": F.startswith, "ENDS WITH": F.endswith, "CONTAINS": F.contains}[op](a.col, b.col), _B)
        if op == "=~":
            return Val(F.rlike(a.col, F.concat(F.lit("^(?:"), b.col, F.lit(")$"))), _B)
        if op in ("=", "<>", "<", ">", "<=", ">="):
            return self._compare(op, a, b)
        if op == "+" and (is_list(a) or is_list(b)):
            left = a.col if is_list(a) else F.array(a.col)
            right = b.col if is_list(b) else F.array(b.col)
            return Val(F.concat(left, right), a.type if is_list(a) else b.type)
        if op == "+" and (is_text(a) or is_text(b)):
            return Val(F.concat(a.col.cast("string"), b.col.cast("string")), T.StringType())
        if op in "+-" and is_time(a):
            if is_time(b) and op == "-":
                return Val(F.unix_timestamp(a.col.cast("timestamp")) - F.unix_timestamp(b.col.cast("timestamp")), T.LongType())
            if not is_number(b):
                return Val(a.col.cast("timestamp") + b.col if op == "+" else a.col.cast("timestamp") - b.col, T.TimestampType())
            return Val(F.date_add(a.col, b.col) if op == "+" else F.date_sub(a.col, b.col), T.DateType())
        if op == "+" and is_time(b):
            return Val(b.col.cast("timestamp") + a.col, T.TimestampType())
        if op == "/":  # always a fraction; null by zero
            return Val(F.try_divide(a.col.cast("double"), b.col.cast("double")), T.DoubleType())
        if op == "%":
            return Val(F.try_mod(a.col, b.col), common([x.type for x in (a, b)]) if is_number(a) and is_number(b) else None)
        if op == "^":
            return Val(F.pow(a.col.cast("double"), b.col.cast("double")), T.DoubleType())
        out = None
        if is_number(a) and is_number(b):
            out = T.DoubleType() if any(isinstance(x.type, T.DoubleType | T.FloatType) for x in (a, b)) else T.LongType() if all(isinstance(x.type, T.IntegralType) for x in (a, b)) else None
        if isinstance(out, T.LongType):  # no overflow of 32 bits
            a, b = (Val(x.col.cast("bigint")) if x.literal is None else Val(F.lit(x.literal).cast("bigint")) for x in (a, b))
        return Val({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[op], out)

    def _compare(self, op: str, a: Val, b: Val) -> Val:
        x, y = a.col, b.col
        if {a.kind, b.kind} <= {"node", "edge"} and a.kind == b.kind and op in ("=", "<>"):
            fields = ("__label", "__id") if a.kind == "node" else ("__type", "__sl", "__src", "__dl", "__dst")
            x, y = (F.struct(*(v.col[f] for f in fields)) for v in (a, b))
            same = F.when(a.col.isNotNull() & b.col.isNotNull(), x == y)
            return Val(same if op == "=" else ~same, _B)
        # a time difference in seconds against a duration
        x, y = (F.lit(v.seconds) if v.seconds is not None and is_number(o) else c for v, o, c in ((a, b, x), (b, a, y)))
        if is_time(a) and is_text(b):
            y = b.col.cast(a.type)
        elif is_time(b) and is_text(a):
            x = a.col.cast(b.type)
        return Val({"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], _B)

    def _in(self, e: A.Binary) -> Val:
        a, b = self.val(e.left), self.val(e.right)
        if b.items is not None:
            # with SQL's rules for nulls in the list
            return Val(a.col.isin(*(i.col for i in b.items)) if b.items else F.when(a.col.isNotNull(), F.lit(False)), _B)
        if is_list(b):
            same = F.exists(b.col, lambda x: x == a.col)
            return Val(same, _B)
        raise QueryError(f"IN takes a list, not {b.type.simpleString() if b.type else 'a value'}")

    def _case(self, e: A.Case) -> Val:
        subject = self.col(e.subject) if e.subject is not None else None
        out, kinds = None, []
        for when, then in e.whens:
            w, t = self.val(when), self.val(then)
            c = w.col if subject is None else subject == w.col
            kinds.append(t)
            out = F.when(c, t.col) if out is None else out.when(c, t.col)
        if e.default is not None:
            d = self.val(e.default)
            kinds.append(d)
            out = out.otherwise(d.col)
        types = [k.type for k in kinds if not is_null(k)]
        return Val(out, types[0] if types and all(t == types[0] for t in types) else None)

    # lists

    def _index(self, e: A.Index) -> Val:
        v, i = self.val(e.base), self.val(e.at_)
        if isinstance(i.literal, str):
            return self._prop(A.Prop(e.base, i.literal))
        n = F.when(i.col < 0, F.size(v.col) + i.col).otherwise(i.col).cast("int")
        return Val(F.get(v.col, n), v.type.elementType if is_list(v) else None)

    def _slice(self, e: A.Slice) -> Val:
        v = self.val(e.base)
        size = F.size(v.col)
        bound = lambda x, d: d if x is None else F.greatest(F.lit(0), F.least(size, F.when(self.col(x) < 0, size + self.col(x)).otherwise(self.col(x)).cast("int")))
        low, high = bound(e.low, F.lit(0)), bound(e.high, size)
        return Val(F.slice(v.col, low + 1, F.greatest(high - low, F.lit(0))), v.type)

    def _element(self, v: Val, x: Column) -> Val:
        """A lambda variable over the elements of a list."""
        kind = v.type.elementType if is_list(v) else None
        return Val(x, kind, kind="pathnode" if v.kind == "nodes" else "value", binding=v.binding if v.kind == "nodes" else None)

    def _quantifier(self, e: A.Quantifier) -> Val:
        items = self._items(e.items)
        test = lambda x: self.within(**{e.var: self._element(items, x)}).col(e.where)
        if e.kind == "ALL":
            return Val(F.forall(items.col, test), _B)
        if e.kind in ("ANY", "NONE"):
            some = F.exists(items.col, test)
            return Val(some if e.kind == "ANY" else ~some, _B)
        return Val(F.size(F.filter(items.col, test)) == 1, _B)

    def _items(self, e: A.Node) -> Val:
        v = self.val(e)
        return v

    def _comprehension(self, e: A.Comprehension) -> Val:
        items = self._items(e.items)
        col, kind = items.col, items.type
        if e.where is not None:
            col = F.filter(col, lambda x: self.within(**{e.var: self._element(items, x)}).col(e.where))
        if e.out is not None:
            made: list[Val] = []

            def one(x: Column) -> Column:
                made.append(self.within(**{e.var: self._element(items, x)}).val(e.out))
                return made[-1].col

            col = F.transform(col, one)
            kind = T.ArrayType(made[0].type) if made and made[0].type is not None else None
        return Val(col, kind, kind="value" if e.out is not None else items.kind, binding=items.binding)

    def _reduce(self, e: A.Reduce) -> Val:
        items, first = self._items(e.items), self.val(e.start)
        # the accumulator has the type of a step from it
        probe = self.within(**{e.acc: Val(first.col, first.type), e.var: self._element(items, F.lit(None))}).val(e.out).type
        kind = probe if probe is not None and first.type is not None and not isinstance(probe, T.NullType) else (T.DoubleType() if is_number(first) else first.type)
        if is_number(Val(first.col, kind)) and is_number(first):
            kind = common([kind, first.type])
        start = first.col.cast(kind) if kind is not None else first.col

        def merge(acc: Column, x: Column) -> Column:
            out = self.within(**{e.acc: Val(acc, kind), e.var: self._element(items, x)}).col(e.out)
            return out.cast(kind) if kind is not None else out

        return Val(F.aggregate(items.col, start, merge), kind)

    # calls

    def _call(self, e: A.Call) -> Val:
        name = e.name
        if name in registry.AGGREGATES:
            raise QueryError(f"{name} is an aggregate: it can't stand here", self.text, e.at)
        if name == "is_terminator":
            raise QueryError("is_terminator stands alone in the WHERE of a variable-length pattern", self.text, e.at)
        args = [self.val(a) for a in e.args]
        if name in registry.SPECIAL:
            return self._special(e, args[0])
        if name == "last" or name == "size" and args and args[0].kind == "path":
            name = {"last": "last_of", "size": "length"}[name]
        return registry.call(name, args, self.text, e.at)

    def _special(self, e: A.Call, v: Val) -> Val:
        names = lambda: [n for n in v.type.names if n not in HIDDEN]
        if v.kind == "node":
            if e.name == "id":
                return Val(v.col["__id"], v.type["__id"].dataType)
            if e.name == "labels":
                return Val(F.array(v.col["__label"]), T.ArrayType(T.StringType()))
        if v.kind == "edge":
            if e.name == "type":
                return Val(v.col["__type"], T.StringType())
            if e.name in ("startnode", "endnode"):
                f = "__src" if e.name == "startnode" else "__dst"
                return Val(v.col[f], v.type[f].dataType)
        if v.kind in ("node", "edge") and e.name == "keys":
            return Val(F.array_compact(F.array(*(F.when(v.col[n].isNotNull(), F.lit(n)) for n in sorted(names())))), T.ArrayType(T.StringType()))
        if v.kind in ("node", "edge") and e.name == "properties":
            return self.shown(v)
        if e.name == "exists":
            return Val(v.col.isNotNull(), _B)
        raise QueryError(f"{e.name} doesn't take this", self.text, e.at)

    def _exists(self, e: A.Exists) -> Val:
        raise UnsupportedError("EXISTS inside a list expression", self.text)

    _patterncomprehension = _exists

    # results

    def shown(self, v: Val) -> Val:
        """A value as a result: entities without hidden fields, their properties by name; edges with src and dst."""
        if v.kind == "path":
            return Val(v.col["nodes"], v.type["nodes"].dataType)
        if v.kind not in ("node", "edge"):
            return v
        fields = {n: v.col[n] for n in v.type.names if n not in HIDDEN}
        kinds = {n: v.type[n].dataType for n in fields}
        if v.kind == "edge":
            fields |= {"src": v.col["__src"], "dst": v.col["__dst"]}
            kinds |= {"src": v.type["__src"].dataType, "dst": v.type["__dst"].dataType}
        order = sorted(fields)
        return Val(F.when(v.col.isNotNull(), F.struct(*(fields[n].alias(n) for n in order))), T.StructType([T.StructField(n, kinds[n]) for n in order]))
