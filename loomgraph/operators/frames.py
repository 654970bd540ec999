"""Node and edge frames: one struct column a row, with hidden fields for ids, labels and types."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.errors import BindingError
from loomgraph.sources.graph import EdgeTable, PropertyGraph

HIDDEN = ("__id", "__label", "__type", "__src", "__dst", "__sl", "__dl")


def common(kinds: Sequence[T.DataType]) -> T.DataType:
    """One type for columns that are united: theirs, the wider number, else string."""
    first = kinds[0]
    if all(k == first for k in kinds):
        return first
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return T.LongType()
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.DoubleType()
    return T.StringType()


def same_key(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Equality of two ids, as text where one is text and the other isn't."""
    if isinstance(ta, T.StringType) != isinstance(tb, T.StringType):
        return a.cast("string") == b.cast("string")
    return a == b


def united(frames: list[tuple[DataFrame, dict[str, tuple[Column, T.DataType]]]]) -> list[DataFrame]:
    """Each frame as one struct column x of all fields of all frames, of common types; missing fields are null."""
    names = list(dict.fromkeys(n for _, f in frames for n in f))
    kinds = {n: common([f[n][1] for _, f in frames if n in f]) for n in names}
    out = []
    for df, f in frames:
        fields = [(f[n][0] if f[n][1] == kinds[n] else f[n][0].cast(kinds[n])) if n in f else F.lit(None).cast(kinds[n]) for n in names]
        out.append(df.select(F.struct(*(c.alias(n) for n, c in zip(names, fields, strict=True))).alias("x")))
    return out


def node_frame(g: PropertyGraph, labels: Sequence[str]) -> DataFrame:
    """Column x: struct of __id, __label and properties, of all nodes with one of the labels."""
    if len(labels) == len(g.nodes) and len(labels) > 1 and g.triple is not None:
        df, kind = g.triple["nodes"], g.triple["node_type"]
        t = next(iter(g.nodes.values()))
        frames = [(df.where(F.col(kind).isin(list(labels))), {"__id": (F.col(t.id), df.schema[t.id].dataType), "__label": (F.col(kind), T.StringType())} | {c: (F.col(f"`{c}`"), df.schema[c].dataType) for c in df.columns})]
    else:
        tables = [g.nodes[x] for x in labels]
        frames = [(t.df, {"__id": (F.col(f"`{t.id}`"), t.df.schema[t.id].dataType), "__label": (F.lit(t.label), T.StringType())} | {c: (F.col(f"`{c}`"), t.df.schema[c].dataType) for c in t.props}) for t in tables]
    return reduce(DataFrame.union, united(frames))


def edge_frame(g: PropertyGraph, tables: Sequence[EdgeTable], flipped: Sequence[EdgeTable] = ()) -> DataFrame:
    """Columns x (the edge struct) and f, t (structs of label and id of the ends, in the direction of travel).

    Edges of ``tables`` go from source to target, those of ``flipped`` from target to source. An edge from a node
    to itself is in the flipped half only if it is not in the other, so that it is met once.
    """
    if not tables and not flipped:
        raise BindingError("no edges of these types between these labels")
    rows: list[tuple[EdgeTable, bool]] = [(e, False) for e in tables] + [(e, True) for e in flipped]
    if g.triple is not None:
        # one scan of the one table, whatever the types and labels: ids are unique over labels
        kind, seen = g.triple["edge_type"], {}
        for e, flip in rows:
            seen.setdefault(flip, {})[e.type] = e
        rows = []
        frames, flips = [], []
        for flip, by in seen.items():
            e = next(iter(by.values()))
            df = g.triple["edges"].where(F.col(kind).isin(list(by)) if len(by) > 1 else F.col(kind) == next(iter(by)))
            frames.append((df, _edge_fields(e, df, F.col(kind), F.lit(""), F.lit(""))))
            flips.append((flip, flip and False in seen))
    else:
        straight = {(e.source, e.type, e.target) for e in tables}
        frames = [(e.df, _edge_fields(e, e.df, F.lit(e.type), F.lit(e.source), F.lit(e.target))) for e, _ in rows]
        flips = [(flip, flip and (e.source, e.type, e.target) in straight) for e, flip in rows]
    out = []
    for df, (flip, no_loops) in zip(united(frames), flips, strict=True):
        s = F.struct(F.col("x.__sl").alias("label"), F.col("x.__src").alias("id"))
        d = F.struct(F.col("x.__dl").alias("label"), F.col("x.__dst").alias("id"))
        if no_loops:
            df = df.where((F.col("x.__src") != F.col("x.__dst")) | (F.col("x.__sl") != F.col("x.__dl")))
        out.append(df.select("x", (d if flip else s).alias("f"), (s if flip else d).alias("t")))
    return reduce(DataFrame.union, out)


def _edge_fields(e: EdgeTable, df: DataFrame, kind: Column, source: Column, target: Column) -> dict[str, tuple[Column, T.DataType]]:
    ends = common([df.schema[e.src].dataType, df.schema[e.dst].dataType])
    text = T.StringType()
    return {
        "__type": (kind, text), "__sl": (source, text), "__dl": (target, text), "__src": (F.col(f"`{e.src}`").cast(ends), ends), "__dst": (F.col(f"`{e.dst}`").cast(ends), ends),
        **{c: (F.col(f"`{c}`"), df.schema[c].dataType) for c in df.columns},
    }
