"""Property graphs over DataFrames.

A graph holds a DataFrame for each node label and for each edge triple (source label, type, target label). Columns
and types come from the DataFrames; nothing is declared twice.
"""

from __future__ import annotations

import contextlib
import io
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.errors import BindingError, did_you_mean


@dataclass(frozen=True)
class NodeTable:
    label: str
    df: DataFrame
    id: str

    @property
    def props(self) -> list[str]:
        return self.df.columns


@dataclass(frozen=True)
class EdgeTable:
    source: str
    type: str
    target: str
    df: DataFrame
    src: str
    dst: str
    #: "source" or "target" where every row is also that end's row in its node table, which has both columns
    of: str | None = None

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in (self.src, self.dst)]


@dataclass
class PropertyGraph:
    """Nodes and edges by label and triple, and queries over them.

    assume_referential_integrity: edges are known to end at nodes that exist. Then a node of which a query needs
    only the id is taken from the edge, without a join. Off by default, because it changes results where edges
    are orphaned.
    """

    spark: SparkSession
    assume_referential_integrity: bool = False
    max_depth: int = 10
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: dict[tuple[str, str, str], EdgeTable] = field(default_factory=dict)
    wildcard_nodes: bool = True
    #: ids are unique over all labels (triple stores), so an id alone is a key
    global_ids: bool = False
    #: the one node and one edge table of a triple store, and their type columns
    triple: dict | None = None

    # registration

    def add_nodes(self, label: str, df: DataFrame, id: str, where: Column | str | None = None, rename: dict[str, str] | None = None) -> PropertyGraph:
        """Nodes of a label. rename gives columns other property names; id is a column of df."""
        if id not in df.columns:
            raise BindingError(f"node label {label!r}: no column {id!r}{did_you_mean(id, df.columns)}")
        rename = rename or {}
        self.nodes[label] = NodeTable(label, (df if where is None else df.where(where)).withColumnsRenamed(rename), rename.get(id, id))
        return self

    def add_edges(self, source: str, type: str, target: str, df: DataFrame | None = None, src: str = "", dst: str = "", where: Column | str | None = None, rename: dict[str, str] | None = None, of: str | None = None) -> PropertyGraph:
        """Edges of a type between two labels; src and dst are the columns with the ids of their ends.

        of: the edges are foreign keys in the node table of their "source" or "target"; then no df is given, and src
        and dst are properties of that node. Hops over such edges read the node's row and join nothing for the edge.
        """
        for label in (source, target):
            if label not in self.nodes:
                raise BindingError(f"edge type {type!r}: no node label {label!r}{did_you_mean(label, list(self.nodes))}")
        if of is not None:
            if of not in ("source", "target") or df is not None or where is not None or rename:
                raise BindingError(f"edge type {type!r}: of is 'source' or 'target', without a table of its own")
            node = self.nodes[source if of == "source" else target]
            if (src if of == "source" else dst) != node.id:
                raise BindingError(f"edge type {type!r}: {of} is identified by {node.id!r}")
            df = node.df
        for c in (src, dst):
            if c not in df.columns:
                raise BindingError(f"edge type {type!r}: no column {c!r}{did_you_mean(c, df.columns)}")
        if of is not None:
            df = df.select(*dict.fromkeys((src, dst))).where(F.col(f"`{src}`").isNotNull() & F.col(f"`{dst}`").isNotNull())
        rename = rename or {}
        self.edges[source, type, target] = EdgeTable(source, type, target, (df if where is None else df.where(where)).withColumnsRenamed(rename), rename.get(src, src), rename.get(dst, dst), of)
        return self

    # lookup

    def labels(self, wanted: Sequence[str] = ()) -> list[str]:
        """Labels that a pattern's labels stand for: all if it has none."""
        for label in wanted:
            if label not in self.nodes:
                raise BindingError(f"unknown node label {label!r}{did_you_mean(label, list(self.nodes))}")
        if not wanted and not self.wildcard_nodes:
            raise BindingError("nodes without a label are not enabled for this graph")
        return list(wanted) or list(self.nodes)

    def triples(self, types: Iterable[str], sources: Iterable[str], targets: Iterable[str]) -> list[EdgeTable]:
        known = {t for _, t, _ in self.edges}
        for t in (types := list(types)):
            if t not in known:
                raise BindingError(f"unknown relationship type {t!r}{did_you_mean(t, list(known))}")
        sources, targets = set(sources), set(targets)
        return [e for (s, t, d), e in self.edges.items() if (not types or t in types) and s in sources and d in targets]

    # queries

    def cypher(self, query: str, parameters: dict | None = None, *, vlp_mode: str = "paths", bidirectional: str = "auto", **more) -> DataFrame:
        """The result of a query as a DataFrame. Parameters are Python values for $name.

        vlp_mode: "paths" gives every node-simple path; "reachability" (or "procedural") gives each reached
        node once for each start, at the least depth. bidirectional: "auto" searches from both ends where both
        are fixed by their ids, "off" never does, "on" wherever both ends are bound.
        """
        from loomgraph.plans.compiler import Compiler

        return Compiler(self, {**(parameters or {}), **more}, vlp_mode=vlp_mode, bidirectional=bidirectional).run(query)

    def explain(self, query: str, parameters: dict | None = None, mode: str = "formatted", **how) -> str:
        """Text of the plan that Spark would run."""
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            self.cypher(query, parameters, **how).explain(mode)
        return out.getvalue()

    def plan(self, query: str, parameters: dict | None = None, *, vlp_mode: str = "paths", bidirectional: str = "auto", **more) -> str:
        """The logical plan of a query, a step a line in the order of execution: scans, hops, searches, filters, projections.

        Searches of more than a few levels run while they are compiled, so for those this takes as long as the query.
        """
        from loomgraph.plans.compiler import Compiler

        compiler = Compiler(self, {**(parameters or {}), **more}, vlp_mode=vlp_mode, bidirectional=bidirectional)
        compiler.run(query)
        return "\n".join(compiler.steps)

    def create_views(self, prefix: str = "") -> list[str]:
        """Registers every node and edge DataFrame as a temporary view; returns the names."""
        names = []
        for label, n in self.nodes.items():
            n.df.createOrReplaceTempView(f"{prefix}{label}")
            names.append(f"{prefix}{label}")
        for (s, t, d), e in self.edges.items():
            e.df.createOrReplaceTempView(f"{prefix}{s}_{t}_{d}")
            names.append(f"{prefix}{s}_{t}_{d}")
        return names

    def drop_views(self, names: Iterable[str]) -> None:
        for n in names:
            self.spark.catalog.dropTempView(n)


def triple_store(
    nodes: DataFrame, edges: DataFrame, *, node_id: str = "node_id", node_type: str = "node_type", src: str = "src", dst: str = "dst", edge_type: str = "relationship_type",
    node_types: Sequence[str] | None = None, edge_types: Sequence[str] | None = None, edge_combinations: Sequence[tuple[str, str, str]] | None = None, discover_edge_combinations: bool = False, **options,
) -> PropertyGraph:
    """A graph over one table of nodes and one of edges, told apart by type columns.

    Types that are not given are discovered with one DISTINCT query each. Edge combinations are given, or
    discovered with one join, or every combination of types exists.
    """
    spark = nodes.sparkSession
    g = PropertyGraph(spark, global_ids=True, **options)
    if node_types is None:
        node_types = sorted(r[0] for r in nodes.select(node_type).where(F.col(node_type).isNotNull()).distinct().collect())
    if edge_types is None:
        edge_types = sorted(r[0] for r in edges.select(edge_type).where(F.col(edge_type).isNotNull()).distinct().collect())
    if edge_combinations is None and discover_edge_combinations:
        ends = nodes.select(F.col(node_id).alias("i"), F.col(node_type).alias("t"))
        found = edges.join(ends.toDF("i1", "t1"), F.col(src) == F.col("i1")).join(ends.toDF("i2", "t2"), F.col(dst) == F.col("i2"))
        edge_combinations = sorted(tuple(r) for r in found.select("t1", edge_type, "t2").distinct().collect())
    for t in node_types:
        g.add_nodes(t, nodes, node_id, where=F.col(node_type) == t)
    for s, t, d in edge_combinations if edge_combinations is not None else [(s, t, d) for t in edge_types for s in node_types for d in node_types]:
        g.add_edges(s, t, d, edges, src, dst, where=F.col(edge_type) == t)
    g.triple = {"nodes": nodes, "edges": edges, "node_type": node_type, "edge_type": edge_type}
    return g


def from_yaml(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None, **options) -> PropertyGraph:
    """A graph from a YAML schema.

    schema (or the top level): nodes: [{name, tableName, idProperty: {name}, filter}], edges: [{name, sourceNode, sinkNode, tableName,
    sourceIdProperty: {name}, sinkIdProperty: {name}, filter}], noLabelSupport: true | {enabled}. Tables are looked
    up in ``tables`` by their full or last name, else with spark.table.
    """
    import yaml

    spec, tables = yaml.safe_load(text) or {}, tables or {}
    spec = spec.get("schema", spec)

    def frame(name: str) -> DataFrame:
        last = name.split(".")[-1]
        return tables[name] if name in tables else tables[last] if last in tables else spark.table(name)

    def named(entry: dict, *keys: str) -> str:
        value = next((entry[k] for k in keys if k in entry), None)
        if value is None:
            raise BindingError(f"schema entry {entry.get('name')!r} has none of {', '.join(keys)}")
        return value["name"] if isinstance(value, dict) else value

    loose = spec.get("noLabelSupport", True)
    g = PropertyGraph(spark, wildcard_nodes=bool(loose.get("enabled", True) if isinstance(loose, dict) else loose), **options)
    for n in spec.get("nodes", []):
        g.add_nodes(named(n, "name", "label"), frame(named(n, "tableName", "table")), named(n, "idProperty", "id", "idColumn", "nodeIdProperty"), where=n.get("filter"))
    for e in spec.get("edges", []):
        g.add_edges(named(e, "sourceNode", "source", "from"), named(e, "name", "type"), named(e, "sinkNode", "target", "to"), frame(named(e, "tableName", "table")), named(e, "sourceIdProperty", "src", "sourceIdColumn"), named(e, "sinkIdProperty", "dst", "sinkIdColumn"), where=e.get("filter"))
    return g
