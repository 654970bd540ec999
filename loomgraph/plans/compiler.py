"""Clauses to DataFrames. Catalyst plans the joins; only what needs knowledge of the graph is decided here."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.errors import BindingError, QueryError, UnsupportedError, did_you_mean
from loomgraph.functions import registry
from loomgraph.functions.values import Val
from loomgraph.lang import ast as A
from loomgraph.lang.parser import parse
from loomgraph.operators import paths
from loomgraph.operators.frames import HIDDEN, common, edge_frame, node_frame, same_key
from loomgraph.plans.expressions import Expressions
from loomgraph.plans.scope import Binding, State
from loomgraph.sources.graph import EdgeTable, PropertyGraph
from loomgraph.storage import stored

_FLIP = {"out": "in", "in": "out", "both": "both"}
_VOLATILE = {"rand", "random"}


def _has_aggregate(e: Any) -> bool:
    return any(isinstance(n, A.Call) and n.name in registry.AGGREGATES for n in A.walk(e))


class Compiler:
    def __init__(self, graph: PropertyGraph, args: dict[str, Any], vlp_mode: str = "paths", bidirectional: str = "auto"):
        if vlp_mode not in ("paths", "cte", "reachability", "procedural"):
            raise QueryError(f"vlp_mode is 'paths' or 'reachability', not {vlp_mode!r}")
        if bidirectional not in ("auto", "on", "off", "recursive", "unrolling"):
            raise QueryError(f"bidirectional is 'auto', 'on' or 'off', not {bidirectional!r}")
        self.g, self.args, self.text, self.n = graph, args, "", 0
        self.reach, self.both = vlp_mode in ("reachability", "procedural"), bidirectional
        #: property names that the query takes from each variable; None: all
        self.used: dict[str, set[str] | None] = {}
        #: foreign keys of each variable's node that hops may need
        self.keys: dict[str, set[str]] = {}
        #: conditions that a search applies to its edges, so that nothing else has to see these
        self.pushed: list[A.Node] = []
        #: the logical plan, a line a step
        self.steps: list[str] = []
        self.tree: A.Query | None = None

    def run(self, query: str) -> DataFrame:
        self.text = query
        self.tree = tree = parse(query)
        self._usage(tree)
        out, names = None, None
        for i, part in enumerate(tree.parts):
            df = self.single(part)
            if out is None:
                out, names = df, df.columns
                continue
            if len(df.columns) != len(names) or {c.lower() for c in df.columns} != {c.lower() for c in names}:
                raise QueryError(f"the parts of a UNION return {', '.join(names)} and {', '.join(df.columns)}")
            out = out.unionByName(df)
            if not tree.alls[i - 1]:
                out = out.distinct()
            self.steps.append("union all" if tree.alls[i - 1] else "union, distinct")
        return out

    def _usage(self, tree: A.Query) -> None:
        """Bare uses of a variable need all its properties, n.p needs p. WITH n passes on what later uses need."""
        passed: list[tuple[str, str]] = []

        def visit(x: Any) -> None:
            if isinstance(x, A.Prop) and isinstance(x.base, A.Var):
                if self.used.get(x.base.name, set()) is not None:
                    self.used.setdefault(x.base.name, set()).add(x.name)
                return
            if isinstance(x, A.Var):
                self.used[x.name] = None
            if isinstance(x, A.Call) and x.name in ("count", "id") and len(x.args) == 1 and isinstance(x.args[0], A.Var):
                self.used.setdefault(x.args[0].name, set())
                return
            if isinstance(x, A.NodePattern):
                if x.props and self.used.get(x.var, set()) is not None:
                    self.used.setdefault(x.var, set()).update(k for k, _ in x.props)
            if isinstance(x, A.Project) and not x.final:
                for i in x.items:
                    if isinstance(i.expr, A.Var):
                        passed.append((i.expr.name, i.alias or i.expr.name))
                    else:
                        visit(i.expr)
                for e in (*(e for e, _ in x.order), x.skip, x.limit, x.where):
                    if e is not None:
                        visit(e)
                return
            for c in A.children(x):
                if isinstance(c, A.Node | tuple):
                    visit(c)

        visit(tree)
        for _ in passed:
            for old, new in passed:
                if old != new and self.used.get(old, set()) is not None:
                    later = self.used.get(new, set())
                    self.used[old] = None if later is None else self.used.get(old, set()) | later
        for q in A.walk(tree):
            if isinstance(q, A.Pattern):
                for i, r in enumerate(q.rels):
                    for e in self.g.edges.values():
                        if e.of and (not r.types or e.type in r.types):
                            for n in (q.nodes[i], q.nodes[i + 1]):
                                self.keys.setdefault(n.var, set()).update((e.src, e.dst))
        if any(isinstance(c, A.Project) and c.star for p in tree.parts for c in p.clauses):
            self.used = dict.fromkeys({n.var for n in A.walk(tree) if isinstance(n, A.NodePattern)})

    def _wanted(self, path: str | None, rels: str) -> set[str]:
        """Which of "nodes" and "rels" the query takes from a searched path, by its variable or by that of its relationships."""
        if any(isinstance(c, A.Project) and c.star for p in self.tree.parts for c in p.clauses):
            return {"nodes", "rels"}
        out: set[str] = set()

        def visit(x: Any) -> None:
            if x in self.pushed:
                return
            if isinstance(x, A.Call) and len(x.args) == 1 and path is not None and x.args[0] == A.Var(path):
                out.update({"length": (), "size": (), "nodes": ("nodes",), "relationships": ("rels",), "rels": ("rels",)}.get(x.name, ("nodes", "rels")))
                return
            if isinstance(x, A.Var):
                out.update(("nodes", "rels") if x.name == path else ("rels",) if x.name == rels else ())
            for c in A.children(x):
                if isinstance(c, A.Node | tuple):
                    visit(c)

        visit(self.tree)
        return out

    # helpers

    def fresh(self, name: str) -> str:
        self.n += 1
        return f"{''.join(c if c.isalnum() else '_' for c in name.strip()) or 'x'}_{self.n}"

    def exprs(self, s: State) -> Expressions:
        return Expressions(s.scope, self.args, self.text, s.df)

    def single(self, part: A.Single) -> DataFrame:
        s = State()
        for clause in part.clauses:
            if isinstance(clause, A.Match):
                self.optional(s, clause) if clause.optional and s.df is not None else self.match(s, clause.patterns, clause.where)
            elif isinstance(clause, A.Unwind):
                self.unwind(s, clause)
            else:
                self.project(s, clause)
        return s.df

    def begin(self, s: State) -> None:
        """One row without variables, for queries that don't start with a pattern."""
        if s.df is None:
            s.df = self.g.spark.range(1).select(F.lit(0).alias(self.fresh("one")))

    def unwind(self, s: State, clause: A.Unwind) -> None:
        self.begin(s)
        expr = self.flagged(s, clause.items)
        v = self.exprs(s).val(expr)
        if v.type is None:
            v.type = s.df.select(v.col.alias("x")).schema["x"].dataType
        name = self.fresh(clause.var)
        if not isinstance(v.type, T.ArrayType):
            raise QueryError(f"UNWIND takes a list, not {v.type.simpleString()}")
        s.df = s.df.withColumn(name, F.explode(v.col))
        s.scope[clause.var] = Binding("pathnode" if v.kind == "nodes" else "value", name, v.type.elementType, id_name=v.binding.id_name if v.binding is not None and v.kind == "nodes" else None)

    # filters

    def keep(self, s: State, cond: A.Node) -> None:
        """WHERE: conjuncts that are EXISTS become semi or anti joins, the others filters."""
        for c in A.conjuncts(cond):
            inner = c.arg if isinstance(c, A.Unary) and c.op == "NOT" else c
            if isinstance(inner, A.Exists):
                self.semi(s, inner, inner is not c)
            else:
                c = self.flagged(s, c)
                self.steps.append(f"filter by {', '.join(sorted(n for n in A.free(c) if n[0] != ' ')) or 'a flag'}")
                s.df = s.df.where(self.exprs(s).col(c))

    def sub(self, s: State, x: A.Node, patterns: tuple[A.Pattern, ...], where: A.Node | None, late: bool = True) -> tuple[State, list[tuple[Column, Column, bool]], list[A.Node]]:
        """A pattern as a plan of its own and how it joins the rows: pairs (ours, its, null-safe), and more conditions.

        If the pattern itself needs no more of our variables than the ids of nodes, it starts from its own edges, and
        conditions that also speak of our variables are left to the join (if ``late`` allows). Else it starts from the
        distinct values of what it needs; rows that come from a join are stored first, since they are read twice.
        """
        outer = {n: s.scope[n] for n in A.free(x) if n in s.scope}
        in_nodes = {n.var for p in patterns for n in p.nodes}
        in_props = {n for p in patterns for e in (*p.nodes, *p.rels) for _, v in e.props for n in A.free(v)}
        bare = {p.nodes[i].var for p in patterns for i in range(len(p.nodes)) if len(p.rels) and not p.nodes[i].props}
        ends = [n for n in outer if n in in_nodes]
        left = [c for c in A.conjuncts(where) if A.free(c) & set(outer) and not any(isinstance(q, A.Exists | A.PatternComprehension) for q in A.walk(c))] if late and ends else []
        own = [c for c in A.conjuncts(where) if c not in left]
        simple = all(outer[n].kind == "node" and n in bare for n in ends) and not any(r.length or r.var in outer for p in patterns for r in p.rels) and bool(in_nodes)
        simple = simple and not (in_props | {v for c in own for v in A.free(c)}) & set(outer) and all(n in ends or any(n in A.free(c) for c in left) for n in outer)
        simple = simple and not any(n.labels and n.var in outer for p in patterns for n in p.nodes)
        t = State()
        if not outer or simple:
            self.match(t, patterns, own, elide=set(ends), known={n: outer[n].labels for n in ends})
            outer = {n: outer[n] for n in ends}
        else:
            left = []
            if s.joined and not s.df.isStreaming:
                self.steps.append("store the rows so far")
                s.df, s.joined = stored(s.df), False
            cols, scope = [], {}
            for n, b in outer.items():
                need = {p.name for p in A.walk(x) if isinstance(p, A.Prop) and p.base == A.Var(n)} | {k for q in A.walk(x) if isinstance(q, A.NodePattern) and q.var == n for k, _ in q.props} | self.keys.get(n, set())
                whole = any(v == A.Var(n) for v in _bare(x))
                kept = [f for f in b.type.names if f in HIDDEN or f in need] if b.kind in ("node", "edge") and not whole else None
                c = self.fresh(n)
                value = b.col if kept is None else F.when(b.col.isNotNull(), F.struct(*(b.col[f].alias(f) for f in kept)))
                cols.append(value.alias(c))
                scope[n] = replace(b, column=c, type=b.type if kept is None else T.StructType([b.type[f] for f in kept]))
            t = State(s.df.select(*cols).distinct(), scope)
            self.match(t, patterns, where)
        pairs = []
        for n, b in outer.items():
            own = t.scope[n]
            if b.kind == "node":
                pairs.append((b.col["__id"], own.col["__id"], False))
                if not self._one_key(b.labels):
                    pairs.append((b.col["__label"], own.col["__label"], False))
            elif b.kind == "edge":
                pairs += [(b.col[f], own.col[f], False) for f in ("__type", "__sl", "__src", "__dl", "__dst")]
            else:
                pairs.append((b.col, own.col, True))
        return t, pairs, left

    def _left(self, s: State, t: State, keys: DataFrame, cond: Column, left: list[A.Node]) -> Column:
        """The join's condition with what was left to it; keys has the columns of the pattern's variables."""
        if left:
            ex = Expressions({**t.scope, **s.scope}, self.args, self.text, s.df.crossJoin(keys))
            for c in left:
                cond = cond & ex.col(c)
        return cond

    def _keys(self, t: State, pairs: list[tuple[Column, Column, bool]], more: list[Column] = ()) -> tuple[DataFrame, Column]:
        """The plan's key columns, and the condition that joins them."""
        names = [self.fresh("key") for _ in pairs]
        df = t.df.select(*(its.alias(n) for (_, its, _), n in zip(pairs, names, strict=True)), *more)
        cond = F.lit(True)
        for (ours, _, safe), n in zip(pairs, names, strict=True):
            one = ours.eqNullSafe(F.col(n)) if safe else ours == F.col(n)
            cond = one if cond is None else cond & one
        return df, cond

    def semi(self, s: State, e: A.Exists, negated: bool) -> None:
        self.steps.append(f"{'anti' if negated else 'semi'} join with:")
        t, pairs, left = self.sub(s, e, e.patterns, e.where)
        if not pairs:  # says the same of every row
            c = self.fresh("any")
            s.df = s.df.crossJoin(t.df.agg(F.count(F.lit(1)).alias(c))).where(F.col(c) == 0 if negated else F.col(c) > 0).drop(c)
            return
        keys, cond = self._keys(t, pairs, [t.scope[n].col.alias(t.scope[n].column) for n in sorted({v for c in left for v in A.free(c)} & set(t.scope) - set(s.scope))])
        s.df = s.df.join(keys, self._left(s, t, keys, cond, left), "left_anti" if negated else "left_semi")
        s.joined = True

    def flagged(self, s: State, e: Any) -> Any:
        """e with a hidden variable for every EXISTS and pattern comprehension in it, joined to the rows."""
        def change(x: A.Node) -> A.Node | None:
            if isinstance(x, A.Quantifier | A.Comprehension | A.Reduce):
                return x  # a pattern over a lambda variable is refused where it is compiled
            if isinstance(x, A.Exists):
                self.steps.append("flag from:")
                t, pairs, _ = self.sub(s, x, x.patterns, x.where, late=False)
                c = self.fresh("exists")
                if not pairs:
                    s.df = s.df.crossJoin(t.df.agg((F.count(F.lit(1)) > 0).alias(c)))
                else:
                    keys, cond = self._keys(t, pairs)
                    names = keys.columns
                    s.df = s.df.join(keys.distinct().withColumn(c, F.lit(True)), cond, "left").drop(*names).withColumn(c, F.coalesce(c, F.lit(False)))
                s.scope[f" {c}"] = Binding("value", c, T.BooleanType())
                return A.Var(f" {c}")
            if isinstance(x, A.PatternComprehension):
                self.steps.append("list from:")
                t, pairs, _ = self.sub(s, x, (x.pattern,), x.where, late=False)
                out = self.exprs(t)
                v = out.val(x.out)
                c = self.fresh("list")
                keys, cond = self._keys(t, pairs, [v.col.alias(c)])
                names = [n for n in keys.columns if n != c]
                got = keys.groupBy(*names).agg(F.collect_list(c).alias(c))
                kind = got.schema[c].dataType
                s.df = s.df.join(got, cond, "left").drop(*names).withColumn(c, F.coalesce(F.col(c), F.array().cast(kind)))
                s.scope[f" {c}"] = Binding("value", c, kind)
                return A.Var(f" {c}")
            return None

        return A.rewrite(e, change)

    # patterns

    def match(self, s: State, patterns: tuple[A.Pattern, ...], where: A.Node | list[A.Node] | None, elide: set[str] = frozenset(), known: dict[str, tuple[str, ...]] | None = None) -> None:
        """Joins the patterns to the rows and keeps what ``where`` allows, each conjunct as soon as it can be said."""
        labels: dict[str, tuple[str, ...]] = dict(known or {})
        for p in patterns:
            for n in p.nodes:
                if len(n.labels) > 1:
                    raise UnsupportedError(f"nodes with several labels ({':'.join(n.labels)})", self.text, n.at)
                if n.labels:
                    if n.var in labels and len(labels[n.var]) == 1 and labels[n.var] != n.labels:
                        raise BindingError(f"{n.var!r} has label {labels[n.var][0]!r} and {n.labels[0]!r}", self.text, n.at)
                    labels[n.var] = n.labels
        pending = list(where) if isinstance(where, list) else A.conjuncts(where)
        for p in patterns:
            for x in (*p.nodes, *(r for r in p.rels if r.length is None)):
                pending += [A.Binary("=", A.Prop(A.Var(x.var, x.at), k, x.at), v) for k, v in x.props]
        names = {x.var for p in patterns for x in (*p.nodes, *p.rels)} | {p.path for p in patterns if p.path} | set(s.scope)
        for c in pending:
            for v in A.free(c) - names:
                if not isinstance(c, A.Exists) and not any(isinstance(q, A.Exists | A.PatternComprehension) for q in A.walk(c)):
                    raise BindingError(f"unknown variable {v!r}{did_you_mean(v, [n for n in names if n[0] != ' '])}", self.text, next((q.at for q in A.walk(c) if q == A.Var(v)), None))
        self._terminators(pending, patterns)
        if any(r.length for p in patterns for r in p.rels):
            for p in patterns:
                self.pattern(s, p, labels, pending, elide, names)
        else:
            self.hops(s, patterns, labels, pending, elide, names)
        self._ready(s, pending, names, last=True)

    def _ready(self, s: State, pending: list[A.Node], names: set[str], last: bool = False) -> None:
        for c in list(pending):
            if last or all(v in s.scope for v in A.free(c) & names):
                pending.remove(c)
                self.keep(s, c)

    def _terminators(self, pending: list[A.Node], patterns: tuple[A.Pattern, ...]) -> None:
        ends = {n.var for p in patterns for i, r in enumerate(p.rels) if r.length for n in (p.nodes[i], p.nodes[i + 1])}
        for c in pending:
            for q in A.walk(c):
                if isinstance(q, A.Call) and q.name == "is_terminator":
                    if q is not c:
                        raise QueryError("is_terminator stands alone in the WHERE of a variable-length pattern", self.text, q.at)
                    if len(q.args) != 1:
                        raise QueryError("is_terminator takes one condition", self.text, q.at)
                    if not any(r.length for p in patterns for r in p.rels):
                        raise QueryError("is_terminator needs a variable-length pattern", self.text, q.at)
                    if not A.free(q) <= ends or len(A.free(q)) != 1:
                        raise QueryError("is_terminator speaks of the target of the variable-length pattern only", self.text, q.at)

    def hops(self, s: State, patterns: tuple[A.Pattern, ...], labels: dict, pending: list[A.Node], elide: set[str], names: set[str]) -> None:
        """Patterns of fixed length, joined in the order that multiplies rows least.

        First come hops between nodes that are both known, then hops that find one node for each row (a foreign key
        in the row), then others, those from nodes that stand above many rows last, else in the order of the text.
        Where nothing is known yet, the start is the node from which the fewest hops multiply rows.
        """
        for p in patterns:
            for n in p.nodes:
                if n.var in s.scope and s.scope[n.var].kind != "node":
                    raise BindingError(f"{n.var!r} is no node", self.text, n.at)
        steps: dict[tuple[int, int], dict] = {}
        lazy = lambda n: n.var in elide or (self.g.assume_referential_integrity and not self._needs(n, labels, s))
        todo = [(k, i) for k, p in enumerate(patterns) for i in range(len(p.rels))]
        ends = {(k, i): (patterns[k].nodes[i], patterns[k].nodes[i + 1]) for k, i in todo}

        def rank(x: tuple[int, int], known: dict[str, int]) -> tuple[int, int] | None:
            """0: closes a circle, 1: finds one node a row, 2: multiplies rows, and how far up the known end is; None: out of reach."""
            a, b = ends[x]
            if a.var in known and b.var in known:
                return 0, 0
            if a.var not in known and b.var not in known:
                return None
            return 1 if self._to_one(s, a, patterns[x[0]].rels[x[1]], b, labels, a.var in known) else 2, known[a.var if a.var in known else b.var]

        def learn(x: tuple[int, int], known: dict[str, int]) -> None:
            """A node found by a foreign key stands above many rows: hops down from there make all pairs of these and what is found."""
            r = rank(x, known)
            for n in ends[x]:
                known.setdefault(n.var, r[1] + 1 if r[0] == 1 else 0)

        def cost(start: str) -> int:
            known, rest, total = {start: 0}, set(todo), 0
            while reach := [(r, x) for x in rest if (r := rank(x, known)) is not None]:
                r, x = min(reach)
                total += (1 + r[1]) * (r[0] == 2)
                learn(x, known)
                rest.remove(x)
            return total

        def take(x: tuple[int, int], a: A.NodePattern, b: A.NodePattern, origin: Binding | None) -> None:
            r = patterns[x[0]].rels[x[1]]
            steps[x] = self.hop(s, origin, a, r, b, r.direction if a is ends[x][0] else _FLIP[r.direction], labels, lazy)
            todo.remove(x)
            self._ready(s, pending, names)

        known: dict[str, int] = dict.fromkeys(s.scope, 0)
        for k, p in enumerate(patterns):
            while not p.rels and p.nodes[0].var not in s.scope or any(x[0] == k for x in todo):
                reach = [(r, x) for x in todo if (r := rank(x, known)) is not None]
                if reach:
                    x = min(reach)[1]
                    a, b = ends[x] if ends[x][0].var in known else ends[x][::-1]
                    learn(x, known)
                    take(x, a, b, s.scope[a.var])
                    continue
                # the nodes that hang together with this pattern's first
                near = {p.nodes[0].var}
                while (grown := near | {n.var for x in todo if any(m.var in near for m in ends[x]) for n in ends[x]}) != near:
                    near = grown
                order = list({n.var: n for q in patterns for n in q.nodes if n.var in near}.values())
                start = min(order, key=lambda n: cost(n.var))
                first = next((x for x in todo if start.var in {n.var for n in ends[x]} and ends[x][0].var != ends[x][1].var), None)
                if lazy(start) and first is not None:
                    a, b = ends[first] if ends[first][0].var == start.var else ends[first][::-1]
                    known |= {a.var: 0, b.var: 0}
                    take(first, a, b, None)
                else:
                    known[start.var] = 0
                    self.scan(s, start, labels)
                    self._ready(s, pending, names)
        for k, p in enumerate(patterns):
            if p.path:
                self.path(s, p, [steps[k, i] for i in range(len(p.rels))])
                self._ready(s, pending, names)

    def _single(self, r: A.RelPattern, direction: str, la: tuple[str, ...], lb: tuple[str, ...]) -> tuple[EdgeTable, str] | None:
        """The one foreign key that a hop stands for, and which side of the hop ("near" or "far") has it in its row."""
        ahead = self.g.triples(r.types, la, lb) if direction in ("out", "both") else []
        back = self.g.triples(r.types, lb, la) if direction in ("in", "both") else []
        if len(ahead) + len(back) != 1 or self.g.triple is not None:
            return None
        e = (ahead or back)[0]
        return (e, "near" if (e.of == "source") == bool(ahead) else "far") if e.of else None

    def _to_one(self, s: State, a: A.NodePattern, r: A.RelPattern, b: A.NodePattern, labels: dict, forward: bool) -> bool:
        la, lb = (tuple(self.g.labels(s.scope[n.var].labels if n.var in s.scope else labels.get(n.var, ()))) for n in (a, b))
        one = self._single(r, r.direction, la, lb)
        return one is not None and one[1] == ("near" if forward else "far")

    def in_row(self, s: State, origin: Binding, r: A.RelPattern, b: A.NodePattern, direction: str, la: tuple[str, ...], lb: tuple[str, ...], lazy) -> Binding | None:
        """A hop over a foreign key in a row that is at hand anyway: no join for the edge. Gives the edge, or None if it can't."""
        one = self._single(r, direction, la, lb)
        if one is None or r.var in s.scope:
            return None
        e, side = one
        own = e.source if e.of == "source" else e.target
        other = e.target if e.of == "source" else e.source
        fk = e.dst if e.of == "source" else e.src
        if side == "near":
            if origin.labels != (own,) or not {e.src, e.dst} <= set(origin.type.names):
                return None
            row, key, kind = origin, origin.col[fk], origin.field_type(fk)
        else:
            if b.var in s.scope or lazy(b):
                return None
            n = self.fresh(b.var)
            nodes = node_frame(self.g, (own,)).withColumnRenamed("x", n)
            row = self._node(n, nodes.schema[n].dataType, (own,))
            s.df, s.joined = s.df.join(nodes, self._joins(origin, row.col[fk], row.field_type(fk), F.lit(other) if len(la) > 1 else None)), True
            s.scope[b.var] = row
        kinds = common([row.field_type(e.src), row.field_type(e.dst)])
        text = {"__type": e.type, "__sl": e.source, "__dl": e.target}
        c = self.fresh(r.var)
        fields = [*(F.lit(v).alias(k) for k, v in text.items()), row.col[e.src].cast(kinds).alias("__src"), row.col[e.dst].cast(kinds).alias("__dst"), *(row.col[x].alias(x) for x in dict.fromkeys((e.src, e.dst)))]
        if side == "near":
            if b.var in s.scope:
                s.df = s.df.where(self._joins(s.scope[b.var], key, kind, F.lit(other) if len(lb) > 1 else None))
            elif lazy(b):
                s.df = s.df.where(key.isNotNull())
                self._from_edge(s, b.var, key, F.lit(other), (other,))
            else:
                n = self.fresh(b.var)
                nodes = node_frame(self.g, (other,)).withColumnRenamed("x", n)
                far = self._node(n, nodes.schema[n].dataType, (other,))
                s.df, s.joined = s.df.join(nodes, self._joins(far, key, kind, None)), True
                s.scope[b.var] = far
        s.df = s.df.withColumn(c, F.struct(*fields))
        return Binding("edge", c, s.df.schema[c].dataType)

    def pattern(self, s: State, p: A.Pattern, labels: dict, pending: list[A.Node], elide: set[str], names: set[str]) -> None:
        at = next((i for i, n in enumerate(p.nodes) if n.var in s.scope and s.scope[n.var].kind == "node"), None)
        for n in p.nodes:
            if n.var in s.scope and s.scope[n.var].kind != "node":
                raise BindingError(f"{n.var!r} is no node", self.text, n.at)
        steps: dict[int, dict] = {}
        lazy = lambda n: n.var in elide or (self.g.assume_referential_integrity and not self._needs(n, labels, s))
        if at is None:
            at = 0
            if p.rels and p.rels[0].length is None and lazy(p.nodes[0]) and p.nodes[0].var != p.nodes[1].var:
                steps[0] = self.hop(s, None, p.nodes[0], p.rels[0], p.nodes[1], p.rels[0].direction, labels, lazy)
                self._ready(s, pending, names)
                at = 1
            else:
                self.scan(s, p.nodes[0], labels)
                self._ready(s, pending, names)
        for i in range(at, len(p.rels)):
            steps[i] = self.expand(s, p, i, True, labels, pending, lazy)
            self._ready(s, pending, names)
        for i in range(at - 1, -1, -1):
            if i in steps:
                continue
            steps[i] = self.expand(s, p, i, False, labels, pending, lazy)
            self._ready(s, pending, names)
        if p.path:
            self.path(s, p, [steps[i] for i in range(len(p.rels))])
            self._ready(s, pending, names)

    def _needs(self, n: A.NodePattern, labels: dict, s: State) -> bool:
        """Whether a query needs more of a node than its id."""
        own = labels.get(n.var, ())
        used = self.used.get(n.var, set())
        if used is None or len(own) != 1:
            return True
        return bool(used - {self.g.nodes[own[0]].id if own[0] in self.g.nodes else ""})

    def _one_key(self, labels: tuple[str, ...]) -> bool:
        """Whether ids alone tell nodes of these labels apart."""
        return self.g.global_ids or len(labels) == 1

    def scan(self, s: State, n: A.NodePattern, labels: dict) -> None:
        own = tuple(self.g.labels(labels.get(n.var, ())))
        if not own:
            raise BindingError("the graph has no nodes", self.text, n.at)
        c = self.fresh(n.var)
        self.steps.append(f"scan {n.var}:{'|'.join(own)}{'' if s.df is None else ' (cross join)'}")
        df = node_frame(self.g, own).withColumnRenamed("x", c)
        s.df = df if s.df is None else s.df.crossJoin(df)
        s.scope[n.var] = self._node(c, df.schema[c].dataType, own)

    def _node(self, column: str, kind: T.DataType, labels: tuple[str, ...]) -> Binding:
        ids = {self.g.nodes[x].id for x in labels}
        return Binding("node", column, kind, labels, ids.pop() if len(ids) == 1 else None)

    def _labels_of(self, s: State, n: A.NodePattern, labels: dict) -> tuple[str, ...]:
        if n.var in s.scope:
            own = s.scope[n.var].labels
            if n.labels and n.labels[0] not in own:
                raise BindingError(f"{n.var!r} has no label {n.labels[0]!r}", self.text, n.at)
            return own
        return tuple(self.g.labels(labels.get(n.var, ())))

    def _tables(self, r: A.RelPattern, direction: str, a: tuple[str, ...], b: tuple[str, ...]) -> tuple[list, list]:
        ahead = self.g.triples(r.types, a, b) if direction in ("out", "both") else []
        back = self.g.triples(r.types, b, a) if direction in ("in", "both") else []
        if not ahead and not back:
            raise BindingError(f"no relationship {'|'.join(r.types) or 'of any type'} between {'|'.join(a)} and {'|'.join(b)}", self.text, r.at)
        return ahead, back

    def expand(self, s: State, p: A.Pattern, i: int, ahead: bool, labels: dict, pending: list[A.Node], lazy) -> dict:
        a, b = (p.nodes[i], p.nodes[i + 1]) if ahead else (p.nodes[i + 1], p.nodes[i])
        r = p.rels[i]
        direction = r.direction if ahead else _FLIP[r.direction]
        if r.length is None:
            return self.hop(s, s.scope[a.var], a, r, b, direction, labels, lazy)
        out = self.vlp(s, p, a, r, b, direction, labels, pending, lazy)
        out["ahead"] = ahead
        return out

    def hop(self, s: State, origin: Binding | None, a: A.NodePattern, r: A.RelPattern, b: A.NodePattern, direction: str, labels: dict, lazy) -> dict:
        """One relationship: an equi-join with the edges, one with the far node's table if it is new and needed.

        Without an origin the rows start from the edges, and the near node is known by its id only.
        """
        la, lb = self._labels_of(s, a, labels), self._labels_of(s, b, labels)
        ahead, back = self._tables(r, direction, la, lb)
        known = b.var in s.scope
        arrow = {"out": "->", "in": "<-", "both": "--"}[direction]
        found = self.in_row(s, origin, r, b, direction, la, lb, lazy) if origin is not None else None
        self.steps.append(f"hop {a.var} {arrow} {b.var}{' (known)' if known else ''} by {'|'.join(sorted({e.type for e in (*ahead, *back)}))}{', in the row' if found else ''}")
        if found is not None:
            s.scope[r.var] = found
            return {"edge": found, "near": a.var, "far": b.var}
        s.joined = True
        c, f, t = self.fresh(r.var), self.fresh("from"), self.fresh("to")
        edges = edge_frame(self.g, ahead, back).toDF(c, f, t)
        key = edges.schema[f].dataType["id"].dataType
        ends = {(e.source if not flip else e.target, e.target if not flip else e.source) for flip, es in ((False, ahead), (True, back)) for e in es}
        label_a = not self.g.global_ids and len({x for x, _ in ends} | set(la)) > 1
        label_b = not self.g.global_ids and len({x for _, x in ends} | set(lb)) > 1
        at = lambda side, b_, lab: self._joins(b_, F.col(f"{side}.id"), key, F.col(f"{side}.label") if lab else None)
        loop = a.var == b.var
        if origin is None:
            own = tuple(dict.fromkeys(x for x, _ in ends)) if not self.g.global_ids else la
            s.df = edges if s.df is None else s.df.crossJoin(edges)
            self._from_edge(s, a.var, F.col(f"{f}.id"), F.col(f"{f}.label"), own)
        else:
            cond = at(f, origin, label_a)
            if b.var in s.scope:
                cond = cond & at(t, s.scope[b.var], label_b)
            s.df = s.df.join(edges, cond)
        if r.var in s.scope:
            old = s.scope[r.var]
            if old.kind != "edge":
                raise BindingError(f"{r.var!r} is no relationship", self.text, r.at)
            for x in ("__type", "__sl", "__src", "__dl", "__dst"):
                s.df = s.df.where(old.col[x] == F.col(f"{c}.{x}"))
        else:
            s.scope[r.var] = Binding("edge", c, edges.schema[c].dataType)
        if b.var not in s.scope or (origin is None and b.var in s.scope and not loop):
            if b.var in s.scope:
                s.df = s.df.where(at(t, s.scope[b.var], label_b))
            elif lazy(b):
                own = tuple(x for x in lb if x in {y for _, y in ends}) or lb
                self._from_edge(s, b.var, F.col(f"{t}.id"), F.col(f"{t}.label"), own)
            else:
                own = lb if self.g.global_ids else tuple(x for x in lb if x in {y for _, y in ends})
                n = self.fresh(b.var)
                nodes = node_frame(self.g, own).withColumnRenamed("x", n)
                node = self._node(n, nodes.schema[n].dataType, own)
                s.df = s.df.join(nodes, at(t, node, label_b and len(own) > 1))
                s.scope[b.var] = node
        s.df = s.df.drop(f, t)
        return {"edge": s.scope[r.var], "near": a.var, "far": b.var}

    def _joins(self, b: Binding, key: Column, kind: T.DataType, label: Column | None) -> Column:
        cond = same_key(b.col["__id"], b.field_type("__id"), key, kind)
        return cond if label is None else cond & (b.col["__label"] == label)

    def _from_edge(self, s: State, var: str, key: Column, label: Column, labels: tuple[str, ...]) -> None:
        """Binds a node by its id alone."""
        c = self.fresh(var)
        ids = {self.g.nodes[x].id for x in labels}
        fields = [key.alias("__id"), (F.lit(labels[0]) if len(labels) == 1 else label).alias("__label")]
        if len(ids) == 1:
            fields.append(key.alias(next(iter(ids))))
        s.df = s.df.withColumn(c, F.struct(*fields))
        s.scope[var] = self._node(c, s.df.schema[c].dataType, labels)

    # variable-length paths

    def vlp(self, s: State, p: A.Pattern, a: A.NodePattern, r: A.RelPattern, b: A.NodePattern, direction: str, labels: dict, pending: list[A.Node], lazy) -> dict:
        origin = s.scope[a.var]
        la, lb = self._labels_of(s, a, labels), self._labels_of(s, b, labels)
        least, most = r.length
        most = self.g.max_depth if most is None else most
        if least > most:
            raise QueryError(f"a path of {least} to {most} relationships", self.text, r.at)
        # nodes in the middle may have any label that the types allow
        inner = set(la) | set(lb)
        known = {t for _, t, _ in self.g.edges}
        for t in r.types:
            if t not in known:
                self.g.triples([t], (), ())
        while True:
            ahead = [e for e in self.g.edges.values() if not r.types or e.type in r.types]
            grown = inner | {x for e in ahead for x in ((e.target,) if direction == "out" and e.source in inner else (e.source,) if direction == "in" and e.target in inner else (e.source, e.target) if direction == "both" and (e.source in inner or e.target in inner) else ())}
            if grown == inner:
                break
            inner = grown
        tables, back = self._tables(r, direction, tuple(inner), tuple(inner))
        edges = edge_frame(self.g, tables, back)
        plain = self.g.global_ids or len({x for e in (*tables, *back) for x in (e.source, e.target)} | set(la) | set(lb)) == 1
        kind = edges.schema["f"].dataType["id"].dataType
        key = (lambda label, id_: id_.cast(kind)) if plain else (lambda label, id_: F.struct(label.alias("label"), id_.cast(kind).alias("id")))
        props = [n for n in edges.schema["x"].dataType.names if n not in HIDDEN]
        item = F.struct(F.col("x.__src").alias("src"), F.col("x.__dst").alias("dst"), *(F.col(f"x.`{n}`") for n in props if n not in ("src", "dst")))
        frame = edges.select("x", key(F.col("f.label"), F.col("f.id")).alias("f"), key(F.col("t.label"), F.col("t.id")).alias("t"), item.alias("e"))
        # conditions on every edge: inline properties and ALL(x IN relationships(p) WHERE ...)
        edge = {"x": Binding("edge", "x", frame.schema["x"].dataType)}
        on_edges = Expressions({}, self.args, self.text, frame)
        for k, v in r.props:
            frame = frame.where(Expressions(edge, self.args, self.text, frame).col(A.Binary("=", A.Prop(A.Var("x"), k), v)))
        whole = {A.Var(r.var)} | ({A.Call(f, (A.Var(p.path),)) for f in ("relationships", "rels")} if p.path and len(p.rels) == 1 else set()) | {A.Call(f, (A.Var(r.var),)) for f in ("relationships", "rels")}
        for c in list(pending):
            if isinstance(c, A.Quantifier) and c.kind == "ALL" and c.items in whole and A.free(c.where) <= {c.var}:
                pending.remove(c)
                self.pushed.append(c)
                frame = frame.where(on_edges.within(**{c.var: Val(F.col("e"), frame.schema["e"].dataType)}).col(c.where))
        rels_wanted = "rels" in self._wanted(p.path, r.var)
        frame = frame.select("f", "t", *(["e"] if rels_wanted else []))
        barrier = None
        for c in list(pending):
            if isinstance(c, A.Call) and c.name == "is_terminator" and A.free(c) == {b.var}:
                pending.remove(c)
                # a node of the target's labels, wherever it is on the path
                stop = State()
                self.scan(stop, replace(b, props=()), {b.var: lb})
                self.keep(stop, c.args[0])
                n = stop.scope[b.var].col
                stops = stop.df.select(key(n["__label"], n["__id"]).alias("k"))
                barrier = stops if barrier is None else barrier.unionByName(stops)
        s_, n_ = self.fresh("start"), self.fresh("end")
        depth, path, rels = self.fresh("depth"), self.fresh("path"), self.fresh("rels")
        own = key(origin.col["__label"], origin.col["__id"])
        seeds = s.df.select(own.alias("k")).where(F.col("k").isNotNull() if plain else F.col("k.id").isNotNull()).distinct()
        circular = a.var == b.var
        targets = self._targets(s, b, lb, pending, key, a) if not circular else None
        self.steps.append(f"search {a.var} to {b.var}, {least} to {most} edges of {'|'.join(sorted({e.type for e in (*tables, *back)}))}{', each node once' if self.reach else ''}{', from both ends' if targets is not None else ''}{', with relationships' if rels_wanted else ''}")
        if self.reach:
            found = paths.reachable(seeds, frame, least, most, barrier, targets)
        elif targets is not None and most > 1:
            found = paths.meeting(seeds, targets, frame, least, most, barrier)
        else:
            found = paths.paths(seeds, frame, least, most, circular, barrier)
        if not rels_wanted:
            found = found.withColumn("rels", F.lit(None).cast("array<struct<src:string,dst:string>>"))
        found = found.toDF(s_, n_, depth, path, rels)
        s.joined = True
        s.df = s.df.join(found, own == F.col(s_))
        if not circular:
            if b.var in s.scope:
                far = s.scope[b.var]
                s.df = s.df.where(key(far.col["__label"], far.col["__id"]) == F.col(n_))
            elif lazy(b) and len(lb) == 1:
                end = F.col(n_) if plain else F.col(f"{n_}.id")
                if not plain:
                    s.df = s.df.where(F.col(f"{n_}.label") == lb[0])
                self._from_edge(s, b.var, end, F.lit(lb[0]), lb)
            else:
                n = self.fresh(b.var)
                nodes = node_frame(self.g, lb).withColumnRenamed("x", n)
                far = self._node(n, nodes.schema[n].dataType, lb)
                s.df = s.df.join(nodes, key(far.col["__label"], far.col["__id"]) == F.col(n_))
                s.scope[b.var] = far
        s.df = s.df.drop(s_, n_)
        s.scope[r.var] = Binding("rels", rels, s.df.schema[rels].dataType)
        ids = F.col(path) if plain else F.transform(path, lambda k: k["id"])
        return {"path": ids, "rels": F.col(rels), "depth": F.col(depth), "near": a.var, "far": b.var, "plain": plain}

    def _targets(self, s: State, b: A.NodePattern, lb: tuple[str, ...], pending: list[A.Node], key, a: A.NodePattern) -> DataFrame | None:
        """Keys of the end nodes if the search should start from both ends: both are fixed by an id (or mode "on")."""
        if self.both == "off":
            return None

        def fixed(var: str, own: tuple[str, ...]) -> bool:
            ids = {self.g.nodes[x].id for x in own}
            said = [*pending, *self._said()]
            return len(ids) == 1 and any(isinstance(c, A.Binary) and c.op == "=" and any(x == A.Prop(A.Var(var), i) and isinstance(y, A.Lit | A.Param) for x, y in ((c.left, c.right), (c.right, c.left))) for c in said for i in ids)

        if b.var in s.scope:
            if self.both == "auto":
                return None
            far = s.scope[b.var]
            return s.df.select(key(far.col["__label"], far.col["__id"]).alias("k")).distinct()
        own = [c for c in pending if A.free(c) == {b.var} and not any(isinstance(q, A.Exists | A.PatternComprehension | A.Call) for q in A.walk(c))]
        if not own or (self.both == "auto" and not (fixed(b.var, lb) and fixed(a.var, s.scope[a.var].labels))):
            return None
        end = State()
        self.scan(end, replace(b, props=()), {b.var: lb})
        for c in own:
            self.keep(end, c)
        n = end.scope[b.var].col
        return end.df.select(key(n["__label"], n["__id"]).alias("k")).distinct()

    def _said(self) -> list[A.Node]:
        """What every match of the query holds to: conjuncts of WHERE and properties of its patterns, applied or not."""
        whole = [m for part in self.tree.parts for m in part.clauses if isinstance(m, A.Match) and not m.optional]
        return [c for m in whole for c in A.conjuncts(m.where)] + [A.Binary("=", A.Prop(A.Var(n.var), k), v) for m in whole for p in m.patterns for n in p.nodes for k, v in n.props]

    def path(self, s: State, p: A.Pattern, steps: list[dict]) -> None:
        """Binds a path: length, ids of nodes and structs of relationships in the order of the pattern."""
        start = s.scope[p.nodes[0].var]
        kind = start.field_type("__id")
        if steps and all("edge" not in x for x in steps) and len(steps) == 1:
            one = steps[0]
            nodes, rels, length = one["path"], one["rels"], one["depth"]
            if not one["ahead"]:
                nodes, rels = F.reverse(nodes), F.reverse(rels)
        else:
            ids = [s.scope[n.var].field_type("__id") for n in p.nodes] + [s.df.select(x["path"].alias("y")).schema["y"].dataType.elementType for x in steps if "path" in x]
            kind = common(ids)
            nodes = F.array(start.col["__id"].cast(kind))
            length, lists, names = F.lit(0), [], []
            for x in steps:
                b = x["edge"].type if "edge" in x else s.df.select(x["rels"].alias("y")).schema["y"].dataType.elementType
                names.append({n: b[n].dataType for n in b.names if n not in HIDDEN and n not in ("src", "dst")})
            fields: dict[str, T.DataType] = {}
            for own in names:
                for n, t in own.items():
                    fields[n] = common([fields[n], t]) if n in fields else t
            for i, x in enumerate(steps):
                has = names[i]
                if "edge" in x:
                    e = x["edge"].col
                    nodes = F.concat(nodes, F.array(s.scope[p.nodes[i + 1].var].col["__id"].cast(kind)))
                    length = length + 1
                    lists.append(F.array(F.struct(e["__src"].cast("string").alias("src"), e["__dst"].cast("string").alias("dst"), *((e[n] if n in has else F.lit(None)).cast(t).alias(n) for n, t in fields.items()))))
                else:
                    ids_, rels_ = (x["path"], x["rels"]) if x["ahead"] else (F.reverse(x["path"]), F.reverse(x["rels"]))
                    nodes = F.concat(nodes, F.transform(F.slice(ids_, 2, F.greatest(F.size(ids_) - 1, F.lit(0))), lambda k: k.cast(kind)))
                    length = length + x["depth"]
                    lists.append(F.transform(rels_, _shaped(has, fields)))
            rels = F.concat(*lists) if lists else F.array()
        c = self.fresh(p.path)
        s.df = s.df.withColumn(c, F.struct(length.alias("length"), nodes.alias("nodes"), rels.alias("rels")))
        names_ = {self.g.nodes[x].id for n in p.nodes for x in s.scope[n.var].labels}
        s.scope[p.path] = Binding("path", c, s.df.schema[c].dataType, id_name=names_.pop() if len(names_) == 1 else None)

    # optional

    def optional(self, s: State, clause: A.Match) -> None:
        """A left join with the whole pattern; its WHERE decides what matches, not which rows stay."""
        new = [x.var for p in clause.patterns for x in (*p.nodes, *p.rels) if x.var not in s.scope] + [p.path for p in clause.patterns if p.path]
        whole = A.Exists(clause.patterns, clause.where)
        self.steps.append("left join with:")
        t, pairs, left = self.sub(s, whole, clause.patterns, clause.where)
        kept = [n for n in dict.fromkeys(new) if n in t.scope]
        keys, cond = self._keys(t, pairs, [t.scope[n].col.alias(t.scope[n].column) for n in kept])
        names = [c for c in keys.columns if c not in {t.scope[n].column for n in kept}]
        s.df, s.joined = s.df.join(keys, self._left(s, t, keys, cond, left), "left").drop(*names), True
        for n in kept:
            s.scope[n] = t.scope[n]

    # projections

    def project(self, s: State, clause: A.Project) -> None:
        self.begin(s)
        items = list(clause.items)
        if clause.star:
            items = [A.Item(A.Var(n), n, n) for n in s.scope if n[0] != " "] + items
            if not items:
                raise QueryError("* without variables", self.text)
        items = [replace(i, expr=self.flagged(s, i.expr)) for i in items]
        names = self._names(items, clause.final)
        grouped = any(_has_aggregate(i.expr) for i in items)
        before = s.copy()
        self.steps.append(f"{'aggregate' if grouped else 'project'} {', '.join(names)}{', distinct' if clause.distinct else ''}{', sorted' if clause.order else ''}{', some rows' if clause.skip is not None or clause.limit is not None else ''}")
        if grouped:
            after, mapping = self.aggregate(s, items, names)
        else:
            after, mapping = self.select(s, items, names), None
        if clause.distinct:
            after.df = self._distinct(after.df)
        # keys that name no result come from the rows before, where these still stand one for one
        order, extra = [], []
        for e, down in clause.order:
            e = self._renamed(e, items, names)
            if mapping is not None:
                e = A.rewrite(e, mapping)
            if A.free(e) <= set(after.scope) and not _has_aggregate(e):
                order.append((self.exprs(after).col(e), down))
            elif not grouped and not clause.distinct:
                c = self.fresh("order")
                extra.append(c)
                before.df = before.df.withColumn(c, self.exprs(before).col(self.flagged(before, e)))
                order.append((F.col(c), down))
            else:
                raise BindingError(f"ORDER BY can't see {', '.join(sorted(A.free(e) - set(after.scope))) or 'this'} after DISTINCT or aggregation", self.text)
        if extra:
            after = self.select(before, items, names, extra)
        df = after.df
        if clause.where is not None and not clause.order and clause.skip is None and clause.limit is None:
            after.df = df
            self.keep(after, clause.where)
            df = after.df
        if order:
            df = df.orderBy(*(c.desc_nulls_first() if down else c.asc_nulls_last() for c, down in order))
        if clause.skip is not None:
            df = df.offset(self._count(clause.skip, "SKIP"))
        if clause.limit is not None:
            df = df.limit(self._count(clause.limit, "LIMIT"))
        after.df = df
        if clause.where is not None and (clause.order or clause.skip is not None or clause.limit is not None):
            self.keep(after, clause.where)
        if clause.final:
            shown = self.exprs(after)
            out = [shown.shown(shown.val(A.Var(n))).col.alias(n) for n in names]
            after.df = after.df.select(*out)
        elif extra:
            after.df = after.df.drop(*extra)
        s.df, s.scope, s.joined = after.df, after.scope, after.joined

    def _names(self, items: list[A.Item], final: bool) -> list[str]:
        out: list[str] = []
        for i in items:
            name = i.alias or (i.expr.name if isinstance(i.expr, A.Var | A.Prop) else i.text)
            if not i.alias and not final and not isinstance(i.expr, A.Var):
                raise QueryError(f"WITH needs an alias for {i.text}", self.text)
            if name.lower() in {n.lower() for n in out}:
                if i.alias or i.text.lower() in {n.lower() for n in out}:
                    raise QueryError(f"two results are called {name!r}", self.text)
                name = i.text
            out.append(name)
        return out

    def _renamed(self, e: A.Node, items: list[A.Item], names: list[str]) -> A.Node:
        """An ORDER BY key in terms of results where it equals one."""
        by = {i.expr: n for i, n in zip(items, names, strict=True)}
        return A.rewrite(e, lambda x: A.Var(by[x]) if x in by else None)

    def _count(self, e: A.Node, what: str) -> int:
        v = self._constant(e)
        if not isinstance(v, int) or isinstance(v, bool) or v < 0:
            raise QueryError(f"{what} takes a number of rows, not {v!r}", self.text)
        return v

    def _constant(self, e: A.Node) -> Any:
        if isinstance(e, A.Lit):
            return e.value
        if isinstance(e, A.Param):
            if e.name not in self.args:
                raise BindingError(f"no value for parameter ${e.name}")
            return self.args[e.name]
        if A.free(e):
            raise QueryError("a number of rows can't depend on a row", self.text)
        return self.g.spark.range(1).select(Expressions({}, self.args, self.text).col(e)).first()[0]

    def _distinct(self, df: DataFrame) -> DataFrame:
        if any(isinstance(f.dataType, T.MapType) for f in df.schema.fields):
            return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
        return df.distinct()

    def select(self, s: State, items: list[A.Item], names: list[str], extra: list[str] = ()) -> State:
        cols, scope = [], {}
        ex = self.exprs(s)
        values: dict[str, Val] = {}
        by = {n: i.expr for i, n in zip(items, names, strict=True)}
        for i, n in zip(items, names, strict=True):
            # an alias of the same list, where no variable has the name
            e = A.substitute(i.expr, {k: v for k, v in by.items() if k not in s.scope and k != n})
            v = values[n] = ex.val(e)
            c = self.fresh(n)
            cols.append(v.col.alias(c))
            scope[n] = (c, v)
        df = s.df.select(*cols, *extra)
        return State(df, {n: self._bound(c, v, df) for n, (c, v) in scope.items()}, s.joined)

    def _bound(self, c: str, v: Val, df: DataFrame) -> Binding:
        b = v.binding
        if v.kind in ("node", "edge", "rels", "path") and b is not None:
            return Binding(v.kind, c, df.schema[c].dataType, b.labels, b.id_name)
        return Binding("value", c, df.schema[c].dataType)

    def aggregate(self, s: State, items: list[A.Item], names: list[str]):
        """Implicit GROUP BY: results without aggregates are keys. Entities group by their ids and are carried along."""
        siblings = {n: i.expr for i, n in zip(items, names, strict=True) if n not in s.scope}
        # aliases of the same list inside other results
        for _ in range(len(items)):
            items = [replace(i, expr=A.substitute(i.expr, {k: v for k, v in siblings.items() if k != n})) for i, n in zip(items, names, strict=True)]
        ex = self.exprs(s)
        groups, carried, rebuilt, keys, aggs = [], [], [], {}, {}
        shape: dict[str, tuple[str, Val]] = {}
        for i, n in zip(items, names, strict=True):
            if _has_aggregate(i.expr):
                continue
            v = ex.val(i.expr)
            c = self.fresh(n)
            if v.kind == "node":
                # an id stands for one node, so its properties are keys too: hash aggregation carries no structs
                used = self._carried(i.expr, n)
                own = [f for f in v.type.names if f in ("__id", "__label") or used is None or f in used]
                flat = {f: self.fresh("by") for f in own if not isinstance(v.type[f].dataType, T.MapType)}
                groups += [v.col[f].alias(k) for f, k in flat.items()]
                maps = {f: self.fresh("by") for f in own if f not in flat}
                carried += [F.first(v.col[f]).alias(k) for f, k in maps.items()]
                rebuilt.append(F.when(F.col(flat["__id"]).isNotNull(), F.struct(*(F.col((flat | maps)[f]).alias(f) for f in own))).alias(c))
            else:
                groups.append(v.col.alias(c))
            keys[i.expr] = (n, c)
            shape[n] = (c, v)
        pre: list[tuple[str, Column]] = []

        def found(x: A.Node) -> A.Node | None:
            if x in keys:
                return A.Var(f" {keys[x][1]}")
            if isinstance(x, A.Prop) and x.base in keys:
                return A.Prop(A.Var(f" {keys[x.base][1]}"), x.name)
            if isinstance(x, A.Call) and x.name in registry.AGGREGATES:
                if x not in aggs:
                    if any(_has_aggregate(a) for a in x.args):
                        raise QueryError(f"{x.name} of an aggregate", self.text, x.at)
                    aggs[x] = (self.fresh(x.name), self._aggregate(ex, x, pre))
                return A.Var(f" {aggs[x][0]}")
            return None

        rest = {n: A.rewrite(i.expr, found) for i, n in zip(items, names, strict=True) if _has_aggregate(i.expr)}
        df = s.df
        for c, col in pre:
            df = df.withColumn(c, col)
        columns = [v.col.alias(c) for c, v in aggs.values()] + carried
        df = df.groupBy(*groups).agg(*columns) if columns else df.select(*groups).distinct()
        if rebuilt:
            df = df.select("*", *rebuilt)
        inner = {f" {c}": self._bound(c, v, df) for c, v in shape.values()} | {f" {c}": Binding("value", c, df.schema[c].dataType) for c, _ in aggs.values()}
        mid = State(df, inner)
        ex2 = self.exprs(mid)
        cols, scope = [], {}
        for n in names:
            if n in shape:
                c, v = shape[n]
                cols.append(F.col(c))
                scope[n] = (c, v)
            else:
                loose = {x for x in A.free(rest[n]) if x not in inner}
                if loose:
                    raise BindingError(f"{', '.join(sorted(loose))} is neither grouped by nor aggregated", self.text)
                v = ex2.val(rest[n])
                c = self.fresh(n)
                cols.append(v.col.alias(c))
                scope[n] = (c, v)
        out = df.select(*cols)
        after = State(out, {n: self._bound(c, v, out) for n, (c, v) in scope.items()}, True)
        results = {i.expr: n for i, n in zip(items, names, strict=True)}

        def mapping(x: A.Node) -> A.Node | None:
            if x in results:
                return A.Var(results[x])
            return None

        return after, mapping

    def _carried(self, e: A.Node, alias: str) -> set[str] | None:
        """Properties of a grouped node that later clauses may use; None: all."""
        names = {alias} | ({e.name} if isinstance(e, A.Var) else set())
        if not isinstance(e, A.Var) or any(self.used.get(n, set()) is None for n in names):
            return None
        return {f for n in names for f in self.used.get(n, set()) | self.keys.get(n, set())}

    def _aggregate(self, ex: Expressions, x: A.Call, pre: list[tuple[str, Column]]) -> Val:
        if x.star:
            return Val(F.count(F.lit(1)), T.LongType())
        args = [ex.val(a) for a in x.args]
        v = args[0] if args else None
        if v is not None and v.kind in ("node", "edge"):
            if x.name == "count":
                fields = ("__label", "__id") if v.kind == "node" else ("__type", "__sl", "__src", "__dl", "__dst")
                if v.kind == "node" and v.binding is not None and self._one_key(v.binding.labels):
                    fields = ("__id",)
                args[0] = Val(v.col[fields[0]] if len(fields) == 1 or not x.distinct else F.when(v.col["__id" if v.kind == "node" else "__src"].isNotNull(), F.struct(*(v.col[f] for f in fields))))
            else:
                args[0] = ex.shown(v)
        elif v is not None and v.kind == "path":
            args[0] = ex.shown(v)
        if x.name == "percentiledisc":
            if len(args) != 2 or not isinstance(args[1].literal, int | float):
                raise QueryError("percentiledisc takes a value and a literal share", self.text, x.at)
            c = self.fresh("value")
            pre.append((c, args[0].col))
            return Val(F.expr(f"percentile_disc({float(args[1].literal)}) within group (order by `{c}`)"), args[0].type)
        return registry.aggregate(x.name, args, x.distinct, [(ex.val(e), down) for e, down in x.order], self.text, x.at)


def _shaped(has: dict[str, T.DataType], fields: dict[str, T.DataType]):
    """A function from a relationship to a struct of its ends and all fields."""
    def shape(e: Column) -> Column:
        return F.struct(e["src"].cast("string").alias("src"), e["dst"].cast("string").alias("dst"), *((e[n] if n in has else F.lit(None)).cast(t).alias(n) for n, t in fields.items()))

    return shape


def _bare(x: Any) -> list[A.Node]:
    """Variables used other than as n.p."""
    if isinstance(x, A.Prop) and isinstance(x.base, A.Var):
        return []
    if isinstance(x, A.Var):
        return [x]
    return [v for c in A.children(x) if isinstance(c, A.Node | tuple) for v in _bare(c)]
