"""Pattern matching: scans, expansions, variable-length trails, shortest paths, uniqueness.

A pattern grows from the rows at hand by equi-joins on ids. Node tables are joined only
for labels that the edge's ends don't already ensure and for properties that the query
reads. Trails of a constant length are unrolled self-joins; longer ones and shortest
paths are loops over a frontier that end when it is empty.
"""

from __future__ import annotations

import re
import tempfile
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.errors import QueryError, semantic
from quiltgraph.functions import scalar
from quiltgraph.functions.types import Typed
from quiltgraph.operators.expressions import Expressions
from quiltgraph.operators.scope import Node, Path, Rel, Scope, Value, fresh
from quiltgraph.sources.catalog import EdgeTable, Graph, spark_type

TURNED = {"out": "in", "in": "out", "both": "both"}
UNROLLED = 6  # hops that are joined without looking whether the frontier is empty


def props_of(e, params: dict) -> tuple:
    """The (key, expression) pairs of a pattern's properties."""
    if e and e[0] == "param":
        return tuple((k, ("lit", v)) for k, v in params[e[1]].items())
    return e or ()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in ``spark.checkpoint.dir``; only a session of one machine may do without that setting."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise QueryError("ConfigurationError", "NoSharedFolder", "set spark.checkpoint.dir to a folder that the cluster shares", "Runtime")
            where = tempfile.mkdtemp(prefix="quilt-checkpoints-")
        context.setCheckpointDir(where)
    return df.checkpoint()


class Trace(list):
    """The operators of a query in order; with estimates of the rows after scans and expansions, where they are asked for."""

    def __init__(self, estimating: bool = False):
        super().__init__()
        self.estimating, self.rows = estimating, 1.0

    def grown(self, line: str, factor: float) -> None:
        if self.estimating:
            self.rows *= factor
            line += f" ~{self.rows:,.0f} rows"
        self.append(line)


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Matcher:
    """Grows rows by the path patterns of one MATCH."""

    def __init__(self, graph: Graph, params: dict, used: dict[str, set | None], df: DataFrame | None, scope: Scope, trace: Trace):
        self.graph, self.params, self.used, self.df, self.scope, self.trace = graph, params, used, df, dict(scope), trace
        self.rels: list[tuple[str, str, frozenset]] = []  # ("one" | "many", id column, types)
        self.hidden: dict[str, object] = {}

    # Helpers.
    def wants(self, name: str | None) -> set | None:
        """Properties that the query reads of a variable; None for all."""
        return self.used.get(name, set()) if name else set()

    def where(self, condition) -> None:
        self.df = self.df.where(condition)

    def expressions(self) -> Expressions:
        return Expressions(self.scope, self.params)

    def has(self, name: str) -> bool:
        return name in self.scope or name in self.hidden

    def bound(self, name: str):
        return self.scope.get(name, self.hidden.get(name))

    def bind(self, name: str, b) -> None:
        (self.hidden if name.startswith("\0") else self.scope)[name] = b

    def select_nodes(self, tables, labels, wanted: set | None, hint: str, need_labels: bool) -> tuple[DataFrame, Node]:
        df, types = self.graph.scan(labels, tables)
        props = {p: (fresh(f"{hint}_{p}"), t) for p, t in types.items() if wanted is None or p in wanted}
        keep = need_labels or wanted is None or "_labels" in wanted
        node = Node(fresh(f"{hint}_id"), fresh(f"{hint}_labels") if keep else None, frozenset(labels), props)
        columns = [F.col("_id").alias(node.id), *([F.col("_labels").alias(node.labels)] if keep else []), *(F.col(p).alias(c) for p, (c, _) in props.items())]
        return df.select(columns), node

    def filter_props(self, b, pairs) -> None:
        for k, e in pairs:
            x = self.expressions()(e)
            have = Typed(F.col(b.props[k][0]), b.props[k][1]) if k in b.props else Typed(F.lit(None), "null")
            self.where(scalar.equal(have, x))

    # Nodes.
    def wanted_of(self, element) -> set | None:
        _, name, _, props = element
        wanted = self.wants(name)
        return None if wanted is None else wanted | {k for k, _ in props_of(props, self.params)}

    def scan_node(self, element, name: str) -> None:
        _, _, labels, props = element
        df, node = self.select_nodes(None, labels, self.wanted_of(element), name.strip("\0") or "n", False)
        about = sum(self.graph.rows_of(t) for t in self.graph.node_tables(labels)) * (0.1 if props else 1) if self.trace.estimating else 0
        self.trace.grown(f"NodeScan({name}:{':'.join(labels)})", about)
        if self.df is None:
            self.df = df
        else:
            self.trace.append("CrossProduct")
            self.df = self.df.crossJoin(df)  # patterns without a shared variable
        self.bind(name, node)
        self.filter_props(node, props_of(props, self.params))

    def check_node(self, element, name: str) -> None:
        """Labels and properties of a node that is bound already."""
        _, _, labels, props = element
        b = self.bound(name)
        if isinstance(b, Value):
            if not (isinstance(b.type, tuple) and b.type[0] == "node"):
                raise semantic("VariableTypeConflict", f"{name} is not a node")
            c = F.col(b.column)
            b = Node(fresh(name), fresh(name), frozenset(), {p: (fresh(name), t) for p, t in b.type[1]})
            self.df = self.df.withColumns({b.id: c["_id"], b.labels: c["_labels"], **{k: c[p] for p, (k, _) in b.props.items()}})
            self.bind(name, b)
        if not isinstance(b, Node):
            raise semantic("VariableTypeConflict", f"{name} is not a node")
        missing = [x for x in labels if x not in b.static]
        if missing and b.labels:
            for x in missing:
                self.where(F.array_contains(b.labels, x))
        elif missing:
            df, other = self.select_nodes(None, labels, set(), name.strip("\0"), False)
            self.df = self.df.join(df, F.col(b.id) == F.col(other.id), "left_semi")
            self.bind(name, replace(b, static=b.static | set(labels)))
        self.filter_props(self.bound(name), props_of(props, self.params))

    def attach_node(self, element, name: str, id_column: str, tables: list[str] | None) -> None:
        """Binds a new node by an id that an edge gave; ``tables`` may hold it."""
        _, _, labels, props = element
        if self.told(element, tables) is not None:
            self.bind_end(element, name, id_column, tables)
            return
        known = [t for t in self.graph.nodes if (tables is None or t.name in tables) and set(labels) <= t.may]
        df, node = self.select_nodes(known, labels, self.wanted_of(element), name.strip("\0") or "n", False)
        self.trace.append(f"NodeJoin({name}:{':'.join(labels)})")
        self.df = self.df.join(df, F.col(id_column) == F.col(node.id))
        self.bind(name, node)
        self.filter_props(node, props_of(props, self.params))

    def told(self, element, tables: list[str] | None) -> dict[str, object] | None:
        """What is read of a node at an edge's end and its id tells, by its type: nothing, or the key. None if its table must be read, for labels that the end's ``tables`` don't ensure or for other properties."""
        labels, wanted = set(element[2]), self.wanted_of(element)
        ends = [t for t in self.graph.nodes if tables is not None and t.name in tables]
        if tables is None or wanted is None or not all(labels <= t.always for t in ends):
            return None
        keys = {t.key: t.types[t.key] for t in ends if len(ends) == 1 and t.by_key and t.key}
        return {p: keys[p] for p in wanted} if wanted <= set(keys) else None

    def bind_end(self, element, name: str, id_column: str, tables: list[str]) -> None:
        """Binds a node whose id tells all that is read of it."""
        props = {p: (fresh(f"{name.strip(chr(0)) or 'n'}_{p}"), t) for p, t in self.told(element, tables).items()}
        if props:
            self.where(F.col(id_column).isNotNull())
            self.df = self.df.withColumns({c: self.graph.key_of(F.col(id_column)) for c, _ in props.values()})
        self.bind(name, Node(id_column, None, frozenset(element[2]), props, frozenset(c for c, _ in props.values())))
        self.filter_props(self.bound(name), props_of(element[3], self.params))

    # Relationships.
    @staticmethod
    def ends_of(tables: list[EdgeTable], direction: str) -> list[str] | None:
        """The node tables that edges lead to; None if they may be any."""
        ends = {"out": [t.dst for t in tables], "in": [t.src for t in tables], "both": [x for t in tables for x in (t.src, t.dst)]}[direction]
        return None if None in ends else sorted(set(ends))

    def edge_tables(self, types, direction: str, left: frozenset, right: frozenset) -> list[EdgeTable]:
        may = {t.name: t.may for t in self.graph.nodes}
        fits = lambda labels, end: end is None or labels <= may[end]
        out = []
        for t in self.graph.edges:
            if types and t.type not in types:
                continue
            forward, back = fits(left, t.src) and fits(right, t.dst), fits(right, t.src) and fits(left, t.dst)
            if direction == "out" and forward or direction == "in" and back or direction == "both" and (forward or back):
                out.append(t)
        return out

    def edges(self, element, left: frozenset, right: frozenset, wanted: set | None, hint: str) -> tuple[DataFrame, Rel, str, str, list[str] | None]:
        """(edges, their binding, from and to columns, tables of the far ends)."""
        _, _, types, direction, _, _, props = element
        tables = self.edge_tables(types, direction, left, right)
        df, kinds = self.graph.edge_scan(tables)
        pairs = props_of(props, self.params)
        keep = {p: (fresh(f"{hint}_{p}"), t) for p, t in kinds.items() if wanted is None or p in wanted or p in dict(pairs)}
        rel = Rel(*(fresh(f"{hint}_{x}") for x in ("id", "src", "dst", "type")), keep)
        df = df.select(F.col("_id").alias(rel.id), F.col("_src").alias(rel.src), F.col("_dst").alias(rel.dst), F.col("_type").alias(rel.type), *(F.col(p).alias(c) for p, (c, _) in keep.items()))
        for k, e in pairs:
            if e[0] in ("lit", "param", "list", "map", "call"):
                have = Typed(F.col(keep[k][0]), keep[k][1]) if k in keep else Typed(F.lit(None), "null")
                df = df.where(scalar.equal(have, Expressions({}, self.params)(e)))
        near, far = fresh(f"{hint}_from"), fresh(f"{hint}_to")
        ways = {"out": [(rel.src, rel.dst)], "in": [(rel.dst, rel.src)], "both": [(rel.src, rel.dst), (rel.dst, rel.src)]}[direction]
        out = None
        for k, (a, b) in enumerate(ways):
            part = df if k == 0 else df.where(F.col(rel.src) != F.col(rel.dst))  # a loop counts once
            part = part.select("*", F.col(a).alias(near), F.col(b).alias(far))
            out = part if out is None else out.unionByName(part)
        return out, rel, near, far, self.ends_of(tables, direction)

    def labels_of(self, name: str, element) -> frozenset:
        b = self.bound(name)
        return frozenset(element[2]) | (b.static if isinstance(b, Node) else frozenset())

    def expand(self, here: str, here_element, element, there: str, there_element) -> None:
        _, name, types, direction, low, high, props = element
        left, right = self.labels_of(here, here_element), self.labels_of(there, there_element)
        if low is not None:
            self.expand_many(here, element, there, there_element, left, right)
            return
        hint = name or "r"
        edges, rel, near, far, tables = self.edges(element, left, right, self.wants(name), hint)
        begins = not self.has(here)
        if begins:
            self.df = edges.where(F.col(near).isNotNull())
            self.bind_end(here_element, here, near, self.ends_of(self.edge_tables(types, direction, left, right), TURNED[direction]))
        condition = F.col(self.bound(here).id) == F.col(near)
        if self.has(there):
            if isinstance(self.bound(there), Value):
                self.check_node(there_element, there)
            condition = condition & (F.col(self.bound(there).id) == F.col(far))
        old = self.scope.get(name) if name else None
        if isinstance(old, Rel):
            condition = condition & (F.col(old.id) == F.col(rel.id))
        elif isinstance(old, Value):
            condition = condition & (F.col(old.column)["_id"] == F.col(rel.id))
        self.trace.grown(f"Expand({here})-[{name or ''}:{'|'.join(types)}]-({there}) {direction}{' of all edges' if begins else ''}", self.growth)
        self.df = self.df.where(condition) if begins else self.df.join(edges, condition)
        if old is None:
            for kind, other, other_types in self.rels:
                if not types or not other_types or set(types) & other_types:
                    self.where(F.col(other) != F.col(rel.id) if kind == "one" else ~F.array_contains(other, F.col(rel.id)))
            self.rels.append(("one", rel.id, frozenset(types)))
        if name:
            self.scope[name] = rel if not isinstance(old, Rel) else old
        self.last_rel = rel
        dynamic = [(k, e) for k, e in props_of(props, self.params) if e[0] not in ("lit", "param", "list", "map", "call")]
        self.filter_props(rel, dynamic)
        if not self.has(there):
            self.attach_node(there_element, there, far, tables)

    def expand_many(self, here: str, element, there: str, there_element, left: frozenset, right: frozenset) -> None:
        """Trails of ``low`` to ``high`` edges, none of them twice."""
        _, name, types, direction, low, high, _ = element
        hint, full = name or "r", self.keep_rels or bool(name) and self.used.get(name, set()) is None
        edges, rel, near, far, tables = self.edges(element, frozenset(), frozenset(), None if full else set(), hint)
        if name and isinstance(old := self.scope.get(name), Value):
            self.walk_bound(here, old, direction, there, there_element)
            return
        ids, end, rels, nodes = fresh(f"{hint}_ids"), fresh(f"{hint}_end"), fresh(f"{hint}_rels"), fresh(f"{hint}_nodes")
        rel_kinds = tuple(sorted(self.graph.merged_types(self.graph.edges).items()))
        node_kinds = tuple(sorted(self.graph.merged_types(self.graph.nodes).items()))
        start = self.bound(here)
        first = {ids: F.array().cast("array<bigint>"), end: F.col(start.id)}
        if full:
            first[rels] = F.array().cast(f"array<{spark_type(('rel', rel_kinds)).simpleString()}>")
        if self.keep_nodes:
            first[nodes] = F.array().cast(f"array<{spark_type(('node', node_kinds)).simpleString()}>")
        frontier = self.df.withColumns(first)
        columns = frontier.columns
        hops = [frontier] if low == 0 else []
        self.trace.grown(f"VarExpand({here})-[{name or ''}:{'|'.join(types)}*{low}..{high}]-({there}) {direction}", self.growth)
        open_end = not self.has(there) and not there_element[2] and not there_element[3]
        visited = 0
        for k in range(1, high + 1):
            if k > UNROLLED or self.graph.work_cap and k > 1:
                last, frontier = frontier, checkpointed(frontier)
                if hops and hops[-1] is last:
                    hops[-1] = frontier
                if frontier.isEmpty():
                    break
                if self.graph.work_cap:
                    visited += frontier.count()
                    if visited > self.graph.work_cap:
                        raise QueryError("ResourceError", "SizeLimit", f"trails of more than {self.graph.work_cap} steps", "Runtime")
                if self.result_cap is not None and open_end and hops and united(hops).limit(self.result_cap).count() >= self.result_cap:
                    break
            step = frontier.join(edges, F.col(end) == F.col(near))
            if k > 1:
                step = step.where(~F.array_contains(ids, F.col(rel.id)))
            grown = {c: F.col(c) for c in columns} | {ids: F.array_append(ids, F.col(rel.id)), end: F.col(far)}
            if full:
                grown[rels] = F.array_append(rels, rel.struct(rel_kinds).col)
            if self.keep_nodes:
                df, node = self.select_nodes(None, (), None, "hop", True)
                step = step.join(df, F.col(far) == F.col(node.id))
                grown[nodes] = F.array_append(nodes, node.struct(node_kinds).col)
            frontier = step.select(*(v.alias(c) for c, v in grown.items()))
            if k >= low:
                hops.append(frontier)
        self.df = united(hops)
        for kind, other, other_types in self.rels:
            if not types or not other_types or set(types) & other_types:
                self.where(~F.array_contains(ids, F.col(other)) if kind == "one" else ~F.arrays_overlap(ids, other))
        self.rels.append(("many", ids, frozenset(types)))
        if name:
            if full:
                self.scope[name] = Value(rels, ("list", ("rel", rel_kinds)))
            else:
                self.scope[name] = Value(ids, ("list", "int"))
        self.last_many = (ids, rels if full else None, nodes if self.keep_nodes else None)
        if self.has(there):
            b = self.bound(there)
            self.where(F.col(b.id) == F.col(end))
            self.check_node(there_element, there)
        else:
            self.attach_node(there_element, there, end, None if tables is None or low == 0 else tables)

    def walk_bound(self, here: str, rels: Value, direction: str, there: str, there_element) -> None:
        """A list of relationships that is bound already: the rows where it leads on from ``here``."""
        if not (isinstance(rels.type, tuple) and rels.type[0] == "list" and isinstance(rels.type[1], tuple) and rels.type[1][0] == "rel"):
            raise semantic("VariableTypeConflict", "a list of relationships is needed")
        forward = lambda at, e: F.when(at == e["_src"], e["_dst"])
        back = lambda at, e: F.when(at == e["_dst"], e["_src"])
        step = {"out": forward, "in": back, "both": lambda at, e: F.coalesce(forward(at, e), back(at, e))}[direction]
        end = fresh("end")
        self.df = self.df.withColumn(end, F.aggregate(rels.column, F.col(self.bound(here).id), step)).where(F.col(end).isNotNull())
        self.last_many = (rels.column, rels.column, None)
        if self.has(there):
            self.where(F.col(self.bound(there).id) == F.col(end))
            self.check_node(there_element, there)
        else:
            self.attach_node(there_element, there, end, None)

    # Paths.
    keep_nodes = keep_rels = False
    growth = 0.0  # rows for each row, by which the next expansion multiplies
    result_cap: int | None = None  # rows after which the query needs no more hops

    def match(self, patterns) -> None:
        todo = [(p, [e[1] or f"\0{fresh('n')}" for e in p[3][::2]]) for p in patterns]
        while todo:
            plain = [x for x in todo if not x[0][2]]
            ready = [x for x in plain if any(self.has(n) for n in x[1])]
            chosen = (ready or plain or todo)[0]
            if self.df is None and len(plain) > 1 and not ready:
                chosen = min(plain, key=lambda x: -max(self.rank(e) for e in x[0][3][::2]))
            todo.remove(chosen)
            if chosen[0][2]:
                self.shortest(*chosen)
            else:
                self.grow(*chosen)

    def rank(self, element) -> int:
        """How selective a node pattern looks: properties, then labels."""
        return 2 * bool(element[3]) + bool(element[2])

    def grow(self, path, names: list[str]) -> None:
        _, path_name, _, elements = path
        nodes = elements[::2]
        mode = self.used.get(path_name, set()) if path_name else set()
        self.keep_nodes = self.keep_rels = mode is None
        if mode is None:
            for n in names:
                self.used[n] = None
        bound = [k for k, n in enumerate(names) if self.has(n)]
        start = bound[0] if bound else max(range(len(nodes)), key=lambda k: (self.rank(nodes[k]), -k))
        first = None if bound else self.first_edge(start, elements, names)
        if bound:
            self.check_node(nodes[start], names[start])
        elif first is None:
            self.scan_node(nodes[start], names[start])
        segments: dict[int, object] = {}
        todo = set(range(len(nodes) - 1))
        while todo:
            k = self.next_segment(todo, elements, names) if first is None else first
            todo.remove(k)
            rel = elements[2 * k + 1]
            a, b = (k, k + 1) if (self.has(names[k]) if first is None else k == start) else (k + 1, k)
            first = None
            if a > b:
                rel = (*rel[:3], TURNED[rel[3]], *rel[4:])
            known = self.has(names[b]) or names[a] == names[b]
            if self.trace.estimating:
                self.growth = self.fan_out(k, elements, names) if self.has(names[a]) else self.edge_rows(k, elements)
            self.expand(names[a], nodes[a], rel, names[b], nodes[b])
            if known:
                self.check_node(nodes[b], names[b])
            if rel[4] is None:
                segments[k] = self.last_rel
            else:
                segments[k] = (*self.last_many, a > b, names[b])
        if path_name:
            self.bind_path(path_name, names, segments, mode is None)
        self.keep_nodes = self.keep_rels = False

    def first_edge(self, start: int, elements, names: list[str]) -> int | None:
        """The relationship whose edges the pattern can begin with, as they tell all that is read of the node ``start``; None if its table must be read."""
        if self.df is not None or elements[2 * start][3]:
            return None
        for k in (k for k in (start, start - 1) if 0 <= k < len(names) - 1):
            _, name, types, direction, low, _, _ = elements[2 * k + 1]
            left, right = (frozenset(elements[2 * j][2]) for j in (k, k + 1))
            back = TURNED[direction] if k == start else direction
            if low is None and not (name and self.has(name)) and self.told(elements[2 * start], self.ends_of(self.edge_tables(types, direction, left, right), back)) is not None:
                return k
        return None

    def next_segment(self, todo: set[int], elements, names: list[str]) -> int:
        """Of the relationships at bound nodes: one that closes a cycle, else the one that multiplies rows least."""
        near = [k for k in sorted(todo) if self.has(names[k]) or self.has(names[k + 1])]
        closing = [k for k in near if self.has(names[k]) and self.has(names[k + 1])]
        if closing or len(near) == 1:
            return (closing or near)[0]
        return min(near, key=lambda k: (self.fan_out(k, elements, names), k))

    def fan_out(self, k: int, elements, names: list[str]) -> float:
        """Edges per node at the bound end, from the tables' row counts."""
        _, _, types, direction, low, high, _ = elements[2 * k + 1]
        left, right = self.labels_of(names[k], elements[2 * k]), self.labels_of(names[k + 1], elements[2 * k + 2])
        tables = self.edge_tables(types, direction, left, right)
        from_left = self.has(names[k])
        out = 0.0
        for t in tables:
            ends = {"out": [t.src if from_left else t.dst], "in": [t.dst if from_left else t.src], "both": [t.src, t.dst]}[direction]
            for end in ends:
                nodes = self.graph.rows_of(self.graph.table(end)) if end else sum(self.graph.rows_of(n) for n in self.graph.nodes)
                out += self.graph.rows_of(t) / max(1, nodes)
        return out if low is None else max(out, 1.0) ** min(high, 3)

    def edge_rows(self, k: int, elements) -> float:
        """About how many edges may match a relationship."""
        _, _, types, direction, _, _, _ = elements[2 * k + 1]
        left, right = (frozenset(elements[2 * j][2]) for j in (k, k + 1))
        return sum(self.graph.rows_of(t) for t in self.edge_tables(types, direction, left, right)) * (2 if direction == "both" else 1)

    def bind_path(self, name: str, names: list[str], segments: dict, full: bool) -> None:
        if name in self.scope:
            raise semantic("VariableAlreadyBound", f"{name} is bound already")
        length = F.lit(0).cast("bigint")
        for s in segments.values():
            length = length + (F.lit(1) if isinstance(s, Rel) else F.size(s[0]))
        columns = {fresh(f"{name}_length"): length.cast("bigint")}
        node_kinds = tuple(sorted(self.graph.merged_types(self.graph.nodes).items()))
        rel_kinds = tuple(sorted(self.graph.merged_types(self.graph.edges).items()))
        if full:
            one = lambda n: F.array(self.bound(n).struct(node_kinds).col)
            rels, nodes = [], [one(names[0])]
            for k in sorted(segments):
                s = segments[k]
                if isinstance(s, Rel):
                    rels.append(F.array(s.struct(rel_kinds).col))
                    nodes.append(one(names[k + 1]))
                elif not s[3]:
                    rels.append(F.col(s[1]))
                    nodes.append(F.col(s[2]))
                else:  # walked from the right: the nodes met are those before it, the last being the left end
                    rels.append(F.reverse(F.col(s[1])))
                    inner = F.reverse(F.col(s[2]))
                    nodes.append(F.when(F.size(inner) > 0, F.concat(F.slice(inner, 2, F.greatest(F.size(inner) - 1, F.lit(0))), one(names[k + 1]))).otherwise(F.slice(inner, 1, 0)))
            columns[fresh(f"{name}_nodes")] = F.concat(*nodes)
            empty = F.array().cast(f"array<{spark_type(('rel', rel_kinds)).simpleString()}>")
            columns[fresh(f"{name}_rels")] = F.concat(*rels) if rels else empty
        self.df = self.df.withColumns(columns)
        self.scope[name] = Path(*columns, node_type=node_kinds, rel_type=rel_kinds)

    def shortest(self, path, names: list[str]) -> None:
        """A shortest path, or all, for each pair of ends; without one the row stays and the path is null."""
        _, path_name, kind, elements = path
        if len(elements) != 3:
            raise semantic("UnexpectedSyntax", f"{kind} takes one relationship")
        for k in (0, 1):
            if self.has(names[k]):
                self.check_node(elements[2 * k], names[k])
            else:
                self.scan_node(elements[2 * k], names[k])
        rel_element = elements[1]
        high = rel_element[5] or 1
        full = bool(path_name) and self.used.get(path_name, set()) is None
        edges, rel, near, far, _ = self.edges(rel_element, frozenset(), frozenset(), None if full else set(), "sp")
        a, b = self.bound(names[0]).id, self.bound(names[1]).id
        self.trace.append(f"ShortestPath({names[0]})-({names[1]}) {'all' if kind != 'shortestPath' else 'one'}")
        node_kinds = tuple(sorted(self.graph.merged_types(self.graph.nodes).items()))
        rel_kinds = tuple(sorted(self.graph.merged_types(self.graph.edges).items()))
        pairs = checkpointed(self.df.select(F.col(a).alias("_from"), F.col(b).alias("_goal")).distinct())
        ids = F.array().cast("array<bigint>")
        steps = F.array().cast(f"array<struct<rel:{spark_type(('rel', rel_kinds)).simpleString()},node:bigint>>")
        frontier = pairs.select("_from").distinct().select("_from", F.col("_from").alias("_at"), ids.alias("_ids"), *([steps.alias("_steps")] if full else []))
        seen = frontier.select("_from", "_at")
        found = frontier
        for depth in range(1, high + 1):
            grown = [F.array_append("_ids", F.col(rel.id)).alias("_ids")]
            if full:
                grown.append(F.array_append("_steps", F.struct(rel.struct(rel_kinds).col.alias("rel"), F.col(far).alias("node"))).alias("_steps"))
            step = frontier.join(edges, F.col("_at") == F.col(near)).select("_from", F.col(far).alias("_at"), *grown)
            step = step.join(seen, ["_from", "_at"], "left_anti")
            if kind == "shortestPath":
                columns = F.struct("_ids", *(["_steps"] if full else []))
                step = step.groupBy("_from", "_at").agg(F.min_by(columns, "_ids").alias("s")).select("_from", "_at", "s.*")
            frontier = checkpointed(step)
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier.select("_from", "_at").distinct())
            found = found.unionByName(frontier)
            if depth % 4 == 0:
                seen = checkpointed(seen)
            left = pairs.join(seen, (F.col("_goal") == F.col("_at")) & (pairs["_from"] == seen["_from"]), "left_anti")
            if left.isEmpty():
                break
            alive = left.select("_from").distinct()
            frontier = frontier.join(alive, "_from", "left_semi")
        lowest = rel_element[4] if rel_element[4] is not None else 1
        hits = found.where(F.size("_ids") >= (0 if lowest <= 1 else lowest)).select(F.col("_from").alias("_f"), F.col("_at").alias("_g"), "_ids", *(["_steps"] if full else []))
        self.df = self.df.join(hits, (F.col(a) == F.col("_f")) & (F.col(b) == F.col("_g")), "left")
        ids_name = fresh("sp_ids")
        self.df = self.df.withColumn(ids_name, F.col("_ids"))
        if rel_element[1]:
            self.scope[rel_element[1]] = Value(ids_name, ("list", "int"))
        if path_name:
            length = fresh(f"{path_name}_length")
            self.df = self.df.withColumn(length, F.when(F.col(ids_name).isNotNull(), F.size(ids_name)).cast("bigint"))
            made = Path(length, None, None, node_kinds, rel_kinds)
            if full:
                self.df, made = self.hydrate(made, a, "_steps", node_kinds, rel_kinds, path_name)
            self.scope[path_name] = made
        self.df = self.df.drop("_f", "_g", "_ids", "_steps")

    def hydrate(self, path: Path, start: str, steps: str, node_kinds, rel_kinds, name: str):
        """Nodes of found paths by one join of their distinct ids."""
        key = [start, "_ids"]
        flat = self.df.where(F.col("_ids").isNotNull()).select(*key, F.posexplode(F.concat(F.array(F.col(start)), F.transform(steps, lambda s: s["node"]))).alias("k", "_node")).distinct()
        df, node = self.select_nodes(None, (), None, "sp", True)
        rows = flat.join(df, F.col("_node") == F.col(node.id)).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("k", F.col(node.id).alias("i"), node.struct(node_kinds).col.alias("n")))).alias("ns"))
        nodes, rels = fresh(f"{name}_nodes"), fresh(f"{name}_rels")
        rows = rows.select(F.col(start).alias("_s"), F.col("_ids").alias("_i"), F.transform("ns", lambda x: x["n"]).alias(nodes))
        df = self.df.join(rows, (F.col(start) == F.col("_s")) & (F.col("_ids") == F.col("_i")), "left").drop("_s", "_i")
        return df.withColumn(rels, F.transform(steps, lambda s: s["rel"])), replace(path, nodes=nodes, rels=rels)
