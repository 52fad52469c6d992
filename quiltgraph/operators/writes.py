"""Updates: new versions of the catalog's tables.

A clause reads the rows and the graph as they were when it began: its input is
checkpointed before any table changes. Created ids are dense: the rows of each
partition are counted, and a row's number is its partition's offset plus its place.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.errors import QueryError, semantic
from quiltgraph.functions import scalar
from quiltgraph.functions.types import Typed, joined
from quiltgraph.operators.expressions import Expressions
from quiltgraph.operators.patterns import checkpointed, props_of
from quiltgraph.operators.scope import Node, Rel, Value, fresh
from quiltgraph.sources.catalog import SLOTS, EdgeTable, NodeTable, spark_type

CREATED = SLOTS - 1  # the table number of created nodes and edges


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df``, fixed by a checkpoint, with dense row numbers from 0, and how many rows it has."""
    mark = fresh("mark")
    df = checkpointed(df.withColumn(mark, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(mark), 33)
    counts = sorted((r[0], r[1]) for r in df.groupBy(part.alias("p")).count().collect())  # one row per partition
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    at, first = fresh("part"), fresh("first")
    table = df.sparkSession.createDataFrame(offsets, f"{at} bigint, {first} bigint")  # one row per partition
    placed = df.join(F.broadcast(table), part == F.col(at))
    return placed.withColumn(name, F.col(first) + F.col(mark).bitwiseAND((1 << 33) - 1)).drop(mark, at, first), total


def storable(x: Typed, key: str) -> Typed:
    kind = x.t[0] if isinstance(x.t, tuple) else x.t
    if kind in ("node", "rel", "map") or kind == "list" and isinstance(x.t[1], tuple):
        raise QueryError("TypeError", "InvalidPropertyType", f"{key} can't be stored: {kind}", "Runtime")
    return x


def _create_id(q, df: DataFrame, number: str, per_row: int, k: int, total: int) -> F.Column:
    return (F.lit(q.graph.next_id).cast("bigint") + F.col(number) * per_row + k) * SLOTS + CREATED


def _add_nodes(q, df: DataFrame, node: Node, labels) -> None:
    types = {p: t for p, (_, t) in node.props.items() if t != "null"}
    made = df.select(F.col(node.id).alias("_id"), F.array(*(F.lit(x) for x in sorted(labels))).cast("array<string>").alias("_labels"), *(F.col(node.props[p][0]).alias(p) for p in types))
    q.graph.nodes = [*q.graph.nodes, NodeTable(fresh("created"), made, frozenset(labels), frozenset(labels), types)]


def _add_edges(q, df: DataFrame, rel: Rel, type_: str) -> None:
    types = {p: t for p, (_, t) in rel.props.items() if t != "null"}
    made = df.select(F.col(rel.id).alias("_id"), F.col(rel.src).alias("_src"), F.col(rel.dst).alias("_dst"), *(F.col(rel.props[p][0]).alias(p) for p in types))
    q.graph.edges = [*q.graph.edges, EdgeTable(type_, made, None, None, types)]


def _check_relationship(element) -> None:
    _, _, types, direction, low, _, _ = element
    if low is not None:
        raise semantic("CreatingVarLength", "a created relationship has one hop")
    if len(types) != 1:
        raise semantic("NoSingleRelationshipType", "a created relationship has one type")
    if direction == "both":
        raise semantic("RequiresDirectedRelationship", "a created relationship has a direction")


def create(q, patterns) -> None:
    q.rows()
    number = fresh("row")
    for p in patterns:
        for e in p[3]:
            if e[0] == "rel":
                _check_relationship(e)
                if e[1] in q.scope:
                    raise semantic("VariableAlreadyBound", f"{e[1]} is bound already")
            elif e[1] in q.scope and (e[2] or e[3] or len(p[3]) == 1):
                raise semantic("VariableAlreadyBound", f"{e[1]} is bound already")
    steps = []  # in order: nodes before the edges that need them
    anonymous: dict[int, str] = {}
    for p in patterns:
        for e in p[3][::2]:
            name = e[1] or anonymous.setdefault(id(e), fresh("anonymous"))
            if name not in q.scope and all(s[1] != name for s in steps if s[0] == "node"):
                steps.append(("node", name, e))
        for k, e in enumerate(p[3][1::2]):
            ends = [x[1] or anonymous[id(x)] for x in (p[3][2 * k], p[3][2 * k + 2])]
            steps.append(("rel", e, ends[::-1] if e[3] == "in" else ends))
    evaluate = q.prepared(*(x for s in steps for _, x in props_of((s[2] if s[0] == "node" else s[1])[3 if s[0] == "node" else 6], q.params)))
    columns, made = {}, []
    for s in steps:
        e = s[2] if s[0] == "node" else s[1]
        props = {}
        for key, x in props_of(e[3] if s[0] == "node" else e[6], q.params):
            value = storable(evaluate(x), key)
            c = fresh(key)
            columns[c] = value.col
            props[key] = (c, value.t)
        made.append((s, props))
    df, total = numbered(q.df.withColumns(columns) if columns else q.df, number)
    ids = {}
    for k, (s, props) in enumerate(made):
        ids[k] = fresh("id")
        df = df.withColumn(ids[k], _create_id(q, df, number, len(made), k, total))
    q.graph.next_id += total * len(made)
    hidden = {}
    for k, (s, props) in enumerate(made):
        if s[0] == "node":
            node = Node(ids[k], None, frozenset(s[2][2]), props)
            hidden[s[1]] = node
            _add_nodes(q, df, node, s[2][2])
        else:
            a, b = (hidden.get(n, q.scope.get(n)) for n in s[2])
            kind = fresh("type")
            df = df.withColumn(kind, F.lit(s[1][2][0]))
            rel = Rel(ids[k], a.id, b.id, kind, props)
            _add_edges(q, df, rel, s[1][2][0])
            if s[1][1]:
                q.scope[s[1][1]] = rel
    q.scope |= {n: b for n, b in hidden.items() if "__" not in n}
    q.df = df.drop(number)
    q.trace.append("Create")


def changed(table, **more):
    """A new version of a table; the shortcut to the source's rows no longer holds."""
    return replace(table, by_key=None, **more)


def _updated(table, changes: DataFrame, values: dict[str, Typed], keep) -> object:
    """A table with new property values for the ids of ``changes`` (_k, columns)."""
    types = dict(table.types)
    columns = {}
    for p, x in values.items():
        t = joined(types[p], x.t) if p in types else x.t
        if t == "null":
            t = types.get(p, "null")
        if t == "null":
            continue
        old = F.col(p) if p in types else F.lit(None)
        types[p] = "str" if t == "any" else t
        kind = spark_type(types[p])
        columns[p] = F.when(F.col("_k").isNotNull(), x.col.cast(kind)).otherwise(old.cast(kind))
    df = table.df.join(changes, table.df["_id"] == changes["_k"], "left").withColumns(columns)
    return changed(table, df=df.select(*keep, *types), types=types)


def _assign(q, name: str, values: dict[str, Typed], clear: bool = False) -> None:
    """Sets properties of a bound node or relationship; ``clear`` drops the others."""
    b = q.scope.get(name)
    if not isinstance(b, (Node, Rel)):
        raise semantic("UndefinedVariable" if b is None else "VariableTypeConflict", f"{name} is not a node or relationship")
    values = {p: storable(x, p) for p, x in values.items()}
    columns = {fresh(p): (p, x) for p, x in values.items()}
    q.df = checkpointed(q.df.withColumns({c: x.col for c, (_, x) in columns.items()}) if columns else q.df)
    changes = q.df.where(F.col(b.id).isNotNull()).groupBy(F.col(b.id).alias("_k")).agg(*(F.max(c).alias(c) for c in columns)) if columns else q.df.select(F.col(b.id).alias("_k")).distinct()
    tables = q.graph.nodes if isinstance(b, Node) else q.graph.edges
    fixed = ["_id", "_labels"] if isinstance(b, Node) else ["_id", "_src", "_dst"]
    out = []
    for t in tables:
        if isinstance(b, Node) and not b.static <= t.may:
            out.append(t)
            continue
        new = {p: Typed(F.col(c), x.t) for c, (p, x) in columns.items()}
        if clear:
            new = {p: Typed(F.lit(None), "null") for p in t.types if p not in new} | new
        out.append(_updated(t, changes, new, fixed))
    if isinstance(b, Node):
        q.graph.nodes = out
    else:
        q.graph.edges = out
    kept = {} if clear else dict(b.props)
    q.scope[name] = replace(b, props=kept | {p: (c, x.t) for c, (p, x) in columns.items()})


def _relabel(q, name: str, labels, add: bool, only: F.Column | None = None) -> None:
    """Adds or removes labels of a bound node, in the rows where ``only`` holds."""
    b = q.scope.get(name)
    if not isinstance(b, Node):
        raise semantic("VariableTypeConflict", f"{name} is not a node")
    q.df = checkpointed(q.df)
    ids = (q.df if only is None else q.df.where(only)).select(F.col(b.id).alias("_k")).where("_k is not null").distinct()
    names = F.array(*(F.lit(x) for x in labels))
    out = []
    for t in q.graph.nodes:
        if not b.static <= t.may:
            out.append(t)
            continue
        change = F.array_sort(F.array_union("_labels", names)) if add else F.array_except("_labels", names)
        df = t.df.join(ids, t.df["_id"] == ids["_k"], "left").withColumn("_labels", F.when(F.col("_k").isNotNull(), change).otherwise(F.col("_labels"))).drop("_k")
        out.append(changed(t, df=df, may=t.may | set(labels) if add else t.may, always=t.always if add else t.always - set(labels)))
    q.graph.nodes = out
    fresh_labels = fresh("labels")
    have = F.col(b.labels) if b.labels else F.array(*(F.lit(x) for x in sorted(b.static))).cast("array<string>")
    change = F.array_sort(F.array_union(have, names)) if add else F.array_except(have, names)
    q.df = q.df.withColumn(fresh_labels, change if only is None else F.when(only, change).otherwise(have))
    q.scope[name] = replace(b, labels=fresh_labels, static=b.static if add and only is not None else b.static | set(labels) if add else b.static - set(labels))


def set_items(q, items) -> None:
    q.rows()
    for item in items:
        if item[0] == "label":
            _relabel(q, item[1], item[2], True)
            continue
        value = item[3] if item[0] == "prop" else item[2]
        x = q.prepared(value)(value)
        if item[0] == "prop":
            _assign(q, item[1], {item[2]: x})
            continue
        if x.t == "null":
            continue
        if not (isinstance(x.t, tuple) and x.t[0] in ("map", "node", "rel")):
            raise semantic("InvalidArgumentType", "SET needs a map")
        _assign(q, item[1], {k: Typed(x.col[k], t) for k, t in x.t[1] if k != "_empty"}, clear=item[0] == "replace")
    q.trace.append("Set")


def remove(q, items) -> None:
    q.rows()
    for item in items:
        if item[0] == "label":
            _relabel(q, item[1], item[2], False)
        else:
            _assign(q, item[1], {item[2]: Typed(F.lit(None).cast("string"), "null")})
    q.trace.append("Remove")


def delete(q, expressions, detach: bool) -> None:
    q.df = checkpointed(q.rows())
    nodes = edges = None
    for e in expressions:
        b = q.scope.get(e[1]) if e[0] == "var" else None
        if not isinstance(b, (Node, Rel)):
            raise semantic("InvalidDelete", "DELETE takes nodes and relationships")
        ids = q.df.select(F.col(b.id).alias("_k")).where("_k is not null").distinct()
        if isinstance(b, Node):
            nodes = ids if nodes is None else nodes.union(ids).distinct()
        else:
            edges = ids if edges is None else edges.union(ids).distinct()
    drop = lambda df, ids, c: df.join(ids, df[c] == ids["_k"], "left_anti")
    if edges is not None:
        q.graph.edges = [changed(t, df=drop(t.df, edges, "_id")) for t in q.graph.edges]
    if nodes is not None:
        if not detach:
            for t in q.graph.edges:
                for end in ("_src", "_dst"):  # two equi-joins; an OR of both would be a nested loop
                    if not t.df.select(end).join(nodes, F.col(end) == F.col("_k"), "left_semi").isEmpty():
                        raise QueryError("ConstraintViolation", "DeleteConnectedNode", "a deleted node still has relationships", "Runtime")
        q.graph.edges = [changed(t, df=drop(drop(t.df, nodes, "_src"), nodes, "_dst")) for t in q.graph.edges]
        q.graph.nodes = [changed(t, df=drop(t.df, nodes, "_id")) for t in q.graph.nodes]
    q.trace.append("Delete")


def merge(q, path, on_create, on_match) -> None:
    """Match or create a node, or a relationship of two bound nodes; each missing key is created once."""
    _, _, _, elements = path
    q.rows()
    if len(elements) == 1:
        _merge_node(q, elements[0], on_create, on_match)
    elif len(elements) == 3 and elements[0][1] in q.scope and elements[2][1] in q.scope:
        _merge_edge(q, elements, on_create, on_match)
    else:
        for e in elements[::2]:
            if e[1] not in q.scope:
                _merge_node(q, (e[0], e[1] or fresh("anonymous"), *e[2:]) if not e[1] else e, [], [])
        if all(e[1] for e in elements[::2]) and len(elements) == 3:
            _merge_edge(q, elements, on_create, on_match)
        else:
            raise semantic("InvalidClauseComposition", "MERGE of a longer pattern")
    q.trace.append("Merge")


def _values(q, pairs) -> dict[str, tuple[str, object]]:
    """Columns of the wanted property values, nulls refused."""
    evaluate = q.prepared(*(x for _, x in pairs))
    out, columns = {}, {}
    for key, x in pairs:
        value = storable(evaluate(x), key)
        if value.t == "null":
            raise QueryError("SemanticError", "MergeReadOwnWrites", f"MERGE on a null {key}", "Runtime")
        c = fresh(key)
        columns[c] = F.when(value.col.isNull(), F.raise_error(F.lit(f"MergeReadOwnWrites: MERGE on a null {key}")).cast(spark_type(value.t))).otherwise(value.col)
        out[key] = (c, value.t)
    q.df = checkpointed(q.df.withColumns(columns) if columns else q.df)
    return out


def _split_set(q, name: str, items, created: F.Column, flag: bool) -> None:
    """ON CREATE and ON MATCH: values where the row was (not) created, the old ones elsewhere."""
    for item in items:
        if item[0] == "label":
            _relabel(q, item[1], item[2], True, created if flag else ~created)
            continue
        b = q.scope[item[1]]
        value = item[3] if item[0] == "prop" else item[2]
        x = q.prepared(value)(value)
        pairs = {item[2]: x} if item[0] == "prop" else {k: Typed(x.col[k], t) for k, t in x.t[1]}
        out = {}
        for p, v in pairs.items():
            old = Typed(F.col(b.props[p][0]), b.props[p][1]) if p in b.props else Typed(F.lit(None), "null")
            t = joined(v.t, old.t)
            out[p] = Typed(F.when(created if flag else ~created, scalar.cast(v, t).col).otherwise(scalar.cast(old, t).col), t)
        _assign(q, item[1], out)


def _merge_node(q, element, on_create, on_match) -> None:
    _, name, labels, props = element
    name = name or fresh("anonymous")
    if name in q.scope:
        raise semantic("VariableAlreadyBound", f"{name} is bound already")
    wanted = _values(q, props_of(props, q.params))
    existing, types = q.graph.scan(labels)
    keys = [c for c, _ in wanted.values()]
    missing = q.df.select(*keys).distinct() if keys else q.df.limit(1).select(F.lit(1).alias(fresh("one")))
    condition = F.lit(True)
    for p, (c, t) in wanted.items():
        have = Typed(F.col(p), types[p]) if p in types else Typed(F.lit(None), "null")
        condition = condition & scalar.equal(Typed(F.col(c), t), have)
    missing = missing.join(existing, condition, "left_anti")
    number, first = fresh("row"), q.graph.next_id
    rows, total = numbered(missing, number)
    ident = fresh("id")
    rows = rows.withColumn(ident, (F.lit(first).cast("bigint") + F.col(number)) * SLOTS + CREATED)
    q.graph.next_id += total
    if total:
        _add_nodes(q, rows, Node(ident, None, frozenset(labels), wanted), labels)
    m = q.matcher(q.df, q.scope)
    df, node = m.select_nodes(None, labels, None, name, True)
    condition = F.lit(True)
    for p, (c, t) in wanted.items():
        condition = condition & scalar.equal(Typed(F.col(c), t), Typed(F.col(node.props[p][0]), node.props[p][1]))
    q.df = checkpointed(q.df.join(df, condition))
    q.scope[name] = node
    created = (F.col(node.id) % SLOTS == CREATED) & (F.floor(F.col(node.id) / SLOTS) >= first)
    _split_set(q, name, on_create, created, True)
    _split_set(q, name, on_match, created, False)


def _merge_edge(q, elements, on_create, on_match) -> None:
    left, rel, right = elements
    _, name, kinds, direction, low, _, props = rel
    if low is not None or len(kinds) != 1:
        raise semantic("NoSingleRelationshipType" if low is None else "CreatingVarLength", "MERGE takes one relationship of one type")
    wanted = _values(q, props_of(props, q.params))
    ends = [q.scope[left[1]].id, q.scope[right[1]].id]
    src, dst = ends[::-1] if direction == "in" else ends
    hint = name or "r"

    def probe():
        m = q.matcher(q.df, q.scope)
        edges, found, near, far, _ = m.edges((rel[0], None, kinds, "both" if direction == "both" else "out", None, None, ()), frozenset(), frozenset(), None, hint)
        condition = (F.col(src) == F.col(near)) & (F.col(dst) == F.col(far))
        for p, (c, t) in wanted.items():
            have = Typed(F.col(found.props[p][0]), found.props[p][1]) if p in found.props else Typed(F.lit(None), "null")
            condition = condition & scalar.equal(Typed(F.col(c), t), have)
        return edges, found, condition

    edges, _, condition = probe()
    keys = [src, dst, *(c for c, _ in wanted.values())]
    missing = q.df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).join(edges, condition, "left_anti").select(*keys)
    if direction == "both":
        missing = missing.withColumns({"_lo": F.least(src, dst), "_hi": F.greatest(src, dst)}).select(F.col("_lo").alias(src), F.col("_hi").alias(dst), *keys[2:])
    number, first, ident, kind = fresh("row"), q.graph.next_id, fresh("id"), fresh("type")
    rows, total = numbered(missing.distinct(), number)
    rows = rows.withColumns({ident: (F.lit(first).cast("bigint") + F.col(number)) * SLOTS + CREATED, kind: F.lit(kinds[0])})
    q.graph.next_id += total
    if total:
        _add_edges(q, rows, Rel(ident, src, dst, kind, wanted), kinds[0])
    edges, found, condition = probe()
    q.df = checkpointed(q.df.join(edges, condition))
    name = name or fresh("anonymous")
    q.scope[name] = found
    created = F.col(found.id).isin([]) if not total else (F.col(found.id) % SLOTS == CREATED) & (F.floor(F.col(found.id) / SLOTS).between(first, first + total - 1))
    _split_set(q, name, on_create, created, True)
    _split_set(q, name, on_match, created, False)
