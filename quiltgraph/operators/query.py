"""Clauses to DataFrames: matching, projection, aggregation, subqueries, unions, calls.

Correlated parts are decorrelated when the plan is made. EXISTS and pattern
predicates become semi or anti joins on the outer ids and properties that they read,
distinct where these repeat; inside other expressions, a mark joined on those columns. OPTIONAL
MATCH and pattern comprehensions join what was found back on them, nulls being equal.
"""

from __future__ import annotations

import inspect
import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiltgraph.errors import QueryError, semantic
from quiltgraph.functions import scalar
from quiltgraph.functions.types import Typed
from quiltgraph.operators import fulltext, writes
from quiltgraph.operators.expressions import SUBQUERIES, Expressions, aggregates_of, has_aggregate, is_aggregate
from quiltgraph.operators.patterns import Matcher, Trace
from quiltgraph.operators.scope import Node, Path, Rel, Scope, Value, fresh, null_safe
from quiltgraph.plans.parser import walk
from quiltgraph.sources.catalog import Graph, spark_type



SPARSE = 8  # combinations of nodes for each edge, beyond which they hardly repeat
MOST_CALLS = 100  # of a procedure, with arguments that the rows give


def names_in(e) -> set[str]:
    """Variables that a clause or expression mentions, in patterns too."""
    out = set()
    for x in walk(e):
        if len(x) >= 2 and x[0] in ("var", "node", "rel", "path") and isinstance(x[1], str):
            out.add(x[1])
    return out


def conjuncts(e) -> list[tuple]:
    return conjuncts(e[2]) + conjuncts(e[3]) if e[0] == "bin" and e[1] == "AND" else [e]


def joined_by_and(parts: list[tuple]):
    out = None
    for p in parts:
        out = p if out is None else ("bin", "AND", out, p)
    return out


def properties_read(clauses) -> dict[str, set | None]:
    """What the query reads of each variable: property names, or None for all of it."""
    used: dict[str, set | None] = {}
    same: list[tuple[str, str]] = []
    lists: set[str] = set()
    mentions: list[tuple[str, frozenset]] = []  # of nodes in patterns, with their labels
    counted: list[str] = []  # in count(DISTINCT), which takes nodes by their id
    refused: set[str] = set()  # in negated patterns, which an edge's end that isn't in its table would pass

    def add(name: str, key: str | None) -> None:
        if key is None or used.get(name, set()) is None:
            used[name] = None
        else:
            used.setdefault(name, set()).add(key)

    def visit(e, bare=False) -> None:
        if isinstance(e, (list, tuple)) and not (isinstance(e, tuple) and e and isinstance(e[0], str)):
            for x in e:
                visit(x)
            return
        if not isinstance(e, tuple):
            return
        kind = e[0]
        if kind == "not" and e[1][0] in ("pattern", "exists", "existsq"):
            refused.update(names_in(e[1]))
        if kind == "var":
            add(e[1], None)
        elif kind == "prop" and e[1][0] == "var":
            add(e[1][1], e[2])
        elif kind == "labels" and e[1][0] == "var":
            add(e[1][1], "_labels")
        elif kind == "call" and e[1].lower() in ("id", "type", "labels", "length", "size", "count", "exists", "score") and len(e[2]) == 1 and e[2][0][0] == "var" and not (len(e) > 3 and e[3]):
            if e[1].lower() == "labels":
                add(e[2][0][1], "_labels")
            if e[1].lower() == "score":
                add(e[2][0][1], "__score")
        elif kind == "call" and e[1].lower() == "count" and len(e[2]) == 1 and e[2][0][0] == "var":
            counted.append(e[2][0][1])
        elif kind == "call" and len(e) == 5:  # the clause
            visit(e[2])
            visit(e[4])
        elif kind == "map":
            for _, x in e[1]:
                visit(x)
        elif kind == "cmp" and all(o in ("=", "<>") for o, _ in e[2]):
            for x in (e[1], *(y for _, y in e[2])):
                if x[0] != "var":
                    visit(x)
        elif kind == "isnull" and e[1][0] == "var":
            pass
        elif kind in ("with", "return"):
            _, _, star, items, order, *rest = e
            if star and kind == "return":
                used["*"] = None
            for x, name, _ in items:
                if x[0] == "var" and kind == "with":
                    same.append((x[1], name))
                else:
                    visit(x)
            for x, _ in order:
                visit(x)
            visit(rest)
        elif kind == "node":
            for k, x in e[3] if e[3] and e[3][0] != "param" else ():
                if e[1]:
                    add(e[1], k)
                visit(x)
            if e[1]:
                mentions.append((e[1], frozenset(e[2])))
        elif kind == "rel":
            if e[1] and e[4] is not None:  # a list that is walked again is needed whole
                if e[1] in lists:
                    add(e[1], None)
                lists.add(e[1])
            for k, x in e[6] if e[6] and e[6][0] != "param" else ():
                if e[1]:
                    add(e[1], k)
                visit(x)
        elif kind in ("prop", "label", "merge", "replace") and len(e) > 1 and isinstance(e[1], str):  # SET and REMOVE items
            add(e[1], None)
            visit(e[2:])
        elif kind == "delete":
            for x in e[1]:
                if x[0] != "var":
                    visit(x)
        else:
            for x in e[1:]:
                visit(x)

    visit(clauses)
    first: dict[str, frozenset] = {}
    for name, labels in mentions:
        if not labels <= first.setdefault(name, labels):  # checked again where it's bound already
            add(name, "_labels")
    for name in counted:
        if name not in first:
            add(name, None)
    names = [n for n, _ in mentions]
    for name in refused & ({n for n in names if names.count(n) > 1} | {new for _, new in same}):
        add(name, "_id")  # so that its table is read
    for _ in range(len(same) + 1):
        for old, new in same:
            if new in used:
                used[old] = None if used[new] is None or used.get(old, set()) is None else used.get(old, set()) | used[new]
    if "*" in used:
        for name in names_in(clauses):
            used[name] = None
    return used


class Query:
    """One query part (clauses up to a UNION) over a graph."""

    def __init__(self, spark: SparkSession, graph: Graph, params: dict, procedures: dict, used: dict | None = None, scope: Scope | None = None, df: DataFrame | None = None, trace: Trace | None = None):
        self.spark, self.graph, self.params, self.procedures = spark, graph, params, procedures
        self.used, self.scope, self.df = used or {}, scope or {}, df
        self.trace = trace if trace is not None else Trace()
        self.sorted_by: list[tuple[str, bool, object]] = []
        self.wrote = False

    result_cap: int | None = None

    def cap_of(self, clauses: list[tuple]) -> int | None:
        """Of a single relationship's rows straight to a LIMIT: how many are needed."""
        if len(clauses) != 2 or clauses[0][0] != "match" or clauses[1][0] != "return":
            return None
        _, optional, patterns, where = clauses[0]
        _, distinct, _, items, order, skip, limit = clauses[1]
        plain = not (optional or where or distinct or order) and len(patterns) == 1 and len(patterns[0][3]) == 3 and not patterns[0][2]
        if not plain or limit is None or any(has_aggregate(e) for e, _, _ in items):
            return None
        return self.constant(limit, "LIMIT") + (self.constant(skip, "SKIP") if skip is not None else 0)

    def rows(self) -> DataFrame:
        if self.df is None:
            self.df = self.spark.range(1).select(F.lit(1).alias(fresh("unit")))
        return self.df

    def run(self, clauses: list[tuple]) -> DataFrame:
        self.used = self.used or properties_read(clauses)
        self.scored = {x[2][0][1] for x in walk(tuple(clauses)) if len(x) == 4 and x[0] == "call" and str(x[1]).lower() == "score" and x[2] and x[2][0][0] == "var"}
        self.result_cap = self.cap_of(clauses)
        for k, c in enumerate(clauses):
            if c[0] == "call" and c[3] is None and len(clauses) > 1:
                raise semantic("UnexpectedSyntax", "YIELD * stands only in a call by itself")
            if c[0] == "return" and k != len(clauses) - 1:
                raise semantic("InvalidClauseComposition", "RETURN must be last")
            getattr(self, f"on_{c[0]}")(*c[1:])
        last = clauses[-1][0]
        if last == "return":
            return self.df
        if self.wrote:
            return self.spark.range(0).select()
        if last == "call":
            return self.rows().select(*(F.col(b.column).alias(n) for n, b in self.scope.items() if isinstance(b, Value)))
        raise semantic("InvalidClauseComposition", "a query must end with RETURN or an update")

    # Matching.
    def matcher(self, df: DataFrame | None, scope: Scope) -> Matcher:
        m = Matcher(self.graph, self.params, self.used, df, scope, self.trace)
        m.result_cap = self.result_cap
        return m

    def seen_by(self, *parts) -> tuple[list[str], Scope]:
        """The columns of outer variables that a subquery may read, and these variables: nodes and relationships by their id, with what it reads of them."""
        reads, out = properties_read(parts), {}
        labelled = {(x[1], label) for x in walk(parts) if len(x) == 4 and x[0] == "node" for label in x[2]}
        whole = any(len(x) == 4 and x[0] == "path" and x[1] for x in walk(parts))  # a path may hold all of its nodes
        for n in sorted(names_in(parts) & set(self.scope)):
            b, read = self.scope[n], reads.get(n, set())
            if isinstance(b, (Node, Rel)) and read is not None and not whole:
                b = replace(b, props={p: c for p, c in b.props.items() if p in read})
                if isinstance(b, Node) and "_labels" not in read and all(label in b.static for name, label in labelled if name == n):
                    b = replace(b, labels=None)
            out[n] = b
        keys = list(dict.fromkeys(c for b in out.values() for c in b.columns() if c in self.df.columns))
        return keys, {n: b for n, b in out.items() if all(c in keys for c in b.columns())}

    def matched(self, df: DataFrame | None, scope: Scope, patterns, where) -> tuple[DataFrame, Scope]:
        m = self.matcher(df, scope)
        m.match(patterns)
        inner = Query(self.spark, self.graph, self.params, self.procedures, self.used, m.scope, m.df, self.trace)
        if where is not None:
            inner.filter(where)
        return inner.df, inner.scope

    def bind_scores(self, where) -> None:
        """score(n) after a substring predicate on a property with a full-text index."""
        for e in conjuncts(where) if where is not None else ():
            if not (e[0] == "bin" and e[1] in ("CONTAINS", "STARTS", "ENDS") and e[2][0] == "prop" and e[2][1][0] == "var" and e[3][0] in ("lit", "param")):
                continue
            name, prop, term = e[2][1][1], e[2][2], self.params.get(e[3][1]) if e[3][0] == "param" else e[3][1]
            b = self.scope.get(name)
            if name not in self.scored or not isinstance(b, Node) or prop not in b.props or not isinstance(term, str):
                continue
            label = next((x for x, props, kind in self.graph.indexes if x in b.static and tuple(props) == (prop,) and kind in ("fulltext", "fulltext_ci")), None)
            if label is None:
                continue
            totals, score = fulltext.substring_score(F.col(b.props[prop][0]), term, self.graph.scan([label])[0], prop)
            c = fresh("score")
            self.df = self.df.crossJoin(F.broadcast(totals)).withColumn(c, score.cast("double")).drop(*totals.columns)  # one row of totals
            self.scope[name] = replace(b, props=b.props | {"__score": (c, "float")})

    def on_match(self, optional: bool, patterns, where) -> None:
        for p in patterns:
            for e in p[3]:
                if e[1] and isinstance(b := self.scope.get(e[1]), Path) or e[1] and e[0] == "rel" and isinstance(self.scope.get(e[1]), Node) or e[1] and e[0] == "node" and isinstance(self.scope.get(e[1]), Rel):
                    raise semantic("VariableTypeConflict", f"{e[1]} is bound to something else")
            if p[1] and p[1] in self.scope:
                raise semantic("VariableAlreadyBound", f"{p[1]} is bound already")
        if has_aggregate(where):
            raise semantic("InvalidAggregation", "an aggregate in WHERE")
        if not optional:
            plain = [p for p in patterns if not p[2]]
            if where is not None and plain and len(plain) < len(patterns):  # conditions on the ends come before the search
                known = names_in(tuple(plain)) | set(self.scope)
                early = [c for c in conjuncts(where) if names_in(c) <= known]
                late = [c for c in conjuncts(where) if names_in(c) - known]
                self.df, self.scope = self.matched(self.df, self.scope, plain, joined_by_and(early))
                patterns, where = [p for p in patterns if p[2]], joined_by_and(late)
            condition = where
            self.df, self.scope = self.matched(self.df, self.scope, patterns, where)
            self.bind_scores(condition)
            return
        self.trace.append("LeftOuterJoin")
        self.rows()
        keys, outer = self.seen_by(tuple(patterns), where)
        seed = self.df.select(*keys).distinct() if keys else None
        found, scope = self.matched(seed, outer, patterns, where)
        fresh_columns = [c for n, b in scope.items() if n not in outer for c in b.columns()]
        fresh_columns = [c for c in dict.fromkeys(fresh_columns) if c not in keys]
        self.attach(found, keys, fresh_columns)
        self.scope |= {n: b for n, b in scope.items() if n not in self.scope}

    def attach(self, found: DataFrame, keys: list[str], columns: list[str]) -> None:
        """Left join of ``columns`` on equal keys."""
        right = found.select(*(F.col(k).alias(k + "_r") for k in keys), *columns)
        condition = null_safe(keys, "_r")
        self.df = self.df.join(right, condition, "left").drop(*(k + "_r" for k in keys))

    # Expressions with subqueries.
    def subqueries(self, e) -> list:
        """The outermost subqueries of an expression."""
        if not isinstance(e, tuple):
            return []
        if e and isinstance(e[0], str) and (e[0] in SUBQUERIES or e[0] == "call" and e[1].lower() in ("startnode", "endnode")):
            return [e]
        return [y for x in e for y in self.subqueries(x)]

    def prepared(self, *expressions, extra: dict | None = None) -> Expressions:
        """An evaluator for which the subqueries of ``expressions`` have been joined on."""
        extra = dict(extra or {})
        for e in dict.fromkeys(s for x in expressions if x is not None for s in self.subqueries(x)):
            if e not in extra:
                extra[e] = self.joined(e)
        return Expressions(self.scope, self.params, extra)

    def joined(self, e) -> Typed:
        self.rows()
        if e[0] == "call":
            return self.end_node(e)
        if e[0] == "patcomp":
            _, path, where, out = e
            keys, outer = self.seen_by(e)
            found, scope = self.matched(self.df.select(*keys).distinct() if keys else None, outer, [path], where)
            inner = Query(self.spark, self.graph, self.params, self.procedures, self.used, scope, found, self.trace)
            x = inner.prepared(out)(out)
            name = fresh("items")
            items = inner.df.groupBy(*keys).agg(F.sort_array(F.collect_list(x.col)).alias(name)) if keys else inner.df.agg(F.sort_array(F.collect_list(x.col)).alias(name))
            self.attach(items, keys, [name])
            kind = ("list", x.t)
            return Typed(F.coalesce(F.col(name), F.array().cast(spark_type(kind))), kind)
        keys, found = self.found(e)
        mark = fresh("mark")
        self.attach((found.distinct() if keys else found).withColumn(mark, F.lit(True)), keys, [mark])
        return Typed(F.coalesce(F.col(mark), F.lit(False)), "bool")

    def end_node(self, e) -> Typed:
        """startNode and endNode by a join on the id."""
        inner = e[2][0]
        b = self.scope.get(inner[1]) if inner[0] == "var" else None
        if not isinstance(b, Rel):
            raise semantic("InvalidArgumentType", f"{e[1]} needs a relationship variable")
        m = self.matcher(self.df, self.scope)
        df, node = m.select_nodes(None, (), None, "end", True)
        self.df = self.df.join(df, F.col(b.src if e[1].lower() == "startnode" else b.dst) == F.col(node.id), "left")
        return node.struct()

    def found(self, e) -> tuple[list[str], DataFrame]:
        """The outer columns for which a pattern or subquery has a match; they may repeat."""
        keys, outer = self.seen_by(e)
        seed = self.df.select(*keys) if keys else None
        if keys and (e[0] == "existsq" or not self.hardly_repeat(outer)):  # queries count what they find for each
            seed = seed.distinct()
        if e[0] == "pattern":
            df, _ = self.matched(seed, outer, [e[1]], None)
        elif e[0] == "exists":
            df, _ = self.matched(seed, outer, list(e[1]), e[2])
        else:
            df = None
            for clauses in e[1]:
                part = self.subquery_rows(seed, outer, keys, list(clauses))
                df = part if df is None else df.unionByName(part)
        return keys, (df.select(*keys) if keys else df.limit(1).select())

    def hardly_repeat(self, outer: Scope) -> bool:
        """Whether several nodes could make many more combinations than there are edges of any type, so that looking for equal ones costs more than it saves."""
        nodes = [sum(self.graph.rows_of(t) for t in self.graph.node_tables(b.static)) for b in outer.values() if isinstance(b, Node)]
        return len(nodes) > 1 and len(nodes) == len(outer) and math.prod(nodes) > SPARSE * max(map(self.graph.rows_of, self.graph.edges), default=0)

    def subquery_rows(self, seed, outer: Scope, keys: list[str], clauses: list[tuple]) -> DataFrame:
        """Rows of an inner query, with the outer columns carried through its projections."""
        if any(c[0] in ("create", "merge", "set", "remove", "delete") for c in clauses):
            raise semantic("InvalidClauseComposition", "updates aren't allowed in EXISTS")
        q = Query(self.spark, self.graph, self.params, self.procedures, properties_read(clauses) | {n: None for n in outer}, dict(outer), seed, self.trace)
        q.carried, q.seed = keys, seed
        for c in clauses:
            if c[0] == "return":
                if any(has_aggregate(x) for x, _, _ in c[3]) or c[5] is not None or c[6] is not None:
                    q.project(*c[1:], None)
                continue
            getattr(q, f"on_{c[0]}")(*c[1:])
        return q.rows()

    scored: set[str] = set()
    carried: list[str] = []
    seed: DataFrame | None = None

    def filter(self, e) -> None:
        """WHERE: conjuncts that are subqueries become semi or anti joins."""
        if e[0] == "bin" and e[1] == "AND":
            self.filter(e[2])
            self.filter(e[3])
            return
        negated, inner = e[0] == "not", e[1] if e[0] == "not" else e
        if inner[0] in ("pattern", "exists", "existsq"):
            self.rows()
            self.trace.append("AntiJoin" if negated else "SemiJoin")
            keys, found = self.found(inner)
            right = found.select(*(F.col(k).alias(k + "_r") for k in keys))
            self.df = self.df.join(right, null_safe(keys, "_r"), "left_anti" if negated else "left_semi")
            return
        x = self.prepared(e)
        self.df = self.df.where(x.boolean(e).col)
        self.trace.append("Filter")

    def on_unwind(self, e, name: str) -> None:
        if name in self.scope:
            raise semantic("VariableAlreadyBound", f"{name} is bound already")
        self.rows()
        x = self.prepared(e)(e)
        if x.t == "null":
            x = Typed(F.array().cast("array<string>"), ("list", "str"))
        if not (isinstance(x.t, tuple) and x.t[0] == "list"):
            raise QueryError("TypeError", "InvalidArgumentType", "UNWIND needs a list", "Runtime")
        column = fresh(name)
        self.df = self.df.select("*", F.explode(x.col).alias(column))
        self.scope[name] = Value(column, x.t[1])
        self.trace.append(f"Unwind({name})")

    # Projection.
    def star_items(self) -> list[tuple]:
        return [(("var", n), n, True) for n in sorted(self.scope)]

    def constant(self, e, what: str) -> int:
        v = self.params.get(e[1]) if e[0] == "param" else e[1] if e[0] == "lit" else None
        if e[0] not in ("param", "lit"):
            v = self.spark.range(1).select(Expressions({}, self.params)(e).col).head()[0]
        if isinstance(v, bool) or not isinstance(v, int):
            raise semantic("InvalidArgumentType", f"{what} needs an integer")
        if v < 0:
            raise semantic("NegativeIntegerArgument", f"{what} is negative")
        return v

    def on_with(self, distinct, star, items, order, skip, limit, where) -> None:
        for e, _, aliased in items:
            if not aliased and e[0] != "var":
                raise semantic("NoExpressionAlias", "an expression in WITH needs AS")
        self.project(distinct, star, items, order, skip, limit, where)

    def on_return(self, distinct, star, items, order, skip, limit) -> None:
        self.project(distinct, star, items, order, skip, limit, None)
        out = []
        for n in self.order_of_names:
            b = self.scope[n]
            x = b.typed() if isinstance(b, Value) else b.struct()
            out.append((x.col.cast("string") if x.t == "null" else x.col).alias(n))
        self.df = self.df.select(*out)

    def project(self, distinct, star, items, order, skip, limit, where) -> None:
        self.rows()
        items = [*(self.star_items() if star else []), *items]
        names = [n for _, n, _ in items]
        if len(set(names)) != len(names):
            raise semantic("ColumnNameConflict", "two columns have one name")
        aggregated = any(has_aggregate(e) for e, _, _ in items)
        if not aggregated and any(has_aggregate(e) for e, _ in order):
            raise semantic("InvalidAggregation", "an aggregate in ORDER BY without one in the projection")
        self.order_of_names = names
        if aggregated:
            extra, scope = self.aggregate(items, [e for e, _ in order])
        else:
            extra, scope = self.plain(items)
        aliases = {("var", n): (b.typed() if isinstance(b, Value) else b.struct()) for n, b in scope.items()}
        whole = {e: aliases[("var", n)] for e, n, _ in items if e[0] != "var"}
        self.trace.append(("Aggregate(" if aggregated else "Project(") + ", ".join(names) + ")")
        before = dict(self.scope)
        late = {} if aggregated or distinct else before
        if distinct:
            self.scope = scope
            self.df = self.df.select(*dict.fromkeys([*self.carried, *(c for b in scope.values() for c in b.columns())])).dropDuplicates()
            self.trace.append("Distinct")
        self.scope = late | scope
        if order:
            keys = []
            self.sorted_by = []
            evaluate = self.prepared(*(e for e, _ in order), extra=extra | whole)
            added = {}
            for e, down in order:
                x = evaluate(e)
                if isinstance(x.t, tuple) and x.t[0] in ("node", "rel"):
                    x = Typed(x.col["_id"], "int")
                c = fresh("key")
                added[c] = x.col if x.t not in ("dt", "time") else Expressions.part(x, "epochMillis").col if x.t == "dt" else x.col["nanos"]
                keys.append(F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last())
                self.sorted_by.append((c, down, x.t))
            self.df = self.df.withColumns(added)
            if not self.carried:
                self.df = self.df.orderBy(*keys)
            self.trace.append("Sort")
        if self.carried and (skip is not None or limit is not None):  # of each outer row, not of all together
            place, low = fresh("place"), self.constant(skip, "SKIP") if skip is not None else 0
            window = Window.partitionBy(*self.carried).orderBy(*(keys if order else [F.lit(1)]))
            ranked = self.df.withColumn(place, F.row_number().over(window)).where(F.col(place) > low)
            self.df = (ranked if limit is None else ranked.where(F.col(place) <= low + self.constant(limit, "LIMIT"))).drop(place)
        elif skip is not None or limit is not None:
            if skip is not None:
                self.df = self.df.offset(self.constant(skip, "SKIP"))
            if limit is not None:
                self.df = self.df.limit(self.constant(limit, "LIMIT"))
        if where is not None:
            if has_aggregate(where):
                raise semantic("InvalidAggregation", "an aggregate in WHERE")
            if skip is not None or limit is not None:
                self.scope = scope
            self.filter(where)
        # Renamed or shadowed variables are in scope's own columns by now.
        self.scope = {n: self.scope.get(n, b) if self.scope.get(n) == b else b for n, b in scope.items()}
        keep = dict.fromkeys([*self.carried, *(c for b in self.scope.values() for c in b.columns()), *(c for c, _, _ in self.sorted_by if c in self.df.columns)])
        self.df = self.df.select(*keep) if keep else self.df.select(F.lit(1).alias(fresh("unit")))

    def plain(self, items) -> tuple[dict, Scope]:
        scope: Scope = {}
        evaluate = self.prepared(*(e for e, _, _ in items))
        added = {}
        for e, n, _ in items:
            if e[0] == "var" and not isinstance(evaluate.binding(e[1]), Value):
                scope[n] = self.scope[e[1]]
                continue
            x = evaluate(e)
            c = fresh(n)
            added[c] = x.col
            scope[n] = Value(c, x.t)
        if added:
            self.df = self.df.withColumns(added)
        return {}, scope

    def aggregate(self, items, order) -> tuple[dict, Scope]:
        keys = [(e, n) for e, n, _ in items if not has_aggregate(e)]
        wanted = dict.fromkeys(x for e in [*(e for e, _, _ in items), *order] for x in aggregates_of(e))
        for a in wanted:
            if any(has_aggregate(x) for x in a[2:] if isinstance(x, tuple)) and any(has_aggregate(y) for y in a[2]):
                raise semantic("NestedAggregation", "an aggregate inside an aggregate")
            if any(x[0] == "call" and x[1].lower() == "rand" for x in walk(a) if len(x) > 1 and isinstance(x[1], str)):
                raise semantic("NonConstantExpression", "rand() inside an aggregate")
        evaluate = self.prepared(*(e for e, _ in keys), *(x for a in wanted if a[0] == "call" for x in a[2]))
        added, group, extra, scope, told = {}, [], {}, {}, {}
        for e, n in keys:
            b = self.scope.get(e[1]) if e[0] == "var" else None
            if b is not None and not isinstance(b, Value):
                if isinstance(b, Node):
                    told |= {c: self.graph.key_of(F.col(b.id)) for c in b.told}
                group += [c for c in b.columns() if c not in told]
                scope[n] = b
                extra[e] = b.struct() if not (isinstance(b, Path) and b.nodes is None) else Typed(F.col(b.length), "int")
                continue
            x = evaluate(e)
            c = fresh(n)
            added[c] = x.col
            group.append(c)
            scope[n] = Value(c, x.t)
            extra[e] = Typed(F.col(c), x.t)
        for e, n, _ in items:
            self.check_leaves(e, keys, extra)
        order_columns = self.collect_order()
        df = self.df.withColumns(added) if added else self.df
        made, named, results = [], [], {}
        for a in wanted:
            c = fresh("agg")
            if a[0] == "count*":
                x = scalar.aggregate("count", None, False, None, [])
            else:
                arg = evaluate.identity(a[2][0]) if a[1].lower() == "count" else None
                path = self.scope.get(a[2][0][1]) if a[2][0][0] == "var" else None
                if a[1].lower() == "count" and not a[3] and isinstance(path, Path):
                    arg = Typed(F.col(path.length), "int")
                x0 = Typed(arg.col, "int") if arg else evaluate(a[2][0])
                if isinstance(x0.t, tuple) and x0.t[0] == "null" or x0.t == "null":
                    x0 = Typed(x0.col.cast("bigint"), "int")
                x = scalar.aggregate(a[1], x0, a[3], evaluate(a[2][1]) if len(a[2]) > 1 else None, order_columns)
                if a[1].lower() == "collect" and not a[3] and not order_columns and not (isinstance(x0.t, tuple) and x0.t[0] == "map"):
                    x = Typed(F.sort_array(x.col), x.t)
            made.append(x.col.alias(c))
            named.append(c)
            results[a] = Typed(F.col(c), x.t)
        alone = not group and bool(made)
        group = list(dict.fromkeys([*self.carried, *group]))
        self.df = (df.groupBy(*group).agg(*made) if group else df.agg(*made)) if made else df.select(*group).distinct()
        if told:
            self.df = self.df.withColumns(told)
        if alone and self.carried:  # one row for each outer row, also where nothing was found
            mark = fresh("mark")
            right = self.df.select(*(F.col(k).alias(k + "_r") for k in self.carried), *(c.col for c in results.values()), F.lit(True).alias(mark))
            empty = {name: F.when(F.col(mark), x.col).otherwise(scalar.of_nothing(a[1] if a[0] == "call" else a[0], x.t)) for (a, x), name in zip(results.items(), named)}
            self.df = self.seed.join(right, null_safe(self.carried, "_r"), "left").withColumns(empty).drop(mark, *(k + "_r" for k in self.carried))
        extra |= results
        old, self.scope = self.scope, dict(scope)
        last = {}
        after = self.prepared(*(e for e, _, _ in items), extra=extra)
        for e, n, _ in items:
            if n not in scope:
                x = after(e)
                c = fresh(n)
                last[c] = x.col
                scope[n] = Value(c, x.t)
        if last:
            self.df = self.df.withColumns(last)
        self.sorted_by = []
        self.scope = {n: scope[n] for _, n, _ in items}
        scope = dict(self.scope)
        return extra, scope

    def collect_order(self) -> list:
        """Columns, and whether they descend, that put a group's rows in the order of the last ORDER BY."""
        return [(F.col(c), d) for c, d, _ in self.sorted_by if c in self.df.columns]

    def check_leaves(self, e, keys, extra) -> None:
        """Non-aggregated parts of an aggregating item must be grouping keys."""
        known = {k for k, _ in keys}

        def visit(x, bound=frozenset()) -> None:
            if not isinstance(x, tuple) or not x or x in known or isinstance(x[0], str) and is_aggregate(x):
                return
            if x[0] == "var" and isinstance(x[1], str) and x[1] not in bound:
                raise semantic("AmbiguousAggregationExpression", f"{x[1]} is neither aggregated nor a grouping key")
            if x[0] == "prop" and ("var", x[1][1] if x[1][0] == "var" else None) in known:
                return
            inner = bound | {x[1]} if x[0] in ("listcomp",) else bound | {x[2]} if x[0] == "quant" else bound
            for y in x[1:]:
                visit(y, inner)

        if has_aggregate(e):
            visit(e)

    # Calls.
    def on_call(self, name: str, args, yields, where) -> None:
        if name not in self.procedures:
            raise QueryError("ProcedureError", "ProcedureNotFound", f"no procedure {name}")
        outputs, f = self.procedures[name]
        if args is None:  # without parentheses: parameters of the query by the procedure's own names
            inputs = [p.name for p in list(inspect.signature(f).parameters.values())[1:] if p.kind is p.POSITIONAL_OR_KEYWORD and p.default is p.empty]
            if missing := [p for p in inputs if p not in self.params]:
                raise QueryError("ArgumentError", "MissingParameter", f"parameter ${missing[0]} is missing", "Runtime")
            args = [("param", p) for p in inputs]
        if any(map(has_aggregate, args)):
            raise semantic("InvalidAggregation", "an aggregate in CALL")
        keys: list[str] = []
        if all(a[0] in ("lit", "param") for a in args):
            found = f(self.graph, *(self.params[a[1]] if a[0] == "param" else a[1] for a in args))
        else:
            keys, found = self.call_each(name, f, outputs, args)
        self.trace.append(f"ProcedureCall({name})")
        if not outputs:
            self.rows()
            return
        chosen = [(c, c) for c in outputs] if not yields else yields
        for c, alias in chosen:
            if c not in outputs:
                raise semantic("UndefinedVariable", f"{name} yields no {c}")
            if alias in self.scope:
                raise semantic("VariableAlreadyBound", f"{alias} is bound already")
        made = {alias: fresh(alias) for _, alias in chosen}
        found = found.select(*(k + "_r" for k in keys), *(F.col(c).alias(made[alias]) for c, alias in chosen))
        kinds = {c: outputs[c] for c, _ in chosen}
        if keys:
            self.df = self.df.join(found, null_safe(keys, "_r")).drop(*keys, *(k + "_r" for k in keys))
        else:
            self.df = found if self.df is None else self.df.crossJoin(found)  # each row meets the call's whole result
        self.scope |= {alias: Node(made[alias], None, frozenset(), {}) if kinds[c] == "node" else Value(made[alias], kinds[c]) for c, alias in chosen}
        for alias, b in list(self.scope.items()):
            if isinstance(b, Node) and b.id in made.values() and not b.props:
                m = self.matcher(self.df, self.scope)
                df, node = m.select_nodes(None, (), self.used.get(alias, set()), alias, False)
                self.df = self.df.join(df, F.col(b.id) == F.col(node.id))
                score = next((made[a] for c, a in chosen if c == "score"), None)
                self.scope[alias] = Node(node.id, node.labels, node.static, node.props | ({"__score": (score, "float")} if score else {}))
        if where is not None:
            self.filter(where)

    def call_each(self, name: str, f, outputs: dict, args) -> tuple[list[str], DataFrame]:
        """Calls with arguments of the rows: one for each different set of them, and the columns (.._r) to join its rows by."""
        self.rows()
        evaluate = self.prepared(*args)
        columns = {fresh("argument"): evaluate(a) for a in args}
        self.df = self.df.withColumns({k: x.col for k, x in columns.items()})
        wanted = self.df.select(*columns).distinct().limit(MOST_CALLS + 1).collect()
        if len(wanted) > MOST_CALLS:
            raise QueryError("ProcedureError", "TooManyCalls", f"{name} would be called with more than {MOST_CALLS} different arguments", "Runtime")
        kinds = {k: spark_type(x.t) for k, x in columns.items()}
        out = self.spark.range(0).select(*(F.lit(None).cast("bigint" if t == "node" else spark_type(t)).alias(c) for c, t in outputs.items()), *(F.lit(None).cast(t).alias(k + "_r") for k, t in kinds.items()))
        for r in wanted:
            rows = f(self.graph, *r).select(*outputs, *(F.lit(r[k]).cast(t).alias(k + "_r") for k, t in kinds.items()))
            out = out.unionByName(rows)
        return list(columns), out

    # Updates.
    def on_create(self, patterns) -> None:
        self.wrote = True
        writes.create(self, patterns)

    def on_merge(self, path, on_create, on_match) -> None:
        self.wrote = True
        writes.merge(self, path, on_create, on_match)

    def on_set(self, items) -> None:
        self.wrote = True
        writes.set_items(self, items)

    def on_remove(self, items) -> None:
        self.wrote = True
        writes.remove(self, items)

    def on_delete(self, expressions, detach: bool) -> None:
        self.wrote = True
        writes.delete(self, expressions, detach)


def execute(spark: SparkSession, graph: Graph, statement: dict, params: dict, procedures: dict) -> tuple[DataFrame, list[str]]:
    """The rows of a parsed query, and the operators it is made of."""
    if statement["kind"] != "query":
        key = (statement["label"], tuple(statement["props"]), "btree")
        if statement["kind"] == "create_index":
            if key in graph.indexes:
                raise QueryError("ConstraintViolation", "IndexAlreadyExists", f"an index on :{key[0]}{key[1]} exists", "Runtime")
            graph.indexes.append(key)
        elif key not in graph.indexes:
            raise QueryError("EntityNotFound", "IndexNotFound", f"no index on :{key[0]}{key[1]}", "Runtime")
        else:
            graph.indexes.remove(key)
        return spark.range(0).select(), [statement["kind"]]
    out, trace, names = None, Trace(bool(statement["explain"])), None
    for part in statement["parts"]:
        q = Query(spark, graph, params, procedures, trace=trace)
        df = q.run(part)
        if out is not None:
            if df.columns != names:
                raise semantic("DifferentColumnsInUnion", f"{names} and {df.columns}")
            trace.append("Union")
            df = out.unionByName(df)
        out, names = df, df.columns
    if len(statement["parts"]) > 1 and not statement["all"]:
        out = out.distinct()
        trace.append("Distinct")
    return out, trace


fulltext_procedures = fulltext.procedures
