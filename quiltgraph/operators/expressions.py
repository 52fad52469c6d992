"""Expressions of the syntax tree as typed Columns over a scope."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from quiltgraph.errors import QueryError, mistyped, nearest, semantic
from quiltgraph.functions import scalar, temporal
from quiltgraph.functions.types import Typed, all_of, is_list, joined, null
from quiltgraph.operators.scope import Node, Path, Rel, Scope, Value


def literal(v) -> Typed:
    if v is None:
        return null()
    if isinstance(v, bool):
        return Typed(F.lit(v), "bool")
    if isinstance(v, int):
        if not -(1 << 63) <= v < 1 << 63:
            raise semantic("IntegerOverflow", f"{v} doesn't fit 64 bits")
        return Typed(F.lit(v).cast("bigint"), "int")
    if isinstance(v, float):
        return Typed(F.lit(v), "float")
    if isinstance(v, str):
        return Typed(F.lit(v), "str")
    if isinstance(v, (list, tuple)):
        return make_list([literal(x) for x in v])
    if isinstance(v, dict):
        return make_map({k: literal(x) for k, x in v.items()})
    return Typed(F.lit(v), "any")


def make_list(items: list[Typed]) -> Typed:
    t: object = "null"
    for x in items:
        t = joined(t, x.t)
    if t == "any" and all(x.t != "any" for x in items):
        raise mistyped("a list of mixed types has no column type")
    if not items:
        return Typed(F.array(), ("list", "null"))
    return Typed(F.array(*(scalar.cast(x, t).col for x in items)), ("list", t))


def make_map(items: dict[str, Typed]) -> Typed:
    if not items:
        return Typed(F.struct(F.lit(None).cast("string").alias("_empty")), ("map", (("_empty", "str"),)))
    return Typed(F.struct(*(x.col.alias(k) for k, x in items.items())), ("map", tuple((k, x.t) for k, x in items.items())))


def is_aggregate(e) -> bool:
    return e[0] == "count*" or e[0] == "call" and e[1].lower() in scalar.AGGREGATES


SUBQUERIES = ("pattern", "exists", "existsq", "patcomp")


def aggregates_of(e) -> Iterator[tuple]:
    """The aggregates of an expression's own rows; what subqueries aggregate is their affair."""
    if not isinstance(e, (tuple, list)):
        return
    if e and isinstance(e[0], str):
        if e[0] in SUBQUERIES:
            return
        if e[0] in ("count*", "call") and is_aggregate(e):
            yield e
    for x in e:
        yield from aggregates_of(x)


def has_aggregate(e) -> bool:
    return next(aggregates_of(e), None) is not None


class Expressions:
    """``extra`` gives columns for whole subexpressions that were computed before (subqueries, aggregates, keys)."""

    def __init__(self, scope: Scope, params: dict, extra: dict | None = None, local: dict[str, Typed] | None = None):
        self.scope, self.params, self.extra, self.local = scope, params, extra or {}, local or {}

    def within(self, name: str, x: Typed) -> Expressions:
        return Expressions(self.scope, self.params, self.extra, self.local | {name: x})

    def __call__(self, e) -> Typed:
        if e in self.extra:
            return self.extra[e]
        return getattr(self, f"on_{e[0].replace('*', '_star')}")(e)

    def boolean(self, e) -> Typed:
        x = self(e)
        if x.t not in ("bool", "null", "any"):
            raise mistyped(f"a boolean is needed, not {x.t}")
        return Typed(x.col.cast("boolean"), "bool")

    def binding(self, name: str):
        if name not in self.scope:
            raise semantic("UndefinedVariable", f"variable {name} is not defined", nearest(name, [*self.scope, *self.local]))
        return self.scope[name]

    def on_lit(self, e) -> Typed:
        return literal(e[1])

    def on_param(self, e) -> Typed:
        if e[1] not in self.params:
            raise QueryError("ArgumentError", "MissingParameter", f"parameter ${e[1]} is missing", "Runtime")
        return literal(self.params[e[1]])

    def on_var(self, e) -> Typed:
        if e[1] in self.local:
            return self.local[e[1]]
        b = self.binding(e[1])
        return b.typed() if isinstance(b, Value) else b.struct()

    def on_prop(self, e) -> Typed:
        if e[1][0] == "var" and e[1][1] not in self.local and e[1] not in self.extra:
            b = self.binding(e[1][1])
            if isinstance(b, (Node, Rel)):
                if e[2] not in b.props:
                    return null()
                column, t = b.props[e[2]]
                return Typed(F.col(column), t)
            if isinstance(b, Path):
                raise mistyped("a path has no properties")
        return self.part(self(e[1]), e[2])

    @staticmethod
    def part(x: Typed, key: str) -> Typed:
        if x.t == "null":
            return null()
        if temporal.is_temporal(x.t):
            return temporal.accessor(x, key)
        if isinstance(x.t, tuple) and x.t[0] != "list":
            kinds = dict(x.t[1])
            return Typed(x.col[key], kinds[key]) if key in kinds else null()
        raise mistyped(f"{x.t} has no properties")

    def on_index(self, e) -> Typed:
        x = self(e[1])
        if x.t == "null":
            return null()
        if not is_list(x.t):
            key = self.params.get(e[2][1]) if e[2][0] == "param" else e[2][1] if e[2][0] == "lit" else None
            if not isinstance(key, str):
                raise mistyped("a map is read by a constant string", "MapElementAccessByNonString")
            return self.on_prop(("prop", e[1], key))
        i = self(e[2])
        if i.t not in ("int", "null", "any"):
            raise mistyped("a list is read by an integer")
        return null() if i.t == "null" else scalar.element(x, i)

    def on_slice(self, e) -> Typed:
        x = self(e[1])
        if x.t == "null":
            return null()
        low = self(e[2]).col if e[2] else F.lit(0)
        high = self(e[3]).col if e[3] else F.size(x.col)
        return Typed(scalar.sliced(x.col, low.cast("bigint"), high.cast("bigint")), x.t)

    def on_list(self, e) -> Typed:
        return make_list([self(x) for x in e[1]])

    def on_map(self, e) -> Typed:
        return make_map({k: self(x) for k, x in e[1]})

    def on_not(self, e) -> Typed:
        return Typed(~self.boolean(e[1]).col, "bool")

    def on_neg(self, e) -> Typed:
        x = self(e[1])
        if x.t == "dur":
            return temporal.duration(*(-x.col[p] for p in ("months", "days", "seconds", "nanos")))
        return Typed(-x.col, x.t)

    def on_isnull(self, e) -> Typed:
        if e[1][0] == "var" and e[1][1] not in self.local and isinstance(b := self.binding(e[1][1]), (Node, Rel, Path)):
            c = F.col(b.columns()[0])
        else:
            c = self(e[1]).col
        return Typed(c.isNotNull() if e[2] else c.isNull(), "bool")

    def on_bin(self, e) -> Typed:
        op = e[1]
        if op in ("AND", "OR", "XOR"):
            a, b = self.boolean(e[2]).col, self.boolean(e[3]).col
            return Typed(a & b if op == "AND" else a | b if op == "OR" else a != b, "bool")
        if op == "IN":
            return Typed(scalar.member(self(e[2]), self(e[3])), "bool")
        if op in ("STARTS", "ENDS", "CONTAINS", "=~"):
            return Typed(scalar.text_predicate(op, self(e[2]), self(e[3])), "bool")
        return scalar.arithmetic(op, self(e[2]), self(e[3]))

    def identity(self, e) -> Typed | None:
        """A node's or relationship's id, if that is what ``e`` names."""
        if e[0] == "var" and e[1] not in self.local and isinstance(b := self.scope.get(e[1]), (Node, Rel)):
            return Typed(F.col(b.id), "node" if isinstance(b, Node) else "rel")
        return None

    def on_cmp(self, e) -> Typed:
        verdicts, left = [], e[1]
        for op, right in e[2]:
            a, b = self.identity(left), self.identity(right)
            if a and b and op in ("=", "<>"):
                same = a.col == b.col if a.t == b.t else F.lit(False)
                verdicts.append(same if op == "=" else ~same)
            else:
                verdicts.append(scalar.compare(op, self(left), self(right)))
            left = right
        return Typed(all_of(*verdicts), "bool")

    def on_labels(self, e) -> Typed:
        if e[1][0] == "var" and isinstance(b := self.scope.get(e[1][1]), Rel):
            return Typed(all_of(*(F.col(b.type) == x for x in e[2])), "bool")
        held = self.call_labels(e[1])
        return Typed(all_of(*(F.array_contains(held.col, x) for x in e[2])), "bool")

    def call_labels(self, e) -> Typed:
        if e[0] == "var" and isinstance(b := self.scope.get(e[1]), Node):
            if b.labels:
                return Typed(F.col(b.labels), ("list", "str"))
            return Typed(F.when(F.col(b.id).isNotNull(), F.array(*(F.lit(x) for x in sorted(b.static)))), ("list", "str"))
        x = self(e)
        if x.t == "null":
            return null()
        if not (isinstance(x.t, tuple) and x.t[0] == "node"):
            raise mistyped("labels needs a node")
        return Typed(x.col["_labels"], ("list", "str"))

    def on_case(self, e) -> Typed:
        tests = [(scalar.equal(self(e[1]), self(w)) if e[1] else self.boolean(w).col, self(t)) for w, t in e[2]]
        other = self(e[3]) if e[3] else null()
        t = other.t
        for _, x in tests:
            t = joined(t, x.t)
        out = F
        for test, x in tests:
            out = out.when(test, scalar.cast(x, t).col)
        return Typed(out.otherwise(scalar.cast(other, t).col), t)

    def items(self, e) -> Typed:
        x = self(e)
        if x.t != "null" and not is_list(x.t):
            raise mistyped("a list is needed")
        return x

    def on_listcomp(self, e) -> Typed:
        _, name, source, where, out = e
        if has_aggregate(where) or has_aggregate(out):
            raise semantic("InvalidAggregation", "an aggregate in a list comprehension")
        x = self.items(source)
        if x.t == "null":
            return null()
        c, kind = x.col, x.t[1]
        if where is not None:
            c = F.filter(c, lambda y: self.within(name, Typed(y, kind)).boolean(where).col)
        if out is None:
            return Typed(c, x.t)
        found: list[object] = []

        def mapped(y):
            got = self.within(name, Typed(y, kind))(out)
            found.append(got.t)
            return got.col

        c = F.transform(c, mapped)
        return Typed(c, ("list", found[0]))

    def on_quant(self, e) -> Typed:
        _, kind, name, source, where = e
        x = self.items(source)
        if x.t == "null":
            return Typed(F.lit(None).cast("boolean"), "bool")
        test = lambda y: self.within(name, Typed(y, x.t[1])).boolean(where).col
        if kind == "any":
            return Typed(F.exists(x.col, test), "bool")
        if kind == "all":
            return Typed(F.forall(x.col, test), "bool")
        if kind == "none":
            return Typed(~F.exists(x.col, test), "bool")
        verdicts = F.transform(x.col, test)
        true = F.size(F.filter(verdicts, lambda v: v))
        unknown = F.size(F.filter(verdicts, lambda v: v.isNull()))
        return Typed(F.when(x.col.isNull(), None).when(true > 1, False).when(unknown > 0, None).otherwise(true == 1), "bool")

    def on_call(self, e) -> Typed:
        _, name, args, _ = e
        low = name.lower()
        if low in scalar.AGGREGATES:
            raise semantic("InvalidAggregation", f"{name} isn't allowed here")
        if low in scalar.GRAPH_FUNCTIONS:
            if len(args) != 1:
                raise semantic("InvalidNumberOfArguments", f"{name} takes 1 argument")
            return self.graph_call(low, args[0])
        values = []
        for a in args:
            if low == "exists" and (i := self.identity(a)):
                values.append(i)
            else:
                values.append(self(a))
        return scalar.call(name, values)

    def graph_call(self, low: str, e) -> Typed:
        b = self.scope.get(e[1]) if e[0] == "var" and e[1] not in self.local else None
        if low == "labels":
            return self.call_labels(e)
        if low == "score":
            if not isinstance(b, Node):
                raise semantic("InvalidArgumentType", "score needs a node variable")
            return Typed(F.col(b.props["__score"][0]), "float") if "__score" in b.props else Typed(F.lit(None).cast("double"), "float")
        if low == "id" and isinstance(b, (Node, Rel)):
            return Typed(F.col(b.id), "int")
        if low == "type" and isinstance(b, Rel):
            return Typed(F.col(b.type), "str")
        if isinstance(b, Path):
            if low == "length":
                return Typed(F.col(b.length), "int")
            if low == "nodes":
                return Typed(F.col(b.nodes), ("list", ("node", b.node_type)))
            if low == "relationships":
                return Typed(F.col(b.rels), ("list", ("rel", b.rel_type)))
        x = self(e)
        if x.t == "null":
            return null()
        if low == "length":
            return scalar.size(x)
        field = {"id": "_id", "type": "_type"}.get(low)
        if field and isinstance(x.t, tuple) and x.t[0] in ("node", "rel"):
            return Typed(x.col[field], "int" if low == "id" else "str")
        raise mistyped(f"{low} of {x.t}")

    def refuse(self, e) -> Typed:
        raise semantic("UnexpectedSyntax", "a pattern or subquery isn't allowed here")

    on_pattern = on_patcomp = on_exists = on_existsq = refuse

    def on_count_star(self, e) -> Typed:
        raise semantic("InvalidAggregation", "count(*) isn't allowed here")
