"""What a variable stands for in a row: names of the DataFrame's columns, and their types."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiltgraph.functions.types import Typed

_COUNTER = itertools.count()


def fresh(hint: str = "c") -> str:
    """A column name that no other has."""
    return f"{re.sub(r'[^A-Za-z0-9_]+', '_', hint)[:40]}__{next(_COUNTER)}"


@dataclass(frozen=True)
class Node:
    id: str
    labels: str | None = None
    static: frozenset = frozenset()
    props: dict = field(default_factory=dict)  # name -> (column, type)
    told: frozenset = frozenset()  # columns of properties that are the key in the id

    def columns(self) -> list[str]:
        return [self.id, *([self.labels] if self.labels else []), *(c for c, _ in self.props.values())]

    def struct(self, like=None) -> Typed:
        """As a value; ``like`` lists the (name, type) pairs to have."""
        from quiltgraph.sources.catalog import spark_type

        kinds = tuple((p, t) for p, (_, t) in self.props.items()) if like is None else like
        labels = F.col(self.labels) if self.labels else F.array(*(F.lit(x) for x in sorted(self.static))).cast("array<string>")
        parts = [F.col(self.props[p][0]).cast(spark_type(t)).alias(p) if p in self.props else F.lit(None).cast(spark_type(t)).alias(p) for p, t in kinds]
        whole = F.struct(F.col(self.id).alias("_id"), labels.alias("_labels"), *parts)
        return Typed(F.when(F.col(self.id).isNotNull(), whole), ("node", kinds))


@dataclass(frozen=True)
class Rel:
    id: str
    src: str
    dst: str
    type: str
    props: dict = field(default_factory=dict)

    def columns(self) -> list[str]:
        return [self.id, self.src, self.dst, self.type, *(c for c, _ in self.props.values())]

    def struct(self, like=None) -> Typed:
        from quiltgraph.sources.catalog import spark_type

        kinds = tuple((p, t) for p, (_, t) in self.props.items()) if like is None else like
        parts = [F.col(self.props[p][0]).cast(spark_type(t)).alias(p) if p in self.props else F.lit(None).cast(spark_type(t)).alias(p) for p, t in kinds]
        whole = F.struct(F.col(self.id).alias("_id"), F.col(self.src).alias("_src"), F.col(self.dst).alias("_dst"), F.col(self.type).alias("_type"), *parts)
        return Typed(F.when(F.col(self.id).isNotNull(), whole), ("rel", kinds))


@dataclass(frozen=True)
class Value:
    column: str
    type: object

    def columns(self) -> list[str]:
        return [self.column]

    def typed(self) -> Typed:
        return Typed(F.col(self.column), self.type)


@dataclass(frozen=True)
class Path:
    """Hops, and where they are wanted the nodes and relationships, as columns."""

    length: str
    nodes: str | None = None
    rels: str | None = None
    node_type: tuple = ()
    rel_type: tuple = ()

    def columns(self) -> list[str]:
        return [c for c in (self.length, self.nodes, self.rels) if c]

    def struct(self) -> Typed:
        whole = F.struct(F.col(self.nodes).alias("nodes"), F.col(self.rels).alias("relationships"))
        kinds = (("nodes", ("list", ("node", self.node_type))), ("relationships", ("list", ("rel", self.rel_type))))
        return Typed(F.when(F.col(self.length).isNotNull(), whole), ("map", kinds))


Binding = Node | Rel | Value | Path
Scope = dict[str, Binding]


def null_safe(columns: list[str], suffix: str) -> Column:
    """Equality of key columns, nulls being equal, with copies named by ``suffix``."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(c + suffix))
    return out
