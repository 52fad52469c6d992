"""The graph catalog: DataFrames registered as node labels and edge types.

A node's id is its source's id times 64 plus the table's number, so sources with equal
keys don't collide. An edge's id is a 64-bit hash of its row unless one is given; equal
rows are edges of their own, told apart by a number among equals.
The catalog is a value: changes give new tables, and a copy is a snapshot.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltgraph.errors import QueryError
from quiltgraph.functions.types import from_spark, joined, widened

SLOTS = 64
ID_ROW = 16  # bytes that the optimizer gives a row of one id
UNKNOWN = 1 << 60  # what it says of data of which it knows nothing
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class NodeTable:
    """Rows (_id, _labels, properties). All carry ``always``; some may carry others of ``may``."""

    name: str
    df: DataFrame
    always: frozenset
    may: frozenset
    types: dict[str, object]
    by_key: Callable[[int], DataFrame] | None = None  # the same rows for one key, read through the source's own column
    key: str | None = None  # the property that is the key in _id, as long as by_key holds


@dataclass
class EdgeTable:
    """Rows (_id, _src, _dst, properties) of one type; the node tables at its ends, if known."""

    type: str
    df: DataFrame
    src: str | None
    dst: str | None
    types: dict[str, object]
    by_key: Callable[[str, int], DataFrame] | None = None  # the same rows for a key at an end (_src or _dst)


@dataclass
class Graph:
    spark: SparkSession
    nodes: list[NodeTable] = field(default_factory=list)
    edges: list[EdgeTable] = field(default_factory=list)
    indexes: list[tuple[str, tuple, str]] = field(default_factory=list)
    next_id: int = 0
    counts: dict[int, tuple] = field(default_factory=dict)
    work_cap: int | None = None  # steps of a pattern's trails, above which a query fails; each hop is then counted

    def copy(self) -> Graph:
        out = copy.copy(self)
        out.nodes, out.edges, out.indexes = list(self.nodes), list(self.edges), list(self.indexes)
        return out

    def rows_of(self, table) -> float:
        """About how many rows a table has, by the optimizer's statistics of its ids; only data without any is counted, once."""
        key = id(table.df)
        if key not in self.counts:
            stats = table.df.select("_id")._jdf.queryExecution().optimizedPlan().stats()
            known, size = stats.rowCount(), int(str(stats.sizeInBytes()))
            rows = float(str(known.get())) if known.isDefined() else size / ID_ROW if size < UNKNOWN else float(table.df.count())
            self.counts[key] = (table.df, max(1.0, rows))
        return self.counts[key][1]

    def table(self, name: str) -> NodeTable:
        found = [t for t in self.nodes if t.name == name]
        if not found:
            raise QueryError("EntityNotFound", "UnknownLabel", f"no node table {name}")
        return found[0]

    def global_id(self, name: str, key: Column, kind: T.DataType | None = None) -> Column:
        return self.as_id(key, kind, [t.name for t in self.nodes].index(name))

    @staticmethod
    def as_id(key: Column, kind: T.DataType | None, slot: int) -> Column:
        """A node's id by its key. Keys that are not whole numbers are hashed to 58 bits, which suits some hundred million nodes of a label; beyond, give whole numbers."""
        if kind is None or isinstance(kind, (*WHOLE, T.DecimalType)):
            return key.cast("bigint") * SLOTS + slot
        return F.when(key.isNotNull(), F.xxhash64(key).bitwiseAND(F.lit(-SLOTS)) + slot)

    @staticmethod
    def key_of(node_id: Column) -> Column:
        """The whole number that :meth:`as_id` made an id of."""
        return F.shiftright(node_id, SLOTS.bit_length() - 1)

    def id_of(self, name: str, key: int) -> int:
        return key * SLOTS + [t.name for t in self.nodes].index(name)

    def with_id(self, node_id: int) -> tuple[DataFrame, dict[str, object]]:
        """The nodes with an id, from the one table that can hold them; a registered one is filtered by its own key, so that files are pruned."""
        slot = node_id % SLOTS
        tables = [t for k, t in enumerate(self.nodes) if (t.by_key is None or k == slot)]
        narrowed = [replace(t, df=t.by_key(node_id // SLOTS) if t.by_key else t.df) for t in tables]
        found, types = self.scan(tables=narrowed)
        return found.where(F.col("_id") == node_id), types

    def edges_at(self, node_id: int, end: str, type_: str | None = None) -> DataFrame:
        """The edges whose ``end`` (_src or _dst) is a node, from tables that can hold them, by the source's own key."""
        slot, out = node_id % SLOTS, []
        names = [t.name for t in self.nodes]
        for t in self.edges:
            owner = t.src if end == "_src" else t.dst
            if type_ in (None, t.type) and (t.by_key is None or names.index(owner) == slot):
                out.append(replace(t, df=t.by_key(end, node_id // SLOTS) if t.by_key else t.df))
        return self.edge_scan(out)[0].where(F.col(end) == node_id)

    def node(self, label: str, df: DataFrame, id_col: str, props: dict[str, str], extra: dict[str, Column] | None = None) -> Graph:
        """Registers ``df``: property names to its columns; ``extra`` labels hold where their conditions do."""
        if len(self.nodes) >= SLOTS - 1:
            raise ValueError(f"at most {SLOTS - 1} node tables")
        labels = F.array(F.lit(label))
        for name, condition in (extra or {}).items():
            labels = F.when(condition, F.array_append(labels, F.lit(name))).otherwise(labels)
        kinds = {f.name: f.dataType for f in df.schema.fields}
        columns = [self.as_id(F.col(id_col), kinds[id_col], len(self.nodes)).alias("_id"), F.array_sort(labels).alias("_labels"), *(widened(F.col(c), kinds[c]).alias(p) for p, c in props.items())]
        by_key = (lambda key: df.where(F.col(id_col) == key).select(*columns)) if isinstance(kinds[id_col], WHOLE) else None
        self.nodes.append(NodeTable(label, df.select(*columns), frozenset([label]), frozenset([label, *(extra or {})]), {p: from_spark(kinds[c]) for p, c in props.items()}, by_key, next((p for p, c in props.items() if c == id_col), None)))
        return self

    def edge(self, type_: str, df: DataFrame, src: tuple[str, str], dst: tuple[str, str], props: dict[str, str] | None = None, edge_id: str | None = None, distinct_rows: bool = False) -> Graph:
        """Registers ``df`` as edges between keys (label, column) of two node tables, which must hold these keys.

        Without ``edge_id``, a column that tells edges apart, equal rows are numbered, which
        costs a shuffle in queries that read the edges' ids; ``distinct_rows`` says that there are none.
        """
        kinds = {f.name: f.dataType for f in df.schema.fields}
        if edge_id:
            key = F.col(edge_id).cast("bigint")
        else:
            names, twin = list(df.columns), []
            if not distinct_rows:  # a column before the ids are made, so that conditions on the ends go below the shuffle
                twin = [f"_twin{len(self.edges)}"]
                df = df.withColumn(twin[0], F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(1))))
            key = F.xxhash64(F.lit(len(self.edges)), *names, *twin)
        ends = [self.global_id(label, F.col(c), kinds[c]) for label, c in (src, dst)]
        columns = [key.alias("_id"), ends[0].alias("_src"), ends[1].alias("_dst"), *(widened(F.col(c), kinds[c]).alias(p) for p, c in (props or {}).items())]
        by_key = (lambda end, k: df.where(F.col(src[1] if end == "_src" else dst[1]) == k).select(*columns)) if all(isinstance(kinds[c], WHOLE) for _, c in (src, dst)) else None
        self.edges.append(EdgeTable(type_, df.select(*columns), src[0], dst[0], {p: from_spark(kinds[c]) for p, c in (props or {}).items()}, by_key))
        return self

    # Reading.
    @staticmethod
    def merged_types(tables) -> dict[str, object]:
        """Property types over tables; conflicting ones are read as text."""
        out: dict[str, object] = {}
        for t in tables:
            for p, k in t.types.items():
                out[p] = joined(out[p], k) if p in out else k
                if out[p] == "any":
                    out[p] = "str"
        return out

    def node_tables(self, labels=()) -> list[NodeTable]:
        return [t for t in self.nodes if set(labels) <= t.may]

    def scan(self, labels=(), tables: list[NodeTable] | None = None) -> tuple[DataFrame, dict[str, object]]:
        """Nodes with all ``labels``: (_id, _labels, properties of any table that may have them)."""
        tables = self.node_tables(labels) if tables is None else tables
        types = self.merged_types(tables)
        return self._union(tables, ["_id", "_labels"], types, lambda t: [F.array_contains("_labels", x) for x in labels if x not in t.always]), types

    def edge_scan(self, tables: list[EdgeTable]) -> tuple[DataFrame, dict[str, object]]:
        """(_id, _src, _dst, _type, properties)."""
        types = self.merged_types(tables)
        typed = [EdgeTable(t.type, t.df.withColumn("_type", F.lit(t.type)), t.src, t.dst, t.types) for t in tables]
        return self._union(typed, ["_id", "_src", "_dst", "_type"], types, lambda t: []), types

    def _union(self, tables, fixed: list[str], types: dict[str, object], conditions) -> DataFrame:
        out = None
        for t in tables:
            df = t.df
            for c in conditions(t):
                df = df.where(c)
            df = df.select(*fixed, *(self._as(F.col(p), t.types[p], k).alias(p) if p in t.types else F.lit(None).cast(spark_type(k)).alias(p) for p, k in types.items()))
            out = df if out is None else out.unionByName(df)
        if out is None:
            kinds = {"_id": "bigint", "_src": "bigint", "_dst": "bigint", "_labels": "array<string>", "_type": "string"}
            out = self.spark.range(0).select(*(F.lit(None).cast(kinds[c]).alias(c) for c in fixed), *(F.lit(None).cast(spark_type(k)).alias(p) for p, k in types.items()))
        return out

    @staticmethod
    def _as(column: Column, have, want) -> Column:
        return column if have == want else column.cast(spark_type(want))

    # Snapshots.
    def snapshot_to(self, path: str) -> None:
        """A consistent copy as Parquet, with the catalog as JSON; refuses a folder that exists."""
        for kind, tables in (("nodes", self.nodes), ("edges", self.edges)):
            for k, t in enumerate(tables):
                t.df.write.mode("error").parquet(f"{path}/{kind}/{k}")
        about = {
            "nodes": [{"name": t.name, "always": sorted(t.always), "may": sorted(t.may), "types": t.types} for t in self.nodes],
            "edges": [{"type": t.type, "src": t.src, "dst": t.dst, "types": t.types} for t in self.edges],
            "indexes": self.indexes,
            "next_id": self.next_id,
        }
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("error").text(f"{path}/catalog")

    @classmethod
    def read_snapshot(cls, spark: SparkSession, path: str) -> Graph:
        """The graph that :meth:`snapshot_to` wrote to a folder."""
        about = json.loads(spark.read.text(f"{path}/catalog").head().value)
        tupled = lambda t: tuple(map(tupled, t)) if isinstance(t, list) else t
        types = lambda t: {p: tupled(k) for p, k in t["types"].items()}
        read = lambda kind, k: spark.read.parquet(f"{path}/{kind}/{k}")
        nodes = [NodeTable(t["name"], read("nodes", k), frozenset(t["always"]), frozenset(t["may"]), types(t)) for k, t in enumerate(about["nodes"])]
        edges = [EdgeTable(t["type"], read("edges", k), t["src"], t["dst"], types(t)) for k, t in enumerate(about["edges"])]
        return cls(spark, nodes, edges, [tupled(i) for i in about["indexes"]], about["next_id"])


def spark_type(t) -> T.DataType:
    from quiltgraph.functions.types import DATETIME, DURATION, TIME

    simple = {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType(), "any": T.StringType(), "bool": T.BooleanType(), "date": T.DateType(), "ldt": T.TimestampNTZType(), "ltime": T.LongType(), "dt": DATETIME, "dur": DURATION, "time": TIME, "null": T.NullType()}
    if not isinstance(t, tuple):
        return simple[t]
    if t[0] == "list":
        return T.ArrayType(spark_type(t[1]))
    fixed = {"node": [("_id", T.LongType()), ("_labels", T.ArrayType(T.StringType()))], "rel": [("_id", T.LongType()), ("_src", T.LongType()), ("_dst", T.LongType()), ("_type", T.StringType())], "map": []}[t[0]]
    return T.StructType([T.StructField(n, k) for n, k in fixed] + [T.StructField(n, spark_type(k)) for n, k in t[1]])
