"""The user's entry: a session over a graph, with transactions as versioned snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.errors import QueryError
from quiltgraph.operators import fulltext
from quiltgraph.operators.query import execute
from quiltgraph.plans.parser import parse
from quiltgraph.sources.catalog import Graph

UPDATES = ("create", "merge", "set", "remove", "delete")


class GraphSession:
    """Runs queries on a graph. A query that updates works on a copy, which replaces the graph if it succeeds."""

    def __init__(self, spark: SparkSession, graph: Graph):
        self.spark, self.graph, self.procedures = spark, graph, fulltext.procedures()
        self._parsed: dict[str, dict] = {}

    def register_procedure(self, name: str, outputs: dict[str, str], f: Callable[..., DataFrame]) -> None:
        """``f(graph, *arguments)`` returns the outputs as columns."""
        self.procedures[name] = (outputs, f)

    def query(self, text: str, params: dict | None = None, **more) -> DataFrame:
        statement = self._parsed.get(text)
        if statement is None:
            if len(self._parsed) >= 128:
                self._parsed.clear()
            statement = self._parsed[text] = parse(text)
        self._check_params(text, statement, (params or {}) | more)
        updates = statement["kind"] != "query" or any(c[0] in UPDATES for p in statement["parts"] for c in p)
        if updates and not self._writable:
            raise QueryError("SemanticError", "ReadOnlyTransaction", "an update in a read transaction", "Runtime")
        graph = self.graph.copy() if updates else self.graph
        df, trace = execute(self.spark, graph, statement, (params or {}) | more, self.procedures)
        if statement["explain"]:
            return self.spark.createDataFrame([("\n".join("  " * k + line for k, line in enumerate(reversed(trace))),)], "plan string")
        self.graph = graph
        return df

    _writable = True

    @staticmethod
    def _check_params(text: str, statement: dict, params: dict) -> None:
        from quiltgraph.plans.parser import walk

        for x in walk(tuple(tuple(p) for p in statement.get("parts", ()))):
            if x and x[0] == "param" and isinstance(x[1], str) and x[1] not in params:
                raise QueryError("ArgumentError", "MissingParameter", f"parameter ${x[1]} is missing", "Runtime")

    def begin(self, write: bool = True) -> Transaction:
        return Transaction(self, write)

    # Indexes and batches, as calls.
    def create_index(self, label: str, *props: str, kind: str = "btree") -> None:
        """Records an index; kinds are btree, fulltext, fulltext_ci and fulltext_word. Plans don't depend on it."""
        if kind not in ("btree", "fulltext", "fulltext_ci", "fulltext_word"):
            raise QueryError("ArgumentError", "InvalidArgumentValue", f"no kind of index {kind}", "Runtime")
        if (label, props, kind) in self.graph.indexes:
            raise QueryError("ConstraintViolation", "IndexAlreadyExists", f"an index on :{label}{props} exists", "Runtime")
        self.graph.indexes = [*self.graph.indexes, (label, props, kind)]

    def drop_index(self, label: str, *props: str, kind: str = "btree") -> None:
        if (label, props, kind) not in self.graph.indexes:
            raise QueryError("EntityNotFound", "IndexNotFound", f"no index on :{label}{props}", "Runtime")
        self.graph.indexes = [i for i in self.graph.indexes if i != (label, props, kind)]

    def create_nodes(self, labels: list[str], df: DataFrame) -> DataFrame:
        """Adds a node for each row, its columns as properties; returns the rows with their ``_id``."""
        from quiltgraph.functions.types import from_spark, widened
        from quiltgraph.operators.writes import CREATED, numbered
        from quiltgraph.sources.catalog import SLOTS, NodeTable

        graph, kinds = self.graph.copy(), {f.name: f.dataType for f in df.schema.fields}
        rows, total = numbered(df.select(*(widened(F.col(c), k).alias(c) for c, k in kinds.items())), "_row")
        made = rows.select(((F.lit(graph.next_id) + F.col("_row")) * SLOTS + CREATED).alias("_id"), F.array(*(F.lit(x) for x in sorted(labels))).cast("array<string>").alias("_labels"), *kinds)
        graph.next_id += total
        name = f"batch{len(graph.nodes)}"
        graph.nodes.append(NodeTable(name, made, frozenset(labels), frozenset(labels), {c: from_spark(k) for c, k in kinds.items()}))
        self.graph = graph
        return made.drop("_labels")

    def create_edges(self, type_: str, df: DataFrame, src: str = "_src", dst: str = "_dst") -> None:
        """Adds an edge for each row between node ids; its other columns are properties."""
        from quiltgraph.functions.types import from_spark, widened
        from quiltgraph.operators.writes import CREATED, numbered
        from quiltgraph.sources.catalog import SLOTS, EdgeTable

        graph, kinds = self.graph.copy(), {f.name: f.dataType for f in df.schema.fields if f.name not in (src, dst)}
        rows, total = numbered(df.select(F.col(src).cast("bigint").alias("_src"), F.col(dst).cast("bigint").alias("_dst"), *(widened(F.col(c), k).alias(c) for c, k in kinds.items())), "_row")
        made = rows.select(((F.lit(graph.next_id) + F.col("_row")) * SLOTS + CREATED).alias("_id"), "_src", "_dst", *kinds)
        graph.next_id += total
        graph.edges.append(EdgeTable(type_, made, None, None, {c: from_spark(k) for c, k in kinds.items()}))
        self.graph = graph

    # Typed reads.
    def find_nodes(self, label: str) -> DataFrame:
        return self.graph.scan([label])[0]

    def get_node(self, node_id: int) -> DataFrame:
        return self.graph.with_id(node_id)[0]

    def get_edge(self, edge_id: int) -> DataFrame:
        return self.graph.edge_scan(self.graph.edges)[0].where(F.col("_id") == edge_id)

    def neighbors(self, node_id: int, type_: str | None = None, direction: str = "out") -> DataFrame:
        """(neighbor, edge) ids, a row for each edge; a loop counts once when undirected."""
        out = self.graph.edges_at(node_id, "_src", type_).select(F.col("_dst").alias("neighbor"), F.col("_id").alias("edge"))
        into = self.graph.edges_at(node_id, "_dst", type_).select(F.col("_src").alias("neighbor"), F.col("_id").alias("edge"))
        return {"out": out, "in": into, "both": out.unionByName(into.where(F.col("neighbor") != node_id))}[direction]

    def traverse(self, start: int, type_: str | None = None, max_depth: int = 50, direction: str = "out") -> DataFrame:
        """(node, depth) of every node reachable from ``start``, itself excluded, by the least depth."""
        from quiltgraph.operators.patterns import checkpointed

        edges = self.graph.edge_scan([t for t in self.graph.edges if type_ in (None, t.type)])[0].select("_src", "_dst")
        if direction != "out":
            back = edges.select(F.col("_dst").alias("_src"), F.col("_src").alias("_dst"))
            edges = back if direction == "in" else edges.unionByName(back)
        seen = self.spark.range(1).select(F.lit(start).cast("bigint").alias("node"), F.lit(0).alias("depth"))
        frontier = seen.select("node")
        for depth in range(1, max_depth + 1):
            step = edges.join(frontier, edges["_src"] == frontier["node"]).select(F.col("_dst").alias("node")).distinct()
            frontier = checkpointed(step.join(seen, "node", "left_anti"))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier.select("node", F.lit(depth).alias("depth")))
        return seen.where("depth > 0")


class Transaction(GraphSession):
    """Queries on a snapshot; ``commit`` makes it the session's graph, ``rollback`` forgets it."""

    def __init__(self, session: GraphSession, write: bool):
        if isinstance(session, Transaction):
            raise QueryError("SemanticError", "NestedTransaction", "a transaction in a transaction", "Runtime")
        super().__init__(session.spark, session.graph.copy())
        self._session, self._writable, self._open, self.procedures = session, write, True, session.procedures

    def query(self, text: str, params: dict | None = None, **more) -> DataFrame:
        if not self._open:
            raise QueryError("SemanticError", "TransactionClosed", "the transaction has ended", "Runtime")
        return super().query(text, params, **more)

    def commit(self) -> None:
        self._open = False
        if self._writable:
            self._session.graph = self.graph

    def rollback(self) -> None:
        self._open = False

    def begin(self, write: bool = True) -> Transaction:
        return Transaction(self, write)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self._open:
            self.commit() if kind is None else self.rollback()
