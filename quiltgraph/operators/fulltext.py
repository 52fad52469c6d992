"""Ranked full-text search, and the built-in procedures.

Postings are term frequencies by document, from exploded lower-case word tokens; BM25
(k1 = 1.2, b = 0.75) is a sum over the query's terms. Queries combine words, "phrases",
prefix*, AND, OR and NOT; juxtaposed terms are joined by AND.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.errors import QueryError
from quiltgraph.functions.temporal import let
from quiltgraph.functions.types import all_of
from quiltgraph.operators.patterns import checkpointed
from quiltgraph.sources.catalog import Graph

K1, B = 1.2, 0.75
TOKENS = r"[^\p{L}\p{N}]+"


def parse_query(text: str) -> tuple:
    """("term", w) ("prefix", w) ("phrase", words) ("and"|"or"|"not", a, b)."""
    tokens = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', text)
    at = 0

    def atom():
        nonlocal at
        if at >= len(tokens):
            raise QueryError("ArgumentError", "InvalidArgumentValue", f"bad search {text!r}", "Runtime")
        t = tokens[at]
        at += 1
        if t == "(":
            out = either()
            at += 1
            return out
        if t[0] == '"':
            return ("phrase", tuple(w for w in re.split(r"[\W_]+", t.lower()) if w))
        if t.endswith("*"):
            return ("prefix", t[:-1].lower())
        return ("phrase", tuple(w for w in re.split(r"[\W_]+", t.lower()) if w))

    def both():
        nonlocal at
        out = atom()
        while at < len(tokens) and tokens[at] not in ("OR", ")"):
            kind = "not" if tokens[at] == "NOT" else "and"
            at += tokens[at] in ("AND", "NOT")
            out = (kind, out, atom())
        return out

    def either():
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == "OR":
            at += 1
            out = ("or", out, both())
        return out

    return either()


def search(graph: Graph, label: str, prop: str, query: str) -> DataFrame:
    """(node, score) of the nodes of a label whose property matches; higher scores are better."""
    df, types = graph.scan([label])
    props = [p for p, t in types.items() if t == "str"] if prop == "*" else [prop]
    if any(types.get(p) != "str" for p in props):
        raise QueryError("ProcedureError", "IndexNotFound", f"no text property {prop} of :{label}", "Runtime")
    text = F.concat_ws(" ", *props)
    words = F.filter(F.split(F.lower(text), TOKENS), lambda w: w != "")
    tree = parse_query(query)
    leaves: list[tuple] = []

    def hits(t, w):
        """How often a leaf occurs among the words ``w``."""
        if t[0] == "prefix":
            return F.size(F.filter(w, lambda x: x.startswith(t[1])))
        n = len(t[1])
        if n == 1:
            return F.size(F.filter(w, lambda x: x == t[1][0]))
        at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        same = lambda i: all_of(*(F.get(w, i + k) == t[1][k] for k in range(n)))
        return F.size(F.filter(at, same))

    def collect(t):
        if t[0] in ("and", "or", "not"):
            collect(t[1])
            collect(t[2])
        elif t not in leaves:
            leaves.append(t)

    collect(tree)

    def test(t):
        if t[0] == "and":
            return test(t[1]) & test(t[2])
        if t[0] == "or":
            return test(t[1]) | test(t[2])
        if t[0] == "not":
            return test(t[1]) & ~test(t[2])
        return F.col(f"m.tf{leaves.index(t)}") > 0

    # The words are split once for each node, however many leaves count in them.
    measure = lambda w: F.struct(F.size(w).alias("length"), *(hits(t, w).alias(f"tf{k}") for k, t in enumerate(leaves)))
    docs = df.where(F.coalesce(*props).isNotNull()).select("_id", let([words], measure).alias("m"))
    positive = [k for k, t in enumerate(leaves) if not _only_negated(tree, t)]
    counted = docs.select("_id", F.col("m.length").alias("length"), test(tree).alias("hit"), *(F.col(f"m.tf{k}").alias(f"tf{k}") for k in positive))
    counted = checkpointed(counted)  # numbers only: the texts are split once, for the totals and the rows
    totals = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in positive))
    rows = counted.where("hit").crossJoin(F.broadcast(totals))  # one row of totals
    score = F.lit(0.0)
    for k in positive:
        tf, df_ = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.greatest(F.ln((F.col("n") - df_ + 0.5) / (df_ + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.select(F.col("_id").alias("node"), score.alias("score"))


def substring_score(text: F.Column, term: str, table: DataFrame, prop: str) -> tuple[DataFrame, F.Column]:
    """One row of totals to join, and the BM25 score of texts that hold ``term``, a phrase of trigrams, among a table's.

    A text is as long as it has trigrams; a term of less than three characters scores 0.
    """
    if len(term) < 3:
        return table.sparkSession.range(1).select(F.lit(1).alias("fts_n")), F.lit(0.0)
    pattern = F.lit("(?=\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E)")  # also where occurrences overlap
    length = lambda c: F.greatest(F.length(c) - 2, F.lit(0))
    totals = table.where(F.col(prop).isNotNull()).agg(F.count(F.lit(1)).alias("fts_n"), F.avg(length(F.col(prop))).alias("fts_mean"), F.count_if(F.col(prop).contains(term)).alias("fts_df"))
    n, df_ = F.col("fts_n"), F.col("fts_df")
    idf = F.greatest(F.ln((n - df_ + 0.5) / (df_ + 0.5)), F.lit(1e-6))
    tf = F.regexp_count(text, pattern)
    return totals, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length(text) / F.col("fts_mean")))


def _only_negated(tree, leaf, negated=False) -> bool:
    """Whether a leaf stands only under NOT."""
    if tree == leaf:
        return negated
    if tree[0] in ("and", "or"):
        return all(_only_negated(t, leaf, negated) for t in tree[1:] if _holds(t, leaf))
    if tree[0] == "not":
        parts = [_only_negated(tree[1], leaf, negated)] if _holds(tree[1], leaf) else []
        return all(parts + ([True] if _holds(tree[2], leaf) else []))
    return True


def _holds(tree, leaf) -> bool:
    return tree == leaf or tree[0] in ("and", "or", "not") and any(_holds(t, leaf) for t in tree[1:])


def counts(graph: Graph) -> DataFrame:
    """(kind, name, count) of labels and edge types."""
    out = graph.spark.range(0).select(F.lit("").alias("kind"), F.lit("").alias("name"), F.lit(0).cast("bigint").alias("count"))
    for t in graph.nodes:
        out = out.unionByName(t.df.select(F.explode("_labels").alias("name")).groupBy("name").count().select(F.lit("label").alias("kind"), "name", "count"))
    for e in graph.edges:
        out = out.unionByName(e.df.agg(F.count(F.lit(1)).alias("count")).select(F.lit("type").alias("kind"), F.lit(e.type).alias("name"), "count"))
    return out.groupBy("kind", "name").agg(F.sum("count").alias("count"))


def indexes(graph: Graph) -> DataFrame:
    """(label, property, kind), a row for each property that an index covers."""
    rows = [(label, p, kind) for label, props, kind in graph.indexes for p in props]
    return graph.spark.createDataFrame(rows, "label string, property string, kind string")


def procedures() -> dict:
    """name: ({output: type}, function of the graph and the arguments)."""
    return {
        "db.counts": ({"kind": "str", "name": "str", "count": "int"}, counts),
        "db.indexes": ({"label": "str", "property": "str", "kind": "str"}, indexes),
        "fts.search": ({"node": "node", "score": "float"}, search),
    }
