"""What plans leave out: tables that ids make needless, columns that subqueries don't read, rows that conditions on keys exclude."""

from __future__ import annotations

import pytest

from quiltgraph import queries
from quiltgraph.session import GraphSession
from quiltgraph.sources.catalog import Graph

FOLDER = "/root/testdata/sf0.001"


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def quay(spark) -> GraphSession:
    """Two berths, -3 and 4, and the ships that lie there; one ship's berth isn't known."""
    g = Graph(spark)
    g.node("Berth", spark.createDataFrame([(-3, "north"), (4, "south")], "no int, name string"), "no", {"no": "no", "name": "name"})
    g.node("Ship", spark.createDataFrame([(1,), (2,), (3,)], "k long"), "k", {"k": "k"})
    g.edge("LIES_AT", spark.createDataFrame([(1, -3), (1, -3), (2, 4), (3, None)], "k long, no int"), ("Ship", "k"), ("Berth", "no"))
    return GraphSession(spark, g)


# F1
def test_a_key_is_read_from_the_id(spark):
    assert "Join" not in optimized(queries.queries()["parallel_edges"](spark, FOLDER))
    s = quay(spark)
    pairs = s.query("MATCH (s:Ship)-[r:LIES_AT]->(b:Berth) WITH s, b, count(r) AS n RETURN s.k AS s, b.no AS b, n")
    assert "Join" not in optimized(pairs)
    assert rows(pairs) == [(1, -3, 2), (2, 4, 1)]  # an edge to no key leads to no berth
    assert rows(s.query("MATCH (b:Berth)<-[:LIES_AT]-(s:Ship {k: 2}) RETURN b.no AS b, b.name AS n")) == [(4, "south")]
    assert rows(s.query("MATCH (s:Ship)-[:LIES_AT]->(b:Berth {no: -3}) RETURN s.k AS s")) == [(1,), (1,)]
    perhaps = s.query("MATCH (s:Ship) OPTIONAL MATCH (s)-[:LIES_AT]->(b:Berth) WITH b, count(*) AS n RETURN b.no AS b, n")
    assert "b_no" not in optimized(perhaps).split("Aggregate [")[1].split("]")[0]  # grouped by the id alone
    assert rows(perhaps) == [(-3, 2), (4, 1), (None, 1)]
    with s.begin() as t:
        t.query("MATCH (b:Berth {no: 4}) SET b.no = 5")
    assert rows(s.query("MATCH (s:Ship)-[:LIES_AT]->(b:Berth) RETURN s.k AS s, b.no AS b")) == [(1, -3), (1, -3), (2, 5)]


# F2
def test_a_pattern_begins_with_edges_where_its_first_node_is_not_read(spark):
    assert "Join" not in optimized(queries.queries()["expand_multi_type"](spark, FOLDER))
    s = quay(spark)
    assert "Join" not in optimized(s.query("MATCH (s:Ship)-[r:LIES_AT]->(b) RETURN count(r) AS n"))
    assert rows(s.query("MATCH (b:Berth)<-[r:LIES_AT]-() RETURN count(DISTINCT b) AS berths, count(r) AS n")) == [(2, 3)]
    assert rows(s.query("MATCH (x)-[:LIES_AT]-(y) RETURN count(*) AS n")) == [(7,)]
    assert rows(s.query("MATCH (x:Ship)-[:LIES_AT]->(x:Berth) RETURN count(*) AS n")) == [(0,)]
    assert rows(s.query("MATCH (x:Ship)-[r:LIES_AT]->(b)<-[q:LIES_AT]-(y) RETURN count(*) AS n")) == [(2,)]


# F3
def test_subqueries_join_on_ids(spark):
    assert optimized(queries.queries()["triadic_closure"](spark, FOLDER)).count("<=>") == 2
    s = quay(spark)
    near = s.query("MATCH (b:Berth) WHERE EXISTS { (b)<-[:LIES_AT]-(s:Ship) WHERE s.k > 1 } RETURN b.name AS n")
    assert optimized(near).count("<=>") == 1
    assert rows(near) == [("south",)]
    assert rows(s.query("MATCH (b:Berth) WHERE EXISTS { (b)<-[:LIES_AT]-(s:Ship) WHERE b.name = 'north' } RETURN b.no AS n")) == [(-3,)]
    assert rows(s.query("MATCH (b:Berth) RETURN b.name AS n, [p = (b)<-[:LIES_AT]-(s) | nodes(p)[0].name] AS l, EXISTS { (b)<-[:LIES_AT]-(:Ship {k: 2}) } AS e")) == [("north", ["north", "north"], False), ("south", ["south"], True)]
    assert rows(s.query("MATCH (b) WHERE (b:Berth)<-[:LIES_AT]-() RETURN b.name AS n")) == [("north",), ("south",)]


@pytest.mark.parametrize("many", [False, True])
def test_pairs_with_a_match_come_once_for_each_row(spark, many):
    g, n = Graph(spark), 400 if many else 2  # the pairs are looked for as they come, or once each
    g.node("A", spark.range(n), "id", {"a": "id"})
    g.node("B", spark.range(n), "id", {"b": "id"})
    g.edge("R", spark.createDataFrame([(0, 0), (0, 0), (1, 1)], "a long, b long"), ("A", "a"), ("B", "b"))
    g.edge("Q", spark.createDataFrame([(0, 0), (0, 0)], "a long, b long"), ("A", "a"), ("B", "b"))
    s = GraphSession(spark, g)
    plan = optimized(s.query("MATCH (a:A)-[:R]->(b:B) WHERE EXISTS { (a)-[:Q]->(b) } RETURN count(*) AS n"))
    assert (plan.count("Aggregate") == 1) == many
    assert rows(s.query("MATCH (a:A)-[:R]->(b:B) WHERE EXISTS { (a)-[:Q]->(b) } RETURN a.a AS a")) == [(0,), (0,)]
    assert rows(s.query("MATCH (a:A)-[:R]->(b:B) WHERE NOT (a)-[:Q]->(b) RETURN a.a AS a")) == [(1,)]
    assert rows(s.query("MATCH (a:A)-[:R]->(b:B) RETURN a.a AS a, EXISTS { (a)-[:Q]->(b) } AS e")) == [(0, True), (0, True), (1, False)]
    assert rows(s.query("MATCH (a:A)-[:R]->(b:B) WHERE EXISTS { MATCH (a)-[q:Q]->(b) WITH count(q) AS n WHERE n = 2 RETURN n } RETURN a.a AS a")) == [(0,), (0,)]


# F4
def test_conditions_on_ends_go_below_the_numbering_of_equal_edges(spark):
    plan = optimized(queries.equal_edge_rows(spark, FOLDER))
    assert plan.count("Window [") == 2
    assert all("< 300" in part for part in plan.split("Window [")[1:]) and "< 300" not in plan.split("Window [")[0]
    s = quay(spark)
    few = s.query("MATCH (s:Ship)-[r:LIES_AT]->(b:Berth) WHERE b.no < 0 RETURN count(DISTINCT r) AS n")
    assert "< 0" in optimized(few).split("Window [")[1]
    assert rows(few) == [(2,)]


# as before, what isn't in its table has no place in a negated pattern
def test_an_end_without_a_node_is_not_counted_as_lacking_edges(spark):
    g = Graph(spark)
    g.node("A", spark.range(3), "id", {"a": "id"})
    g.edge("R", spark.createDataFrame([(0, 1), (7, 1), (1, 7)], "a long, b long"), ("A", "a"), ("A", "b"))
    g.edge("Q", spark.createDataFrame([(1, 1)], "a long, b long"), ("A", "a"), ("A", "b"))
    s = GraphSession(spark, g)
    assert rows(s.query("MATCH (a:A)-[:R]->(b:A) WHERE NOT EXISTS { (a)-[:Q]->(b) } RETURN count(*) AS n")) == [(1,)]
