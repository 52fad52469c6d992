from quiltgraph.session import GraphSession
from quiltgraph.sources.catalog import Graph
from quiltgraph.streaming import append_to


def test_streamed_edges_are_queried(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "edges")
    spark.createDataFrame([(1, 2), (2, 3), (1, 2)], "a long, b long").write.parquet(source)
    stream = spark.readStream.schema("a long, b long").parquet(source)
    append_to(stream, table, str(tmp_path / "state"), ["a", "b"]).awaitTermination()
    g = Graph(spark).node("N", spark.range(1, 4), "id", {"id": "id"})
    g.edge("R", spark.read.parquet(table).select("a", "b"), ("N", "a"), ("N", "b"))
    got = GraphSession(spark, g).query("MATCH (x)-[:R*1..2]->(y) RETURN x.id AS x, y.id AS y ORDER BY x, y").collect()
    assert [tuple(r) for r in got] == [(1, 2), (1, 3), (2, 3)]
