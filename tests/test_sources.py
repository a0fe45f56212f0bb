import struct

from linkweave.functions.report import latency_report
from linkweave.operators.graph import Graph
from linkweave.sources import formats, generators


def test_matrix_market(spark, tmp_path):
    path = tmp_path / "g.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real general\n% note\n\n4 4 3\n2 1 0.5\n3 2 1\n\n2 1 9\n3 3 1\n")
    assert sorted(map(tuple, formats.read_matrix_market(spark, str(path)).collect())) == [(0, 1), (1, 2)]


def test_csr_and_binary(spark, tmp_path):
    rows = spark.createDataFrame([(0, 2), (1, 1), (2, 1), (3, 0)], "id long, degree int")
    flat = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 0)], "pos long, neighbor long")
    g = Graph.from_csr(rows, flat)
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1), (0, 2)]
    (tmp_path / "graph.bin").write_bytes(struct.pack("<8i", 3, 2, 1, 1, 1, 2, 0, 0))
    assert sorted(map(tuple, formats.read_binary_graph(spark, str(tmp_path / "graph.bin")).collect())) == [(0, 1), (0, 2)]


def test_generators(spark):
    assert generators.ring_edges(spark, 1000).select("src", "dst").count() <= 2000
    assert generators.caterpillar(spark, 200).count() >= 199
    pairs = generators.sample_pairs(spark.range(100), 20).collect()
    assert len(pairs) == 20 and all(r["u"] != r["v"] for r in pairs)
    edges = generators.caterpillar(spark, 200)
    assert 0 < generators.first_deleted(edges).count() < edges.count()


def test_report(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "op string, ns double")
    got = {r["op"]: r for r in latency_report(rows, "op").collect()}
    assert got["a"]["mean"] == 2.0 and got["a"]["p50"] == 2.0 and got["b"]["std"] == 0.0 and got["b"]["max"] == 5.0
