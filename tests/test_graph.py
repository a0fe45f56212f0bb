import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from linkweave import queries
from linkweave.operators import betweenness, connectivity, cycles, dynamic, traversal, vertices
from linkweave.operators.components import component_labels, min_labels, star_rounds
from linkweave.operators.graph import Graph
from linkweave.plans.scratch import Scratch


def edges_of(spark, pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def brute_components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def random_pairs(n, m, seed):
    rng = random.Random(seed)
    return {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_components_both_ways(spark, limit):
    pairs = random_pairs(300, 220, 1) | {(1000 + i, 1001 + i) for i in range(60)}
    got = dict(map(tuple, component_labels(spark, edges_of(spark, pairs), limit).collect()))
    assert got == brute_components(pairs)


def test_components_of_loops_and_nothing(spark):
    assert component_labels(spark, edges_of(spark, [])).count() == 0
    rows = edges_of(spark, [(5, 5), (None, 3), (7, 8)])
    assert dict(map(tuple, component_labels(spark, rows).collect())) == {5: 5, 7: 7, 8: 7}
    assert dict(map(tuple, component_labels(spark, rows, 0).collect())) == {5: 5, 7: 7, 8: 7}


def test_star_rounds_hub(spark):
    pairs = [(0, i) for i in range(1, 400)] + [(399, 400)]
    got = dict(map(tuple, star_rounds(edges_of(spark, pairs), Scratch(spark, "t")).collect()))
    assert set(got.values()) == {0} and len(got) == 401


def test_loading(spark):
    g = Graph.from_edges(spark.range(4), edges_of(spark, [(1, 0), (0, 1), (2, 2), (1, 9), (2, 1)]))
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1), (1, 2)]
    with pytest.raises(Exception, match="no edge between"):
        Graph.from_edges(spark.range(4), edges_of(spark, [(2, 2)]), strict=True).edges.collect()
    with pytest.raises(ValueError):
        Graph.empty(spark, 0)
    assert Graph.empty(spark, 3).vertices.count() == 3
    lists = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [2])], "id long, neighbors array<long>")
    assert sorted(map(tuple, Graph.from_adjacency(lists).edges.collect())) == [(0, 1), (0, 2)]
    assert g.without_edges().edges.count() == 0


def test_isolated_vertices_count_apart(spark):
    g = Graph.from_edges(spark.range(5), edges_of(spark, [(0, 1), (1, 2)]))
    assert connectivity.num_components(g).first()[0] == 1
    assert connectivity.component_of(g, spark.createDataFrame([(4,)], "id long")).collect() == [(4, 4)]
    assert [tuple(r) for r in connectivity.component_members(g).collect()] == [(0, [0, 1, 2], 3)]
    pairs = spark.createDataFrame([(0, 0, 2), (1, 3, 3), (2, 0, 3), (3, 0, 99), (4, 99, 99)], "pair_id long, u long, v long")
    assert {r["pair_id"]: r["connected"] for r in connectivity.connected(g, pairs).collect()} == {0: True, 1: True, 2: False, 3: False, 4: False}


def test_vertices(spark):
    g = Graph.from_edges(spark.range(5), edges_of(spark, [(0, 1), (1, 2)]))
    assert dict(map(tuple, vertices.degrees(g).collect())) == {0: 1, 1: 2, 2: 1, 3: 0, 4: 0}
    assert sorted(r[0] for r in vertices.isolated(g).collect()) == [3, 4]
    assert sorted(r[0] for r in vertices.active(g).collect()) == [0, 1, 2]
    asked = spark.createDataFrame([(0, 2), (1, 3), (2, 2), (3, 0)], "pos long, id long")
    assert [tuple(r) for r in vertices.retain_active(g, asked).orderBy("pos").collect()] == [(0, 2), (2, 2), (3, 0)]
    assert g.isolate(spark.createDataFrame([(1,)], "id long")).edges.count() == 0
    assert sorted(map(tuple, vertices.neighbors(g, spark.createDataFrame([(1,), (1,)], "id long")).collect())) == [(1, 0), (1, 2)]


def brute_search(pairs, s):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    dist, front = {s: 0}, [s]
    while front:
        front = [y for x in front for y in near[x] if y not in dist and not dist.update({y: dist[x] + 1})]
    return dist, near


@pytest.mark.parametrize("limit", [10**6, 0])
def test_search_and_paths(spark, limit, monkeypatch):
    monkeypatch.setattr(traversal, "GROUP_EDGES", limit)
    pairs = random_pairs(40, 45, 3)
    g = Graph.from_edges(spark.range(45), edges_of(spark, pairs))
    got = traversal.search(g, spark.createDataFrame([(0,), (7,), (44,), (99,)], "id long"), limit).collect()
    for s in (0, 7, 44):
        dist, near = brute_search(pairs, s)
        own = {r["id"]: (r["dist"], r["parent"]) for r in got if r["source"] == s}
        assert {k: d for k, (d, _) in own.items()} == dist
        for k, (d, p) in own.items():
            assert p == (None if d == 0 else min(x for x in near[k] if dist[x] == d - 1))
    ends = spark.createDataFrame([(0, 0, 7), (1, 7, 7), (2, 0, 44), (3, 0, 99), (4, 44, 44)], "pair_id long, u long, v long")
    found = {r["pair_id"]: (r["length"], r["path"]) for r in traversal.shortest_paths(g, ends).collect()}
    assert found[1] == (0, [7]) and found[2] == found[3] == (None, None) and found[4] == (0, [44])
    dist, near = brute_search(pairs, 0)
    if 7 in dist:
        assert found[0][0] == dist[7] and all(b in near[a] for a, b in zip(found[0][1], found[0][1][1:], strict=False))


def test_cycles_and_bridges(spark):
    pairs = {(0, 1), (1, 2), (0, 2), (2, 3), (5, 6), (6, 7), (7, 8), (5, 8)}
    g = Graph.from_edges(spark.range(10), edges_of(spark, pairs))
    basis = [r["cycle"] for r in cycles.cycle_basis(g).collect()]
    assert sorted(sorted(c) for c in basis) == [[0, 1, 2], [5, 6, 7, 8]]
    for c in basis:
        assert all(tuple(sorted(e)) in pairs for e in zip(c, c[1:] + c[:1], strict=True))
    assert [tuple(r) for r in cycles.bridges(g).collect()] == [(2, 3)]
    assert dict(map(tuple, cycles.cycle_rank(g).collect())) == {0: 1, 5: 1}
    assert len(cycles.cycle_basis(g, spark.createDataFrame([(3,)], "id long")).collect()) == 1
    assert cycles.cycle_basis(g, spark.createDataFrame([(9,)], "id long")).count() == 0


def test_betweenness(spark):
    g = Graph.from_edges(spark.range(8), edges_of(spark, [(0, 1), (1, 3), (0, 2), (2, 3), (5, 6)]))
    cands = spark.createDataFrame([(1,), (2,), (0,), (6,)], "id long")
    terms = spark.createDataFrame([(3, 0), (3, 5)], "terminal long, root long")
    assert dict(map(tuple, betweenness.grouped(g, cands, terms).collect())) == {0: 1, 1: 1, 2: 1, 6: 0}
    one = dict(map(tuple, betweenness.pairwise(g, cands, terms).collect()))
    assert one[0] == 1 and one[1] + one[2] == 1 and one[6] == 0
    none = spark.createDataFrame([], "terminal long, root long")
    assert dict(map(tuple, betweenness.subset_betweenness(g, cands, none, mode="auto").collect())) == {0: 0, 1: 0, 2: 0, 6: 0}
    top = spark.createDataFrame([(3, 77)], "terminal long, root long")
    towns = spark.createDataFrame([(0,), (1,)], "id long")
    assert dict(map(tuple, betweenness.pairwise(g, cands, top, towns, 77).collect()))[1] >= 1
    assert set(dict(map(tuple, betweenness.grouped(g, cands, top, 77).collect())).values()) == {0}
    with pytest.raises(ValueError):
        betweenness.subset_betweenness(g, cands, terms, mode="x")


def test_op_log(spark):
    rows = [(1, "insert", 0, 1), (2, "insert", 1, 0), (3, "delete", 0, 1), (4, "delete", 0, 1), (5, "insert", 2, 2), (6, "insert", 2, 3), (7, "query", 0, 1), (8, "insert", 2, 9), (9, "insert", None, 1)]
    ops = spark.createDataFrame(rows, "seq long, op string, u long, v long")
    known = spark.range(4)
    valid = {r["seq"]: r["valid"] for r in dynamic.op_validity(ops, vertices=known).collect()}
    assert valid == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True, 8: False, 9: False}
    assert [tuple(r) for r in dynamic.live_edges(ops, vertices=known).collect()] == [(2, 3)]
    first = edges_of(spark, [(0, 1)])
    valid = {r["seq"]: r["valid"] for r in dynamic.op_validity(ops, first).collect()}
    assert not valid[1] and valid[3]
    assert sorted(map(tuple, dynamic.live_edges(ops, 2, first).collect())) == [(0, 1)]
    assert sorted(map(tuple, dynamic.snapshots(ops, [1, 3, 6]).collect())) == [(1, 0, 1), (6, 2, 3)]


def test_subtrees_and_adjacency(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (2, 4), (10, 11), (1, 3)]
    g = Graph(spark.range(12), edges_of(spark, pairs))
    sizes = traversal.subtree_sizes(traversal.spanning_forest(g))
    assert sorted(map(tuple, sizes.collect())) == [(0, 0, 5), (0, 1, 4), (0, 2, 2), (0, 3, 1), (0, 4, 1), (10, 10, 2), (10, 11, 1)]
    assert sorted(map(tuple, traversal.centroids(sizes).collect())) == [(0, 1), (10, 10)]
    lists = spark.createDataFrame([(i, [i - 1] if i else []) for i in range(12)], "id long, neighbors array<long>")
    assert g.with_adjacency(lists).edges.count() == 11
    with pytest.raises(ValueError):
        g.with_adjacency(lists.limit(5))


def test_bitmaps_of_zero_and_bucket_ends(spark, tmp_path):
    # Vertices 0, 1, 32768 and 32769 in one component, negative ids in others.
    rows = [(0, 0, 50.0), (0, 16384, 46.0), (16384, 16384, 50.0), (-16384, -16384, 50.0), (-16383, -1, 50.0), (20000, 20000, 45.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = sorted(map(tuple, queries.component_bitmaps(spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        assert found == sorted(db.sql(queries.SQL["component_bitmaps"]).fetchall())
    assert (0, 1, 3) in found


def brute_paths(pairs, wanted):
    """How often each vertex is on the path from the first to the second, by smallest parents."""
    out = defaultdict(int)
    for t, r in wanted:
        dist, near = brute_search(pairs, t)
        while r in dist:
            out[r] += 1
            if r == t:
                break
            r = min(x for x in near[r] if dist.get(x) == dist[r] - 1)
    return out


@pytest.mark.parametrize("limit", [10**6, 25, 0])
def test_pairwise_with_super_root(spark, limit):
    # Three parts of different size, the vertices 90 to 99 without edges, 500 unknown.
    big = 2**60
    pairs = random_pairs(30, 60, 1) | {(a + 30, b + 30) for a, b in random_pairs(20, 24, 2)} | {(a + big, b + big) for a, b in random_pairs(6, 7, 3)}
    ids = [*range(100), *range(big, big + 6)]
    g = Graph.from_edges(spark.createDataFrame([(i,) for i in ids], "id long"), edges_of(spark, pairs))
    rng = random.Random(4)
    terms = {(rng.choice(ids), rng.choice(ids)) for _ in range(60)} | {(x, x) for x in (5, 91, big, 500)} | {(rng.choice(ids[:50] + ids[-6:]), -1) for _ in range(30)} | {(92, -1), (93, -1), (500, -1)}
    towns = [0, 7, 7, 31, 35, 92, 500, 3, big + 2]
    want = brute_paths(pairs, [(t, r) for t, r in terms if r != -1 and t != 500] + [(t, r) for t, x in terms if x == -1 and t != 500 for r in set(towns)])
    frame = spark.createDataFrame(sorted(terms), "terminal long, root long")
    found = betweenness.pairwise(g, g.vertices, frame, spark.createDataFrame([(x,) for x in towns], "id long"), -1, limit)
    assert dict(map(tuple, found.collect())) == {i: want[i] for i in ids}


def test_super_root_writes_no_pairs_of_other_components(spark, monkeypatch):
    n, rows, write = 400, [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda *a, **b: (out := write(*a, **b), rows.append(out.count()))[0])
    pairs = [(3 * i + j, 3 * i + j + 1) for i in range(n) for j in range(2)]
    g = Graph(spark.range(3 * n), edges_of(spark, pairs))
    terms = g.vertices.filter("id % 3 > 0").select(F.col("id").alias("terminal"), F.lit(-1).cast("long").alias("root"))
    found = betweenness.pairwise(g, g.vertices, terms, g.vertices.filter("id % 3 = 0"), -1)
    assert dict(map(tuple, found.collect())) == {3 * i + j: (2, 2, 1)[j] for i in range(n) for j in range(3)}
    assert max(rows) <= 3 * n
