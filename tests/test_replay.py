import random

from linkweave.operators import dynamic
from linkweave.streaming.replay import RESULT, Replayer, replay, replay_stream

OPS = "graph_id long, seq long, op string, u long, v long"


def built(edges):
    r = Replayer()
    for u, v in edges:
        assert r.insert(u, v) in (0, 1)
    return r


def test_path_and_cycle():
    r = built([(0, 1), (1, 2), (2, 3)])
    assert r.query(0, 3) and r.delete(1, 2) == 2 and not r.query(0, 3) and r.query(0, 1) and r.query(2, 3)
    assert r.insert(1, 2) == 1 and r.query(0, 3)
    r = built([(0, 1), (1, 2), (2, 3), (0, 3)])
    assert r.delete(1, 2) in (0, 1) and r.query(1, 2) and r.query(0, 3)
    assert r.delete(1, 2) == -1 and r.insert(0, 0) == -1 and r.insert(0, 1) == -1
    assert r.query(7, 7) == 1
    assert Replayer({1}).query(7, 7) == 0 and Replayer({1}).insert(1, 7) == -1


def brute(ops):
    edges, out = set(), []

    def joined(u, v):
        seen, todo = {u}, [u]
        while todo:
            x = todo.pop()
            for a, b in edges:
                for p, q in ((a, b), (b, a)):
                    if p == x and q not in seen:
                        seen.add(q)
                        todo.append(q)
        return v in seen

    for _, seq, op, u, v in ops:
        e = (min(u, v), max(u, v))
        if op == "query":
            code = int(joined(u, v))
        elif u == v or (e in edges) == (op == "insert"):
            code = -1
        elif op == "insert":
            code = 0 if joined(u, v) else 1
            edges.add(e)
        else:
            edges.remove(e)
            code = 1 if joined(u, v) else 2
        out.append((seq, op, code))
    return out


def log(n, seed, graph=0):
    rng = random.Random(seed)
    return [(graph, i, rng.choice(["insert", "insert", "delete", "query"]), rng.randrange(12), rng.randrange(12)) for i in range(n)]


def test_random_logs(spark):
    logs = [log(300, s, s) for s in (1, 2)]
    got = replay(spark.createDataFrame([x for one in logs for x in one], OPS)).collect()
    for g, ops in zip((1, 2), logs, strict=True):
        rows = spark.createDataFrame([tuple(r) for r in got if r["graph_id"] == g], RESULT)
        assert sorted(map(tuple, dynamic.outcome_classes(rows).collect())) == sorted(brute(ops))


def test_stream_keeps_state(spark, tmp_path):
    ops = log(200, 5)
    src = tmp_path / "in"
    src.mkdir()
    stream = replay_stream(spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(str(src)))
    frame = spark.createDataFrame(ops, OPS)
    frame.filter("seq < 100").coalesce(1).write.mode("append").parquet(str(src))
    query = stream.writeStream.format("memory").queryName("codes").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    frame.filter("seq >= 100").coalesce(1).write.mode("append").parquet(str(src))
    query.processAllAvailable()
    query.stop()
    got = spark.table("codes")
    assert sorted(map(tuple, dynamic.outcome_classes(got).collect())) == sorted(brute(ops))


def test_unknown_ends_ops_and_large_ids(spark):
    big = (1 << 53) + 1
    ops = [(1, 0, "insert", big, 5), (1, 1, "insert", None, 5), (1, 2, "query", big - 1, 5), (1, 3, "query", big, 5), (1, 4, "paint", 5, big), (1, 5, "insert", 99, 5), (1, 6, "delete", 5, 7)]
    known = spark.createDataFrame([(1, big), (1, big - 1), (1, 5), (1, 7)], "graph_id long, id long")
    first = spark.createDataFrame([(1, 5, 7)], "graph_id long, src long, dst long")
    got = {r["seq"]: (r["u"], r["code"]) for r in replay(spark.createDataFrame(ops, OPS), known, first).collect()}
    assert [got[i][1] for i in range(7)] == [1, -1, 0, 1, -1, -1, 2] and got[0][0] == big and got[1][0] is None
