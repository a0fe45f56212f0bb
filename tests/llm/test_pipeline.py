"""The pipeline's stages and the registered queries on a small table."""

import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    rng = np.random.default_rng(9)
    common = ["the", "of", "and", "to", "in", "was"]
    word = lambda: common[rng.integers(6)] if rng.random() < 0.5 else "".join(rng.choice(list("abcdefgh"), 6))
    line = lambda: " ".join(word() for _ in range(25)) + "."
    docs = [(i, "\n".join(line() for _ in range(6)), "en", f"s{i % 3}", 1) for i in range(150)]
    docs += [(200 + i, docs[i][1], "en", "s0", 1) for i in range(10)]
    docs += [(300 + i, " ".join(["##@@!!"] * 60), "en", "s1", 1) for i in range(5)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = corpus(spark, tmp_path)
    assert len(pipeline.STAGES) == 5
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(f"{tmp_path}/{len(seen)}")
        frame = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append((name, frame.columns, frame.collect()))
    names = [f.split()[0] for f in DOCS.split(", ")]
    assert all(columns == names for _, columns, _ in seen[:-1])
    ids = lambda i: {r["doc_id"] for r in seen[i][2]}
    assert not [x for x in ids(0) if x >= 300] and len(ids(0)) >= 155
    assert all(r["text"] == "" for r in seen[1][2] if 200 <= r["doc_id"] < 300)
    assert len([x for x in ids(2) if x >= 200]) == 1 and len(ids(2)) >= 145
    assert ids(3) <= ids(2)
    by_id = {d[0]: d[1] for d in docs}
    import hashlib

    for r in seen[4][2]:
        if r["doc_id"] < 200:
            assert r["decoded_sha256"] == hashlib.sha256(by_id[r["doc_id"]].encode()).hexdigest()
    assert pipeline.run(spark, str(tmp_path)).count() == len(seen[4][2])


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
