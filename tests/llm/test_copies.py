"""Line dedup, SimHash, embeddings, mixing, top-k."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from linkweave.llm import embedding_dedup, line_dedup, mixing, simhash, simhash_wide, topk
from linkweave.plans.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(line):
    return len(re.findall(r"[^\x20\x09-\x0D]+", line))


def brute_lines(docs, least):
    """For each line run the longest earlier match; runs with enough words go."""
    seqs = [[(n, x, words(x)) for n, x in enumerate(t.split("\n")) if words(x)] for _, t in docs]
    seen, out = defaultdict(list), []
    for d, s in enumerate(seqs):
        for k, (_, x, _) in enumerate(s):
            seen[x].append((d, k))
    for d, s in enumerate(seqs):
        gone = set()
        for k in range(len(s)):
            for e, j in seen[s[k][1]]:
                if (e, j) >= (d, k):
                    break
                m = 0
                while k + m < len(s) and j + m < len(seqs[e]) and seqs[e][j + m][1] == s[k + m][1]:
                    m += 1
                if sum(x[2] for x in s[k : k + m]) >= least:
                    gone |= {s[k + i][0] for i in range(m)}
        out.append("\n".join(x for n, x in enumerate(docs[d][1].split("\n")) if n not in gone))
    return out


@pytest.mark.parametrize("least", [1, 5, 23])
def test_line_dedup_against_brute_force(spark, least):
    rng = np.random.default_rng(least)
    docs = [(i, "\n".join(rng.choice(["a", "b b", "c c c", "", "d d d d d d", f"own {i} line", "  "], rng.integers(0, 25)))) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = dict(map(tuple, line_dedup.dedup_lines(frame, least).collect()))
    assert [got[i] for i, _ in docs] == brute_lines(docs, least)


def test_line_dedup_odd_rows(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs)
    rows = out.collect()
    assert out.columns == odd_docs.columns and len(rows) == 11
    texts = defaultdict(list)
    for r in rows:
        texts[r["doc_id"]].append(r["text"])
    assert texts[1][0].startswith("The first") and texts[2] == ["", ""] and texts[3] == [None] and texts[4] == [""]
    assert sorted(r["__gone"] for r in rows) == ["g"] * 11
    assert line_dedup.dedup_lines(no_docs, report=True).count() == 0


def brute_fingerprint(text, shingle=4):
    import xxhash

    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints(spark, odd_docs):
    for text in ("", "One", "A b C d e F É", "x\x0by\x1cz " * 5):
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    h = spark.createDataFrame([("a b c d",)], "t string").selectExpr("xxhash64(t)").first()[0]
    import xxhash

    assert h % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def brute_classes(fps, most):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= most:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("dense", [2, 20, 4000])
@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_brute_force(spark, dense, seed):
    """A crowded group, a chain and scattered fingerprints, with buckets of any size."""
    from linkweave.operators.components import component_labels

    rng = np.random.default_rng(seed)
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    centre = int(rng.integers(1 << 62))
    fps = [flip(centre, int(rng.integers(0, 7))) for _ in range(150)]
    fps += [int(rng.integers(1 << 62)) for _ in range(60)]
    for _ in range(40):
        fps.append(flip(fps[-1], 4))
    fps = sorted({x - 2**64 if x >> 63 else x for x in fps})
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = simhash.fingerprint_links(frame, Scratch(spark, "t"), 4, dense)
    label = {r["id"]: r["comp"] for r in component_labels(spark, links).collect()}
    want = brute_classes([x % 2**64 for x in fps], 4)
    groups = defaultdict(set)
    for x, c in zip(fps, want, strict=True):
        groups[c].add(label.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("count", [0, 10, 10**6, 10**9, 10**12])
@pytest.mark.parametrize("most", [0, 1, 3, 4, 7])
def test_segments_cover_all_distances(count, most):
    segments = simhash.plan_segments(most, count)
    assert sum(w for _, w, _ in segments) == 64 and sum(r + 1 for _, _, r in segments) == most + 1


def test_simhash_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicate_classes(odd_docs).collect()
    assert len(rows) == 11
    by = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and by[3]["fp"] == by[4]["fp"] == by[6]["fp"] == 0 and by[6]["component_id"] == 3
    assert simhash.near_duplicate_classes(no_docs).count() == 0


def near_copies(rng, n_bases, copies, edits):
    out = []
    for _ in range(n_bases):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for c in range(copies):
            own = list(base)
            for i in rng.choice(300, edits if c else 0, replace=False):
                own[i] = f"e{rng.integers(10**6)}"
            out.append(own)
    return out


def test_wide_simhash_finds_resemblance_08(spark, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    docs = near_copies(rng, 60, 2, 6)  # each edit changes five of 296 shingles
    frame = spark.createDataFrame([(i, " ".join(d), "en", "s", 1) for i, d in enumerate(docs)], DOCS)
    got = dict(map(tuple, simhash_wide.wide_classes(frame).collect()))
    assert np.mean([got[2 * i] == got[2 * i + 1] for i in range(60)]) >= 0.9
    assert all(got[i] // 2 == i // 2 for i in got)
    kept = simhash_wide.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 1 and ids[4] == 0 and ids[None] == 2
    assert simhash_wide.keep_first(no_docs).count() == 0


def shingles_of(words, n=5):
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


@pytest.mark.parametrize("giant", [simhash_wide.GIANT, 1])
def test_wide_classes_hold_only_verified_links(spark, monkeypatch, giant):
    monkeypatch.setattr(simhash_wide, "CROWD", 8)
    monkeypatch.setattr(simhash_wide, "GIANT", giant)
    rng = np.random.default_rng(15)
    docs = near_copies(rng, 1, 150, 6)  # all near the first one, few near each other
    docs += near_copies(rng, 30, 2, 13)  # resemblance of about 0.65
    docs += near_copies(rng, 40, 3, 4)
    frame = spark.createDataFrame([(i, " ".join(d), "en", "s", 1) for i, d in enumerate(docs)], DOCS)
    got = dict(map(tuple, simhash_wide.wide_classes(frame).collect()))
    sets = [shingles_of(d) for d in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    classes = list(range(len(docs)))
    for _ in range(len(docs)):
        for i, j in near:
            classes[i] = classes[j] = min(classes[i], classes[j])
    assert all(classes[got[i]] == classes[i] for i in got)
    assert np.mean([got[i] == classes[i] for i in got]) >= 0.95
    assert len({got[i] for i in range(150)}) <= 8 and [got[150 + i] for i in range(60)] == list(range(150, 210))


def test_lonely_members_of_crowds_lose_no_link(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash_wide, "CROWD", 8)
    rng = np.random.default_rng(21)
    base = near_copies(rng, 1, 120, 5)  # resemblance of about 0.84 to the first one
    docs = base + [near_copies(rng, 1, 1, 0)[0] for _ in range(20)]
    for _ in range(200):  # about 0.6
        own = list(base[0])
        for i in rng.choice(300, 19, replace=False):
            own[i] = f"e{rng.integers(10**6)}"
        docs.append(own)
    for i in range(20):  # twins of some of these
        own = list(docs[140 + 7 * i])
        own[i] = "twin"
        docs.append(own)
    rows = simhash_wide.wide_fingerprints(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"))
    scratch = Scratch(spark, "lonely")
    fps = scratch.write(rows.withColumnRenamed("doc_id", "id"), "fps")
    found = {r["id"] for r in simhash_wide._lonely(fps.select("id"), fps).collect()}
    sets = [shingles_of(d) for d in docs]
    times = Counter(x for own in sets for x in own)
    assert found == {i for i, own in enumerate(sets) if sum(times[x] > 1 for x in own) < 0.8 * len(own)}
    twins = {140 + 7 * i for i in range(20)} | set(range(340, 360))
    assert len(found & set(range(140, 340))) == 180 and not found & twins
    links = lambda: {(min(r), max(r)) for r in simhash_wide.wide_links(fps, scratch).collect()}
    got = links()
    assert not {x for pair in got for x in pair} & found
    monkeypatch.setattr(simhash_wide, "_lonely", lambda ids, fps: ids.limit(0))
    assert got == links() and len(got) > 100


def test_resemblance_by_sketches():
    rng = np.random.default_rng(16)
    for n, m, k in ((100, 80, 60), (3000, 2500, 2400), (300, 4000, 290), (0, 5, 0), (700, 700, 700)):
        x = np.unique(rng.integers(0, 1 << 63, n + m - k, dtype=np.uint64) * np.uint64(2))
        order = rng.permutation(x)
        a, b = np.sort(order[:n]), np.sort(order[n - k :])
        got = simhash_wide.resemblance(simhash_wide.sketch_of(a), simhash_wide.sketch_of(b))
        assert abs(got - k / (n + m - k)) <= (0.08 if max(n, m) >= simhash_wide.SKETCH and n != k else 1e-9)


def test_wide_plan_meets_at_every_count():
    rng = np.random.default_rng(11)
    differ = rng.random((20_000, 256)) < simhash_wide.EXPECTED
    for count in (1, 50_000, 1 << 21, 2_200_000, 6_000_000, 70_000_000, 10**9):
        bits, places = simhash_wide.plan_wide(count)
        own = np.array([[m >> b & 1 for m in masks for b in range(64)] for masks in places])
        assert (own.sum(axis=1) == bits).all() and all(sum(m).bit_count() == bits for m in places)
        met = (differ.astype(np.float32) @ own.T.astype(np.float32) <= 2).any(axis=1)
        assert met.mean() >= simhash_wide.RECALL - 0.01, count


def test_wide_links_by_the_plan_of_many(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(12)
    plan = simhash_wide.plan_wide(10**9)
    monkeypatch.setattr(simhash_wide, "plan_wide", lambda count: plan)
    bits = rng.random((300, 256)) < 0.5
    bits = np.concatenate([bits, bits ^ (rng.random((300, 256)) < simhash_wide.EXPECTED)])
    fps = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    frame = spark.createDataFrame([(i, *map(int, x), b"same") for i, x in enumerate(fps)], "id long, f0 long, f1 long, f2 long, f3 long, sketch binary")
    got = {(min(r), max(r)) for r in simhash_wide.wide_links(frame, Scratch(spark, "many")).collect()}
    masks = np.array([[m >> b & 1 for m in place for b in range(64)] for place in plan[1]])
    differ = bits[:300] ^ bits[300:]
    apart = differ.astype(int) @ masks.T
    want = (differ.sum(axis=1) <= simhash_wide.MAX_BITS) & ((apart == 0).any(axis=1) | (apart <= 2).any(axis=1) & (differ[:, 192:].sum(axis=1) <= simhash_wide.MAX_CHECK_BITS))
    assert got == {(i, i + 300) for i in np.flatnonzero(want).tolist()} and len(got) > 240


VECTORS = "vec_id long, embedding array<float>, label int"
ODD = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, float("nan")], 1), (5, [1.0, None], 1), (6, [1.0, float("inf")], 1), (7, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (12, [1.0, 2.0, None], 1), (13, [None, 1.0, 2.0], 1), (8, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (10, [2.0, 4.0], 1), (11, [1.0, 2.0, 0.0], 1), (50, [1.0, -3.0], 2)]


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 64))
    rows = [(i, base[i].tolist(), i % 3) for i in range(400)]
    for i in range(200):
        a, b = base[i] / np.linalg.norm(base[i]), rng.normal(size=64)
        b -= (b @ a) * a
        c = rng.uniform(0.93, 0.97)
        near = c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)
        rows += [(1000 + i, near.tolist(), i % 3), (2000 + i, (near * 3).tolist(), i % 3)]
    rows += [(5000 + i, base[0].tolist(), 0) for i in range(30)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    x = np.array([np.float32(r[1]) for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    want, found = link.sum(), sum(r["n_links"] for r in got.values())
    assert 0.98 * want <= found <= want
    # The hard pairs alone: each near vector's first partner is one of 200.
    hard = [(i, 1000 + i) for i in range(200)]
    assert np.mean([got[a]["component_id"] == got[b]["component_id"] for a, b in hard]) >= 0.98
    assert got[5007]["component_id"] == 0 and not got[5007]["kept"] and got[0]["kept"]


def test_embeddings_odd_rows(spark):
    got = defaultdict(list)
    for r in embedding_dedup.near_vectors(spark.createDataFrame(ODD, VECTORS)).collect():
        got[r["vec_id"]].append((r["n_links"], r["component_id"]))
    assert all(got[i] == [(0, i)] for i in (1, 2, 3, 4, 5, 6, 7, 11, 12, 13, 50)) and got[None] == [(0, None)]
    assert got[8] == [(3, 8)] and got[9] == [(3, 8)] * 2 and got[10] == [(3, 8)]
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_e8_is_nearest():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8)) * 2
    p = embedding_dedup.nearest_e8(x)
    short = embedding_dedup.minimal_vectors()
    assert len(short) == 240 and np.allclose((short**2).sum(axis=1), 2)
    own = ((x - p) ** 2).sum(axis=1)
    assert all(own[i] <= ((x[i] - p[i] - short) ** 2).sum(axis=1).min() + 1e-9 for i in range(300))


def brute_top(rows, k=5):
    vecs = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows]
    out = []
    for q, x in vecs:
        if q % 50 == 0:
            scores = sorted((-int(x @ y), i) for i, y in vecs if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SAMPLE", 50)
    monkeypatch.setattr(topk, "ANNULUS", 64)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 900)] + 0.1 * rng.normal(size=(900, 16))
    x[100:400] = x[100]
    rows = [(i, x[i].tolist()) for i in range(900)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = sorted(map(tuple, topk.top_k(frame).collect()))
    assert got == brute_top(rows)


def test_top_k_odd_rows(spark):
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame([*ODD, (100, [1.0, 2.0], 3)], VECTORS)).collect()))
    want = brute_top([(i, v) for i, v, _ in [*ODD, (100, [1.0, 2.0], 3)] if i is not None and v and len(v) == 2 and all(y is not None and np.isfinite(y) for y in v)])
    assert got == want
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0


def test_mix_targets_and_budget(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(n)), "en", ["a", "b", "c", None][int(s)], 1) for i, (n, s) in enumerate(zip(rng.integers(0, 50, 800), rng.choice(4, 800, p=[0.02, 0.08, 0.8, 0.1]), strict=True))]
    frame = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(mixing.sized_rows(frame)).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(mixing.sized_rows(frame.repartition(7))).collect()}
    assert {r["doc_id"]: r["taken"] for r in got} == again
    size, target, taken, largest = Counter(), {}, Counter(), Counter()
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
    # The excess over three times a source's size goes to the others by weight, again and again.
    weight, left, want = {"a": 5, "b": 2, "c": 1, None: 5}, dict(size), {}
    total, open_ = sum(size.values()), set(size)
    while True:
        level = (total - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * left[s]}
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 3 * left[s] for s in over}
        open_ -= over
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_mixed_documents_are_the_copies_decided(spark):
    rng = np.random.default_rng(21)
    word = lambda: " ".join(["w"] * int(rng.integers(0, 30)))
    rows = [(i if i % 9 else None, word(), "en", ["a", "b", None][i % 3 and (i % 7 > 1) + 1], 1) for i in range(300)]
    rows += [(1000, "a b c d", "en", "b", 1)] * 40 + [(None, "x y z", "de", "b", 1)] * 40 + [(2000 + i, "", "en", "a", 1) for i in range(5)]
    frame = spark.createDataFrame(rows, DOCS)
    want = Counter()
    for r in mixing.mix(mixing.sized_rows(frame)).collect():
        want[r["doc_id"], r["text"], r["source"]] += r["copies"]
        assert r["copies"] <= mixing.MAX_EPOCHS
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mix_documents(frame).collect())
    assert got == +want and sum(want.values()) != len(rows)


def test_prefix_sums_over_many_runs(spark, monkeypatch):
    frame = spark.createDataFrame([(i, "w " * (i % 13), "en", "ab"[i % 5 > 0], 1) for i in range(500)], DOCS)
    want = sorted(map(tuple, mixing.mix(mixing.sized_rows(frame)).select("doc_id", "taken").collect()))
    monkeypatch.setattr(mixing, "SLICE_ROWS", 2)
    monkeypatch.setattr(mixing, "RUN", 7)
    assert sorted(map(tuple, mixing.mix(mixing.sized_rows(frame)).select("doc_id", "taken").collect())) == want


def test_mix_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(mixing.sized_rows(odd_docs)).collect()
    assert len(rows) == 11 and all(r["taken"] <= 3 * r["size"] for r in rows)
    out = mixing.mix_documents(odd_docs)
    assert out.columns == odd_docs.columns and {r["target"] for r in out.collect()} == {"t"}
    assert mixing.mix(mixing.sized_rows(no_docs)).count() == 0 and mixing.mix_documents(no_docs).count() == 0
