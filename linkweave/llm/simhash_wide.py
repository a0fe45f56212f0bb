"""Near duplicates of five-word-shingle resemblance 0.8 and more by wide SimHash.

At that resemblance 64 bits differ in ten places, too many to tell from chance
safely.  Here a fingerprint has 256 bits: four words of majority bits over four
independent hashes of the text's distinct shingles.  The words are cut into
segments of about log2(documents) bits.  Every fingerprint is put under all
values of the radius-1 Hamming ball of a segment, so that two of them meet if
the segment differs in two bits at most; so many segments are used that a pair
with a share of ``EXPECTED`` differing bits meets with a probability of
``RECALL`` at any number of documents.  Where the disjoint segments of the
words don't suffice, further rounds cut all 256 bits again in other orders.
A pair that meets is a candidate if its complete distance allows; candidates are
verified by the resemblance of the texts' shingle sets, exactly where both have
fewer than ``SKETCH`` shingles, else over the smallest ``SKETCH`` hashes of their
union.

Dense groups: equal fingerprints are one.  The members of each bucket are first
linked with one member, those of a crowded bucket also with the member nearest
to the majority of a sample's bits, which is the common original where there is
one.  Then only members of different components meet, each pair once for each
segment that it meets in.  Members of one component of more than ``GIANT``
fingerprints don't even come together, so that a group costs nothing once it is
connected.

Near copies below the resemblance, linked with no original and not with each
other, would be compared with their group's members in every bucket.  A text
with more than a fifth of its shingles in no other text resembles none by 0.8.
So the shingles of all texts around crowded buckets are counted over these, and
the texts that this rule proves to be alone there only meet texts from elsewhere.
No link is lost by it.

Defined cases: a text without words, a null one included, has fingerprint zero
and no shingles; one with fewer words than a shingle has one shingle; texts of
any length are read whole, ``SKETCH`` hashes of them are kept; rows with a null
id link like others but are kept, as nothing can name them; repeated rows are
copies of each other; an empty table gives no rows; further columns, whatever
their names, are returned by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkweave.llm.common import FEW_IDS, TEXT_ROWS, tidy, without
from linkweave.llm.simhash import BLOCK, SEED, _signed, ball
from linkweave.operators.components import component_labels
from linkweave.plans.scratch import Scratch

WORDS = ("f0", "f1", "f2", "f3")
#: Share of differing bits at resemblance 0.8, the chance that such a pair has to meet, and the bounds for candidates: 1.7 and 2.4 standard deviations above.
EXPECTED, RECALL = 0.156, 0.95
MAX_BITS = 50
MAX_CHECK_BITS = 17
RESEMBLANCE = 0.8
#: Hashes of a text that are kept to verify its resemblance to others (4 bytes each).
SKETCH = 512
#: Fingerprints from which a component is so large that its members don't meet each other again.
GIANT = 64
#: Members from which a bucket is crowded; so many of them give its majority bits.
CROWD = 64
#: Fixed odd multipliers that derive the further hashes from the first.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(text: bytes, shingle: int = 5) -> np.ndarray:
    """Distinct XXH64 values of a UTF-8 text's word shingles, sorted."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[:n].tolist(), ends[len(words) - n :].tolist()
    h = xxhash.xxh64_intdigest
    own = np.sort(np.fromiter((h(flat[a:b], SEED) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=n))
    return own[np.concatenate([[True], own[1:] != own[:-1]])]


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """Four words of the SimHash of shingle hashes."""
    ones = np.zeros((4, 64), dtype=np.int64)
    for at in range(0, len(own), BLOCK):
        x = own[at : at + BLOCK]
        for i in range(4):
            if i:
                x = x * np.uint64(MIX[i - 1])
                x = x ^ (x >> np.uint64(31))
            ones[i] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(own), axis=1, bitorder="little").view("<u8").ravel()


def sketch_of(own: np.ndarray) -> bytes:
    """The smallest distinct hashes, shortened to 32 bits."""
    short = (own >> np.uint64(32)).astype("<u4")
    return short[np.concatenate([[True], short[1:] != short[:-1]])][:SKETCH].tobytes() if len(short) else b""


def resemblance(a: bytes, b: bytes) -> float:
    """Shared part of two texts' shingles by their sketches."""
    both = np.sort(np.concatenate([np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")]))
    first = np.concatenate([[True], both[1:] != both[:-1]])
    n = int(first.sum())
    if max(len(a), len(b)) < 4 * SKETCH:
        return (len(both) - n) / n if n else 1.0
    # Of two sketches' union only the smallest values are sure to be the smallest of both texts.
    end = np.flatnonzero(first)[SKETCH] if n > SKETCH else len(both)
    return (int(end) - min(n, SKETCH)) / min(n, SKETCH)


def wide_fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, f0..f3, sketch) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1_024):
                part = batch.slice(start, 1_024)
                own = [shingle_hashes(x.as_py() or b"", shingle) for x in part.column(1)]
                fps = np.stack([wide_fingerprint(x) for x in own]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(fps[:, i].copy()) for i in range(4)), pa.array(map(sketch_of, own), pa.binary())], names=["doc_id", *WORDS, "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, f0 long, f1 long, f2 long, f3 long, sketch binary")


def _round(bits: int, number: int) -> list[list[int]]:
    """Disjoint segments over all 256 bits, as masks over the four words.

    No two bits of a segment have the same place in their words.  Round 0 takes
    runs of each word, the fourth one's last; each other round has an order of
    its own.
    """
    if number == 0:
        runs = [((1 << bits) - 1) << (s * bits) for s in range(64 // bits)]
        return [[m if w == i else 0 for i in range(4)] for own in ((0, 1, 2), (3,)) for m in runs for w in own]
    rng = Random(number)
    words = [rng.sample(range(4), 4) for _ in range(64)]
    out = []
    for layer in range(4):
        order = rng.sample(range(64), 64)
        for s in range(64 // bits):
            masks = [0] * 4
            for p in order[s * bits : (s + 1) * bits]:
                masks[words[p][layer]] |= 1 << p
            out.append(masks)
    return out


def _missed(bits: int, segments: int) -> float:
    """At most this share of the pairs with ``EXPECTED`` meets in none of so many segments.

    Disjoint segments are independent.  Those of several rounds are so only for
    a given number of differing bits.
    """
    if segments <= 4 * (64 // bits):
        return (1 - sum(comb(bits, i) * EXPECTED**i * (1 - EXPECTED) ** (bits - i) for i in range(3))) ** segments
    out = 0.0
    for d in range(257):
        meets = sum(comb(d, i) * comb(256 - d, bits - i) for i in range(3)) / comb(256, bits)
        out += comb(256, d) * EXPECTED**d * (1 - EXPECTED) ** (256 - d) * (1 - meets) ** segments
    return out


def plan_wide(count: int) -> tuple[int, list[list[int]]]:
    """(bits of a segment, masks over the four words of each segment used)."""
    bits = min(32, max(16, count.bit_length()))
    needed = next(k for k in range(1, 1000) if _missed(bits, k) <= 1 - RECALL)
    places = [masks for r in range(-(-needed // (4 * (64 // bits)))) for masks in _round(bits, r)]
    return bits, places[:needed]


def _distance(a: str, b: str, words: tuple[str, ...] = WORDS) -> F.Column:
    out = F.bit_count(F.col(f"{a}.{words[0]}").bitwiseXOR(F.col(f"{b}.{words[0]}")))
    for w in words[1:]:
        out = out + F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}")))
    return out


def _flips(masks: F.Column, value: F.Column, segment: F.Column) -> F.Column:
    return F.transform(masks, lambda m, j: F.struct(segment, value.bitwiseXOR(m).alias("v"), j.cast("short").alias("flip")))


def _under(fps: DataFrame, places: list[list[int]], radius: int, *more: str) -> DataFrame:
    """One row for each segment value under which a fingerprint is put: s, v, how it was flipped (0: not), id, more."""
    each = []
    for i, masks in enumerate(places):
        value = F.lit(0).cast("long")
        for word, m in zip(WORDS, masks, strict=True):
            if m:
                value = value.bitwiseOR(F.col(word).bitwiseAND(F.lit(_signed(m)).cast("long")))
        at = [b for b in range(64) if sum(masks) >> b & 1]
        flips = F.array(*[F.lit(_signed(sum(1 << at[j] for j in range(len(at)) if x >> j & 1))).cast("long") for x in ball(len(at), radius)])
        each.append(_flips(flips, value, F.lit(i).cast("short").alias("s")))
    return fps.select("id", *more, F.explode(F.concat(*each)).alias("k")).select("k.s", "k.v", "k.flip", "id", *more)


def _majority(group: pa.Table) -> pa.Table:
    bits = [np.unpackbits(group[w].to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) * 2 > group.num_rows for w in WORDS]
    return pa.table({"s": group["s"][:1], "v": group["v"][:1], **{w: np.packbits(b, bitorder="little").view("<i8") for w, b in zip(WORDS, bits, strict=True)}})


def _star(alone: DataFrame, centres: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the members of buckets with their bucket's centre (s, v, centre)."""
    found = alone.join(centres, ["s", "v"]).select("id", F.struct(*WORDS).alias("x"), "centre")
    found = found.filter((F.col("id") != F.col("centre.id")) & (_distance("x", "centre") <= MAX_BITS))
    return found.select(F.least("id", "centre.id").alias("a"), F.greatest("id", "centre.id").alias("b"))


def _resembling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array([resemblance(x.as_py(), y.as_py()) >= RESEMBLANCE for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def _small(keys: DataFrame) -> DataFrame:
    """The keys, broadcast where they are few."""
    return F.broadcast(keys) if keys.count() <= FEW_IDS else keys


def _around(known: DataFrame, crowded: DataFrame, places: list[list[int]], scratch: Scratch) -> DataFrame:
    """(id) of all fingerprints that may meet a member of a crowded bucket (s, v, centre) within the bucket's ball."""
    centres = crowded.select(F.col("s").alias("own"), "centre.id", *[f"centre.{w}" for w in WORDS])
    ball_of = scratch.write(_under(centres, places, 1, "own").filter("s = own").select("s", "v").distinct(), "crowds")
    return scratch.write(_under(known, places, 1).join(_small(ball_of), ["s", "v"], "left_semi").select("id").distinct(), "around")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1_024):
            part = batch.slice(start, 1_024)
            sketches = [np.frombuffer(x.as_py(), "<i4") for x in part.column(1)]
            sizes = np.array([len(x) for x in sketches])
            ids = np.repeat(part.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(sizes, sizes).astype("<i2")), pa.array(np.concatenate(sketches))], names=["id", "n", "h"])


def _lonely(ids: DataFrame, fps: DataFrame) -> DataFrame:
    """(id) of those fingerprints that can't be verified with any other of ``ids``.

    Of a sketch with n hashes, u of them in no other one, at most n - u are
    shared, and whatever ``resemblance`` divides by is n or more.
    """
    hashes = fps.join(_small(ids), "id", "left_semi").select("id", "sketch").mapInArrow(tidy(_spread), "id long, n short, h int")
    single = hashes.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("top"), F.min("n").alias("n")).filter("id = top")
    return single.groupBy("id", "n").agg(F.count("*").alias("u")).filter((F.col("n") - F.col("u")) / F.col("n") < RESEMBLANCE).select("id")


def _verified(pairs: DataFrame, fps: DataFrame) -> DataFrame:
    """The pairs whose texts resemble each other enough; sketches of few documents are picked before they move."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    if ids.count() <= FEW_IDS:
        fps = fps.join(F.broadcast(ids), "id", "left_semi")
    x, y = (fps.select(F.col("id").alias(c), F.col("sketch").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(_resembling), "a long, b long")


def _met(some: DataFrame, others: DataFrame, ordered: F.Column) -> DataFrame:
    """Pairs (a, b) of rows of ``_under`` in different components that meet, once for each segment that they meet in."""
    once = (F.col("x.flip") < F.col("y.flip")) | ((F.col("x.flip") == 0) & (F.col("y.flip") == 0))
    met = some.alias("x").join(others.alias("y"), ["s", "v"])
    met = met.filter(once & ordered & (F.col("x.c") != F.col("y.c")) & (_distance("x", "y", ("f3",)) <= MAX_CHECK_BITS))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def wide_links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) links among distinct fingerprints (id, f0..f3, sketch)."""
    places = plan_wide(fps.count())[1]
    alone = _under(fps, places, 0, *WORDS)
    low = [F.min_by(w, "id").alias(w) for w in WORDS]
    buckets = alone.groupBy("s", "v").agg(F.min("id").alias("id"), *low, F.count("*").alias("n")).filter("n > 1")
    buckets = scratch.write(buckets.select("s", "v", "n", F.struct("id", *WORDS).alias("centre")), "buckets")
    star = _star(alone, buckets.select("s", "v", "centre"))
    crowded = buckets.filter(F.col("n") > CROWD)
    crowds = not crowded.isEmpty()
    if crowds:
        members = scratch.write(alone.join(crowded.select("s", "v"), ["s", "v"]), "members")
        some = members.withColumn("k", F.row_number().over(W.partitionBy("s", "v").orderBy(F.xxhash64("id"), "id"))).filter(F.col("k") <= CROWD)
        middle = some.select("s", "v", *WORDS).groupBy("s", "v").applyInArrow(_majority, "s short, v long, f0 long, f1 long, f2 long, f3 long")
        middle = middle.select("s", "v", F.struct(*WORDS).alias("middle"))
        near = members.join(middle, ["s", "v"]).select("s", "v", F.struct("id", *WORDS).alias("x"), "middle")
        near = near.groupBy("s", "v").agg(F.min_by("x", F.struct(_distance("x", "middle"), "x.id")).alias("centre"))
        star = star.union(_star(members, near))
    star = scratch.write(_verified(scratch.write(star.distinct(), "candidates"), fps), "star")
    labels = component_labels(fps.sparkSession, star, scratch=scratch)
    known = fps.join(labels, "id", "left").select("id", *WORDS, F.coalesce("comp", "id").alias("c"))
    known = whole = scratch.write(known, "known")
    scratch.sweep()
    under = lambda df: _under(df, places, 1, "c", "f3")
    apart = None
    if crowds:
        around = _around(known, crowded, places, scratch)
        lonely = _small(scratch.write(_lonely(around, fps), "lonely"))
        apart = scratch.write(under(known.join(lonely, "id", "left_semi")), "apart")
        elsewhere = known.join(_small(around), "id", "left_anti")
        known = known.join(lonely, "id", "left_anti")
    sizes = labels.groupBy(F.col("comp").alias("c")).agg(F.count("*").alias("size")).filter(F.col("size") > GIANT)
    giants = scratch.write(sizes.select("c"), "giants")
    few, many = known.join(giants, "c", "left_anti"), known.join(giants, "c", "left_semi")
    met = _met(under(few), under(few), F.col("x.id") < F.col("y.id"))
    if not giants.isEmpty():
        met = met.union(_met(under(few), under(many), F.lit(True)))
    if giants.count() > 1:
        # Of several giants in a bucket, the members outside the one with the largest name meet the others.
        there = under(many)
        top = there.groupBy("s", "v").agg(F.max("c").alias("top"), F.min("c").alias("low")).filter("low <> top").select("s", "v", "top")
        there = scratch.write(there.join(top, ["s", "v"]), "there")
        met = met.union(_met(there.filter("c <> top"), there, (F.col("y.c") == F.col("y.top")) | (F.col("x.id") < F.col("y.id"))))
    if apart is not None and not apart.isEmpty():
        buckets = _small(apart.select("s", "v").distinct())
        met = met.union(_met(apart, under(elsewhere).join(buckets, ["s", "v"], "left_semi"), F.lit(True)))
    met = scratch.write(met, "met").distinct()
    whole = whole.select("id", *WORDS)
    pairs = met.join(whole.alias("x"), F.col("a") == F.col("x.id")).join(whole.alias("y"), F.col("b") == F.col("y.id")).filter(_distance("x", "y") <= MAX_BITS)
    near = scratch.write(pairs.select("a", "b"), "near")
    return scratch.write(star.union(_verified(near, fps)), "links")


def wide_classes(docs: DataFrame, shingle: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, component_id) of each row of ``docs``."""
    scratch = scratch or Scratch(docs.sparkSession, "wide")
    rows = scratch.write(wide_fingerprints(docs, shingle).withColumn("id", F.xxhash64(*WORDS)), "fps", TEXT_ROWS)
    distinct = scratch.write(rows.groupBy("id", *WORDS).agg(F.min("doc_id").alias("first"), F.max("sketch").alias("sketch")), "distinct")
    labels = component_labels(docs.sparkSession, wide_links(distinct.drop("first"), scratch), scratch=scratch)
    classes = distinct.select("id", "first").join(labels, "id", "left").select("id", "first", F.coalesce("comp", "id").alias("c"))
    lowest = classes.groupBy("c").agg(F.min("first").alias("component_id"))
    return rows.select("id", "doc_id").join(classes.join(lowest, "c").select("id", "component_id"), "id").select("doc_id", "component_id")


def keep_first(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id; same columns.

    Documents without an id stay, as nothing can name them as copies.
    """
    scratch = Scratch(docs.sparkSession, "wide")
    gone = wide_classes(docs, shingle, scratch).filter("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, scratch.write(gone, "gone"))
