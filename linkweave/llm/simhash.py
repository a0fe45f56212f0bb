"""Near-duplicate documents by SimHash with multi-index hashing.

Fingerprints: 64 majority bits over the XXH64 values (seed 42) of the text's
word shingles.  Equal fingerprints are merged first, so that groups of exact
copies cost nothing afterwards.

Links: two fingerprints within ``max_bits`` differ by at most r_i bits in some
segment i wherever the sum of (r_i + 1) exceeds ``max_bits``.  Each fingerprint
is stored under its segments' values and looks up the Hamming ball of radius
r_i around each of them; matches are verified over all 64 bits.

Dense groups: a bucket may hold many different fingerprints that all lie close
together.  Three steps keep the work linear there.  First the members of each
bucket are linked with the bucket's smallest fingerprint where the distance
allows, and components of those links are taken.  Then the lookup reports only
pairs whose components still differ.  Buckets beyond ``DENSE`` members stay out
of the lookup; their members, and those that look into them, meet instead in
the common points of their radius-``max_bits/2`` balls: two fingerprints are
within the bound exactly if they share such a point, and grouping by point
never compares two members with each other.

Defined cases: a text without words, a null one included, has fingerprint zero,
which links like any other; documents with a null id have a fingerprint but no
class of their own: their component is that of their fingerprint's class, null
if no document with an id is in it; repeated rows give rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.common import TEXT_ROWS, table, tidy
from linkweave.operators.components import component_labels
from linkweave.plans.scratch import Scratch

SEED = 42
#: Members from which a bucket goes to the meeting points.
DENSE = 4_000
#: Shingles hashed at a time.
BLOCK = 65_536


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of a UTF-8 text, unsigned."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[:n].tolist(), ends[len(words) - n :].tolist()
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([h(flat[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) of each row; the bits of fp are the fingerprint's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, fp long")


def plan_segments(max_bits: int, count: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment for so many fingerprints.

    Segments get about log2(count) bits, as few false candidates as members are
    then met; the radii add up to what the pigeonhole argument needs.
    """
    n = max(1, min(max_bits + 1, 64 // max(16, count.bit_length() + 3)))
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    radii = [(max_bits + 1) // n - 1 + (i < (max_bits + 1) % n) for i in range(n)]
    shifts = [sum(widths[:i]) for i in range(n)]
    return list(zip(shifts, widths, radii, strict=True))


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of ``width`` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flipped(masks: F.Column, value: F.Column, tag: F.Column) -> F.Column:
    return F.transform(masks, lambda m: F.struct(tag, value.bitwiseXOR(m).alias("v")))


def _keys(fp: str, segments: list[tuple[int, int, int]], probe: bool) -> F.Column:
    """Array of (segment, value): the stored values or all that are looked up."""
    parts = []
    for i, (shift, width, radius) in enumerate(segments):
        value = F.shiftrightunsigned(F.col(fp), shift).bitwiseAND(F.lit(_signed((1 << width) - 1)))
        tag = F.lit(i).cast("tinyint").alias("s")
        masks = ball(width, radius) if probe else [0]
        parts.append(_flipped(F.array(*[F.lit(_signed(m)).cast("long") for m in masks]), value, tag))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _near(a: str, b: str, max_bits: int) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def _meeting_points(max_bits: int):
    """Tasks give each point of a member's ball with the point's smallest member."""
    masks = np.array([np.uint64(m) for m in ball(64, max_bits // 2)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 256):
                part = fps[at : at + 256]
                points = (part[:, None] ^ masks[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64)), pa.array(np.repeat(part, len(masks)).view(np.int64))], names=["z", "fp"])

    return run


def fingerprint_links(fps: DataFrame, scratch: Scratch, max_bits: int = 4, dense: int = DENSE) -> DataFrame:
    """(a, b) links whose components are those of all pairs within the bound.

    ``fps`` has one row per distinct fingerprint, in the column fp.
    """
    spark = fps.sparkSession
    segments = plan_segments(max_bits, fps.count())
    stored = fps.select("fp", F.explode(_keys("fp", segments, False)).alias("k")).select("fp", "k.s", "k.v")
    buckets = stored.groupBy("s", "v").agg(F.min("fp").alias("low"), F.count("*").alias("n")).filter("n > 1")
    buckets = scratch.write(buckets, "buckets")
    star = stored.join(buckets, ["s", "v"]).filter((F.col("fp") != F.col("low")) & _near("fp", "low", max_bits))
    star = scratch.write(star.select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct(), "star")
    labels = component_labels(spark, star, scratch=scratch)
    known = scratch.write(fps.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("comp", "fp").alias("c")), "known")

    crowded = buckets.filter(F.col("n") > dense).select("s", "v")
    has_crowd = not crowded.isEmpty()
    left = known.select("fp", "c", F.explode(_keys("fp", segments, True)).alias("k")).select(F.col("fp").alias("a"), F.col("c").alias("ca"), "k.s", "k.v")
    right = known.select("fp", "c", F.explode(_keys("fp", segments, False)).alias("k")).select(F.col("fp").alias("b"), F.col("c").alias("cb"), "k.s", "k.v")
    if has_crowd:
        right = right.join(crowded, ["s", "v"], "left_anti")
    pairs = left.join(right, ["s", "v"]).filter((F.col("ca") != F.col("cb")) & _near("a", "b", max_bits)).select("a", "b")
    links = star.union(pairs)
    if has_crowd:
        members = known.select("fp", F.explode(_keys("fp", segments, True)).alias("k")).select("fp", "k.s", "k.v").join(crowded, ["s", "v"], "left_semi").select("fp").distinct()
        members = scratch.write(members, "crowd")
        points = scratch.write(members.mapInArrow(_meeting_points(max_bits), "z long, fp long").groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("b")), "points")
        meet = members.mapInArrow(_meeting_points(max_bits), "z long, fp long").join(points.filter("a <> b"), "z").filter("fp <> a")
        links = links.union(meet.select("fp", "a").distinct())
    return scratch.write(links, "links")


def near_duplicate_classes(docs: DataFrame, max_bits: int = 4, shingle: int = 4, dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = scratch.write(fingerprints(docs, shingle), "fps", TEXT_ROWS)
    distinct = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = fingerprint_links(distinct.select("fp"), scratch, max_bits, dense)
    labels = component_labels(spark, links, scratch=scratch)
    classes = distinct.join(labels.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("comp", "fp").alias("c"))
    lowest = classes.groupBy("c").agg(F.min("first").alias("component_id"))
    classes = scratch.write(classes.join(lowest, "c").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
