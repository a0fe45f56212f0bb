"""Questions about components; all share one labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators.components import component_labels
from linkweave.operators.graph import Graph


def labels(g: Graph, isolated: bool = True) -> DataFrame:
    """(id, comp): the smallest id of each vertex's component.

    Without ``isolated``, vertices that have no edge are left out.
    """
    own = component_labels(g.edges.sparkSession, g.edges)
    if not isolated:
        return own
    return g.vertices.join(own, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def component_sizes(g: Graph) -> DataFrame:
    """(comp, size) of components with an edge."""
    return labels(g, False).groupBy("comp").agg(F.count("*").alias("size"))


def component_members(g: Graph) -> DataFrame:
    """(comp, members, size) of components with an edge."""
    return labels(g, False).groupBy("comp").agg(F.sort_array(F.collect_list("id")).alias("members"), F.count("*").alias("size"))


def num_components(g: Graph) -> DataFrame:
    """The number of components with an edge, as one row."""
    return labels(g, False).agg(F.count_distinct("comp").alias("n_components"))


def component_of(g: Graph, ids: DataFrame) -> DataFrame:
    """(id, member): the component of each asked vertex; an isolated one is alone."""
    own = labels(g)
    return ids.select("id").join(own, "id").join(own.withColumnRenamed("id", "member"), "comp").select("id", "member")


def component_bitmaps(g: Graph) -> DataFrame:
    """(comp, bucket, bitmap): the members of each component as bitmaps of 32768 ids.

    Buckets are numbered as Spark does: 1 has the ids 1 to 32768, 0 has -32767 to 0.
    """
    own = labels(g, False).select("comp", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit"))
    return own.groupBy("comp", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def connected(g: Graph, pairs: DataFrame) -> DataFrame:
    """``pairs(pair_id, u, v)`` with ``connected``; unknown vertices are connected with nothing."""
    own = labels(g)
    a = own.select(F.col("id").alias("u"), F.col("comp").alias("cu"))
    b = own.select(F.col("id").alias("v"), F.col("comp").alias("cv"))
    return pairs.join(a, "u", "left").join(b, "v", "left").select("pair_id", "u", "v", F.coalesce(F.col("cu") == F.col("cv"), F.lit(False)).alias("connected"))
