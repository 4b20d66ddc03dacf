"""Connected components of a link table, without collecting a group anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlabel.session import settle


def _centre_on_smallest(neighbours: DataFrame) -> DataFrame:
    """Rows (u, v) with the smallest of u and all its v as `m`. The minimum combines before its shuffle;
    the join back is a plain equi-join, so that a hub with very many links is split at run time."""
    smallest = neighbours.groupBy("u").agg(F.min("v").alias("m"))
    smallest = smallest.select("u", F.least("u", "m").alias("m"))
    return neighbours.join(smallest, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    linked = _centre_on_smallest(both).filter(F.col("v") > F.col("u"))
    return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    linked = _centre_on_smallest(down).select("u", "v", "m")
    pairs = F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
    out = linked.select(F.explode(pairs).alias("p")).select("p.*")
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that can be reached from each node of `edges`.

    Alternates large-star and small-star steps, which need about log(n) rounds however long a chain is.
    Each round is written to the shared folder, so a lost executor costs one round at most. Nodes may be
    of any ordered type. Links with a NULL end and links of a node to itself are ignored; a node without
    links is not in the result; an empty table gives an empty result.
    """
    known = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    now, mark = settle(known.distinct(), "links"), None
    while True:
        count, digest = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if count == 0 or (count, digest) == mark:
            break
        mark = (count, digest)
        now = settle(_small_star(_large_star(now)), "links")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
