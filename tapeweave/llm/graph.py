"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.session import materialize


def components(links: DataFrame, most: int = 100) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b: long); root is the least node reachable.

    Large-star and small-star steps in turn: every node passes its least neighbour to its greater, then to its
    lesser neighbours, until only stars are left. Each step is two shuffles of pairs and is written to the
    shared folder, so lineage stays short; the number of steps grows with the logarithm of the longest path.
    A self link makes a component of one node.
    """
    edges = materialize(
        links.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v >= u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lesser = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = (
            large.join(lesser, F.col("u") == F.col("w"))
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .filter("u >= v")
            .distinct()
        )
        edges = materialize(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        seen = tuple(state)
    raise RuntimeError("the components did not settle")
