"""Connected components of an edge table by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def _settled(edges: DataFrame) -> bool:
    """Whether each node hangs on one other that hangs on none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("n")), F.struct(F.col("v").alias("node"), F.lit(0).alias("n")))).alias("e")).select("e.*")
    hung = ends.groupBy("node").agg(F.sum("n").alias("times"), F.min("n").alias("least"))
    return hung.where("times > 1 OR (times = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) bigint links -> (node, component), component being the smallest node that is reachable.

    Each round hangs every neighbour on the smallest one it knows; the rounds
    needed grow with the logarithm of the longest path.  Only aggregates and
    joins on the node are used, links never leave the executors, and each round
    is cut off in the shared folder.  Self-links and NULLs are ignored.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = cut(small.where("u <> v").distinct())
        release(edges.sparkSession)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
