"""Edges of a Zipf deck pool, dealt plainly and with hot sources spread: wall times, and rows of the largest task against the median."""

import json
import os
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup_graph.functions.cards import archetypes
from matchup_graph.operators import graph as G
from matchup_graph.operators.skew import deal
from matchup_graph.plans.synth import zipf_games


def loads(*dealt: DataFrame) -> dict:
    """Rows dealt, the largest task's, and the greatest ratio of a largest task to the median task with rows of the same exchange."""
    each = [[r["n"] for r in frame.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()] for frame in dealt]
    each = [x for x in each if x]
    return {"rows": sum(map(sum, each)), "largest": max(map(max, each)), "largest_to_median": round(max(max(x) / median(x) for x in each), 2)}


def main(games: int, partitions: int, ks: list[int]) -> None:
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.local.dir", scratch)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    zipf_games(spark, games).write.parquet(f"{scratch}/games")
    decoded, out = spark.read.parquet(f"{scratch}/games"), {}
    G.edges(decoded, 8).write.format("noop").mode("overwrite").save()
    for k in ks:
        plain = G.sides(decoded).select(F.explode(archetypes(F.col("own"), k)).alias("source"), "other")
        rows = G.deck_pairs(decoded).select(F.explode(archetypes(F.col("own"), k)).alias("source"), "other")
        one = out[f"k{k}"] = {}
        for name, found in (("plain", loads(plain.repartition(partitions, "source"))), ("spread", loads(*deal(rows, "source", "other", partitions)))):
            one[name] = found
        for name, salt in (("plain", 1), ("spread", None)):
            began = time.time()
            one[name]["edges"] = G.packed_edges(decoded, k, salt, partitions).count()
            one[name]["sec"] = round(time.time() - began, 1)
    print(json.dumps({"games": games, "partitions": partitions, **out}))


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 100_000, int(sys.argv[2]) if len(sys.argv) > 2 else 64, [int(k) for k in sys.argv[3].split(",")] if len(sys.argv) > 3 else [1, 2, 7])
