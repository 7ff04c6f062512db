"""Heavy keys found by a sketch before a shuffle, and a deal of rows that spreads only them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One sketch for so many partitions, so that no single task merges those of all keys, and sketches in all, below what Spark aggregates by hash.
PER_SKETCH, MOST_GROUPS = 16, 64
#: A key is heavy from this share of a partition's mean; its rows go to parts of about PART of the mean, so that hashing evens out.
HEAVY, PART = 0.5, 0.125
#: Items that a sketch tracks at least; Spark allows up to a million.
LEAST_ITEMS, MOST_ITEMS = 1024, 1_000_000


def partitions_of(rows: DataFrame, partitions: int | None) -> int:
    return partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def heavy_keys(rows: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """(key, parts) of keys with over HEAVY of a partition's mean rows, and how many parts to split them into.

    Keys are hashed to groups, and each group has a frequent-items sketch that
    map tasks fill and reducers merge, so only sketches are shuffled.  A sketch
    of m items is off by at most 3.5 / m of its group's rows; m is chosen so that
    this stays below a fourth of a partition's mean, which keeps every key of
    three fourths of it or more on the list.  The list has at most
    partitions / HEAVY keys, all others being lighter.  NULL keys are never listed.
    """
    n = partitions_of(rows, partitions)
    most, groups = int(n / HEAVY) + 1, max(1, min(MOST_GROUPS, n // PER_SKETCH))
    items = min(MOST_ITEMS, max(LEAST_ITEMS, 16 * n // groups, most))
    grouped = rows.where(F.col(key).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(groups)).alias("group"))
    sketches = grouped.agg(F.expr(f"approx_top_k({key}, {most}, {items})").alias("top"), F.count("*").alias("rows"))
    total = sketches.agg(F.sum("rows").alias("total"))
    found = sketches.select(F.inline("top")).crossJoin(F.broadcast(total))
    share = F.col("count") * n / F.col("total")
    return found.where(share > HEAVY).select(F.col("item").alias(key), F.ceil(share / PART).cast("int").alias("parts"))


def deal(rows: DataFrame, key: str, spread_by: str, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of light keys dealt by key, and those of heavy keys dealt by key and `salt`, a hash of spread_by.

    The list of heavy keys is bounded by the number of partitions and is
    broadcast.  Rows of one key and one spread_by stay together, so count them
    together first if they may be many.
    """
    heavy = F.broadcast(heavy_keys(rows, key, partitions))
    light = rows.join(heavy, key, "left_anti")
    split = rows.join(heavy, key).withColumn("salt", F.pmod(F.xxhash64(spread_by), F.col("parts"))).drop("parts")
    n = [partitions] if partitions else []
    return light.repartition(*n, key), split.repartition(*n, key, "salt")
