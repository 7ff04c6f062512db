"""Places of rows in a total order, without a window over the whole table."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import conf, cut

#: monotonically_increasing_id() has the row's place in its partition below this bit and the partition above.
_BITS = 33


def placed(frame: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """Add `name`, the row's place from 0 in the order given; `name_part` is the sorted partition that it lies in.

    Rows are range-partitioned by the whole order and sorted there, so a key
    that holds a third of all rows is spread as far as the later keys tell rows
    apart.  The sorted rows are cut off in the shared folder: sampling, counting
    and numbering see the same partitions, also after an executor is lost.  Only
    one number a partition is summed in one place.  `frame` is read twice, once
    for the sample of keys; cut it first if it is dear.
    """
    n = int(conf(frame.sparkSession, "spark.sql.shuffle.partitions", "200"))
    raw, part = f"{name}_raw", f"{name}_part"
    rows = cut(frame.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(raw, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftright(raw, _BITS))
    counts = rows.groupBy(part).agg(F.count("*").alias("rows of part"))
    before = counts.select(part, (F.sum("rows of part").over(Window.orderBy(part)) - F.col("rows of part")).alias("rows before"))
    within = F.col(raw).bitwiseAND(F.lit((1 << _BITS) - 1))
    return rows.join(F.broadcast(before), part).withColumn(name, F.col("rows before") + within).drop(raw, "rows before")


def before(rows: DataFrame, weight: str, place: str = "place", block: int = 1 << 16) -> DataFrame:
    """Add `weight_before`, the sum of `weight` over all rows placed before, and `weight_total`.

    Three levels: within blocks of neighbouring rows, over the blocks of a
    stretch, over the stretches; each level's rows are dealt over the tasks.
    """
    rows = rows.withColumns({"block": F.floor(F.col(place) / block), "stretch": F.floor(F.col(place) / (block * block))})
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(weight).over(up_to(Window.partitionBy("block").orderBy(place))), F.lit(0))
    blocks = rows.groupBy("stretch", "block").agg(F.sum(weight).alias("of_block"))
    stretches = blocks.groupBy("stretch").agg(F.sum("of_block").alias("of_stretch"))
    outer = stretches.select("stretch", F.coalesce(F.sum("of_stretch").over(up_to(Window.orderBy("stretch"))), F.lit(0)).alias("before_stretch"), F.sum("of_stretch").over(Window.partitionBy()).alias(f"{weight}_total"))
    middle = blocks.select("stretch", "block", F.coalesce(F.sum("of_block").over(up_to(Window.partitionBy("stretch").orderBy("block"))), F.lit(0)).alias("before_block"))
    starts = middle.join(F.broadcast(outer), "stretch").select("block", (F.col("before_stretch") + F.col("before_block")).alias("before_block"), f"{weight}_total")
    return rows.withColumn("within", inner).join(starts, "block").withColumn(f"{weight}_before", F.col("before_block") + F.col("within")).drop("block", "stretch", "within", "before_block")
