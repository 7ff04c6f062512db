"""Read and write the jobs' tables: game lines, clean games, node, edge and prediction files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_FILE_BYTES = 128 * 1024 * 1024
PREDICTION_SCHEMA = "source string, target string, observed bigint, wins bigint, total_source bigint, total_target bigint, prediction double"
_INTEGER = r"^[+-]?\d{1,18}$"


def read_game_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_sequence_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) lines of old (null, text) sequence files.

    Spark SQL has no reader for them.  The pairs are read and turned into strings
    on the JVM, by the converter that Spark has for such files, and become a
    table there; no row passes through Python.
    """
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    kind = lambda name: jvm.java.lang.Class.forName(f"org.apache.hadoop.io.{name}")
    converter = jvm.org.apache.spark.api.python.WritableToJavaConverter(None)  # it needs a configuration for maps only
    pairs = jvm.org.apache.spark.api.python.PythonHadoopUtil.convertRDD(context.sequenceFile(path, kind("NullWritable"), kind("Text")).rdd(), converter, converter)
    tag = jvm.scala.reflect.ClassTag.Object()
    lines = jvm.org.apache.spark.api.java.JavaPairRDD(pairs, tag, tag).values().rdd()
    return DataFrame(spark._jsparkSession.createDataset(lines, jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)


def write_clean(clean: DataFrame, path: str, partitions: int | None = None) -> None:
    (clean.repartition(partitions) if partitions else clean).write.mode("overwrite").option("compression", "snappy").parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def to_lines(rows: DataFrame) -> DataFrame:
    """Columns joined by semicolons."""
    return rows.select(F.concat_ws(";", *[F.col(c).cast("string") for c in rows.columns]).alias("value"))


def write_lines(rows: DataFrame, path: str, sort_by: list[str] | None = None, partitions: int | None = None, single: bool = False) -> None:
    """Headless `;` text, replacing what is there, sorted within each file.

    partitions: that many files of equal size, rows being dealt by all of
    sort_by, so that a key which many rows share is spread.  single: one file,
    which is written in parts by all tasks and merged afterwards.
    """
    if partitions:
        rows = rows.repartition(partitions, *(sort_by or []))
    if sort_by:
        rows = rows.sortWithinPartitions(*sort_by)
    to_lines(rows).write.mode("overwrite").text(path)
    if single:
        merge_files(rows.sparkSession, path)


def merge_files(spark: SparkSession, path: str) -> None:
    """Join the part files of a folder, in their order, to one, through the file system and without a task.

    The joined file is written under a hidden name first and takes its own name
    once it is whole; the parts go last.
    """
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(settings)
    parts = sorted((s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    if len(parts) < 2:
        return
    hidden, whole = (jvm.org.apache.hadoop.fs.Path(folder, name) for name in ("_merging", "merged.txt"))
    out = files.create(hidden, True)
    try:
        for part in parts:
            source = files.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()
    if not files.rename(hidden, whole):
        raise OSError(f"can't name the merged file in {path}")
    for part in parts:
        files.delete(part, False)


def files_for(rows: int, line_bytes: int, target: int = TARGET_FILE_BYTES) -> int:
    """How many files of at most about `target` bytes hold so many lines; with several, each is over half of that."""
    return max(1, -(-rows * line_bytes // target))


def write_bucketed(rows: DataFrame, table: str, key: str, path: str | None = None, buckets: int | None = None) -> None:
    """Write rows as Parquet bucketed and sorted by key, as a table of the session's catalog, replacing it.

    Tables with equally many buckets meet on their keys without a shuffle:
    edges by source and nodes by archetype.  path: where the files lie, which on
    a cluster must be shared storage; else the warehouse.
    """
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    writer = rows.repartition(n, key).write.mode("overwrite").bucketBy(n, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def _whole(fields, i: int):
    text = F.get(fields, F.lit(i))
    return F.when(text.rlike(_INTEGER), text.cast("bigint"))


def parse_node_lines(lines: DataFrame) -> DataFrame:
    """(archetype, count) of lines with two fields or more and a whole count; others are ignored."""
    fields = F.split("value", ";", -1)
    return lines.select(F.get(fields, F.lit(0)).alias("archetype"), _whole(fields, 1).alias("count")).where("count IS NOT NULL")


def parse_edge_lines(lines: DataFrame) -> DataFrame:
    """(source, target, count, wins) of lines with three fields or more; missing wins are 0."""
    fields = F.split("value", ";", -1)
    return lines.select(
        F.get(fields, F.lit(0)).alias("source"),
        F.get(fields, F.lit(1)).alias("target"),
        _whole(fields, 2).alias("count"),
        F.coalesce(_whole(fields, 3), F.lit(0)).alias("wins"),
    ).where("count IS NOT NULL")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return parse_node_lines(spark.read.text(path))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return parse_edge_lines(spark.read.text(path))


def write_predictions(predicted: DataFrame, path: str, single: bool = False) -> None:
    """Seven columns, the prediction with four decimals and always a dot."""
    write_lines(predicted.withColumn("prediction", F.round("prediction", 4).cast("decimal(38,4)")), path, single=single)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_SCHEMA).option("sep", ";").csv(path)


def line_sizing(lines: DataFrame, table: str) -> DataFrame:
    """One row: text lines, their bytes, and the partitions that give files of 128 MiB."""
    size = lines.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("value")), F.lit(0)).cast("bigint").alias("bytes"))
    return size.select(F.lit(table).alias("table_name"), "rows", "bytes", F.greatest(F.lit(1), F.ceil(F.col("bytes") / TARGET_FILE_BYTES)).cast("bigint").alias("partitions"))


def sizing(rows: DataFrame, table: str) -> DataFrame:
    """The same for a table's rows as they would be written."""
    return line_sizing(to_lines(rows), table)
