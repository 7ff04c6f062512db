"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest.  New rows are digested,
thinned to one per digest, anti-joined with the index and appended, so the
index is never rewritten.  Everything is DataFrame operations.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, conf, cut, remove, shared_folder


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the text with each run of ASCII white space as one space; NULL is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256)


#: Ids that the point between the two batches is chosen from.
PROBES = 101


class DigestIndex:
    """Digest -> doc_id of the row that stays, as table `name` in the session's catalog, its files in the shared folder or at `path`."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(conf(spark, "spark.sql.shuffle.partitions", "200"))
        self.path = path or f"{shared_folder(spark)}/{self.name}"
        self.id_type = "bigint"

    def read(self) -> DataFrame:
        if self.spark.catalog.tableExists(self.name):
            return self.spark.table(self.name)
        return self.spark.createDataFrame([], f"digest string, keep_id {self.id_type}")

    def append(self, digests: DataFrame) -> None:
        """Add the digests that the index lacks, each with the smallest doc_id.

        Both the grouping and the anti-join use the digest; with as many shuffle
        partitions as buckets neither side of the join is shuffled for it again.
        """
        self.id_type = digests.schema["doc_id"].dataType.simpleString()
        first = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        if self.spark.catalog.tableExists(self.name):
            first = first.join(self.read().hint("merge"), "digest", "left_anti")
        first.repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)

    def append_batches(self, digests: DataFrame) -> None:
        """Append all of it in two batches, the smaller doc_ids first, so that the smallest doc_id of a digest stays.

        Ids need an order only: the batches meet at the middle one of a hundred
        ids that a hash picks, so they are about equally large.
        """
        probes = digests.where("doc_id IS NOT NULL").groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(PROBES)).alias("part")).agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(1))).alias("id"))
        ids = F.sort_array(F.collect_list("id"))
        middle = probes.agg(F.get(ids, F.floor(F.size(ids) / 2).cast("int")).alias("id")).first()["id"]
        if middle is None:
            return self.append(digests)
        self.append(digests.where(F.col("doc_id") <= F.lit(middle)))
        self.append(digests.where((F.col("doc_id") > F.lit(middle)) | F.col("doc_id").isNull()))

    def drop(self) -> None:
        """Forget the table and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """All columns of docs but text, with text_sha256, keep_id, group_size and kept; the index gains docs' new digests.

    NULL text equals the empty one.  keep_id is the smallest non-NULL doc_id of
    the first call that had the digest; group_size counts this call's rows.
    Of repeated rows with the kept doc_id one stays.  A group without any doc_id
    keeps one row.  doc_ids may be of any type with an order.  Texts of any
    length are digested whole.  Columns of docs that clash with an added name are dropped.
    Texts are digested once.  Groups are summed before they are shuffled, and
    the join that gives each row its group is one that Spark can split where
    thousands of copies share a digest.
    """
    added = {"text", "text_sha256", "keep_id", "group_size", "kept"}
    columns = [c for c in docs.columns if c.lower() not in added]
    rows = cut(docs.select(*columns, digest(F.col("text")).alias("text_sha256"), F.monotonically_increasing_id().alias("number of row")))
    digests = rows.select(F.col("text_sha256").alias("digest"), "doc_id")
    index.append_batches(digests)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("number of row").alias("row"))
    groups = rows.groupBy(F.col("text_sha256").alias("digest")).agg(F.count("*").alias("group_size"), F.min(order)["row"].alias("first row"))
    known = groups.join(index.read(), "digest").withColumnRenamed("digest", "digest of group")
    joined = rows.join(known, F.col("text_sha256") == F.col("digest of group"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("number of row") == F.col("first row"))
    return joined.select(*columns, "text_sha256", "keep_id", "group_size", kept.alias("kept"))


def apply_exact(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, in docs' own columns.

    The texts are shuffled once, by digest and doc_id, so that a large group of
    copies spreads over the tasks; the index side has one row per digest.
    """
    index = DigestIndex(docs.sparkSession)
    try:
        index.append_batches(docs.select("doc_id", digest(F.col("text")).alias("digest")))
        keep = cut(index.read())
    finally:
        index.drop()
    tagged = docs.withColumns({"digest of text": digest(F.col("text")), "id of row": F.col("doc_id")})
    same = (F.col("digest of text") == keep["digest"]) & F.col("id of row").eqNullSafe(keep["keep_id"])
    nth = F.row_number().over(Window.partitionBy("digest of text", "id of row").orderBy("id of row"))
    return tagged.join(keep, same, "left_semi").withColumn("nth of row", nth).where("`nth of row` = 1").select(*docs.columns)


def op7(docs: DataFrame) -> DataFrame:
    index = DigestIndex(docs.sparkSession)
    try:
        return cut(dedup(docs.select("doc_id", "text"), index).select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
    finally:
        index.drop()
