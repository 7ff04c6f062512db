"""Best-fit packing planned on the histogram of lengths.

The plan looks at counts by length only: at most `capacity` numbers, whatever
the corpus.  Documents then take its slots by joining on their rank within
their length.
"""

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import conf, cut, text_batches, trim
from .tokens import word_tokenizer

CAPACITY = 4096
END_ID = 1
_PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut at the capacity.

    NULL text is empty: one piece that holds the end id alone.  Repeated rows
    give repeated pieces, other columns are left out whatever their names, and
    a NULL doc_id is carried.
    """
    end = np.array([end_id], "<u4")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer().encode
        for whole in batches:
            for batch, texts in text_batches(whole):
                origin, rows = [], []
                for i, found in enumerate(encode(texts)):
                    packed = np.concatenate([found.astype("<u4"), end]).tobytes()
                    for n, start in enumerate(range(0, len(packed) // 4, capacity)):
                        part = packed[4 * start : 4 * (start + capacity)]
                        origin.append(i)
                        rows.append((n, start, len(part) // 4, zlib.crc32(part), part if ids else None))
                n, start, length, crc, part = zip(*rows, strict=True)
                columns = [batch.column("doc_id").take(pa.array(origin, pa.int64())), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(part, pa.binary())] * ids, names + ["ids"] * ids)
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut_up, f"doc_id {kind}, {_PIECES}" + ", ids binary" * ids)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Counts by length -> runs (length, rank_from, rank_to, first_sequence, offset, per_sequence).

    Longest lengths first, each piece into the fullest sequence that takes it.
    Sequences with equal room are one class of ranges, so a run places many
    pieces at once: rank r goes to first_sequence + (r - rank_from) // per_sequence.
    Every run empties a class or a length and opens two classes at most.
    """
    rooms: list[int] = []  # ascending
    classes: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    next_sequence, runs = 0, []

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in classes:
                classes[room] = []
                insort(rooms, room)
            classes[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, end = 0, histogram[length]
        while rank < end:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = classes[room].pop()
                if not classes[room]:
                    del classes[room], rooms[at]
            else:
                room, first, many = capacity, next_sequence, -(-(end - rank) // (capacity // length))
                next_sequence += many
            per = room // length
            used = min(end - rank, per * many)
            full, rest = divmod(used, per)
            runs.append((length, rank, rank + used, first, capacity - room, per))
            give(room - per * length, first, full)
            give(room - rest * length, first + full, int(rest > 0))
            give(room, first + full + (rest > 0), many - full - (rest > 0))
            rank += used
    return runs


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ...).

    Ranks within a length are dealt over hashed slices, so a length that holds a
    third of all pieces is ranked by many tasks; the slices' counts give each its
    first rank.  The plan has at most a few runs per length and is broadcast.
    Repeated rows get slots of their own.  An empty table packs to an empty one.
    """
    spark = cut_pieces.sparkSession
    slices = int(conf(spark, "spark.sql.shuffle.partitions", "200"))
    rows = cut(cut_pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int")))
    counts = cut(rows.groupBy("length", "slice").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(plan(histogram, capacity), "length bigint, rank_from bigint, rank_to bigint, first_sequence bigint, at bigint, per bigint")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece"))
    ranked = rows.withColumn("nth", within).join(before, ["length", "slice"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    step = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(F.broadcast(runs.withColumnRenamed("length", "run_length")), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(step / F.col("per")).cast("bigint"))
        .withColumn("offset", F.col("at") + F.pmod(step, F.col("per")) * F.col("length"))
        .select(*cut_pieces.columns, "sequence_id", "offset")
    )


def op10(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs))
