"""Small pieces that several operators share."""

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII white space, as byte strings' own split() and strip() take it.
SPACE = r"[\x20\x09-\x0D]+"
#: Whether Spark removes the shuffle files of a query when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that are worked on together.
BLOCK = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def conf(spark: SparkSession, key: str, default: str) -> str:
    return spark.conf.get(key, default) or default


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; it is an error if the session names none."""
    folder = conf(spark, "spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the cluster's shared folder."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """Cut the lineage with Parquet files in the shared folder: many narrow rows take a fraction of a checkpoint's space there.

    Once they are written, the shuffle files that led to them are removed.
    """
    spark = frame.sparkSession
    path, before = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}", conf(spark, FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of what earlier rounds of a loop left in the driver: Spark's cleaner drops broadcasts and plans only after a collection of garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared storage."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; NULL counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def blobs(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, one at a time; None for NULL."""
    for value in batch.column(name).cast(pa.large_binary()):
        yield value.as_py()


def text_batches(batch: pa.RecordBatch, size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch whose texts have about `size` bytes together, or one longer text alone; NULL is empty."""
    start, texts, held = 0, [], 0
    for i, blob in enumerate(blobs(batch)):
        blob = blob or b""
        if texts and held + len(blob) > size:
            yield batch.slice(start, i - start), texts
            start, texts, held = i, [], 0
        texts.append(blob)
        held += len(blob)
    if texts:
        yield batch.slice(start, batch.num_rows - start), texts


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line of all texts, starts and ends of its words in turn, number of words of each text); words are those of bytes.split()."""
    line = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    white = _WHITE[line]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return line, edges, np.diff(np.searchsorted(edges[::2], np.cumsum(sizes), "right"), prepend=0)


def coded_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each word in order, words by code, number of words of each text); words are those of bytes.split().

    Words and the gaps between them are slices of one line, which Arrow numbers,
    so no word becomes a Python object.  Gaps have codes too, which none of the
    words has.
    """
    line, edges, many = word_bounds(texts)
    bounds = np.concatenate([[0], edges, [len(line)]]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(line)]).dictionary_encode()
    return coded.indices.to_numpy()[1::2], coded.dictionary, many


def map_texts(frame: DataFrame, each: Callable[[bytes | None], tuple], schema: str, keep: list[str], batch_rows: int = 512) -> DataFrame:
    """Carry `keep` along and add `schema`'s columns, computed from the column `text` by each(bytes or None), which has no caches."""
    carried = frame.select(*keep, "text")
    types = {f.name: f.dataType.simpleString() for f in carried.select(*keep).schema}
    added = to_arrow_schema(StructType.fromDDL(schema))
    names = added.names
    whole = ", ".join([*(f"`{k}` {types[k]}" for k in keep), schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("texts")
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                rows = [each(text) for text in blobs(part)]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(pa.array(c, t) for c, t in zip(columns, added.types, strict=True))], [*keep, *names])
        trim()

    return carried.mapInArrow(run, whole)


_owner: dict[str, list[Callable]] = {}


def claim(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Note a cache of this Python worker under its owner, who may have none; the caches of any other owner are emptied.

    Workers live on from stage to stage, so without this each would hold what
    all earlier operators have cached.
    """
    if owner not in _owner:
        for one in [c for cs in _owner.values() for c in cs]:
            one()
        _owner.clear()
        _owner[owner] = []
        trim()
    if clear and clear not in _owner[owner]:
        _owner[owner].append(clear)


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


#: Longer strings are not memoised.
LONG_KEY = 64


class Memo(dict):
    """Computed values by key, in two generations so that memory stays bounded and hot keys stay known."""

    def __init__(self, compute: Callable, limit: int = 120_000):
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if isinstance(key, (str, bytes)) and len(key) > LONG_KEY:  # as a rule one of a kind
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
