"""Importance resampling towards a target corpus, with bit-sliced weights.

Documents and target are bags of hashed word runs.  A bucket's gain is the
logarithm of the target's share over the corpus's, as a whole number of
thousandths.  A document's weight is the sum of its runs' gains.

The sum is taken bit-sliced: the counts of a document by bucket are planes of
10,000 bits, one for each binary digit of the counts, and the gains are signed
planes, for each digit one plane of the buckets with a positive gain and one of
those with a negative gain.  The ones in the AND of count plane j and gain
plane k weigh 2**(j + k), so the sums of powers of two are exact.
"""

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checksum_sql import crc32_sql
from .common import BLOCK, Memo, claim, cut, text_batches, trim
from .ranks import placed

BUCKETS = 10_000
RUN = 1
SEED = 2024
SCALE = 1000
MIN_WORDS = 20
PERCENT = 10
#: Lower case for A-Z, a space for each ASCII sign that is no letter or digit; bytes of other characters stay as they are.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in blocks, so that a long text's words are never held together."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            end = text.find(b" ", end)  # the word at the border belongs to this block
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


@lru_cache(maxsize=1)
def _known(buckets: int) -> Memo:
    return Memo(lambda feature: zlib.crc32(feature) % buckets)


class Buckets:
    """Bucket counts of texts; the buckets of frequent words are remembered, in one table per Python worker that its tasks share."""

    def __init__(self, buckets: int = BUCKETS, run: int = RUN):
        claim("buckets", _known.cache_clear)
        self.buckets, self.run, self.known = buckets, run, _known(buckets)

    def count(self, text: bytes) -> tuple[int, np.ndarray]:
        """Words, and the buckets of all runs of 1 to `run` words, repeats included."""
        n, found, tail = 0, [], []
        for words in word_blocks(text):
            n += len(words)
            found.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
            if self.run > 1:
                line = tail + words  # runs that begin in the block before end here
                for length in range(2, self.run + 1):
                    first = max(0, len(tail) - length + 1)
                    runs = [b" ".join(line[i : i + length]) for i in range(first, len(line) - length + 1)]
                    found.append(np.fromiter(map(self.known.__getitem__, runs), np.int32, len(runs)))
                tail = line[-(self.run - 1) :]
        return n, np.concatenate(found) if found else np.zeros(0, np.int32)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Features by bucket over all texts; each task gives one row a bucket at most, and so does the result."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = Buckets(buckets, run), np.zeros(buckets, np.int64)
        for whole in batches:
            for _, texts in text_batches(whole):
                for text in texts:
                    total += np.bincount(hashed.count(text)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
        trim()

    out = np.zeros(buckets, np.int64)
    found = docs.select("text").mapInArrow(rows, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed share in the target over that in the corpus), by bucket."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(SCALE * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def planes(values: np.ndarray) -> np.ndarray:
    """Rows of whole numbers from 0 -> their binary digits as bits, [digit, row, words of 64 bits]."""
    width = -(-values.shape[1] // 64) * 64
    digits = max(1, int(values.max(initial=0)).bit_length())
    out = np.zeros((digits, len(values), width), np.uint8)
    for j in range(digits):
        out[j, :, : values.shape[1]] = (values >> j) & 1
    return np.packbits(out, axis=2).view(np.uint64)


class Gains:
    """Signed gains as bit planes."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.plus, self.minus = planes(np.maximum(values, 0)[None])[:, 0], planes(np.maximum(-values, 0)[None])[:, 0]

    def weigh(self, found: list[np.ndarray]) -> list[int]:
        """Exact weights of documents given as lists of buckets.

        The count planes of a batch are built from the buckets that occur: one
        bit for each document, digit and bucket, set where the count has the digit.
        """
        weights = []
        for at in range(0, len(found), 64):
            part = found[at : at + 64]
            owner = np.repeat(np.arange(len(part)), [*map(len, part)])
            cells, counts = np.unique(owner * self.n + np.concatenate([*part, np.zeros(0, np.int32)]), return_counts=True)
            cells, total, words = cells.astype(np.int64), np.zeros(len(part), object), self.plus.shape[1]
            document, bucket = cells // self.n, cells % self.n
            for j in range(int(counts.max(initial=0)).bit_length()):
                has = (counts >> j) & 1 == 1
                bits = np.zeros((len(part), words * 64), np.uint8)
                bits[document[has], bucket[has]] = 1
                rows = np.flatnonzero(bits.any(axis=1))
                plane = np.packbits(bits[rows], axis=1).view(np.uint64)
                sums = np.zeros(len(rows), np.int64)
                for signed, sign in ((self.plus, 1), (self.minus, -1)):
                    for k, gain in enumerate(signed):
                        sums += sign * (np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64) << k)
                total[rows] += sums.astype(object) << j
            weights += [int(x) for x in total]
        return weights


def noise(h: int) -> int:
    """Gumbel noise in thousandths from 32 bits."""
    return math.floor(-SCALE * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): a row for each row of docs.

    rank numbers the drawn rows from 1, NULL for all others: of the N rows with
    at least min_words words the floor(percent * N / 100) highest scores, ties
    to the smaller doc_id, a NULL doc_id first.  NULL and empty texts have no
    features and weight 0; a NULL doc_id is hashed as the empty text.  Repeated
    rows count each time and may each be drawn.  An empty target or corpus has
    no features, which the smoothing covers; an empty table gives an empty one.
    Texts of any length are read in blocks.  Further columns are left out.
    What reaches the driver is one number a bucket.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(gains(bucket_counts(docs, buckets, run), bucket_counts(target, buckets, run)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, weigher = Buckets(buckets, run), Gains(shared.value)
        for whole in batches:
            for batch, texts in text_batches(whole):
                words, found = zip(*map(hashed.count, texts), strict=True)
                weights = weigher.weigh(list(found))
                drawn = [w + noise(int(h, 16)) for w, h in zip(weights, batch.column("h").to_pylist(), strict=True)]
                columns = [pa.array(x, pa.int64()) for x in (words, [*map(len, found)], weights, drawn)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)
        trim()

    h = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    scored = cut(docs.select("doc_id", "text", h.alias("h")).mapInArrow(rows, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint"))
    able = F.col("n_words") >= min_words
    n = scored.where(able).count() * percent // 100
    ranked = placed(scored.where(able).withColumn("nth", F.monotonically_increasing_id()), [F.col("score").desc(), "doc_id", "nth"]).select(*names, F.when(F.col("place") < n, F.col("place") + 1).alias("rank"))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint")))


def op12(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents),
dw AS MATERIALIZED (SELECT doc_id, unnest(words) AS w FROM d), bw AS MATERIALIZED (SELECT unnest({_WORDS}) AS w FROM benchmark),
hashed AS MATERIALIZED (SELECT w, {crc32_sql('w')} % {BUCKETS} AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY bucket),
gains AS (SELECT b.bucket, cast(floor({SCALE} * ln(cast((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM dw) + {BUCKETS}) AS double) / cast((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM bw) + {BUCKETS}) AS double))) AS bigint) AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, cast(sum(gain) AS bigint) AS weight FROM dw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + cast(floor(-{SCALE} * ln(-ln((cast('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS bigint) + 0.5::double) / 4294967296.0::double))) AS bigint) AS score FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM ranked) * {PERCENT} // 100 THEN rank END AS rank, n_features AS n_words FROM scored LEFT JOIN ranked USING (doc_id)"""
