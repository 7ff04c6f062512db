"""Hard negatives by rotated one-bit codes with exact re-scoring.

Vectors of whole numbers are rotated and coded by signs: a code is +1 or -1 in
each dimension, its alignment the mean of the vector along it.  What the code
leaves over, the residual, is coded by signs again, LEVELS times, and the norm
of the last residual is kept.  The inner product of two codes is their width
minus twice the ones of their XOR, so the inner product of two vectors is
estimated from popcounts and alignments alone.  By Cauchy-Schwarz it lies off
the estimate by |residual a| |sum of b's codes| + |sum of a's codes| |residual b|
+ |residual a| |residual b| at most.  No interval ever misses the true value,
so pairs whose interval can't reach a result are left out, and all others are
scored with whole numbers: results are exact.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import conf, cut
from .ranks import placed

SCALE = 256
LEVELS = 5
SEED = 13
#: Anchors that one job works on: its broadcast has at most so many vectors and codes.
BLOCK = 4096
#: Rows and anchors of one piece of work inside a task.
TILE_ROWS, TILE_ANCHORS = 2048, 64
#: Whole-number products are exact in doubles up to here.
EXACT = 1 << 53


def rotation(width: int) -> np.ndarray:
    """A random orthogonal matrix, the same on each machine for a width."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + width).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


class Codes:
    """Sign codes, alignments and norms of the rows of a matrix of whole numbers."""

    def __init__(self, values: np.ndarray, turn: np.ndarray, levels: int = LEVELS):
        rest = values @ turn
        n, width = rest.shape
        self.width, self.bits, self.align = width, np.zeros((levels, n, -(-width // 64)), np.uint64), np.zeros((levels, n))
        for level in range(levels):
            positive = rest >= 0
            padded = np.zeros((n, self.bits.shape[2] * 64), np.uint8)
            padded[:, :width] = positive
            self.bits[level] = np.packbits(padded, axis=1).view(np.uint64)
            self.align[level] = np.abs(rest).mean(axis=1)
            rest = rest - np.where(positive, 1.0, -1.0) * self.align[level][:, None]
        self.residual = np.linalg.norm(rest, axis=1)
        self.coded = np.linalg.norm(values @ turn - rest, axis=1)

    def part(self, at) -> "Codes":
        out = object.__new__(Codes)
        out.width, out.bits, out.align, out.residual, out.coded = self.width, self.bits[:, at], self.align[:, at], self.residual[at], self.coded[at]
        return out


def intervals(a: Codes, b: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of all rows of a with all rows of b."""
    shape = len(a.residual), len(b.residual)
    estimate, part, product = np.zeros(shape, np.float32), np.empty(shape, np.float32), np.empty(shape, np.float32)
    differ, ones = np.empty(shape, np.uint64), np.empty(shape, np.uint8)
    weight = b.align.astype(np.float32)
    for i in range(len(a.bits)):
        part[:] = a.width * weight.sum(axis=0)
        for j in range(len(b.bits)):
            for w in range(a.bits.shape[2]):
                np.bitwise_xor(a.bits[i][:, None, w], b.bits[j][None, :, w], out=differ)
                np.bitwise_count(differ, out=ones)
                np.multiply(ones, 2 * weight[j], out=product)
                part -= product
        part *= a.align[i].astype(np.float32)[:, None]
        estimate += part
    off = a.residual[:, None] * (b.coded + b.residual)[None] + a.coded[:, None] * b.residual[None]
    off += 1.0 + 1e-4 * (a.residual + a.coded)[:, None] * (b.residual + b.coded)[None]  # far more than the rounding of the sums above
    return estimate - off, estimate + off


def comparable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where these hold all products and sums exactly, else as 64-bit numbers."""
    most = a.shape[1] * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if most >= 1 << 63:
        raise ValueError("components are too large for inner products of 64 bits")
    kind = np.float64 if most < EXACT else np.int64
    return a.astype(kind), b.astype(kind)


def exact(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (rows[i] of a, columns[i] of b), which comparable() has made."""
    out = np.zeros(len(rows), np.int64)
    for at in range(0, len(rows), 1 << 14):
        to = at + (1 << 14)
        out[at:to] = np.einsum("ij,ij->i", a[rows[at:to]], b[columns[at:to]])
    return out


class Best:
    """The k best (score, id) of each of n searches, higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.owner, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        owner, score, ids = np.concatenate([self.owner, owner]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = nth < self.k
        self.owner, self.score, self.id = owner[kept], score[kept], ids[kept]
        full = owner[nth == self.k - 1]
        self.least[full] = score[nth == self.k - 1]


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """Of each row, -inf where it has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def prepared(vectors: DataFrame, label: Column, is_anchor: Column) -> DataFrame:
    """(vec_id, label, anchor, width, vec): usable rows, components as floor(256 * x)."""
    wide = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad
    vec = F.transform(wide, lambda x: F.floor(x * SCALE))
    return vectors.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("int").alias("label"), is_anchor.alias("anchor"), F.size("embedding").alias("width"), vec.alias("vec"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(rows: DataFrame, anchors: dict, n: int, wanted: int, levels: int) -> DataFrame:
    """(search, score, id): the best rows that each task finds for each of n searches of a block; anchors is broadcast.

    A search is an anchor (the best rows of its label) or, where anchors has
    `search_of`, an anchor and a band of scores (the best rows of other labels inside).
    """
    shared, banded = rows.sparkSession.sparkContext.broadcast(anchors), "search_of" in anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        turn, starts = rotation(a["vec"].shape[1]), range(0, len(a["ids"]), TILE_ANCHORS)
        codes = Codes(a["vec"], turn, levels)
        # searches of a tile's anchors lie side by side
        first_search = [int(np.searchsorted(a["search_of"], x)) if banded else min(x, n) for x in [*starts, len(a["ids"])]]
        best = [Best(hi - lo, wanted) for lo, hi in zip(first_search, first_search[1:], strict=False)]
        for whole in batches:
            for at in range(0, whole.num_rows, TILE_ROWS):
                batch = whole.slice(at, TILE_ROWS)
                ids, labels, vec = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("vec"))
                mine, (theirs, own) = Codes(vec, turn, levels), comparable(a["vec"], vec)
                for t, first in enumerate(starts):
                    tile = slice(first, first + TILE_ANCHORS)
                    low, high = intervals(codes.part(tile), mine)
                    same = a["label"][tile][:, None] == labels[None]
                    if banded:
                        low[same], high[same] = np.nan, np.nan  # no comparison holds for them
                        _bands(a, range(first_search[t], first_search[t + 1]), first, 100 * low, 100 * high, theirs, own, ids, best[t])
                        continue
                    same &= a["ids"][tile][:, None] != ids[None]
                    floor = np.maximum(best[t].least, kth_largest(np.where(same, low, -np.inf), wanted))
                    i, j = np.nonzero(same & (high >= floor[:, None]))
                    best[t].add(i, exact(theirs, own, i + first, j), ids[j])
        for t, one in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(one.owner + first_search[t]), pa.array(one.score), pa.array(one.id)], ["search", "score", "id"])

    return rows.select("vec_id", "label", "vec").mapInArrow(run, "search bigint, score bigint, id bigint")


def _bands(a: dict, searches: range, first: int, low: np.ndarray, high: np.ndarray, theirs: np.ndarray, own: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """One tile's searches for rows in a band; low and high are a hundred times the intervals' ends."""
    found = []
    for n, s in enumerate(searches):
        i, least, most = a["search_of"][s] - first, a["low"][s], a["high"][s]
        lo, hi = low[i], high[i]
        sure = lo[(lo >= least) & (hi <= most)]
        j = np.flatnonzero((hi >= max(least, 100 * best.least[n], kth_largest(sure[None], best.k)[0])) & (lo <= most))
        score = exact(theirs, own, np.full(len(j), i + first), j)
        inside = (100 * score >= least) & (100 * score <= most)
        found.append((np.full(int(inside.sum()), n), score[inside], ids[j][inside]))
    if found:
        best.add(*map(np.concatenate, zip(*found, strict=True)))


def _top(found: DataFrame, wanted: int) -> DataFrame:
    """The best of all tasks' findings by search, with their rank from 1."""
    order = Window.partitionBy("search").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def _block(rows: DataFrame, anchors: pa.Table, n_positives: int, n_negatives: int, low: int, high: int, levels: int) -> DataFrame | None:
    """The result of one block of anchors of one length; None without a positive."""
    a = {"ids": anchors.column("vec_id").to_numpy(), "label": anchors.column("label").to_numpy(), "vec": matrix(anchors.column("vec").combine_chunks())}
    positives = _top(_search(rows, a, len(a["ids"]), n_positives, levels), n_positives).where("score >= 0").orderBy("search", "rank").toArrow()  # a negative one has an empty band
    if not positives.num_rows:
        return None
    search_of, score = positives.column("search").to_numpy(), positives.column("score").to_numpy()
    a |= {"search_of": search_of, "low": low * score, "high": high * score}
    searches = pa.table({"search": np.arange(len(score)), "anchor_id": a["ids"][search_of], "positive_id": positives.column("id"), "positive_score": score})
    found = _top(_search(rows, a, len(score), n_negatives, levels), n_negatives)
    return found.join(F.broadcast(rows.sparkSession.createDataFrame(searches)), "search").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(
    vectors: DataFrame, label: Column, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, levels: int = LEVELS, block: int = BLOCK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors has vec_id, embedding and label; `label` is the column to compare.
    An anchor's positives are its first n_positives rows of its label with
    another vec_id, its negatives for each of them the first n_negatives rows of
    other labels with low * positive <= 100 * negative <= high * positive, higher
    scores first, ties to the smaller vec_id.  Rows with a NULL id, label,
    vector or component, a component that is not finite, or an empty vector
    take no part; vectors are compared within their length.  A repeated row
    stands once for itself in each place.  No anchors or no rows give an empty
    table.  Further columns are left out.

    Rows are dealt out once.  Anchors are taken in blocks of a fixed number, so
    what a job broadcasts and what the driver holds is bounded, and each block is
    held against all rows by all tasks; tasks send on the best they have seen of
    each search.  Components whose products leave 64 bits are an error.
    """
    spark = vectors.sparkSession
    parts = int(conf(spark, "spark.sql.shuffle.partitions", "200"))
    rows = cut(prepared(vectors, label, is_anchor).withColumn("nth", F.monotonically_increasing_id()).repartition(parts, "vec_id", "nth"))
    anchors = cut(placed(rows.where("anchor"), ["width", "vec_id", "nth"]))
    n, out = anchors.count(), []
    for first in range(0, n, block):
        taken = anchors.where((F.col("place") >= first) & (F.col("place") < first + block)).toArrow()
        for width in sorted(set(taken.column("width").to_pylist())):
            found = _block(rows.where(F.col("width") == width), taken.filter(pa.compute.equal(taken.column("width"), width)), n_positives, n_negatives, low, high, levels)
            if found is not None:
                out.append(cut(found))
    empty = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return reduce(DataFrame.union, out, empty)


def op13(vectors: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(vectors, label, F.col("vec_id") % 100 == 0)


OP13_SQL = f"""WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * cast(x AS double))) AS vec
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, cast(list_dot_product(a.vec, b.vec) AS bigint) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.vec) = len(b.vec) AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, cast(row_number() OVER w AS int) AS rank, s.other_id AS negative_id, positive_score, s.score AS negative_score FROM positives JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) QUALIFY row_number() OVER w <= 10"""
