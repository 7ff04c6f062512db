"""SimHash near-duplicates by deletion-variant signatures.

64-bit fingerprints that differ in at most two bits are found by equality joins.
With two 32-bit segments A and B a close pair is of one of three kinds:

- A equal, and one 16-bit half of B differs by at most one bit;
- B equal, and one 16-bit half of A differs by at most one bit;
- A and B differ by one bit each, so one half of B is equal.

So the index holds, for each fingerprint, the exact segment with each one-bit
wildcard of either half of the other one, and each one-bit wildcard of A with
either exact half of B: 128 signatures of 47 known bits.  A signature therefore
has at most 2^17 fingerprints, whatever the corpus.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, cut, map_texts, release, trim
from .components import components

SEED = 42
MAX_BITS = 2
#: Eight bytes each.
BROADCAST_IDS = 500_000
_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of a text's word shingles as a signed 64-bit number; no words give 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=">u8")
    bytes_at = hashes.view(np.uint8).reshape(-1, 8)
    seen = np.bincount((bytes_at + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _TABLE).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): a map over whole texts.  A NULL or empty text has fingerprint 0."""
    return map_texts(docs.select("doc_id", "text"), lambda text: (fingerprint(text, width),), "fp bigint", ["doc_id"])


def signatures(fp: Column) -> Column:
    """Array of (kind, key): what a fingerprint is indexed under."""
    low32, low16 = F.lit(0xFFFFFFFF), F.lit(0xFFFF)
    a, b = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(low32)
    halves = lambda x: (F.shiftrightunsigned(x, 16), x.bitwiseAND(low16))
    out = []
    for kind, (exact, other) in enumerate(((a, b), (b, a))):
        for half, value in enumerate(halves(other)):
            for bit in range(16):
                wild = value.bitwiseAND(F.lit(0xFFFF ^ (1 << bit)))
                out.append((len(out), F.shiftleft(exact, 16).bitwiseOR(wild)))
    for half in halves(b):
        for bit in range(32):
            wild = a.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit)))
            out.append((len(out), F.shiftleft(wild, 16).bitwiseOR(half)))
    # 48 bits of key are in use; the kind goes above them
    return F.array(*[key.bitwiseOR(F.lit(kind << 48)) for kind, key in out])


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> pairs (u, v), u > v, that differ in one or two bits."""
    indexed = fps.select("fp", F.explode(signatures(F.col("fp"))).alias("key"))
    left, right = indexed.select(F.col("fp").alias("u"), "key"), indexed.select(F.col("fp").alias("v"), "key")
    near = (F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
    return left.join(right.hint("merge"), "key").where(near).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, first_id, component_id, n_links): one row per document.

    first_id is the smallest doc_id with the fingerprint, component_id the
    smallest one that is reachable over links; n_links counts the other
    fingerprints within two bits.  Documents with one
    fingerprint are one node, so copies are never expanded into pairs.  Empty
    texts share fingerprint 0 and are linked like any other.  NULL doc_ids are
    carried and never become a component_id unless the component has no other.
    """
    rows = cut(fingerprints(docs, width))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    pairs = cut(links(nodes.select("fp")))
    degree = pairs.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    classes = components(pairs).withColumnsRenamed({"node": "fp", "component": "root"})
    joined = nodes.join(classes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = joined.join(smallest, "root").join(degree, "fp", "left").select("fp", "first_id", "component_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return rows.join(by_fp, "fp").select("doc_id", "fp", "first_id", "component_id", "n_links")


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    codes = np.array([digest(w, SEED) for w in words], np.uint64)
    n = len(codes) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


#: Texts of similarity s share one of BANDS keys of ROWS min-hashes with probability 1 - (1 - s**ROWS)**BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: Documents of a band that all others of it are compared with in one round, at most.
HEADS = 256
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key per band of min-hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        mixed = hashes[at : at + 1024] * _MIX
        mixed ^= mixed >> np.uint64(29)
        np.minimum(low, mixed.min(axis=1), out=low)
    bands = low.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(band.tobytes(), n) - (1 << 63) for n, band in enumerate(bands)]


#: Bands of so many documents or fewer are compared whole, in one group, whose sets one task holds: 5 MB for texts of 300 words.
WHOLE_BAND = 2048


def forest(hashes: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the sets of a group as all their pairs of at least `similarity` would; pairs that are joined already aren't compared."""
    root, found = list(range(len(hashes))), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(hashes):
        for j in range(i):
            b = hashes[j]
            if min(len(a), len(b)) < similarity * max(len(a), len(b)) or top(i) == top(j):
                continue
            same = len(np.intersect1d(a, b, assume_unique=True))
            if same >= similarity * (len(a) + len(b) - same):
                root[top(i)] = top(j)
                found.append((i, j))
    return found


def grouped_links(members: DataFrame, hashed: DataFrame, similarity: float) -> DataFrame:
    """(group, doc_id), at most WHOLE_BAND documents a group -> links (u, v), u > v, that join each group as all its pairs would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sets")
        last, ids, sets = None, [], []

        def flush() -> pa.RecordBatch:
            ends = [(max(ids[i], ids[j]), min(ids[i], ids[j])) for i, j in forest(sets, similarity)]
            return pa.RecordBatch.from_arrays([pa.array([e[n] for e in ends], pa.int64()) for n in (0, 1)], ["u", "v"])

        for batch in batches:
            for group, doc_id, blob in zip(batch.column("group").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("hashes"), strict=True):
                if group != last:
                    if len(ids) > 1:
                        yield flush()
                    last, ids, sets = group, [], []
                ids.append(doc_id)
                sets.append(np.frombuffer(blob.as_py(), np.uint64))
        if len(ids) > 1:
            yield flush()
        trim()

    rows = members.join(hashed, "doc_id").select("group", "doc_id", "hashes")
    return rows.repartition("group").sortWithinPartitions("group", "doc_id").mapInArrow(run, "u bigint, v bigint")


def similar(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(u, v), u > v: near documents by SimHash or of one band whose shingle sets have a Jaccard similarity of at least `similarity`.

    SimHash comes first, as op3 takes it: each document is a candidate with the
    first one of its fingerprint and the first one of its component of
    fingerprints within two bits, so these candidates grow with the documents.
    Whole sets decide, as everywhere here.  At 0.8 fingerprints differ in about
    ten bits, too many for any exact segment to be a key, so bands of min-hashes
    give further candidates beside those of SimHash.  The documents of a band of WHOLE_BAND or fewer meet in one group, where they are joined exactly
    as all their pairs would join them; bands of the same documents are one group.
    Larger bands go in rounds: all of a band are compared with its heads, at
    first the smallest doc_id, then four times as many a round up to HEADS,
    unless the sizes of the two sets rule the similarity out; the heads and those
    near one leave the band, and the rounds go on with the others.  So a round's
    candidates grow with a band, not with its square.  A link between one that
    is near a head and one that isn't is tried in the other bands that both
    share.  Links are enough to give the components, they are not all pairs.
    NULL doc_ids are left out; NULL and empty texts are one shingle, the empty one.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = lambda frame: map_texts(frame, lambda text: (shingle_hashes(text, width).tobytes(),), "hashes binary", ["doc_id"])

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sets")
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                near = []
                for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    same = len(np.intersect1d(a, b, assume_unique=True))
                    near.append(same >= similarity * (len(a) + len(b) - same))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u", "v", "bands")), pa.array(near, pa.bool_())], ["u", "v", "bands", "near"])

    def keys(text: bytes | None) -> tuple:
        hashes = shingle_hashes(text, width)
        return band_keys(hashes), len(hashes)

    keyed = map_texts(docs, keys, "bands array<bigint>, n int", ["doc_id"])
    bands = cut(keyed.select("doc_id", "n", F.explode("bands").alias("band")).distinct())
    several = lambda frame: frame.join(frame.groupBy("band").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("last")).where("last > v").select("band"), "band", "left_semi")
    # only documents that share a band with another one go on, and their sets are made once, as are those of what SimHash links
    waiting = cut(several(bands))
    classes = near_duplicates(docs)
    alike = classes.select(F.col("doc_id").alias("u"), F.explode(F.array_distinct(F.array("first_id", "component_id"))).alias("v"))
    alike = cut(alike.where("u > v").distinct().withColumn("bands", F.array().cast("array<bigint>")))
    ids = cut(waiting.select("doc_id").union(alike.select(F.explode(F.array("u", "v")))).distinct())
    hashed = cut(sets(docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")))
    left, right = hashed.select(F.col("doc_id").alias("u"), F.col("hashes").alias("a")), hashed.select(F.col("doc_id").alias("v"), F.col("hashes").alias("b"))
    sizes = waiting.groupBy("band").agg(F.count("*").alias("members"))
    small = waiting.join(sizes.where(F.col("members") <= WHOLE_BAND), "band")
    groups = small.groupBy("band").agg(F.sort_array(F.collect_list("doc_id")).alias("ids")).select("ids").distinct().withColumn("group", F.monotonically_increasing_id())
    members = groups.select("group", F.explode("ids").alias("doc_id"))
    judge = lambda pairs: cut(pairs.join(left, "u").join(right, "v").select("u", "v", "bands", "a", "b").mapInArrow(verdicts, "u bigint, v bigint, bands array<bigint>, near boolean"))
    near, heads = [judge(alike).where("near").select("u", "v"), cut(grouped_links(cut(members), hashed, similarity))], 1
    waiting = cut(waiting.join(sizes.where(F.col("members") > WHOLE_BAND), "band", "left_semi"))
    while not waiting.isEmpty():
        # each band's heads, and all others of the band against each of them; a pair that shares several bands is compared once
        head = waiting.groupBy("band", F.pmod(F.xxhash64("doc_id"), F.lit(heads)).alias("part")).agg(F.min(F.struct("doc_id", "n")).alias("first"))
        head = head.select("band", F.col("first.doc_id").alias("head"), F.col("first.n").alias("size"))
        tried = waiting.join(head, "band").where((F.col("doc_id") != F.col("head")) & (F.least("n", "size") >= similarity * F.greatest("n", "size")))
        pairs = tried.groupBy(F.greatest("doc_id", "head").alias("u"), F.least("doc_id", "head").alias("v")).agg(F.collect_set("band").alias("bands"))
        judged = judge(pairs)
        near.append(judged.where("near").select("u", "v"))
        # heads and what is near one have met all that their band can tell them
        met = head.select(F.col("head").alias("doc_id"), "band").union(judged.where("near").select(F.explode(F.array("u", "v")).alias("doc_id"), "bands").select("doc_id", F.explode("bands").alias("band")).distinct())
        waiting = cut(several(waiting.join(met, ["doc_id", "band"], "left_anti")))
        release(docs.sparkSession)
        heads = min(4 * heads, HEADS)
    return reduce(DataFrame.union, near)


def apply_simhash(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest doc_id, in docs' own columns.

    Near means a Jaccard similarity of word shingles of at least `similarity`.
    Candidates are documents that op3 links, by fingerprints of three-word
    shingles, and those of one band of min-hashes.  Repeated rows with
    the kept doc_id stay, as rows without a doc_id do.
    """
    drop = components(similar(docs, width, similarity)).where("node <> component").select(F.col("node").alias("doc_id"))
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
