"""Repeated passages by collinear chaining of shared k-mer seeds.

1. Each text gives winnowed seeds: of any `window` neighbouring 5-word shingles
   the one with the smallest hash, so an exact run of window + 4 words always
   has one.
2. A seed that several documents share links each of them to the one with the
   smallest doc_id: links grow with the seeds and never with their square.
   Where near seeds lead to different places, each pair of them, up to 8 seeds
   apart, with its distance and each run of 4 or 8 is a key of its own and links to the first
   document with that key, so a passage whose parts come first in several
   documents is found as a whole, also where edits took seeds between.
3. The links of a document to one earlier document are chained: matches in
   order in both, a gap costs in proportion to its words on both sides, the best
   predecessor comes from a Fenwick tree of prefix maxima.
4. Chains are aligned word by word between their seeds and extended over
   differing words by a banded alignment while that pays; passages of 50 words
   or more that agree in 0.8 of them are reported.
"""

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, cut, stored, text_batches, trim, word_bounds


@dataclass(frozen=True)
class Params:
    k: int = 5
    window: int = 6
    min_words: int = 50
    similarity: float = 0.8
    gap_cost: float = 0.1
    margin: int = 48
    band: int = 6
    drop: int = 16


#: Ids of eight bytes each that are broadcast at most.
BROADCAST_IDS = 500_000
#: Seeds in a key, where single ones don't lead to one place.
RUNS = (4, 8)
#: A pair of seeds in a key has fewer shared seeds than this between them: edits leave out seeds on one side only.
REACH = 8
#: Bits of a distance within a key.
SPAN = 16
_MULTIPLIERS = [pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)]


#: Bytes of a line whose words are hashed together, few enough for a core's cache, and of a word that is hashed so at most.
_STRETCH, _LONG = 1 << 15, 256
_ROOT = 0x9E3779B97F4A7C15
_SALTS = np.array([xxhash.xxh64_intdigest(bytes([b]).lower(), 42) for b in range(256)], np.uint64)
_POWERS, _INVERSES = (np.cumprod(np.array([1] + [root] * (_STRETCH - 1), np.uint64)) for root in (_ROOT, pow(_ROOT, -1, 1 << 64)))


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, ASCII letters in lower case; number of words of each text).

    A hash is a polynomial of the word's bytes: sums over the line up to the
    word's end and up to its start, their difference shifted back by the power
    of the start, so no word becomes a Python object.
    """
    line, edges, many = word_bounds(texts)
    starts, ends = edges[::2].copy(), edges[1::2].copy()
    codes, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + _STRETCH, "right")))
        if ends[stop - 1] - low <= _STRETCH:
            sums = np.zeros(ends[stop - 1] - low + 1, np.uint64)
            np.cumsum(_SALTS.take(line[low : ends[stop - 1]]) * _POWERS[: len(sums) - 1], out=sums[1:])
            first = starts[at:stop] - low
            codes[at:stop] = (sums[ends[at:stop] - low] - sums[first]) * _INVERSES.take(first)
        at = stop
    codes ^= codes >> np.uint64(32)
    codes *= np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(32)
    for i in np.flatnonzero(ends - starts > _LONG).tolist():
        codes[i] = xxhash.xxh64_intdigest(line[starts[i] : ends[i]].tobytes().lower(), 42)
    return codes, many


def seeds(codes: np.ndarray, many: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, positions, numbers of their texts) of the winnowed shingles, at every place, of texts with `many` words each."""
    n = len(codes) - p.k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(p.k):
        h += codes[i : i + n] * np.uint64(_MULTIPLIERS[i])
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    begin, shingles = np.cumsum(many) - many, np.maximum(many - p.k + 1, 0)
    found = []
    windows = max(0, n - p.window + 1)
    if windows:
        places = np.arange(n)
        least, low = h[:windows].copy(), places[:windows].copy()
        for i in range(1, p.window):
            smaller = h[i : i + windows] < least
            np.copyto(least, h[i : i + windows], where=smaller)
            np.copyto(low, places[i : i + windows], where=smaller)
        # windows inside one text: as many start in it as it has shingles, less those that would end behind
        inside = np.where(shingles > p.window, shingles - p.window + 1, 0)
        start = np.arange(inside.sum()) + np.repeat(begin - (np.cumsum(inside) - inside), inside)
        low = low[start]
        found.append(low[np.concatenate([[True], low[1:] != low[:-1]])[: len(low)]])  # the first smallest one never moves back
    short = np.flatnonzero((shingles > 0) & (shingles <= p.window))
    if len(short):
        found.append(np.array([b + h[b : b + m].argmin() for b, m in zip(begin[short], shingles[short], strict=True)]))
    at = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    owner = np.searchsorted(begin + many, at, "right")
    return h[at].view(np.int64), at - begin[owner], owner


def chain(pos: list[int], other: list[int], k: int, gap_cost: float) -> list[list[int]]:
    """Best-scoring disjoint collinear chains of matches, as lists of indexes in order.

    score(i) = k + max(0, score(j) - gap_cost * ((pos_i - pos_j) + (other_i - other_j)))
    over matches j that lie before i on both sides.
    """
    n = len(pos)
    order = sorted(range(n), key=[*zip(pos, other, strict=True)].__getitem__)
    score, before = [float(k)] * n, [-1] * n
    if all(pos[j] < pos[i] and other[j] < other[i] for j, i in zip(order, order[1:], strict=False)):
        # all in order on both sides: gaps add up, so a match's best predecessor is the one just before
        for j, i in zip(order, order[1:], strict=False):
            gain = score[j] + gap_cost * (pos[j] + other[j]) - gap_cost * (pos[i] + other[i])
            if gain > 0:
                score[i], before[i] = k + gain, j
        return _taken(pos, other, score, before)
    rank = {v: r for r, v in enumerate(sorted(set(other)), 1)}
    size = len(rank)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)
    waiting: list[tuple[int, float, int]] = []
    here = None
    for i in order:
        if pos[i] != here:
            for r, q, j in waiting:
                while r <= size:
                    if tree[r][0] < q:
                        tree[r] = (q, j)
                    r += r & -r
            waiting, here = [], pos[i]
        mine = rank[other[i]]
        r, best = mine - 1, (float("-inf"), -1)
        while r > 0:
            if tree[r][0] > best[0]:
                best = tree[r]
            r -= r & -r
        place = gap_cost * (pos[i] + other[i])
        gain = best[0] - place
        score[i] = k + max(0.0, gain)
        if gain > 0:
            before[i] = best[1]
        waiting.append((mine, score[i] + place, i))
    return _taken(pos, other, score, before)


def _taken(pos: list[int], other: list[int], score: list[float], before: list[int]) -> list[list[int]]:
    """Chains from their best ends back, each up to a match that a better one has."""
    chains, used = [], [False] * len(pos)
    for i in sorted(range(len(pos)), key=[*zip([-x for x in score], pos, other, strict=True)].__getitem__):
        found = []
        while i >= 0 and not used[i]:
            used[i] = True
            found.append(i)
            i = before[i]
        if found:
            chains.append(found[::-1])
    return chains


def pieces(found: list[int], pos: list[int], other: list[int], most: int) -> list[list[int]]:
    """A chain, cut where its matches lie more than `most` words apart: extension bridges less, and more isn't one passage."""
    out = [[found[0]]]
    for i, j in zip(found, found[1:], strict=False):
        if max(pos[j] - pos[i], other[j] - other[i]) > most:
            out.append([])
        out[-1].append(j)
    return out


def _common(a: list[int], b: list[int]) -> int:
    """Words in common, in order."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            up = row[j + 1]
            row[j + 1] = left + 1 if x == y else max(up, row[j])
            left = up
    return row[-1]


def _filled(rows: list[np.ndarray], size: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    out, many = np.full((len(rows), size), fill, np.int64), np.fromiter(map(len, rows), np.int64, len(rows))
    if len(rows):
        out[np.arange(size) < many[:, None]] = np.concatenate(rows)
    return out, many


def extend(a: list[np.ndarray], b: list[np.ndarray], p: Params, cost: int) -> np.ndarray:
    """Rows of (words of a, words of b, words in common): for each pair of stretches, of `margin` words at most, their best starts.

    A common word counts 1, each differing, extra or missing one -cost; of equal
    sums the one with more words in common counts.  Stretches shift against each
    other by at most `band` words, and the search ends where all falls
    `drop` * cost / 2 below the best.  All pairs are worked on together.
    """
    (x, rows), (y, cols) = _filled(a, p.margin, -1), _filled(b, p.margin, -2)
    same = np.logical_and.accumulate(x == y, axis=1).sum(axis=1)
    out = np.stack([same] * 3, axis=1)
    at = np.flatnonzero(same < np.minimum(rows, cols))
    rows, cols = rows[at] - same[at], cols[at] - same[at]
    rest = same[at][:, None] + np.arange(p.margin)
    x = np.take_along_axis(np.pad(x[at], ((0, 0), (0, p.margin)), constant_values=-1), rest, 1)
    y = np.take_along_axis(np.pad(y[at], ((0, 0), (0, p.margin)), constant_values=-2), rest, 1)
    y = np.pad(y, ((0, 0), (p.band, 2 * p.band)), constant_values=-2)
    # a cell holds its sum times `unit`, plus its words in common; column c of row u stands for word u - band + c of b
    width, never = 2 * p.band + 1, -(1 << 28)
    unit = 1 << p.margin.bit_length()
    step, low = cost * unit, -p.drop * cost // 2
    ramp = step * np.arange(width, dtype=np.int32)
    offset = np.arange(width) - p.band
    row = np.full((len(at), width + 1), never, np.int32)
    row[:, :-1] = np.where((offset >= 0) & (offset <= cols[:, None]), -step * offset, never)
    best, live = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for u in range(1, p.margin + 1):
        live &= rows >= u
        if 4 * live.sum() < 3 * len(live):
            at, x, y, row, rows, cols, best, live = (v[live] for v in (at, x, y, row, rows, cols, best, live))
        if not len(at):
            break
        slant = row[:, :-1] + np.where(y[:, u - 1 : u - 1 + width] == x[:, u - 1 : u], np.int32(unit + 1), np.int32(-step))
        there = (u + offset >= 0) & (u + offset <= cols[:, None])
        cells = np.where(there, np.maximum(slant, row[:, 1:] - step), np.int32(never))
        row[:, :-1] = np.where(there, np.maximum.accumulate(cells + ramp, axis=1) - ramp, never)
        column = row.argmax(axis=1)
        top = row[np.arange(len(at)), column]
        value = top // unit
        better = live & (value > best)
        best[better] = value[better]
        i = at[better]
        out[i] = same[i][:, None] + np.stack([np.full(len(i), u), u + offset[column[better]], top[better] % unit], axis=1)
        live &= value >= best + low
    return out


def align(stretches: list[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]], p: Params) -> list[tuple[int, int, int, int, int]]:
    """For each chain (words, other words, matches): (start, end, other start, other end, words in common)."""
    bodies, before, after = [], [], []
    for doc, other, matches in stretches:
        x, y = a, b = matches[0]
        same = p.k
        for m, n in matches[1:]:
            step, other_step = m - x, n - y
            if step == other_step <= p.k:  # most matches overlap alike
                same += step
            else:  # words between two matches, or one match a little closer on one side
                least = min(step, other_step, p.k)
                gap, other_gap = doc[x + p.k : m + p.k - least].tolist(), other[y + p.k : n + p.k - least].tolist()
                same += least + (len(gap) if gap == other_gap else _common(gap, other_gap))
            x, y = m, n
        end, other_end = x + p.k, y + p.k
        bodies.append((a, end, b, other_end, same))
        before.append((doc[max(0, a - p.margin) : a][::-1], other[max(0, b - p.margin) : b][::-1]))
        after.append((doc[end : end + p.margin], other[other_end : other_end + p.margin]))
    best: list = [None] * len(bodies)
    last: list = [None] * len(bodies)
    todo = [*range(len(bodies))]
    for cost in (2, 1, 4):  # a cost of 1 goes on over more differing words, one of 4 keeps the agreement of what is added at 0.8
        ends = extend(*zip(*[before[i] for i in todo], *[after[i] for i in todo], strict=True), p, cost).tolist() if todo else []
        again = []
        for i, (m, n, more), (u, v, yet) in zip(todo, ends[: len(todo)], ends[len(todo) :], strict=True):
            a, end, b, other_end, same = bodies[i]
            out = last[i] = a - m, end + u, b - n, other_end + v, same + more + yet
            if is_passage(out, p) and (best[i] is None or out[1] - out[0] > best[i][1] - best[i][0]):
                best[i] = out
            # what agrees nearly everywhere ends where it ends
            if not (best[i] and (cost == 1 or best[i][4] > 0.95 * (best[i][1] - best[i][0]))):
                again.append(i)
        todo = again
    return [one or two for one, two in zip(best, last, strict=True)]


def is_passage(found: tuple[int, int, int, int, int], p: Params) -> bool:
    start, end, other_start, other_end, same = found
    return end - start >= p.min_words and same >= p.similarity * max(end - start, other_end - other_start)


def _code_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, codes): word hashes, cut to 32 bits, as bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("passages")
        for whole in batches:
            for batch, texts in text_batches(whole):
                codes, many = word_codes(texts)
                bounds = np.concatenate([[0], 4 * np.cumsum(many)]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(codes.astype(np.uint32))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "codes"])

    return docs.mapInArrow(rows, "doc_id bigint, codes binary")


def _seed_rows(docs: DataFrame, p: Params) -> DataFrame:
    """(seed, doc_id, pos); pos is ~pos where the document has the seed before."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("passages")
        for whole in batches:
            for batch, texts in text_batches(whole):
                codes, many = word_codes(texts)
                taken = many >= p.min_words
                if not taken.all():
                    codes = codes[np.repeat(taken, many)]
                h, place, owner = seeds(codes, many[taken], p)
                order = np.argsort(h, kind="stable")
                again = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
                later = order[1:][again]
                place[later] = ~place[later]
                ids = batch.column("doc_id").to_numpy()[taken][owner]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids), pa.array(place.astype(np.int32))], ["seed", "doc_id", "pos"])

    return docs.mapInArrow(rows, "seed bigint, doc_id bigint, pos int")


def shared_seeds(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, links of (pos, seed, keep_id, keep_pos)): each place of a shared seed, with its first place in the document with the smallest id that has it.

    The first document of a seed is found with partial sums, and the join back
    is one that Spark can split where a seed is very common.
    """
    found = _seed_rows(docs, p)
    first = found.groupBy("seed").agg(F.min("doc_id").alias("keep_id"), F.min_by("pos", F.expr("CASE WHEN pos >= 0 THEN doc_id END")).alias("keep_pos"), F.max("doc_id").alias("last_id"))
    shared = first.where("last_id > keep_id").drop("last_id")
    place = F.when(F.col("pos") < 0, F.bitwise_not("pos")).otherwise(F.col("pos")).alias("pos")
    return found.join(shared, "seed").groupBy("doc_id").agg(F.collect_list(F.struct(place, "seed", "keep_id", "keep_pos")).alias("links"))


def runs(pos: np.ndarray, seed: np.ndarray, keep: np.ndarray, keep_pos: np.ndarray, known: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of the pairs and runs of near shared seeds that don't lead to one stretch of one document and aren't all known to be in passages.

    A place is the position of the first seed, shifted by SPAN bits, and the
    distance of the last one; its complement where the key was there before.
    """
    order = np.argsort(pos, kind="stable")
    pos, seed, keep, keep_pos, known = pos[order].astype(np.int64), seed[order].view(np.uint64), keep[order], keep_pos[order], known[order]
    unknown = np.concatenate([[0], np.cumsum(~known)])
    breaks = np.concatenate([[0], np.cumsum((np.diff(keep) != 0) | (np.diff(keep_pos) != np.diff(pos)))])
    keys, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for members in [*((0, i) for i in range(1, REACH + 1)), *(tuple(range(size)) for size in RUNS)]:
        last = members[-1]
        n = len(pos) - last
        if n < 1:
            continue
        span = pos[last:] - pos[:n]
        at = np.flatnonzero((unknown[last + 1 :] > unknown[:n]) & (breaks[last:] > breaks[:n]) & (span <= len(members) * p.min_words // 2))
        # edits of single words leave a distance as it is; only of neighbours is it left open
        key = span[at].astype(np.uint64) << np.uint64(8) if len(members) == 2 and last > 1 else np.zeros(len(at), np.uint64)
        key += np.uint64(len(members))
        for i in members:
            key = (key ^ seed[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        keys.append(key.view(np.int64))
        places.append((pos[at] << SPAN) | span[at])
    key, place = np.concatenate(keys), np.concatenate(places)
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    return key, np.where(np.concatenate([[False], key[1:] == key[:-1]])[: len(key)], ~place, place)


_LINE = ["doc_id", "keep_id", "origin", "stop", "keep_origin", "keep_stop", "matches", "sizes", "place"]
_LINE_KINDS = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.binary(), pa.int64()]
_LINE_SCHEMA = "doc_id bigint, keep_id bigint, origin int, stop int, keep_origin int, keep_stop int, matches binary, sizes binary, place bigint"


def solid(pos: np.ndarray, keep_pos: np.ndarray, p: Params) -> bool:
    """Whether a chain's seeds alone make a passage: enough words, and the words of seeds are enough of them."""
    span, other = pos[-1] + p.k - pos[0], keep_pos[-1] + p.k - keep_pos[0]
    if span < p.min_words:
        return False
    same = p.k + np.minimum(np.minimum(np.diff(pos), np.diff(keep_pos)), p.k).sum()
    return bool(same >= p.similarity * max(span, other))


def promising(doc_id: int, pos: np.ndarray, keep: np.ndarray, keep_pos: np.ndarray, p: Params) -> Iterator[tuple[tuple, np.ndarray]]:
    """Chains of two seeds or more, each with the stretches of both documents that its alignment reads, and the numbers of its matches."""
    order = np.argsort(keep, kind="stable")
    bounds = np.flatnonzero(np.diff(keep[order])) + 1
    for part in np.split(order, bounds):
        if len(part) < 2:
            continue
        a, b = pos[part].tolist(), keep_pos[part].tolist()
        for whole in chain(a, b, p.k, p.gap_cost):
            for found in pieces(whole, a, b, p.margin):
                if len(found) < 2:
                    continue
                lo, hi, keep_lo, keep_hi = a[found[0]], a[found[-1]] + p.k, b[found[0]], b[found[-1]] + p.k
                places = [x for j in found for x in (a[j], b[j])]
                line = doc_id, int(keep[part[0]]), max(0, lo - p.margin), hi + p.margin, max(0, keep_lo - p.margin), keep_hi + p.margin, struct.pack(f"<{len(places)}i", *places)
                yield line, part[found]


def together(lines: list[tuple]) -> Iterator[tuple]:
    """Chains whose stretches overlap as one line, so that words are fetched once: a text that goes round has one chain a round.

    A line has the union of its chains' stretches, all their matches, and how
    many each has.  The union on the other side is no longer than its parts.
    """
    group: list = []
    for line in sorted(lines, key=lambda x: (x[1], x[2], x[4])):
        doc_id, keep_id, origin, stop, keep_origin, keep_stop, matches = line
        if group and group[1] == keep_id and origin <= group[3]:
            low, high, total = min(group[4], keep_origin), max(group[5], keep_stop), group[8] + keep_stop - keep_origin
            if high - low <= total:
                group[3:6], group[8] = [max(group[3], stop), low, high], total
                group[6].append(matches)
                group[7].append(len(matches) // 8)
                continue
        if group:
            yield (*group[:6], b"".join(group[6]), np.array(group[7], "<i4").tobytes())
        group = [doc_id, keep_id, origin, stop, keep_origin, keep_stop, [matches], [len(matches) // 8], keep_stop - keep_origin]
    if group:
        yield (*group[:6], b"".join(group[6]), np.array(group[7], "<i4").tobytes())


def _lines(rows: DataFrame, each: Callable[[int, pa.StructArray], tuple[list[tuple], np.ndarray, np.ndarray]]) -> DataFrame:
    """(doc_id, links) -> the lines that each(doc_id, links) gives, and its keys of runs as rows with a place and no stretches."""
    lines, keys = slice(0, len(_LINE) - 1), [_LINE.index(n) for n in ("doc_id", "keep_id", "place")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("passages")
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                lists, out = batch.column("links"), []
                runs_of = [[np.empty(0, np.int64)] for _ in keys]
                for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                    found, key, place = each(doc_id, lists[i].values)
                    out.extend(found)
                    for column, values in zip(runs_of, (np.full(len(key), doc_id, np.int64), key, place), strict=True):
                        column.append(values)
                columns = list(zip(*out, strict=True)) if out else [()] * len(_LINE[lines])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _LINE_KINDS[lines], strict=True)), pa.nulls(len(out), _LINE_KINDS[-1])], _LINE)
                many = dict(zip(keys, map(np.concatenate, runs_of), strict=True))
                size = len(many[0])
                yield pa.RecordBatch.from_arrays([pa.array(many[j], t) if j in many else pa.nulls(size, t) for j, t in enumerate(_LINE_KINDS)], _LINE)

    return rows.mapInArrow(run, _LINE_SCHEMA)


def _chains(docs: DataFrame, p: Params) -> DataFrame:
    """One row per promising chain, over links of single seeds and links of pairs and runs, of which the first and the last seed are matches."""
    none = np.empty(0, np.int64)

    def seeds_of(doc_id: int, links: pa.StructArray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        pos, seed, keep, keep_pos = (links.field(n).to_numpy(zero_copy_only=False) for n in ("pos", "seed", "keep_id", "keep_pos"))
        mine, known = np.flatnonzero(keep < doc_id), np.zeros(len(pos), bool)
        lines = []
        for line, found in promising(doc_id, pos[mine], keep[mine], keep_pos[mine], p):
            lines.append(line)
            if solid(pos[mine[found]], keep_pos[mine[found]], p):
                known[mine[found]] = True
        return [*together(lines)], *runs(pos, seed, keep, keep_pos, known, p)

    def runs_of(doc_id: int, links: pa.StructArray) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        place, keep, keep_place = (links.field(n).to_numpy(zero_copy_only=False) for n in ("place", "keep_id", "keep_place"))
        span = (1 << SPAN) - 1
        ends = [np.stack([place >> SPAN, keep, keep_place >> SPAN]), np.stack([(place >> SPAN) + (place & span), keep, (keep_place >> SPAN) + (keep_place & span)])]
        pos, keep, keep_pos = np.unique(np.concatenate(ends, axis=1), axis=1)
        return [*together([line for line, _ in promising(doc_id, pos, keep, keep_pos, p)])], none, none

    lines = stored(_lines(shared_seeds(docs, p), seeds_of))
    found = lines.where("place IS NOT NULL").select(F.col("keep_id").alias("key"), "doc_id", "place")
    first = found.groupBy("key").agg(F.min("doc_id").alias("keep_id"), F.min_by("place", F.expr("CASE WHEN place >= 0 THEN doc_id END")).alias("keep_place"), F.max("doc_id").alias("last_id"))
    place = F.when(F.col("place") < 0, F.bitwise_not("place")).otherwise(F.col("place")).alias("place")
    by_doc = found.join(first.where("last_id > keep_id").drop("last_id"), "key").where("doc_id > keep_id").groupBy("doc_id").agg(F.collect_list(F.struct(place, "keep_id", "keep_place")).alias("links"))
    return lines.where("place IS NULL").union(_lines(by_doc, runs_of)).drop("place")


def _pairs(words: np.ndarray) -> np.ndarray:
    """Neighbouring words as one number each."""
    return (words[:-1].astype(np.uint64) << np.uint64(32)) | words[1:]


def may_agree(mine: np.ndarray, there: np.ndarray, p: Params) -> bool:
    """False only if no passage of two stretches, given as pairs of words, can be long and alike enough.

    A passage of n words of which m = similarity * n agree has at most n - m
    breaks on either side, so m - 1 - 2 (n - m) pairs of neighbouring words, at
    least, are common to both.
    """
    least = p.min_words * (3 * p.similarity - 2) - 1
    there = np.sort(there)
    if not len(there):
        return least <= 0
    at = np.minimum(np.searchsorted(there, mine), len(there) - 1)
    return int((there[at] == mine).sum()) >= least


@dataclass
class _Chain:
    """A chain of a line: its matches, the widest gap it may have, what its alignment found, and its parts where that is no passage."""

    line: int
    pairs: list[tuple[int, int]]
    most: int
    found: tuple[int, int, int, int, int] | None = None
    parts: list["_Chain"] = field(default_factory=list)


def _parts(chain: _Chain, p: Params) -> list[_Chain]:
    """A chain that is no passage may hold one and more: its parts between wide gaps; a chain is cut at most twice."""
    most = chain.most
    a, b = zip(*chain.pairs, strict=True)
    while most > 2 * p.k:
        most //= 2
        parts = pieces([*range(len(a))], a, b, most)
        if len(parts) > 1:
            return [_Chain(chain.line, [chain.pairs[j] for j in part], most) for part in parts if len(part) > 1]
    return []


def aligned(lines: list[tuple], p: Params) -> Iterator[tuple]:
    """Passages of lines (doc_id, keep_id, origin, keep_origin, matches, sizes, words, keep_words); chains are aligned in blocks of 1,024."""
    around = p.window + p.k
    codes = [(np.frombuffer(x[6], np.uint32), np.frombuffer(x[7], np.uint32)) for x in lines]
    pairs_of = [(_pairs(doc), _pairs(other)) for doc, other in codes]
    whole: list[list[_Chain]] = []
    for i, (_, _, origin, keep_origin, matches, sizes, _, _) in enumerate(lines):
        places = np.frombuffer(matches, np.int32).reshape(-1, 2) - np.array([origin, keep_origin])
        chains = sorted((c.tolist() for c in np.split(places, np.cumsum(np.frombuffer(sizes, "<i4"))[:-1])), reverse=True)
        whole.append([_Chain(i, pairs, p.margin) for pairs in chains])
    waiting = [c for chains in whole for c in chains]
    while waiting:
        block, waiting = waiting[-1024:], waiting[:-1024]
        likely = []
        for c in block:
            (first, keep_first), (last, keep_last) = c.pairs[0], c.pairs[-1]
            doc, other = codes[c.line]
            if last + p.k > len(doc) or keep_last + p.k > len(other):
                continue  # another text under the same doc_id
            lo, keep_lo = max(0, first - p.margin), max(0, keep_first - p.margin)
            mine, there = pairs_of[c.line]
            if may_agree(mine[lo : last + p.k + p.margin - 1], there[keep_lo : keep_last + p.k + p.margin - 1], p):
                likely.append(c)
        for c, out in zip(likely, align([(*codes[c.line], c.pairs) for c in likely], p), strict=True):
            if is_passage(out, p):
                c.found = out
            else:
                c.parts = _parts(c, p)
                waiting += c.parts
    for (doc_id, keep_id, origin, keep_origin, *_), (doc, _), chains in zip(lines, codes, whole, strict=True):
        inside: list[tuple[int, int]] = []
        left = chains
        while left:
            c = left.pop()
            if any(a <= max(0, c.pairs[0][0] - around) and b >= min(len(doc), c.pairs[-1][0] + p.k + around) for a, b in inside):
                continue  # inside a passage that goes on so far that this chain would have had its next seed there
            if c.found:
                s, e, os, oe, same = c.found
                yield doc_id, s + origin, e - s, keep_id, os + keep_origin, oe - os, same
                inside = [*inside[-31:], (s, e)]
            left += reversed(c.parts)


def _aligned(rows: DataFrame, p: Params) -> DataFrame:
    names = ["doc_id", "start", "n_words", "keep_id", "keep_start", "keep_words", "n_same"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("passages")
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                out = [*aligned([*zip(*(column.to_pylist() for column in batch.columns), strict=True)], p)]
                columns = list(zip(*out, strict=True)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
        trim()

    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_words bigint, keep_id bigint, keep_start bigint, keep_words bigint, n_same bigint")


def passages(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, start, n_words, keep_id, keep_start, keep_words, n_same): passages, in word positions, that a document with a smaller id has too.

    Documents without doc_id, NULL and short texts have none.  doc_id names a
    text; repeated rows of one are the same document.  Repeats inside one
    document aren't passages.

    Words are fetched for the documents of chains alone, by a semi-join on their
    ids: these are broadcast while there are at most BROADCAST_IDS of them.
    Columns other than doc_id and text are left out, whatever their names.
    """
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chains = stored(_chains(docs, p))
    ids = cut(chains.select(F.explode(F.array("doc_id", "keep_id")).alias("doc_id")).distinct())
    small = ids.count() <= BROADCAST_IDS
    codes = _code_rows(docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi"))
    stretch = lambda start, stop: F.substring(F.col("codes"), 4 * F.col(start) + 1, 4 * (F.col(stop) - F.col(start)))
    mine = chains.join(codes, "doc_id").withColumn("words", stretch("origin", "stop")).drop("codes")
    both = mine.join(codes.withColumnRenamed("doc_id", "keep_id"), "keep_id").withColumn("keep_words", stretch("keep_origin", "keep_stop"))
    return _aligned(both.select("doc_id", "keep_id", "origin", "keep_origin", "matches", "sizes", "words", "keep_words"), p).distinct()


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of the ranges and the white space in front of each."""
    data = text.encode()
    spans, at = [], 0
    for word in data.split():
        at = data.index(word, at)
        spans.append((at, at + len(word)))
        at += len(word)
    out, at = [], 0
    for start, stop in sorted(ranges):
        start, stop = spans[min(start, len(spans))][0] if start < len(spans) else len(data), spans[min(stop, len(spans)) - 1][1]
        if stop > at:
            out.append(data[at : max(at, start)].rstrip())
            at = stop
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "replace")


def apply_substrings(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """docs without the passages that an earlier document has; documents of which no word is left go.

    Columns stay as they are; n_chars follows the text.  Rows without passages,
    and those without doc_id or text, pass unchanged.
    """
    ranges = passages(docs, p).groupBy("doc_id").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n_words")).alias("stop"))).alias("ranges of doc"))

    @F.arrow_udf("string")
    def shortened(texts: pa.Array, spans: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.string())]
        for at in range(0, len(texts), 512):
            pairs = zip(texts[at : at + 512], spans[at : at + 512], strict=True)
            parts.append(pa.array([cut_words(t.as_py(), [(x["start"], x["stop"]) for x in s.as_py()]) if s.is_valid and t.is_valid else t.as_py() for t, s in pairs], pa.string()))
        return pa.concat_arrays(parts)

    joined = docs.join(ranges.withColumnRenamed("doc_id", "id of doc"), F.col("doc_id") == F.col("id of doc"), "left")
    new = joined.withColumn("text", shortened("text", "`ranges of doc`")).where(F.col("id of doc").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        new = new.withColumn("n_chars", F.when(F.col("id of doc").isNull(), F.col("n_chars")).otherwise(size))
    return new.select(*docs.columns)


def op5(docs: DataFrame) -> DataFrame:
    return passages(docs.select("doc_id", "text"))
