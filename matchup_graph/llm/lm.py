"""Language-model scores of whole texts.

The model is one layer of causal self-attention over subword ids with relative
position biases, trained in numpy.  Its output is a softmax over classes of ids;
which id of the class it is depends on the id before.  An attention layer's
direct path, from the id before straight to the output, models pairs of ids, and
its best weights are known from their counts, so they are taken from there: every
training text is counted.  Attention learns what lies beyond pairs, on every
training text too.  Texts are scored in overlapping windows, each token once,
with at least `context` tokens in front of it where the text has them.

The tokenizer is needed by the first pass alone; tasks of all later ones empty it
from their worker, where it would stand beside their own tables.

Nothing depends on how the input is split into partitions: counts are sums of
whole numbers, and training deals texts by hash over shards that are each taken
in hash order.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import claim, coded_words, crc_mod, cut, stored, text_batches, trim
from .tokens import word_tokenizer

BOS, END = 49406, 49407
N_IDS = 49408
FOLDS = 10
#: Words of at least a count that at most this many words have go to every worker; all others are joined.
FREQUENT_WORDS = 300_000
#: Shards whose weights one task sums up; the driver gets these sums, one for so many shards.
SHARDS_PER_SUM = 64
#: Different words that a task goes on with at most, and bytes of text whose words are numbered together.
_FLUSH, _LINE = 400_000, 1 << 22
#: Strides of a gradient that are worked on together.
BLOCK = 128


@dataclass(frozen=True)
class Shape:
    dims: int = 8
    context: int = 16
    stride: int = 16
    classes: int = 32
    rows: int = 2048
    rate: float = 0.1
    batch: int = 1024
    rounds: int = 2
    shard_tokens: int = 4_000_000
    smooth: float = 4.0

    def __post_init__(self):
        if self.context % self.stride:
            raise ValueError("the context must be a multiple of the stride, so that all windows start on one grid")

    @property
    def window(self) -> int:
        return self.context + self.stride


@dataclass
class Vocabulary:
    """Id -> row (the most frequent ids have one each, all others the last but one, BOS the last) and log share of it within its row;
    row -> class; log P(row | class, row before) and log P(class | row before), both from counts of pairs."""

    row: np.ndarray
    share: np.ndarray
    kind: np.ndarray
    inner: np.ndarray
    direct: np.ndarray


def rows_of(counts: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(row, log share within the row) of all ids."""
    mass = counts + 0.1
    order = np.lexsort((np.arange(N_IDS), -counts))
    row = np.full(N_IDS, shape.rows - 2, np.int64)
    row[order[: shape.rows - 2]] = np.arange(shape.rows - 2)
    row[BOS] = shape.rows - 1
    mass[BOS] = 1e-9
    total = np.bincount(row, weights=mass, minlength=shape.rows)
    return row, np.log(mass / total[row]).astype(np.float32)


def classes_of(pairs: np.ndarray, shape: Shape, rounds: int = 12) -> np.ndarray:
    """Row -> class: rows that stand in like places, by k-means on the leading directions of the pair counts."""
    totals = pairs.sum(axis=0) + 1.0
    profile = np.sqrt(pairs / totals[None, :]).T.astype(np.float32)
    rng = np.random.default_rng(0)
    # a few leading directions by subspace iteration
    basis = rng.normal(size=(len(totals), 24)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(profile.T @ (profile @ basis))
    places = profile @ basis
    weight = np.sqrt(totals)
    centres = places[np.argsort(-totals, kind="stable")[: shape.classes]].copy()
    kind = np.zeros(len(totals), np.int64)
    for _ in range(rounds):
        kind = (np.square(centres).sum(axis=1)[None, :] - 2 * places @ centres.T).argmin(axis=1)
        for c in range(len(centres)):
            mine = kind == c
            if mine.any():
                centres[c] = np.average(places[mine], axis=0, weights=weight[mine])
    return kind


def vocabulary(counts: np.ndarray, pairs: np.ndarray, shape: Shape) -> Vocabulary:
    """From counts of all ids and of pairs of rows (before, target)."""
    row, share = rows_of(counts, shape)
    kind = classes_of(pairs, shape)
    mass = np.bincount(row, weights=counts + 0.1, minlength=shape.rows)
    mass[shape.rows - 1] = 1e-9  # BOS is no target
    class_mass = np.bincount(kind, weights=mass, minlength=shape.classes)
    onto = np.zeros((shape.rows, shape.classes))
    onto[np.arange(shape.rows), kind] = 1
    by_class = pairs @ onto
    k = shape.smooth
    inner = np.log((pairs + k * (mass / class_mass[kind])[None, :]) / (by_class[:, kind] + k)).astype(np.float32)
    prior = class_mass / class_mass.sum()
    direct = np.log((by_class + k * (prior + 1e-6)) / (by_class.sum(axis=1, keepdims=True) + k * (1 + 1e-6 * shape.classes))).astype(np.float32)
    return Vocabulary(row, share, kind, inner, direct)


Params = dict[str, np.ndarray]


def start(shape: Shape, seed: int = 0) -> Params:
    """Attention that adds nothing yet: the model is the direct path."""
    rng = np.random.default_rng(seed)
    normal = lambda *size: rng.normal(0, shape.dims**-0.5, size).astype(np.float32)
    return {"q": normal(shape.rows, shape.dims), "k": normal(shape.rows, shape.dims), "v": normal(shape.rows, shape.dims), "rel": np.zeros(shape.window, np.float32), "u": np.zeros((shape.dims, shape.classes), np.float32)}


def _mask(shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(distance, allowed) of scored positions to window positions."""
    far = (np.arange(shape.stride) + shape.context)[:, None] - np.arange(shape.window)[None, :]
    return np.clip(far, 0, shape.window - 1), far >= 0


def layout(texts: list[np.ndarray], v: Vocabulary, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, targets, owner of each stride): all texts on one line, each after `context` paddings (-1), padded to whole strides.

    A text's inputs are BOS and its ids, its targets the ids and END.
    """
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    sizes = shape.context + -(-lengths // shape.stride) * shape.stride
    at = np.concatenate([[0], np.cumsum(sizes)])
    rows, targets = np.full(at[-1], -1, np.int64), np.full(at[-1], -1, np.int64)
    for text, place, n in zip(texts, at[:-1] + shape.context, lengths, strict=True):
        rows[place] = v.row[BOS]
        rows[place + 1 : place + n] = v.row[text]
        targets[place : place + n - 1] = text
        targets[place + n - 1] = END
    return rows, targets, np.repeat(np.arange(len(texts)), sizes // shape.stride)


class Network:
    """Forward and backward passes over stretches of a line: the windows of a stretch are views of it."""

    def __init__(self, p: Params, v: Vocabulary, shape: Shape):
        self.p, self.v, self.shape = p, v, shape
        self.far, self.causal = _mask(shape)
        self.refresh()

    def refresh(self, changed: np.ndarray | slice = slice(None)) -> None:
        """Tables that follow from the weights of changed rows: query, key, value with a one; the last row is the padding's, which has no weight."""
        p, d = self.p, self.shape.dims
        if not hasattr(self, "table"):
            self.table = np.zeros((self.shape.rows + 1, -(-(3 * d + 1) // 8) * 8), np.float32)  # whole vector registers a row
            self.table[:-1, 3 * d] = 1
        for i, n in enumerate("qkv"):
            self.table[:-1, i * d : (i + 1) * d][changed] = p[n][changed]
        self.factor = (np.exp(p["rel"][self.far]) * self.causal).astype(np.float32)

    def forward(self, rows: np.ndarray) -> tuple:
        """Of the positions behind the context: class weights before they are normed, and what the backward pass needs."""
        d, stride, context = self.shape.dims, self.shape.stride, self.shape.context
        many = (len(rows) - context) // stride
        line = self.table.take(rows, axis=0)
        step, item = line.strides
        windows = np.lib.stride_tricks.as_strided(line, (many, self.shape.window, line.shape[1]), (stride * step, step, item), writeable=False)
        q, k, v = line[context:, :d].reshape(many, stride, d), windows[:, :, d : 2 * d], windows[:, :, 2 * d : 3 * d + 1]
        w = np.matmul(q, self.across(line[:, d : 2 * d], many))
        np.exp(w, out=w)
        w *= self.factor
        c = np.matmul(w, v)
        norm = np.float32(1) / np.maximum(c[:, :, d:], np.float32(1e-30))
        c = c[:, :, :d] * norm
        z = c.reshape(-1, d) @ self.p["u"]
        z += self.v.direct.take(rows[context:], axis=0)
        np.exp(z, out=z)
        return z, q, k, line[:, 2 * d : 3 * d + 1], w, c, norm

    def across(self, line: np.ndarray, many: int) -> np.ndarray:
        """Windows of some columns of a line, by column: a product whose right side is a transposed view takes several times as long."""
        columns = np.ascontiguousarray(line.T)
        step, item = columns.strides
        return np.lib.stride_tricks.as_strided(columns, (many, len(columns), self.shape.window), (self.shape.stride * item, step, item), writeable=False)

    def log_probability(self, rows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability; 0 where there is none."""
        v = self.v
        z = self.forward(rows)[0]
        before, goal = rows[self.shape.context :], v.row[targets]
        out = np.log(z.ravel().take(np.arange(0, z.size, z.shape[1]) + v.kind[goal]) / (z @ np.ones(z.shape[1], np.float32)))
        out += v.inner.ravel().take(before * len(v.inner) + goal)  # flat places are found faster than pairs of them
        out += v.share[targets]
        return np.where(targets >= 0, out, np.float32(0))

    def gradient(self, rows: np.ndarray, targets: np.ndarray) -> tuple[float, Params]:
        """Mean loss of the classes and its gradient, that of the tables side by side for the rows that occur.

        Windows are worked on in blocks that stay in a core's cache; gradients of places are summed by row at the end.
        """
        d, step, context = self.shape.dims, BLOCK * self.shape.stride, self.shape.context
        m = max(1, int((targets >= 0).sum()))
        loss, g, places = 0.0, {"u": 0, "rel": 0}, np.zeros((len(rows), 3 * d + d % 2), np.float32)
        for at in range(0, max(1, len(targets)), step):
            more, part = self._gradient(rows[at : at + context + step], targets[at : at + step], m, places[at : at + context + step])
            loss += more
            g = {n: g[n] + part[n] for n in g}
        order = np.argsort(rows.astype(np.int16), kind="stable")
        size = np.bincount(rows + 1, minlength=self.shape.rows + 1)
        seen = np.flatnonzero(size[1:])
        first = np.cumsum(size)[seen]
        # sums go two columns at a time, as complex numbers
        by_row = places.take(order, axis=0).view(np.complex64)
        by_row = np.add.reduceat(by_row, first, axis=0) if len(seen) else by_row[:0]
        return loss, g | {"rows": seen, "qkv": by_row.view(np.float32)[:, : 3 * d]}

    def _gradient(self, rows: np.ndarray, targets: np.ndarray, m: int, places: np.ndarray) -> tuple[float, Params]:
        """A block's share of the loss and of its gradient, of `m` targets in all; that of its places is added to theirs."""
        d, stride, context, window = self.shape.dims, self.shape.stride, self.shape.context, self.shape.window
        z, q, k, v, w, c, norm = self.forward(rows)
        many = len(q)
        has = targets >= 0
        goal = np.arange(0, z.size, z.shape[1]) + self.v.kind.take(self.v.row.take(targets))
        one, share = np.float32(1) / (z @ np.ones(z.shape[1], np.float32)), has / np.float32(m)
        loss = float(-np.log(np.maximum((z.ravel().take(goal) * one)[has], 1e-30)).sum() / m)
        z *= (one * share)[:, None]
        z.ravel()[goal] -= share
        dc = (z @ self.p["u"].T).reshape(many, stride, d)
        g = {"u": c.reshape(-1, d).T @ z}
        back = np.empty((many, stride, d + 1), np.float32)
        np.multiply(dc, norm, out=back[:, :, :d])
        back[:, :, d] = -np.einsum("ijk,ijk->ij", back[:, :, :d], c)
        both = np.empty((many, window, 2 * d), np.float32)
        np.matmul(w.transpose(0, 2, 1), back[:, :, :d], out=both[:, :, d:])
        w *= np.matmul(back, self.across(v, many))
        np.matmul(w.transpose(0, 2, 1), q, out=both[:, :, :d])
        g["rel"] = np.bincount(self.far.ravel(), weights=(w.sum(axis=0) * self.causal).ravel(), minlength=window).astype(np.float32)
        places[context:, :d] = np.matmul(w, k).reshape(-1, d)
        for at in range(0, window, stride):  # windows overlap by whole strides
            places[at : at + many * stride, d : 3 * d] += both[:, at : at + stride].reshape(-1, 2 * d)
        return loss, g


class Trainer:
    """Adagrad over stretches of a line, in order; only rows that occur are touched."""

    def __init__(self, p: Params, v: Vocabulary, shape: Shape):
        self.p, self.v, self.shape, self.steps = {n: x.copy() for n, x in p.items()}, v, shape, 0
        self.past = {n: np.full_like(x, 1e-6) for n, x in p.items()}
        self.net = Network(self.p, v, shape)

    def texts(self, texts: list[np.ndarray]) -> float:
        rows, targets, _ = layout(texts, self.v, self.shape)
        context, loss = self.shape.context, 0.0
        step = self.shape.batch * self.shape.stride
        for at in range(context, len(rows), step):
            loss, g = self.net.gradient(rows[at - context : at + step], targets[at : at + step])
            self.step(g)
        return loss

    def step(self, g: Params) -> None:
        self.steps += 1
        d, rate, seen = self.shape.dims, np.float32(self.shape.rate), g["rows"]
        for n, at, grad in [("u", slice(None), g["u"]), ("rel", slice(None), g["rel"]), *((n, seen, g["qkv"][:, i * d : (i + 1) * d]) for i, n in enumerate("qkv"))]:
            past = self.past[n][at] + grad * grad
            self.past[n][at] = past
            new = self.p[n][at] - rate * grad / np.sqrt(past)
            # scores stay within what single precision can take the exponential of
            self.p[n][at] = np.clip(new, -2.5, 2.5) if n in "qk" else np.clip(new, -8, 8)
        self.net.refresh(seen)


def score_texts(texts: list[np.ndarray], net: Network, batch: int = 128) -> np.ndarray:
    """Natural log probability of each text's ids and its end."""
    shape, total = net.shape, np.zeros(len(texts))
    if not texts:
        return total
    rows, targets, owner = layout(texts, net.v, shape)
    step = batch * shape.stride
    for at in range(shape.context, len(rows), step):
        logp = net.log_probability(rows[at - shape.context : at + step], targets[at : at + step])
        strides = logp.reshape(-1, shape.stride).sum(axis=1, dtype=np.float64)
        total += np.bincount(owner[at // shape.stride : at // shape.stride + len(strides)], weights=strides, minlength=len(texts))
    return total


def encoded(docs: DataFrame) -> DataFrame:
    """One pass over the texts: rows with ids (doc_id, hash, trains, ids as 16-bit numbers), and rows with words of training texts (word, n) summed in each task."""
    kind, arrow_kind = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "hash", "trains", "ids", "word", "n"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held = word_tokenizer().encode, []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])

        def words(found: pa.Table) -> Iterator[pa.RecordBatch]:
            for part in found.combine_chunks().to_batches():
                empty = [pa.nulls(part.num_rows, t) for t in (arrow_kind, pa.int64(), pa.bool_(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*empty, *part.columns], names)

        for whole in batches:
            for batch, texts in text_batches(whole):
                ids = [x.astype("<u2").tobytes() for x in encode([*map(bytes.lower, texts)])]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:3]), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary()), pa.nulls(len(ids), pa.int64())], names)
            for batch, texts in text_batches(whole, _LINE):
                code, by_code, _ = coded_words([text.lower() for text, trains in zip(texts, batch.column("trains").to_pylist(), strict=True) if trains])
                times = np.bincount(code, minlength=len(by_code))
                there = np.flatnonzero(times)
                held.append(pa.table([by_code.take(pa.array(there)), times[there]], ["word", "n"]))
                if sum(map(len, held)) > 2 * _FLUSH:
                    held = [summed()]
                    if len(held[0]) > _FLUSH:
                        yield from words(held.pop())
        if held:
            yield from words(summed())
        trim()

    trains = (crc_mod("doc_id", FOLDS) != 0).alias("trains")
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("hash"), trains, "text").mapInArrow(rows, f"doc_id {kind}, hash bigint, trains boolean, ids binary, word binary, n bigint")


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for ids in batch.column("ids"):
            yield np.frombuffer(ids.as_py(), "<u2").astype(np.int64)


def _summed(frame: DataFrame, n: int) -> np.ndarray:
    """Sums of (i, n) rows as an array of n numbers; at most n rows reach the driver."""
    out = np.zeros(n, np.int64)
    got = frame.groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return out


def _cells(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "n"])


def id_counts(table: DataFrame) -> np.ndarray:
    """Counts of all ids, ends included."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lm")
        total = np.zeros(N_IDS, np.int64)
        for ids in _arrays(batches):
            total += np.bincount(ids, minlength=N_IDS) if len(ids) > 4096 else 0
            if len(ids) <= 4096:
                np.add.at(total, ids, 1)
            total[END] += 1
        yield _cells(total)

    return _summed(table.mapInArrow(rows, "i int, n bigint"), N_IDS)


def pair_counts(table: DataFrame, row: np.ndarray, shape: Shape) -> np.ndarray:
    """Counts of (row before, row) over all texts, from BOS to END."""
    n = shape.rows

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lm")
        total, held, size = np.zeros(n * n, np.int64), [], 0

        def add() -> None:
            nonlocal held, size
            if held:
                np.add.at(total, np.concatenate(held), 1)
            held, size = [], 0

        for ids in _arrays(batches):
            line = row[np.concatenate([[BOS], ids, [END]])]
            held.append(line[:-1] * n + line[1:])
            size += len(ids)
            if size > 1_000_000:
                add()
        add()
        yield _cells(total)

    return _summed(table.mapInArrow(rows, "i int, n bigint"), n * n).reshape(n, n)


def fit(table: DataFrame, tokens: int, v: Vocabulary, shape: Shape) -> Params:
    """One pass over all training texts in `rounds` parts.

    A round's texts are dealt by hash over shards, whose number follows from the
    number of tokens and grows with it; a shard is trained in hash order from
    the round's first weights.  The shards' weights are averaged by their steps,
    in order: tasks sum up neighbouring shards, the driver these sums, so it gets
    one vector of some ten thousand numbers for SHARDS_PER_SUM shards.
    """
    p = start(shape)
    names = sorted(p)
    count = int(max(1, tokens // (shape.rounds * shape.shard_tokens)))
    dealt = table.select("hash", "ids", F.pmod(F.xxhash64("hash"), F.lit(count * shape.rounds)).cast("int").alias("shard"))
    for number in range(shape.rounds):
        now = p

        def rows(batches: Iterator[pa.RecordBatch], now: Params = now) -> Iterator[pa.RecordBatch]:
            claim("lm")
            shard, trainer, texts, size = None, None, [], 0

            def end() -> pa.RecordBatch:
                if texts:
                    trainer.texts(texts)
                weights = np.concatenate([trainer.p[n].ravel() for n in names])
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([trainer.steps], pa.int64()), pa.array([weights.astype("<f4").tobytes()], pa.binary())], ["shard", "steps", "weights"])

            for batch in batches:
                for mine, ids in zip(batch.column("shard").to_pylist(), batch.column("ids"), strict=True):
                    if mine != shard:
                        if trainer:
                            yield end()
                        shard, trainer, texts, size = mine, Trainer(now, v, shape), [], 0
                    texts.append(np.frombuffer(ids.as_py(), "<u2").astype(np.int64))
                    size += len(texts[-1]) + 1
                    if size > 100_000:
                        trainer.texts(texts)
                        texts, size = [], 0
            if trainer:
                yield end()
            trim()

        mine = dealt.where(F.pmod("shard", F.lit(shape.rounds)) == number)
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("lm")
            part, steps, total = None, 0, None
            put = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([steps], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "steps", "total"])
            for batch in batches:
                for shard, n, weights in zip(batch.column("shard").to_pylist(), batch.column("steps").to_pylist(), batch.column("weights"), strict=True):
                    if shard // SHARDS_PER_SUM != part:
                        if total is not None:
                            yield put()
                        part, steps, total = shard // SHARDS_PER_SUM, 0, 0.0
                    steps, total = steps + n, total + n * np.frombuffer(weights.as_py(), "<f4").astype(np.float64)
            if total is not None:
                yield put()

        # a partition for each shard
        trained = mine.repartitionById(count, F.floor(F.col("shard") / shape.rounds).cast("int")).sortWithinPartitions("shard", "hash", "ids").mapInArrow(rows, "shard int, steps bigint, weights binary")
        summed = trained.repartition(-(-count // SHARDS_PER_SUM), F.floor(F.col("shard") / SHARDS_PER_SUM)).sortWithinPartitions("shard").mapInArrow(sums, "part int, steps bigint, total binary")
        got = summed.toArrow().sort_by("part")
        steps = got.column("steps").to_numpy()
        if steps.sum():
            flat = sum(np.frombuffer(w.as_py(), np.float64) for w in got.column("total")) / steps.sum()
            at, p = 0, {}
            for n in names:
                p[n] = flat[at : at + now[n].size].reshape(now[n].shape).astype(np.float32)
                at += now[n].size
    return p


def score(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords), one row per row of docs.

    NULL and empty texts have the end token alone.  Repeated rows are counted,
    trained on and scored as often as they occur; other columns are left out,
    whatever their names; long texts are scored whole, window by window.
    Counts, of words, ids and pairs, cover every training text, and so does the
    training of the weights.  Words above a count that at most FREQUENT_WORDS
    have are looked up in a broadcast table of that bounded size, the others by
    a join on the word.  Texts are encoded once: ids are kept for the training
    and the scores, which find their rows by doc_id and the hash of both columns.
    Without any training text N and V are 0, all words are
    unknown, and the model is uniform but for the frequencies' smoothing.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    table = stored(encoded(docs))
    words = cut(table.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    all_ids = table.where("ids IS NOT NULL")
    ids = all_ids.where("trains").select("hash", "ids")
    stats = words.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("size")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()
    counts = id_counts(ids)
    ends = int(counts[END])
    n_tokens = sum(r["tokens"] for r in stats) + ends
    n_words = sum(r["words"] for r in stats) + (ends > 0)
    bottom, taken = 1 << 20, 0
    for r in sorted(stats, key=lambda r: -r["size"]):
        taken += r["words"]
        if taken > FREQUENT_WORDS:
            break
        bottom = r["size"]
    frequent = words.where(F.floor(F.log2("n") * 16) >= bottom).toArrow()
    lower = math.log10(n_tokens + 0.1 * (n_words + 1)) if n_tokens else math.log10(0.1)
    known_words = spark.sparkContext.broadcast((frequent.column("word").combine_chunks(), np.append(np.log10(frequent.column("n").to_numpy() + 0.1) - lower, 0.0)))
    v = vocabulary(counts, pair_counts(ids, rows_of(counts, shape)[0], shape), shape)
    model = spark.sparkContext.broadcast((fit(ids, int(counts.sum()), v, shape), v))
    end_score = math.log10(ends + 0.1) - lower
    kind, arrow_kind = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lm")
        net = Network(*model.value, shape)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = [*_arrays([batch])]
                columns = [pa.array(score_texts(texts, net) / math.log(10)), pa.array([len(x) + 1 for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *columns], ["doc_id", "hash", "score", "n_subwords"])
        trim()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lm")
        known, values = known_words.value
        names = ["row", "doc_id", "hash", "word", "times", "n_tokens", "n_known", "base"]
        for whole in batches:
            for batch, texts in text_batches(whole, _LINE):
                code, words, many = coded_words([*map(bytes.lower, texts)])
                place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()  # -1 is that of rare words
                owner, place = np.repeat(np.arange(len(texts)), many), place[code]
                base = np.bincount(owner, weights=values[place], minlength=len(texts)) + end_score
                rare = place < 0
                cells, times = np.unique(owner[rare] * len(words) + code[rare], return_counts=True)
                n_known = many - np.bincount(owner[rare], minlength=len(texts)) + (ends > 0)
                columns = [pa.nulls(len(texts), pa.binary()), pa.array([1] * len(texts), pa.int64()), pa.array(many + 1), pa.array(n_known), pa.array(base)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("hash"), *columns], names)
                if len(cells):
                    empty = [pa.nulls(len(cells), t) for t in (pa.int64(), pa.int64(), pa.float64())]
                    mine = [pa.nulls(len(cells), arrow_kind), pa.nulls(len(cells), pa.int64()), words.take(pa.array(cells % len(words))), pa.array(times)]
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(cells // len(words))), *mine, *empty], names)
        trim()

    tagged = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("doc_id", "text").alias("hash"), "text")
    scored = tagged.mapInArrow(rows, f"row bigint, doc_id {kind}, hash bigint, word binary, times bigint, n_tokens bigint, n_known bigint, base double")
    of_ids = all_ids.select("doc_id", "hash", "ids").mapInArrow(scores, f"doc_id {kind}, hash bigint, score double, n_subwords bigint")
    # repeated rows have one score
    of_ids = of_ids.groupBy(F.col("doc_id").alias("id of text"), F.col("hash").alias("hash of text")).agg(F.max("score").alias("score"), F.max("n_subwords").alias("n_subwords"))
    c = F.coalesce("n", F.lit(0))
    rare = F.col("is_word")
    # a document's own row has no word: it gets a key that is none, of its own, and finds nothing
    keyed = scored.withColumn("key", F.coalesce("word", F.concat(F.lit(" "), F.col("row").cast("string")).cast("binary"))).drop("word")
    summed = keyed.withColumn("is_word", F.substring("key", 1, 1) != F.lit(b" ")).join(words.withColumnRenamed("word", "key"), "key", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("hash").alias("hash"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.when(rare & (c > 0), F.col("times")).otherwise(F.col("n_known"))).alias("n_known"),
        F.sum(F.when(rare, F.col("times") * (F.log10(c + 0.1) - lower)).otherwise(F.col("base"))).alias("base_score"),
    )
    both = summed.join(of_ids, (F.col("hash") == F.col("hash of text")) & F.col("doc_id").eqNullSafe(F.col("id of text")), "left")
    return both.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "n_subwords")


def op2(docs: DataFrame) -> DataFrame:
    return score(docs)
