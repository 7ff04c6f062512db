"""Language identification: averaged hashed subword embeddings and a linear softmax, trained in numpy."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blobs, crc_mod, text_batches, trim

BUCKETS = 1 << 14
SAMPLE_PER_LANGUAGE = 400
UNKNOWN = "und"
SLICES = 64


def subwords(text: str) -> np.ndarray:
    """Hashed buckets of all runs of one to three characters, lower case."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    one = chars * np.uint32(2654435761)
    out = [one >> np.uint32(18)]
    if len(chars) > 1:
        two = one[:-1] * np.uint32(31) + one[1:]
        out.append((two * np.uint32(2246822519)) >> np.uint32(18))
        if len(chars) > 2:
            three = two[:-1] * np.uint32(31) + one[2:]
            out.append((three * np.uint32(3266489917)) >> np.uint32(18))
    return np.concatenate(out)


def features(text: str) -> np.ndarray:
    """Shares of the buckets, dense."""
    found = subwords(text)
    return np.bincount(found, minlength=BUCKETS).astype(np.float32) / max(1, len(found))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """Scores of the buckets per language (embeddings times output weights), bias, calibration."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x @ self.table + self.bias) / self.temperature
        z -= z.max(axis=-1, keepdims=True)
        e = np.exp(z)
        return e / e.sum(axis=-1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, accepted); `und`, 0.0 and False for a text without letters."""
        if not text or not has_letter(text):
            return UNKNOWN, 0.0, False
        p = self.probabilities(features(text))
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.reject_below)


def train(texts: list[np.ndarray], labels: list[str], dims: int = 16, epochs: int = 30, rate: float = 0.5, seed: int = 0, precision: float = 0.99) -> Model:
    """SGD on the embeddings and the softmax; a fifth of the rows sets temperature and rejection threshold.

    texts: (bucket, share) rows as float arrays of shape (2, n).
    """
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, dims))
    out = rng.normal(0, 0.1, (dims, len(languages)))
    bias = np.zeros(len(languages))
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    step = 0
    for epoch in range(epochs):
        for i in rng.permutation(fit):
            buckets, share = texts[i][0].astype(np.int64), texts[i][1]
            lr = rate * (1 - step / (epochs * len(fit) + 1))
            step += 1
            h = share @ emb[buckets]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            grad_h = out @ p
            out -= lr * np.outer(h, p)
            bias -= lr * p
            # shares are small, so the averaged gradient is brought to the scale of its own norm
            emb[buckets] -= lr * np.outer(share / max(1e-9, float(share @ share)) ** 0.5, grad_h)
    model = Model(languages, (emb @ out).astype(np.float32), bias.astype(np.float32))
    if len(held):
        z = np.stack([texts[i][1] @ model.table[texts[i][0].astype(np.int64)] + model.bias for i in held])

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(held)), y[held]]).mean())

        model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0), key=loss)
        s = z / model.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        right, top = p.argmax(axis=1) == y[held], p.max(axis=1)
        model.reject_below = float("inf")  # unless some threshold is precise enough
        for threshold in np.sort(top):
            if right[top >= threshold].mean() >= precision:
                model.reject_below = float(threshold)
                break
    return model


def training_rows(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[np.ndarray], list[str]]:
    """Feature rows of at most per_language labelled documents of each language, chosen by hash among the training fold.

    The bound limits what the driver gets: per_language rows of distinct buckets
    per language.  Rows are ranked in SLICES hashed slices of a language first
    and the best of these within the language, so a language that most
    documents have is never ranked by one task.
    """
    fold = docs.where((crc_mod("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = fold.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("slice", F.pmod("h", F.lit(SLICES)))
    first = lambda frame, *by: frame.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))).where(F.col("nth") <= per_language).drop("nth")
    ids = first(first(hashed.distinct(), "lang", "slice"), "lang").select("doc_id").distinct()
    rows_of = fold.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    # a doc_id that many rows have counts once, with its smallest row
    chosen = rows_of.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("r.lang", "r.text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, buckets, shares = [], [], []
            for lang, blob in zip(batch.column("lang"), blobs(batch), strict=True):
                text = blob.decode("utf-8", "replace")
                if has_letter(text):
                    b, n = np.unique(subwords(text), return_counts=True)
                    langs.append(lang.as_py())
                    buckets.append(b.astype(np.int32))
                    shares.append((n / n.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["lang", "buckets", "shares"])

    got = chosen.mapInArrow(rows, "lang string, buckets array<int>, shares array<float>").toArrow().sort_by("lang")
    texts = [np.stack([np.asarray(b.as_py(), np.float32), np.asarray(s.as_py(), np.float32)]) for b, s in zip(got.column("buckets"), got.column("shares"), strict=True)]
    return texts, got.column("lang").to_pylist()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted), one row per row of docs: a map over whole texts.

    Each row is judged alone, so repeated rows give repeated rows; texts are read
    whole; other columns are left out, whatever their names.
    accepted is False where the calibrated probability lies under the threshold
    of the model, and for NULL texts and texts without letters, which are `und`.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part, _ in text_batches(whole)):
            out = [model.predict(None if b is None else b.decode("utf-8", "replace")) for b in blobs(batch)]
            columns = [batch.column("doc_id"), batch.column("held_out"), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    tagged = docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text")
    return tagged.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def op8(docs: DataFrame) -> DataFrame:
    """Train and predict.  Without any labelled row all texts are `und`."""
    texts, labels = training_rows(docs)
    model = train(texts, labels) if labels else Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32))
    return identify(docs, model)
