import numpy as np
import pytest
from pyspark.sql import functions as F

from matchup_graph.llm import lm
from test_operators import docs, prose

SHAPE = lm.Shape(dims=4, classes=6, rows=40, shard_tokens=200)


def test_weights_are_trained_on_every_document(spark):
    frame = docs(spark, [prose(30, i) for i in range(12)]).withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    counts = np.arange(lm.N_IDS) % 97
    pairs = np.random.default_rng(1).integers(0, 9, (40, 40))
    v = lm.vocabulary(counts, pairs, SHAPE)
    table = lm.encoded(frame).where("ids IS NOT NULL")
    whole = lm.fit(table, 100, v, SHAPE)
    # each single document reaches the weights, the one without an id too
    for row in table.select("hash").collect():
        assert not np.array_equal(lm.fit(table.where(F.col("hash") != row.hash), 100, v, SHAPE)["q"], whole["q"])


def test_scores_do_not_depend_on_partitions(spark):
    texts = [*[prose(40 + i, i) for i in range(40)], None, "", "É <|endoftext|> 漢"]
    got = []
    for n in (1, 4, 16):
        frame = docs(spark, texts).union(docs(spark, texts).where("doc_id = 3")).repartition(n)
        got.append(sorted(tuple(r) for r in lm.score(frame, SHAPE).collect()))
    for other in got[1:]:
        for a, b in zip(got[0], other, strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_attention_beats_pairs_and_pairs_beat_single_ids(spark):
    """Every text is in one of two languages that share their words but not the order, and its first words tell which."""
    rng, texts = np.random.default_rng(5), []
    words = [f"w{i}x" for i in range(12)]
    for i in range(300):
        step = 1 if i % 2 else 5
        at, out = int(rng.integers(12)), ["left" if i % 2 else "right"]
        for _ in range(12):
            out += [words[at], "left" if i % 2 else "right"]
            at = (at + step) % 12
        texts.append(" ".join(out))
    shape = lm.Shape(dims=8, classes=16, rows=64)
    rows = [r for r in lm.score(docs(spark, texts), shape).collect() if r.held_out]
    ids = [lm.word_tokenizer().encode([t.encode()])[0].astype(np.int64) for t in texts]
    count = np.bincount(np.concatenate(ids), minlength=lm.N_IDS) + 0.1
    single = sum(np.log10(count[ids[r.doc_id]] / count.sum()).sum() for r in rows)
    row, _ = lm.rows_of(count - 0.1, shape)
    pairs = np.zeros((64, 64))
    for i in ids:
        line = row[np.concatenate([[lm.BOS], i, [lm.END]])]
        np.add.at(pairs, (line[:-1], line[1:]), 1)
    net = lm.Network(lm.start(shape), lm.vocabulary(count, pairs, shape), shape)
    paired = lm.score_texts([ids[r.doc_id] for r in rows], net).sum() / np.log(10)
    assert sum(r.score for r in rows) > paired + 0.02 * abs(paired) > single


def test_held_out_scores_beat_single_ids_on_the_table(spark):
    """The model's nats a subword lie below those of the ids' frequencies."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in lm.op2(frame).collect()}
    texts = {r.doc_id: (r.text or "").lower().encode() for r in frame.collect()}
    ids = {i: lm.word_tokenizer().encode([t])[0] for i, t in texts.items()}
    count = np.bincount(np.concatenate([x for i, x in ids.items() if not rows[i].held_out]), minlength=lm.N_IDS) + 0.1
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].score for i in held) > 0.85 * sum(np.log10(count[ids[i]] / count.sum()).sum() for i in held)
