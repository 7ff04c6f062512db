"""Windows scored as views, and words encoded apart, against plain versions."""

import random
import re

import numpy as np
import pytest
from matchup_graph.llm import common, lm, tokens


def model(shape, seed=3):
    rng = np.random.default_rng(seed)
    v = lm.vocabulary(rng.integers(0, 50, lm.N_IDS), rng.integers(0, 9, (shape.rows, shape.rows)), shape)
    p = lm.start(shape)
    p["rel"] = rng.normal(size=shape.window).astype(np.float32)
    p["u"] = rng.normal(size=p["u"].shape).astype(np.float32)
    return p, v


def plain_score(ids, p, v, shape):
    """One position at a time, over the tokens that its window holds."""
    rows = np.concatenate([[v.row[lm.BOS]], v.row[ids]])
    q, k, val = (p[n].astype(np.float64)[rows] for n in "qkv")
    total = 0.0
    for i, target in enumerate([*ids, lm.END]):
        lo = max(0, i // shape.stride * shape.stride - shape.context)
        a = np.exp(k[lo : i + 1] @ q[i] + p["rel"][i - np.arange(lo, i + 1)])
        z = v.direct[rows[i]] + a / a.sum() @ val[lo : i + 1] @ p["u"]
        goal = v.row[target]
        total += z[v.kind[goal]] - np.log(np.exp(z).sum()) + v.inner[rows[i], goal] + v.share[target]
    return total


@pytest.mark.parametrize("batch", [1, 3, 128])
def test_scores_match_a_plain_loop(batch):
    shape = lm.Shape(dims=8, context=6, stride=3, classes=8, rows=40)
    p, v = model(shape)
    net = lm.Network(p, v, shape)
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, lm.BOS, n) for n in (0, 1, 2, 3, 40, 0, 7)]
    want = [plain_score(t, p, v, shape) for t in texts]
    assert lm.score_texts(texts, net, batch) == pytest.approx(want, rel=1e-4)


def test_no_texts_have_no_scores():
    shape = lm.Shape(dims=8, classes=8, rows=40)
    p, v = model(shape)
    assert len(lm.score_texts([], lm.Network(p, v, shape))) == 0


def test_probabilities_of_all_ids_sum_to_one():
    shape = lm.Shape(dims=8, context=6, stride=3, classes=8, rows=40)
    p, v = model(shape)
    net, ids = lm.Network(p, v, shape), np.arange(lm.N_IDS)
    rows = np.full((9,), -1)
    rows[4:7] = [v.row[lm.BOS], 5, 11]
    z = net.forward(rows)[0][0]
    before = rows[6]
    logp = np.log(z[v.kind[v.row[ids]]] / z.sum()) + v.inner[before, v.row[ids]] + v.share[ids]
    assert np.exp(logp).sum() == pytest.approx(1, abs=1e-4)


def test_gradient():
    shape = lm.Shape(dims=4, context=3, stride=3, classes=4, rows=32)
    p, v = model(shape)
    for n in "qkv":
        p[n] *= 0.5
    rows, targets, _ = lm.layout([np.arange(20), np.arange(5, 9)], v, shape)
    goal = targets[shape.context :]
    _, g = lm.Network(p, v, shape).gradient(rows, goal)

    def loss():
        """In double precision."""
        net = lm.Network(p, v, shape)
        net.table, net.factor, net.p = net.table.astype(np.float64), np.exp(p["rel"].astype(np.float64)[net.far]) * net.causal, {n: x.astype(np.float64) for n, x in p.items()}
        z = net.forward(rows)[0]
        has = goal >= 0
        return -np.log((z[np.arange(len(z)), v.kind[v.row[goal]]] / z.sum(axis=1))[has]).mean()

    full = {"u": g["u"], "rel": g["rel"]} | {n: np.zeros_like(p[n]) for n in "qkv"}
    for i, n in enumerate("qkv"):
        full[n][g["rows"]] = g["qkv"][:, i * 4 : (i + 1) * 4]
    for n, x in p.items():
        i = np.unravel_index(np.abs(full[n]).argmax(), x.shape)
        old = x[i]
        x[i] = old + 1e-2
        up, high = loss(), x[i]
        x[i] = old - 1e-2
        down, low = loss(), x[i]
        x[i] = old
        assert full[n][i] == pytest.approx((up - down) / float(high - low), rel=1e-2)


@pytest.mark.parametrize("block", [1, 2, 5])
def test_gradient_is_the_same_in_blocks(monkeypatch, block):
    shape = lm.Shape(dims=4, context=3, stride=3, classes=4, rows=32)
    p, v = model(shape)
    rows, targets, _ = lm.layout([np.arange(20), np.arange(5, 9), np.arange(11)], v, shape)
    net = lm.Network(p, v, shape)
    loss, whole = net.gradient(rows, targets[shape.context :])
    monkeypatch.setattr(lm, "BLOCK", block)
    again, parts = net.gradient(rows, targets[shape.context :])
    assert again == pytest.approx(loss)
    for n in whole:
        np.testing.assert_allclose(parts[n], whole[n], rtol=1e-4, atol=1e-6)


def test_batches_have_the_ids_of_the_library():
    t, r = tokens.word_tokenizer(), random.Random(3)
    texts = ["Word word, WORD. don't a1 ab; (x) it's, ciónes. ÉTÉ! naïve: ,, a, 's A's ét <|endoftext|> x<|END Ωmega 漢字 ſ İ K ª µm ²x", "", "ÉTÉ ÄÖÜß ×÷ 'TIS 12 3a4"]
    for letters in ("ab\n ", "a.,'s", "lL' e", "19 a", "É×÷Äß a'", "¡«»é 're", "THEtion. "):
        texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(200)]
    assert [x.tolist() for x in t.encode([s.encode() for s in texts])] == [t.whole.encode(s, add_special_tokens=False).ids for s in texts]


def test_scores_come_from_the_ids_of_the_first_pass(spark):
    """Texts are encoded once; rows of one doc_id, or of none, have the scores of their own texts, repeated rows too."""
    texts = ["one two three", "four five", "one two three", None, "", "one two three"]
    rows = [*zip([1, 1, 1, 2, None, None], texts, strict=True), *((i, f"w{i} and w{i % 7}") for i in range(10, 40))]
    frame = lm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), lm.Shape(dims=4, classes=6, rows=40))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"MapInArrow scores\(doc_id#\d+L?, hash#\d+L?, ids#\d+\)", plan)
    got = frame.collect()
    encode = lambda text: len(lm.word_tokenizer().encode([(text or "").encode()])[0]) + 1
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_subwords) for r in got) == sorted((i or 0, len((t or "").split()) + 1, encode(t)) for i, t in rows)
    assert all(r.score < 0 for r in got) and len({r.score for r in got if r.doc_id == 1}) == 2


def test_coded_words_are_those_of_split():
    r = random.Random(6)
    texts = [b"", b" ", b"a", b" a", b"a b ", b"\x1c\x85 \x0b\x0c\r\n\tx", "É 漢字\xa0ß".encode(), *("".join(r.choice("ab \n\t") for _ in range(r.randint(0, 30))).encode() for _ in range(300))]
    for some in (texts, texts[:1], texts[:2], texts[3:4]):
        code, words, many = common.coded_words(some)
        by_code = words.to_pylist()
        assert [by_code[i] for i in code] == [w for t in some for w in t.split()] and many.tolist() == [len(t.split()) for t in some]


def test_only_the_first_pass_keeps_a_tokenizer(spark, monkeypatch):
    """Workers live on between stages: those that train and score must not hold the tokenizer of the first pass beside their own tables."""
    frame, found = spark.createDataFrame([(i, f"w{i} and w{i % 7}") for i in range(30)], "doc_id bigint, text string"), []
    plain = type(frame).mapInArrow

    def noted(self, func, *args, **kwargs):
        found.append(func)
        return plain(self, func, *args, **kwargs)

    monkeypatch.setattr(type(frame), "mapInArrow", noted)
    lm.score(frame, lm.Shape(dims=4, classes=6, rows=40))
    later = [f for f in found if not f.__qualname__.startswith("encoded.")]
    assert len(later) == len(found) - 1 >= 6
    for func in later:
        lm.word_tokenizer()
        [*func(iter(()))]
        assert tokens._load.cache_info().currsize == 0, func.__qualname__
