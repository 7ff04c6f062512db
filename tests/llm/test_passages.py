import random

import numpy as np
import pytest

from matchup_graph.llm import common, simhash, substrings, tokens
from test_operators import WORDS, docs, prose


def covered(rows, doc_id):
    return {w for r in rows if r.doc_id == doc_id for w in range(r.start, r.start + r.n_words)}


def test_every_copy_of_a_passage_in_one_document_is_found(spark):
    passage, a, b = (prose(n, 400 + n).split() for n in (60, 150, 151))
    texts = [a[:70] + passage + a[70:], b[:20] + passage + b[20:90] + passage + b[90:] + passage]
    texts = [" ".join(t) for t in texts]
    got = substrings.op5(docs(spark, texts)).collect()
    assert covered(got, 1) == {*range(20, 80), *range(150, 210), *range(271, 331)}
    assert substrings.apply_substrings(docs(spark, texts)).where("doc_id = 1").first().text.split() == b


def test_passages_split_between_earlier_documents_are_found_whole(spark):
    body = [prose(150, 500 + i).split() for i in range(7)]
    one, two = prose(60, 600).split(), prose(80, 601).split()
    put = lambda i, part: " ".join(body[i][:60] + part + body[i][60:])
    # the halves come first in 0 and 1, and once more in 3, between the whole ones in 2 and 4
    texts = [put(0, one[:30]), put(1, one[30:]), put(2, one), put(3, one[:30] + body[3][:40] + one[30:]), put(4, one), put(5, two), put(6, two)]
    got = substrings.op5(docs(spark, texts)).collect()
    assert {r.doc_id for r in got} == {4, 6} and {r.keep_id for r in got if r.doc_id == 4} == {2}
    assert covered(got, 4) >= set(range(63, 117)) and covered(got, 4) <= set(range(60, 120)) and covered(got, 6) == set(range(60, 140))


def test_passages_cover_what_brute_force_finds(spark):
    r = random.Random(3)
    phrases = [prose(12, 700 + i).split() for i in range(6)]
    texts = []
    for i in range(14):
        words = []
        for _ in range(24):
            words += r.choice(phrases) if r.random() < 0.7 else prose(8, 800 + r.randrange(400)).split()
        if texts:
            at = r.randrange(40)
            words[30:30] = r.choice(texts)[at : at + 60]
        texts.append(words)
    got = substrings.op5(docs(spark, [" ".join(t) for t in texts])).collect()
    want = set()
    for i, t in enumerate(texts):
        earlier = {tuple(o[j : j + 50]) for o in texts[:i] for j in range(len(o) - 49)}
        want |= {(i, j + n) for j in range(len(t) - 49) if tuple(t[j : j + 50]) in earlier for n in range(50)}
    have = {(i, w) for i in range(14) for w in covered(got, i)}
    print(len(want), len(want - have))
    assert len(want) > 600 and len(want - have) <= 0.02 * len(want)


def test_passages_with_edits_are_found(spark):
    r = random.Random(9)
    for share, least in ((0.05, 0.97), (0.1, 0.95), (0.15, 0.85)):
        texts, wanted = [], []
        for i in range(60):
            passage, a, b = prose(60, 2000 + i).split(), prose(60, 3000 + i).split(), prose(60, 4000 + i).split()
            edited = [r.choice(WORDS) if r.random() < share else w for w in passage]
            texts += [" ".join(a[:30] + passage + a[30:]), " ".join(b[:30] + edited + b[30:])]
            # a brute-force aligner: substitutions alone keep the diagonal, so windows of equal place are all there is
            same = np.array([x == y for x, y in zip(passage, edited)])
            if any(same[s:e].mean() >= 0.8 for s in range(11) for e in range(s + 50, 61)):
                wanted.append(2 * i + 1)
        got = {x.doc_id for x in substrings.op5(docs(spark, texts)).collect()}
        assert got <= set(range(1, 120, 2))
        print(share, len(wanted), len(set(wanted) - got))
        assert len(got & set(wanted)) >= least * len(wanted)


def test_edited_passages_split_between_earlier_documents_are_covered(spark):
    r = random.Random(5)
    for share, least in ((0.0, 1.0), (0.05, 0.97), (0.1, 0.9), (0.15, 0.8)):
        texts = []
        for i in range(60):
            passage, around = prose(100, 10000 + i).split(), [prose(80, 20000 + 10 * i + j).split() for j in range(4)]
            edited = [r.choice(WORDS) if r.random() < share else w for w in passage]
            # 45 words each in the first two documents, all in the third, all with edits in the fourth
            texts += [" ".join(a[:40] + part + a[40:]) for a, part in zip(around, (passage[:45], passage[55:], passage, edited))]
        rows = substrings.op5(docs(spark, texts)).collect()
        shares = [len(covered(rows, n) & set(range(40, 140))) for n in range(3, 240, 4)]
        assert {x.doc_id for x in rows} <= set(range(3, 240, 4))
        print(share, sum(n >= 90 for n in shares), sum(n > 0 for n in shares))
        assert sum(n >= 90 for n in shares) >= least * 60 and sum(n > 0 for n in shares) >= 0.9 * 60


def best_starts(a, b, p, cost):
    """(value, words in common) -> starts of both lists with them, over the whole band and without an early end."""
    cells = {(0, 0): (0, 0)}
    for i in range(len(a) + 1):
        for j in range(max(0, i - p.band), min(len(b), i + p.band) + 1):
            options = [cells[0, 0]] if i == j == 0 else []
            if (i - 1, j - 1) in cells:
                value, same = cells[i - 1, j - 1]
                options.append((value + 1, same + 1) if a[i - 1] == b[j - 1] else (value - cost, same))
            options += [(cells[c][0] - cost, cells[c][1]) for c in ((i - 1, j), (i, j - 1)) if c in cells]
            cells[i, j] = max(options)
    best = max(value for value, _ in cells.values())
    return best, {(i, j, same) for (i, j), (value, same) in cells.items() if value == best}


def test_extension_equals_a_plain_alignment(spark):
    r, p = random.Random(2), substrings.Params(drop=1000)
    a, b = [[], [1, 2], [], [5]], [[], [], [3], [6]]
    for _ in range(300):
        x = [r.randrange(40) for _ in range(r.randrange(p.margin + 1))]
        y = [w for word in x for w in ([word] if r.random() < 0.85 else r.choice([[], [r.randrange(40)], [word, 3]]))]
        a.append(x)
        b.append(y[: p.margin])
    for cost in (1, 2, 4):
        got = substrings.extend([np.array(x, np.uint32) for x in a], [np.array(y, np.uint32) for y in b], p, cost).tolist()
        for x, y, found in zip(a, b, got, strict=True):
            # equal words at the start are taken first, as no alignment gains by leaving them
            n = next((i for i, (v, w) in enumerate(zip(x, y)) if v != w), min(len(x), len(y)))
            _, starts = best_starts(x[n:], y[n:], p, cost)
            assert (found[0] - n, found[1] - n, found[2] - n) in starts


class Task:
    """Stands for a table: runs a map in this process, over no rows."""

    schema = ()

    def __getattr__(self, name):
        return lambda *_: self

    def mapInArrow(self, run, schema):
        return [*run(iter([]))]


@pytest.mark.parametrize(
    "stage",
    [
        lambda rows: substrings._seed_rows(rows, substrings.Params()),
        lambda rows: substrings._code_rows(rows),
        lambda rows: substrings._lines(rows, lambda doc_id, links: ([], [], [])),
        lambda rows: substrings._aligned(rows, substrings.Params()),
        lambda rows: common.map_texts(rows, lambda text: (), "n int", []),
        lambda rows: simhash.grouped_links(rows, rows, 0.8),
    ],
)
def test_a_workers_tokenizer_goes_before_other_stages(spark, stage):
    tokens.word_tokenizer()
    assert tokens._load.cache_info().currsize == 1
    stage(Task())
    assert tokens._load.cache_info().currsize == 0


def test_words_of_many_texts_are_hashed_and_winnowed_as_one_by_one(monkeypatch):
    r = random.Random(11)
    monkeypatch.setattr(substrings, "_STRETCH", 64)  # lines are worked on in stretches
    texts = [b"", b" ", b"a", b"Ab aB ab", "ÉT\xa0É x".encode(), b"y" * 300 + b" Y" + b"y" * 299, b"z" * 100, *("".join(r.choice("abcB \n") for _ in range(r.randint(0, 200))).encode() for _ in range(80))]
    codes, many = substrings.word_codes(texts)
    words = [w for t in texts for w in t.lower().split()]
    assert many.tolist() == [len(t.split()) for t in texts] and len(codes) == len(words)
    assert len({*zip(codes.tolist(), words, strict=True)}) == len({*codes.tolist()}) == len({*words})
    assert len({*(codes & np.uint64(0xFFFFFFFF)).tolist()}) == len({*words})
    p = substrings.Params(k=3, window=4)
    h, place, owner = substrings.seeds(codes, many, p)
    want, bounds = [], np.cumsum([0, *many]).tolist()
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        all_of = [int(sum(int(c) * substrings._MULTIPLIERS[j] for j, c in enumerate(codes[at : at + p.k]))) & (1 << 64) - 1 for at in range(lo, hi - p.k + 1)]
        for j, x in enumerate(all_of):
            x ^= x >> 31
            x = x * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
            all_of[j] = x ^ x >> 29
        starts = range(max(1, len(all_of) - p.window + 1)) if all_of else ()
        for at in sorted({min(range(s, min(s + p.window, len(all_of))), key=lambda j: (all_of[j], j)) for s in starts}):
            want.append((all_of[at], at, i))
    assert [*zip(h.view(np.uint64).tolist(), place.tolist(), owner.tolist(), strict=True)] == want
