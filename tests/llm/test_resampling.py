"""Importance resampling against plain sums."""

import gc
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchup_graph.llm import resampling as R
from matchup_graph.llm.common import BLOCK, Memo


def features(text, run):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, run=1, buckets=R.BUCKETS, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, run)[1])
    t = Counter(bucket(f) for x in target for f in features(x, run)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, text in docs:
        words, found = features(text, run)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        out.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = n + 1
    return sorted(map(tuple, out), key=repr)


def frames(spark, docs, target):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(t,) for t in target], "text string")


def corpus(n=120):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "中文", "O'Neil", "x-y", "A1"]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 90)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t\n-"), (n + 3, docs[7][1]), (n + 4, docs[7][1])], [" ".join(r.choices(words[:20], k=200)) for _ in range(5)]


@pytest.mark.parametrize("run", [1, 3])
def test_matches_plain_sums(spark, run):
    docs, target = corpus()
    got = R.resample(*frames(spark, docs, target), run=run, percent=30).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == plain(docs, target, run, percent=30)


def test_repeated_rows_ids_and_empty_tables(spark):
    docs, target = corpus(40)
    odd = docs + [docs[3], docs[3], (None, docs[5][1])]
    frame, aim = frames(spark, odd, target)
    frame = frame.withColumns({c: F.lit("mine") for c in ("h", "rank", "place", "n_words", "nth", "weight")})
    assert sorted(map(tuple, R.resample(frame, aim, percent=50).collect()), key=repr) == plain(odd, target, percent=50)
    assert R.op12(frame.limit(0), aim).count() == 0
    assert sorted(map(tuple, R.resample(frame, aim.limit(0)).collect()), key=repr) == plain(odd, [])


@pytest.mark.parametrize("run", [1, 2])
def test_long_texts_are_cut_between_words(run):
    text = ("abc DEF, " * (BLOCK // 6) + "x" * (2 * BLOCK) + " end").encode()
    words, found = features(text.decode(), run)
    n, buckets = R.Buckets(run=run).count(text)
    assert n == len(words) and sorted(buckets.tolist()) == sorted(zlib.crc32(f.encode()) % R.BUCKETS for f in found)


def test_planes_give_exact_sums():
    rng = np.random.default_rng(3)
    gains = rng.integers(-(1 << 40), 1 << 40, 777)
    found = [rng.integers(0, 777, n).astype(np.int32) for n in (0, 1, 5, 4000, 70_000)] * 20
    found[1] = np.full(100_000, 3, np.int32)
    assert R.Gains(gains).weigh(found) == [int(gains[x].sum()) for x in found]
    assert R.Gains(np.zeros(100, np.int64)).weigh([np.array([1, 1])]) == [0]


def test_tasks_of_a_worker_share_one_table_of_buckets():
    tables = lambda: sum(isinstance(x, Memo) for x in gc.get_objects())
    R.Buckets().count(b"first")
    gc.collect()
    before = tables()
    for task in range(8):
        assert R.Buckets(100 if task % 2 else R.BUCKETS).count(b"a task's own words %d" % task)[1].max() < (100 if task % 2 else R.BUCKETS)
    gc.collect()
    assert tables() == before
