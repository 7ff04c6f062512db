import random

import corpus_pipeline
import numpy as np
import pytest
from matchup_graph.llm import simhash

from test_operators import WORDS, docs, prose


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def kept_by_brute_force(texts):
    """The smallest number of each component of pairs of similarity 0.8 or more."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {root(i) for i in range(len(texts))}


def dense(clusters, size, seed):
    """Clusters of texts of 150 words with 0 to 4 changed words: many pairs lie just above or below 0.8."""
    r = random.Random(seed)
    texts = []
    for c in range(clusters):
        base = prose(150, 5000 + 100 * seed + c).split()
        for _ in range(size):
            words = list(base)
            for at in r.sample(range(150), r.randint(0, 4)):
                words[at] = r.choice(WORDS)
            texts.append(" ".join(words))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("clusters", "size", "whole", "least"), [(40, 12, 256, 1.0), (8, 70, 256, 1.0), (8, 70, 4, 0.9)])
def test_dense_clusters(spark, monkeypatch, clusters, size, whole, least):
    monkeypatch.setattr(simhash, "WHOLE_BAND", whole)
    texts = dense(clusters, size, size)
    kept = {r.doc_id for r in simhash.apply_simhash(docs(spark, texts)).collect()}
    wanted = kept_by_brute_force(texts)
    gone, must_go = set(range(len(texts))) - kept, set(range(len(texts))) - wanted
    assert gone <= must_go and len(gone) >= least * len(must_go), (len(gone), len(must_go))


def test_groups_are_joined_as_all_their_pairs_would():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)] + [np.array([1], np.uint64)] * 2
    for similarity in (0.3, 0.45, 0.6):
        near = [(i, j) for i in range(42) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= similarity * len(np.union1d(sets[i], sets[j]))]

        def parts(links):
            names = list(range(42))
            for i, j in links:
                names = [names[j] if x == names[i] else x for x in names]
            return {frozenset(k for k in range(42) if names[k] == n) for n in names}

        found = simhash.forest(sets, similarity)
        assert set(found) <= set(near) and parts(found) == parts(near) and len(found) == 42 - len(parts(near))


def test_near_stage_drops_every_copy_of_similarity_four_fifths(spark):
    r = random.Random(5)
    texts = [prose(300, 900 + i) for i in range(12)]
    for i in range(12):
        for edits in (1, 4, 6, 7, 30):
            words = texts[i].split()
            for at in r.sample(range(300), edits):
                words[at] = r.choice(WORDS)
            texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    expected = {root(i) for i in range(len(texts))}
    assert 12 < len(expected) < len(texts) - 24
    assert {r.doc_id for r in simhash.apply_simhash(docs(spark, texts)).collect()} == expected


def test_pipeline_drops_the_near_copy(spark, tmp_path):
    clean = [prose(200, 50 + i) for i in range(8)]
    near = clean[2].split()
    near[20], near[90], near[150] = "new", "other", "changed"
    docs(spark, [*clean, " ".join(near)]).write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        frame = stage(spark, frame, str(tmp_path))
    assert {r.doc_id for r in frame.select("doc_id").collect()} == set(range(8))


def test_near_rounds_reach_pairs_behind_a_smaller_stranger(spark, monkeypatch):
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: [1])
    monkeypatch.setattr(simhash, "WHOLE_BAND", 1)
    texts = [prose(100, 1), prose(100, 2), prose(100, 2) + " more", prose(100, 3), prose(100, 3) + " more", None, ""]
    assert sorted(r.doc_id for r in simhash.apply_simhash(docs(spark, texts)).collect()) == [0, 1, 3, 5]


def test_near_stage_takes_simhash_links(spark, monkeypatch):
    """No two documents share a band here: only fingerprints can find the copies, and whole sets must refuse equal fingerprints of unlike texts."""
    monkeypatch.setattr(simhash, "band_keys", lambda hashes: [])
    base = prose(400, 9).split()
    variants = [" ".join([*base[:i], "zz", *base[i:]]) for i in range(0, 400, 9)]
    fp = lambda text: simhash.fingerprint(text.encode())
    apart = {}
    for text in variants:
        apart.setdefault(bin((fp(text) ^ fp(" ".join(base))) & (2**64 - 1)).count("1"), text)
    near = [text for bits, text in sorted(apart.items()) if bits <= 2]
    assert near
    alike = ["x " * 2000 + prose(60, 1), "x " * 2000 + prose(60, 2)]
    assert fp(alike[0]) == fp(alike[1])
    texts = [" ".join(base), *near, *alike, prose(300, 4)]
    kept = sorted(r.doc_id for r in simhash.apply_simhash(docs(spark, texts)).collect())
    assert kept == [0, *range(1 + len(near), len(texts))]
