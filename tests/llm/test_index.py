import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_operators import docs

from matchup_graph.llm import exact


def test_queries_append_to_the_index_in_batches_and_drop_it(spark, monkeypatch):
    joined = []
    append = exact.DigestIndex.append

    def noted(self, digests):
        joined.append(self.spark.catalog.tableExists(self.name))
        append(self, digests)

    monkeypatch.setattr(exact.DigestIndex, "append", noted)
    frame = docs(spark, ["a", "b", "a", "n", "b", "c", "c", "a", None, "n", "m"])
    frame = frame.withColumn("doc_id", F.when(~F.col("doc_id").isin(3, 10), F.col("doc_id")))
    before = {t.name for t in spark.catalog.listTables()}
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.op7(frame).collect()}
    assert got == {(0, 0, 3, True), (2, 0, 3, False), (7, 0, 3, False), (1, 1, 2, True), (4, 1, 2, False), (5, 5, 2, True), (6, 5, 2, False), (8, 8, 1, True), (9, 9, 2, True), (None, 9, 2, False), (None, None, 1, True)}
    assert sorted((r.doc_id for r in exact.apply_exact(frame).collect()), key=str) == [0, 1, 5, 8, 9, None]
    assert joined == [False, True] * 2 and {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("kind", ["string", "bigint", "date"])
def test_ids_of_any_ordered_type(spark, kind):
    rows = [(f"2020-01-{1 + i * 7 % 28:02d}" if kind == "date" else str(i), f"t {i % 9}") for i in range(28)] + [(None, "t 3"), (None, "alone")]
    docs = spark.createDataFrame(rows, "i string, text string").select(F.expr(f"cast(i AS {kind})").alias("doc_id"), "text")
    got = exact.op7(docs).collect()
    least = {}
    for r in docs.collect():
        if r.doc_id is not None:
            key = r.text
            least[key] = min(least.get(key, r.doc_id), r.doc_id)
    digest_of = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in rows}
    assert len(got) == 30 and all(r.keep_id == least.get(digest_of[r.text_sha256]) for r in got)
    assert sorted(r.doc_id for r in got if r.kept and r.doc_id is not None) == sorted(least.values())
    assert sorted(r.doc_id for r in exact.apply_exact(docs).collect() if r.doc_id is not None) == sorted(least.values())


def test_a_failed_run_leaves_no_table_and_no_files(spark, monkeypatch):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p.name for p in folder.glob("digest_index_*")}, spark.catalog.listTables()

    def fails(*_):
        raise RuntimeError("lost")

    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id bigint, text string")
    monkeypatch.setattr(exact, "dedup", fails)
    with pytest.raises(RuntimeError):
        exact.op7(docs)
    monkeypatch.setattr(exact.DigestIndex, "read", fails)
    with pytest.raises(RuntimeError):
        exact.apply_exact(docs)
    assert ({p.name for p in folder.glob("digest_index_*")}, spark.catalog.listTables()) == before
