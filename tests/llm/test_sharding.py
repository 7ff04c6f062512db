"""Hilbert sharding against a plain curve, its laws, pruning and odd tables."""

import zlib

import pytest
from pyspark.sql import functions as F

from matchup_graph.llm import sharding as S

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def some(spark, n=500, hot=3):
    """Every third row of one source; texts repeat."""
    return table(spark, [(i, f"text {i % 97} " + "é" * (i % 13), ["en", "de", None][i % 3], "hot" if i % hot == 0 else f"s{i % 29}", None if i % 41 == 0 else i * 37 % 1000) for i in range(n)])


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_takes_single_steps_and_meets_every_cell(spark, dimensions, bits):
    cells = spark.range(1 << (dimensions * bits)).select(*[F.expr(f"cast((id div {1 << (bits * i)}) % {1 << bits} AS int)").alias(f"c{i}") for i in range(dimensions)])
    rows = cells.withColumn("h", S.hilbert([F.col(f"c{i}") for i in range(dimensions)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << (dimensions * bits)))
    assert all(sum(abs(a[i] - b[i]) for i in range(dimensions)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_cells_are_shares_of_smaller_values(spark):
    docs = some(spark)
    starts = S.borders(docs)
    rows = docs.select("lang", "source", "n_chars", *[S.cell(docs, n, starts[n]).alias(f"c_{n}") for n in S.DIMENSIONS]).collect()
    for n in S.DIMENSIONS:
        key = lambda v: (v is not None, v)
        values = [r[n] for r in rows]
        assert all(r[f"c_{n}"] == sum(key(v) < key(r[n]) for v in values) * 32 // len(values) for r in rows)
        assert len(starts[n]) <= 32


@pytest.mark.parametrize("law", S.LAWS)
def test_laws_and_slots(spark, law):
    docs = some(spark)
    rows = S.shards(docs, ["doc_id", "text"], law=law).collect()
    assert sorted(r.doc_id for r in rows) == list(range(500))
    assert all((r.size, r.text_crc32) == (len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in rows)
    by_shard = [[r for r in rows if r.shard == k] for k in range(16)]
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by_shard)
    counts, sizes = [len(p) for p in by_shard], [sum(r.size for r in p) for p in by_shard]
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    else:
        assert max(abs(x - sum(sizes) / 16) for x in sizes) <= max(r.size for r in rows)
    line = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [(r.curve, r.text_crc32) for r in line] == sorted((r.curve, r.text_crc32) for r in rows)  # equal texts of equal metadata lie side by side


def test_files_can_be_skipped_for_a_filter_on_each_column(spark, tmp_path):
    docs = table(spark, [(i, "x", f"l{i % 8}", f"s{i // 8 % 16:02d}", i // 128) for i in range(4096)])
    S.write_shards(docs, str(tmp_path / "out"), n_shards=64)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*docs.columns, "shard"] and back.drop("shard").exceptAll(docs).isEmpty() and back.count() == 4096
    spans = S.spans(back).collect()
    for n, value in (("lang", "l3"), ("source", "s07"), ("n_chars", 9)):
        assert sum(r[f"least_{n}"] <= value <= r[f"greatest_{n}"] for r in spans) <= 32, n  # of 64; in any order by one column two of three would be 64


def test_odd_tables(spark):
    assert S.op11(table(spark, [])).count() == 0
    assert S.borders(table(spark, [])) == {n: [] for n in S.DIMENSIONS}
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0), (2, "a" * 300_000, "en", "a", 300_000), (2, "a" * 300_000, "en", "a", 300_000)]
    frame = table(spark, rows).withColumns({c: F.lit("mine") for c in ("shard", "slot", "row", "size", "place", "crc", "curve", "id")})
    got = S.op11(frame).collect()
    assert len(got) == 5 and sorted(r.shard for r in got) == [0, 3, 6, 9, 12] and all(r.slot == 0 for r in got)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 1} == {(1, 0)}
    with pytest.raises(ValueError, match="law"):
        S.shards(frame, ["doc_id"], law="key")


def test_a_table_of_one_repeated_row_is_cut_evenly(spark):
    same = spark.range(1000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    counts = [r["count"] for r in S.op11(same).groupBy("shard").count().collect()]
    assert len(counts) == 16 and max(counts) - min(counts) <= 1
