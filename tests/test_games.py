import hashlib
import json
import math
from collections import Counter
from itertools import combinations
from statistics import median

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchup_graph.functions.cards import archetypes
from matchup_graph.functions.stats import slope_p_value
from matchup_graph.operators import clean as C
from matchup_graph.operators import graph as G
from matchup_graph.operators import nullmodel as N
from matchup_graph.operators.skew import deal, heavy_keys
from matchup_graph.plans import jobs
from matchup_graph.plans.synth import zipf_games
from matchup_graph.sources import tables as T

A, B = "0102030405060708", "1112131415161718"


def game(date="2025-11-11T10:00:00Z", u="#A", v="#B", a=A, b=B, winner=0, rnd=1, **more):
    record = {"date": date, "round": rnd, "winner": winner, "players": [{"utag": u, "deck": a}, {"utag": v, "deck": b}]} | more
    return json.dumps({k: x for k, x in record.items() if x != "drop"}, separators=(",", ":"))


def frame(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def at(*seconds):
    return [game(f"2025-11-11T10:00:{s:02d}Z") for s in seconds]


def n_clean(spark, lines):
    return C.clean_games(frame(spark, lines)).count()


@pytest.mark.parametrize(
    ("lines", "kept"),
    [
        (at(0, 8, 16, 24), 1),
        ([game("2025-11-11T10:00:00Z"), game("2025-11-11T10:00:10.9Z")], 1),
        ([game("2025-11-11T10:00:00Z"), game("2025-11-11T10:00:11Z")], 2),
        ([game("2025-11-11T23:59:58Z"), game("2025-11-12T00:00:03Z")], 2),
        ([game(), game("2025-11-11T10:00:05Z", "#B", "#A", B, A, 1)], 1),
        ([game(), game(), game()], 1),
        ([game(), game(rnd=2)], 2),
        (["", "  ", "[1]", "{", '{"a":1}', "x" + game(), game(players={"utag": "x"}), game(players=[]), game(players=[{"utag": "a", "deck": A}] * 3)], 0),
        ([game("2025-11-11"), game("2025-11-11T10:00:00+01:00"), game("2025-13-11T10:00:00Z"), game("2025")], 0),
        ([game(rnd="3"), game(rnd=None, u="#C"), game(rnd="x", u="#D"), game(rnd="drop", u="#E")], 1),
        ([game(a=A[:15]), game(a=A + "0"), game(a=None), game(u=None)], 0),
        ([game(a="zz" + A[2:])], 1),
    ],
)
def test_clean_cases(spark, lines, kept):
    assert n_clean(spark, lines) == kept


def test_same_time_keeps_smaller_line(spark):
    x, y = game(winner=0), game(winner=1)
    assert [r.line for r in C.clean_games(frame(spark, [y, x])).collect()] == [x]


def test_report_adds_up(spark):
    lines = [game(), game(), *at(20, 25), game("2025-11-11"), "{", game(a="0")]
    r = C.clean_report(frame(spark, lines)).first()
    assert (r.input_rows, r.valid_rows, r.bad_timestamps, r.exact_copies, r.temporal_copies, r.output_rows) == (7, 5, 1, 1, 1, 2)
    assert r.valid_rows - r.bad_timestamps - r.exact_copies - r.temporal_copies == r.output_rows
    assert {x.reason: x.n for x in C.reject_reasons(frame(spark, lines)).collect()} == {"timestamp": 1, "not_json": 1, "deck_length": 1}


def test_report_of_nothing(spark):
    r = C.clean_report(frame(spark, [])).first()
    assert (r.input_rows, r.output_rows, r.bytes_in, r.reduction_pct) == (0, 0, 0, None)


def brute(games, k):
    nodes, wins, edges, edge_wins = Counter(), Counter(), Counter(), Counter()
    for a, b, w in games:
        subsets = [["".join(c) for c in combinations(sorted(d[i : i + 2] for i in range(0, 16, 2)), k)] for d in (a.lower(), b.lower())]
        for side, own, other in ((0, *subsets), (1, *subsets[::-1])):
            for x in own:
                nodes[x] += 1
                wins[x] += w == side
                for y in other:
                    edges[x, y] += 1
                    edge_wins[x, y] += w == side
    return {x: (n, wins[x]) for x, n in nodes.items()}, {x: (n, edge_wins[x]) for x, n in edges.items()}


GAMES = [(A, B, 0), (A, A, 0), (A.replace("08", "07"), "F0E0D0C0B0A09080", 1), ("0a0a" + A[4:], B, -1), ("FFFEFDFCFBFAF9F8", A, 1)]


def decoded(spark, games):
    return G.decode_games(spark.createDataFrame([(a, b, str(w)) for a, b, w in games], "deck0 string, deck1 string, winner string"))


@pytest.mark.parametrize("k", range(1, 9))
def test_nodes_and_edges_match_brute_force(spark, k):
    d = decoded(spark, GAMES)
    nodes, edges = brute(GAMES, k)
    assert {r.archetype: (r["count"], r.wins) for r in G.nodes(d, k).collect()} == nodes
    for salt in (None, 1, 3):
        assert {(r.source, r.target): (r["count"], r.wins) for r in G.edges(d, k, salt=salt).collect()} == edges
    if k in (1, 7, 8):
        plain = G.matchups(d, k).groupBy("source", "target").agg(F.count("*"), F.sum("win")).collect()
        assert {(r[0], r[1]): (r[2], r[3]) for r in plain} == edges


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.integers(0, 255), min_size=8, max_size=8).map(lambda c: bytes(c).hex())] * 2, st.sampled_from([-1, 0, 1])), min_size=1, max_size=4), st.sampled_from([2, 6]))
def test_relations(spark, games, k):
    node_n, edge_n = G.rows_per_game(k)
    d = decoded(spark, games)
    nodes = {r.archetype: r for r in G.nodes(d, k).collect()}
    edges = {(r.source, r.target): r for r in G.edges(d, k).collect()}
    assert sum(r["count"] for r in nodes.values()) == node_n * len(games)
    assert sum(r.wins for r in nodes.values()) == node_n // 2 * sum(w >= 0 for *_, w in games)
    assert sum(r["count"] for r in edges.values()) == edge_n * len(games)
    assert all(r["count"] == edges[y, x]["count"] for (x, y), r in edges.items())


def test_undecodable_games_are_skipped(spark):
    assert decoded(spark, [("zz" + A[2:], B, 0), (A, B, 2), (A, B, None), (A, B, 1)]).count() == 1


def test_guards(spark):
    d = decoded(spark, GAMES)
    for k in (0, 9):
        with pytest.raises(ValueError):
            G.nodes(d, k)
    with pytest.raises(ValueError):
        G.edges(d, 4, max_rows=10)
    with pytest.raises(ValueError):
        G.edges(d, 4, salt=0)


def test_lines_are_parsed_once(spark):
    for games in (C.clean_games, C.clean_report, C.reject_reasons):
        plan = games(frame(spark, [game()]))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == (2 if games is C.clean_report else 1)  # the report reads the lines twice


def test_generation_report(spark):
    games = [*GAMES, ("zz" + A[2:], B, 0), (A, B, 5)]
    clean = spark.createDataFrame([(a, b, str(w)) for a, b, w in games], "deck0 string, deck1 string, winner string")
    for k in (2, 7):
        nodes, edges = brute(GAMES, k)
        node_n, edge_n = G.rows_per_game(k)
        assert tuple(G.generation_report(clean, k).first()) == (5, 2, 5 * node_n, 5 * edge_n, len(nodes), len(edges))
    assert tuple(G.generation_report(clean.limit(0), 7).first()) == (0,) * 6


def test_plans(spark):
    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    p = plan(C.clean_games(frame(spark, [game()])))
    assert p.count("Exchange hashpartitioning") == 1 and "Python" not in p
    p = plan(G.packed_edges(decoded(spark, GAMES), 2, salt=1))
    assert p.count("Exchange hashpartitioning") == 1 and "Python" not in p
    p = plan(G.packed_edges(decoded(spark, GAMES), 2))
    assert "approx_top_k" in p and "Python" not in p


def loads(dealt):
    return sorted(r.n for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


@pytest.mark.parametrize("k", [1, 2, 7])
def test_hot_sources_are_found_and_spread(spark, k):
    n = 16
    d = zipf_games(spark, 4000, decks=600).cache()
    rows = G.deck_pairs(d).select(F.explode(archetypes(F.col("own"), k)).alias("source"), "other", "count").cache()
    light, split = deal(rows, "source", "other", n)
    assert rows.exceptAll(light.unionByName(split.drop("salt"))).isEmpty() and light.count() + split.count() == rows.count()
    plain = rows.repartition(n, "source")
    if k == 1:  # of 110 cards few are played often
        assert loads(plain)[-1] > 3 * median(loads(plain))
    for part in (light, split):
        found = loads(part)
        assert not found or found[-1] < 3 * median(found) or found[-1] < rows.count() / n  # a task below the mean of all may stand out in its exchange
    # keys of three fourths of a partition's mean rows or more are listed, and none below half of it but for the sketch's error
    exact = {r.source: r["count"] for r in rows.groupBy("source").count().collect()}
    listed, mean = {r.source: r.parts for r in heavy_keys(rows, "source", n).collect()}, rows.count() / n
    assert {s for s, c in exact.items() if c >= 0.75 * mean} <= set(listed) and all(exact[s] >= 0.25 * mean for s in listed)
    assert all(parts >= 8 * exact[s] / mean - 3 for s, parts in listed.items())
    assert G.packed_edges(d, k).exceptAll(G.packed_edges(d, k, salt=1)).isEmpty()


def test_a_pair_that_holds_a_third_of_all_games(spark):
    d = zipf_games(spark, 600, decks=60)
    hot = spark.range(300).select(*[F.array(*[F.lit(16 * n + i).cast("bigint") for i in range(8)]).alias(f"cards{n}") for n in (0, 1)], F.lit(0).alias("winner"))
    both = d.union(hot)
    assert G.packed_edges(both, 2, partitions=8).exceptAll(G.packed_edges(both, 2, salt=1)).isEmpty()
    rows = G.deck_pairs(both).select(F.explode(archetypes(F.col("own"), 2)).alias("source"), "other")
    assert max(r["count"] for r in rows.groupBy("source", "other").count().collect()) <= 28 * 28  # one row for each own deck's subset, however many games
    assert heavy_keys(rows.limit(0), "source", 8).count() == 0


def test_predictions(spark):
    edges = spark.createDataFrame([("a", "b", 4, 1), ("a", "x", 9, 0)], "source string, target string, count bigint, wins bigint")
    nodes = spark.createDataFrame([("a", 3), ("b", 5), ("c", 8), ("x", 0)], "archetype string, count bigint")
    rows = N.predictions(edges, nodes).collect()
    assert [tuple(r) for r in rows] == [("a", "b", 4, 1, 3, 5, 15 / 16)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert N.predictions(edges, nodes).collect() == rows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def ratio(spark, rows):
    return N.prediction_ratio(spark.createDataFrame([(str(i), str(i), x, y) for i, (x, y) in enumerate(rows)], "source string, target string, observed bigint, prediction double"))


def test_fit_sample_and_small_predictions(spark):
    r = ratio(spark, [(1, 2.0), (2, 3.0), (4, 4.0), (7, 0.00004)])
    assert r.count() == 3
    fit = N.linear_fit_p(r).first()
    assert (fit.slope, fit.intercept, fit.r2) == pytest.approx((0.642857142857, 1.5, 0.964285714286))
    assert fit.p_value == pytest.approx(0.1210376, rel=1e-5)
    assert [(x.x, round(x.y, 4)) for x in N.fit_line(r).collect()] == [(1, 2.1429), (4, 4.0714)]
    assert N.sample_points(r, 5).count() == 3
    assert N.sample_points(r, 2).collect() == N.sample_points(r, 2).collect()


@pytest.mark.parametrize(
    ("rows", "fit"),
    [
        ([], (0, None, None, None, None, None)),
        ([(3, 2.0)], (1, None, None, None, None, None)),
        ([(3, 2.0), (3, 5.0), (3, 7.0)], (3, None, None, None, None, None)),
        ([(1, 2.0), (2, 2.0), (4, 2.0)], (3, 0.0, 2.0, None, 1.0, 0.0)),
        ([(1, 2.0), (3, 6.0)], (2, 2.0, 0.0, 1.0, 1.0, None)),
    ],
)
def test_degenerate_fits(spark, rows, fit):
    r = ratio(spark, rows)
    assert tuple(N.linear_fit(r).first()) == pytest.approx(fit)
    assert N.linear_fit_p(r).first().p_value is None
    assert N.fit_line(r).count() == 2 and N.slope_t(r).first().n == fit[0]


def simpson_p(r, n):
    """The tail of Student's t by Simpson's rule over its angle: p = 1 - c * integral of cos^(df - 1) from 0 to asin |r|."""
    df = n - 2
    top, steps = math.asin(abs(r)), 4000
    f = lambda x: math.cos(x) ** (df - 1)
    h = top / steps
    area = h / 3 * sum(f(i * h) * (1 if i in (0, steps) else 4 if i % 2 else 2) for i in range(steps + 1))
    return 1 - 2 * area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)


def test_p_values(spark):
    cases = [(r, n) for r in (0.9999, 0.9, -0.5, 0.1, -0.01, 0.001) for n in (3, 4, 5, 8, 30, 101, 1000, 20_000)]
    rows = spark.createDataFrame(cases, "r double, n bigint").select("r", "n", slope_p_value(F.col("r"), F.col("n")).alias("p")).collect()
    for x in rows:
        assert x.p == pytest.approx(simpson_p(x.r, x.n), rel=1e-7, abs=1e-11), x
    odd = spark.createDataFrame([(None, 10), (0.5, 2), (1.0, 10), (-1.0, 10), (0.0, 10), (0.5, 4)], "r double, n bigint").select(slope_p_value(F.col("r"), F.col("n")).alias("p")).collect()
    assert [x.p for x in odd] == [None, None, 0.0, 0.0, 1.0, pytest.approx(0.5)]  # two degrees of freedom: 1 - |r|
    # a billion rows: t is nearly normal, p = erfc(t / sqrt 2)
    t = 2.5
    r = t / math.sqrt(10**9 - 2 + t * t)
    big = spark.createDataFrame([(r, 10**9)], "r double, n bigint").select(slope_p_value(F.col("r"), F.col("n")).alias("p")).first().p
    assert big == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-7)


def test_fit_with_p_value_is_one_plan(spark):
    frame_ = N.linear_fit_p(ratio(spark, [(1, 2.0), (2, 3.0), (4, 4.0)]))
    assert "Python" not in frame_._jdf.queryExecution().executedPlan().toString() and "LocalRelation [n" not in frame_._jdf.queryExecution().optimizedPlan().toString()


def test_sample_is_the_first_rows_in_hash_order(spark):
    rows = [(f"s{i}", f"t{i % 7}", i, 1.0 + i) for i in range(3000)] + [("dup", "dup", 1, 2.0)] * 3
    r = N.prediction_ratio(spark.createDataFrame(rows, "source string, target string, observed bigint, prediction double"))
    order = sorted((hashlib.md5(f"{s}{t}42".encode()).hexdigest(), s, t) for s, t, *_ in rows)
    for n in (0, 1, 2, 700, 3002, 3003, 5000):
        assert sorted((x.source, x.target) for x in N.sample_points(r, n).collect()) == sorted((s, t) for _, s, t in order[:n])
    assert N.sample_points(r.limit(0), 5).count() == 0


def test_clean_counts_while_it_writes(spark, tmp_path, monkeypatch):
    lines = frame(spark, [game(), game(), *at(20, 25), game("2025-11-11"), "{", game(a="0"), "", game(u="#C", rnd=None)])
    written = []

    def write(games):
        written.append(games._jdf.queryExecution().executedPlan().toString())
        games.write.parquet(str(tmp_path / f"out{len(written)}"))
        return spark.read.parquet(str(tmp_path / f"out{len(written)}")).count()

    expected = C.clean_report(lines).first().asDict(), {r["reason"]: r["n"] for r in C.reject_reasons(lines).collect()}
    with monkeypatch.context() as m:
        m.setattr(C, "clean_report", None)  # not needed as long as the figures add up
        assert C.clean_and_report(lines, write) == expected
    assert written[0].count("Scan ExistingRDD") + written[0].count("LocalTableScan") == 1 and written[0].count("Exchange hashpartitioning") == 1
    again = C.clean_and_report(lines, lambda games: write(games) + 1)  # figures that disagree with what is written are counted anew
    assert again == expected
    nothing = C.clean_and_report(frame(spark, []), write)
    assert nothing == (C.clean_report(frame(spark, [])).first().asDict(), {})


def test_bucketed_tables_meet_without_a_shuffle_of_edges(spark, tmp_path):
    d = decoded(spark, GAMES)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        T.write_bucketed(G.nodes(d, 7), "t_nodes", "archetype", str(tmp_path / "n"), 4)
        T.write_bucketed(G.edges(d, 7), "t_edges", "source", str(tmp_path / "e"), 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        nodes, edges = spark.table("t_nodes"), spark.table("t_edges")
        plan = N.with_total(edges, nodes, "source")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert sorted(map(tuple, N.predictions(edges, nodes).collect())) == sorted(map(tuple, N.predictions(G.edges(d, 7), G.nodes(d, 7)).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS t_nodes"), spark.sql("DROP TABLE IF EXISTS t_edges")


def test_distinct_estimates(spark):
    d = zipf_games(spark, 1500, decks=400)
    for k in (2, 7):
        exact = G.packed_nodes(d, k).count(), G.packed_edges(d, k).count()
        about = G.distinct_estimate(d, k).first()
        assert all(abs(x - y) <= 0.03 * x for x, y in zip(exact, about, strict=True)), (exact, about)
    assert tuple(G.distinct_estimate(d.limit(0), 2).first()) == (0, 0)


def test_files_have_the_target_size_whatever_the_skew(spark, tmp_path):
    d, k, target = zipf_games(spark, 1500, decks=400), 2, 2_000_000
    edges = G.edges(d, k).cache()
    n = T.files_for(G.distinct_estimate(d, k).first()["edges"], G.line_bytes(k, 2), target)
    T.write_lines(edges, str(tmp_path / "e"), ["source", "target"], n)
    sizes = [p.stat().st_size for p in (tmp_path / "e").glob("part-*")]
    assert len(sizes) == n > 2 and all(0.5 * target < s < 1.25 * target for s in sizes), sizes
    for p in (tmp_path / "e").glob("part-*"):  # each file is in the order of its keys
        keys = [tuple(x.split(";")[:2]) for x in p.read_text().split()]
        assert keys == sorted(keys)
    assert T.files_for(0, 10) == 1 and T.files_for(100, 10, 1000) == 1 and T.files_for(101, 10, 1000) == 2


def test_one_file_is_merged_from_parts(spark, tmp_path):
    rows, path = spark.range(1000).repartition(5).select(F.col("id").cast("string").alias("a"), F.lit("é").alias("b")), tmp_path / "one"
    for _ in range(2):
        T.write_lines(rows, str(path), ["a"], single=True)
    assert sorted(p.name for p in path.iterdir() if not p.name.startswith((".", "_SUCCESS"))) == ["merged.txt"]
    assert sorted(r.value for r in spark.read.text(str(path)).collect()) == sorted(f"{i};é" for i in range(1000))
    T.write_lines(rows.limit(0), str(tmp_path / "none"), single=True)
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_jobs_end_to_end(spark, tmp_path, capsys):
    raw, base = str(tmp_path / "raw"), str(tmp_path / "out")
    frame(spark, [*at(0, 30, 45), game(u="#C", winner=1), "bad"]).write.text(raw)
    jobs.clean_job(spark, raw, f"{base}/clean", 2)
    with pytest.raises(FileNotFoundError):
        jobs.stats_job(spark, base, f"{base}/stats")
    for _ in range(2):
        jobs.nodesedges_job(spark, f"{base}/clean", base, 7, 1, 3, tables="job")
    assert T.read_nodes(spark, f"{base}/nodes").agg(F.sum("count")).first()[0] == 4 * 16
    jobs.stats_job(spark, base, f"{base}/stats", single=True)
    p = T.read_predictions(spark, f"{base}/stats")
    jobs.stats_job(spark, base, f"{base}/stats2", tables="job")
    assert sorted(map(tuple, T.read_predictions(spark, f"{base}/stats2").collect())) == sorted(map(tuple, p.collect()))
    spark.sql("DROP TABLE job_nodes"), spark.sql("DROP TABLE job_edges")
    assert p.count() == 128 and p.where("prediction <= 0 OR prediction IS NULL").count() == 0
    jobs.analysis_job(spark, f"{base}/stats", f"{base}/analysis", 10)
    assert spark.read.parquet(f"{base}/analysis/points").count() == 10
    said = capsys.readouterr().out
    assert "rejected: reason=not_json, n=1" in said and "output_rows=4" in said and "games: 4, skipped: 0" in said and "table_name=edges, rows=128" in said and "estimated: nodes=16, edges=128, nodes_files=1, edges_files=3" in said and "wall_s=" in said
    with pytest.raises(ValueError):
        jobs.nodesedges_job(spark, f"{base}/clean", base, 2, max_rows=100)


def test_old_sequence_files(spark, tmp_path):
    path, lines = str(tmp_path / "old"), [*at(0, 30), "bad"]
    spark.sparkContext.parallelize([(None, x) for x in lines], 2).saveAsSequenceFile(path)
    read = T.read_sequence_lines(spark, path)
    assert sorted(r.value for r in read.collect()) == sorted(lines) and read.columns == ["value"]
    assert "Python" not in read._jdf.queryExecution().executedPlan().toString() and "PythonRDD" not in read._jdf.rdd().toDebugString()
    jobs.nodesedges_job(spark, path, str(tmp_path / "out"), 8, sequence=True)
    assert T.read_nodes(spark, str(tmp_path / "out/nodes")).agg(F.sum("count")).first()[0] == 4


def test_malformed_table_lines(spark):
    lines = frame(spark, ["abc", "0a;x;1", "0a;7", "0b;8;3"])
    assert [tuple(r) for r in T.parse_node_lines(lines).collect()] == [("0a", 7), ("0b", 8)]
    lines = frame(spark, ["a;b", "a;b;x;1", "a;b;5", "a;b;6;2"])
    assert [tuple(r) for r in T.parse_edge_lines(lines).collect()] == [("a", "b", 5, 0), ("a", "b", 6, 2)]


def test_sizing(spark):
    assert tuple(T.sizing(spark.createDataFrame([("ab", 1)], "a string, c int"), "t").first()) == ("t", 1, 4, 1)
