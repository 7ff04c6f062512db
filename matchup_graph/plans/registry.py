"""The registered queries over the `events` table and their DuckDB counterparts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cards import archetypes
from ..operators import clean as C
from ..operators import graph as G
from ..operators import nullmodel as N
from ..operators.skew import HEAVY, PART, heavy_keys
from ..sources import tables as T
from .synth import game_lines, game_lines_sql


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Game lines from the events, which are dealt out first: a small table is one row group, which one task reads."""
    return game_lines(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id").repartition(spark.sparkContext.defaultParallelism))


def _clean(spark, d):
    return C.clean_games(lines(spark, d))


def _decoded(spark, d):
    return G.decode_games(_clean(spark, d))


def _predictions(k):
    def run(spark, d):
        decoded = _decoded(spark, d)
        p = N.predictions(G.packed_edges(decoded, k), G.packed_nodes(decoded, k))
        return p.withColumn("source", G.to_hex(F.col("source"), k)).withColumn("target", G.to_hex(F.col("target"), k))

    return run


def _ratio(k):
    return lambda spark, d: N.prediction_ratio(_predictions(k)(spark, d))


def _parse(spark, d):
    g = F.col("game")
    p = C.parse_games(lines(spark, d)).where(g.isNotNull() & g["date"].isNotNull())
    return p.select("line", g["date"].alias("date"), g["round"].alias("round"), g["winner"].alias("winner"), F.size(g["players"]).cast("bigint").alias("n_players"))


def _valid(spark, d):
    return C.valid_games(lines(spark, d)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def _gaps(spark, d):
    return C.with_gaps(C.valid_games(lines(spark, d))).select("line", F.col("gap").cast("bigint").alias("gap"))


def _array_text(column):
    return F.concat_ws(",", F.transform(column, lambda x: x.cast("string"))).alias(column)


def _decks(frame):
    return frame.select(_array_text("cards0"), _array_text("cards1"), "winner")


BAD_NODE_LINES = ["abc", "0a;x;1", "", "0a0b;7"]
BAD_EDGE_LINES = ["abc", "0a;0b", "0a;0b;x;1", "0a;0b;5"]


def _with_bad(rows: DataFrame, bad: list[str]) -> DataFrame:
    """Text lines of a table with some malformed ones."""
    return T.to_lines(rows).union(rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in bad]))))


def _estimate_holds(decoded: DataFrame, k: int) -> DataFrame:
    """Exact distinct nodes and edges, and whether the sketches come within 3 % of them."""
    exact = G.packed_nodes(decoded, k).agg(F.count("*").alias("nodes")).crossJoin(G.packed_edges(decoded, k).agg(F.count("*").alias("edges")))
    about = G.distinct_estimate(decoded, k).withColumnsRenamed({"nodes": "n", "edges": "e"})
    return exact.crossJoin(about).select("nodes", "edges", *[(F.abs(F.col(x) - F.col(y)) <= 0.03 * F.col(x)).alias(f"{x}_close") for x, y in (("nodes", "n"), ("edges", "e"))])


#: Partitions that the registered query looks for hot sources with, on any cluster.
HOT_PARTITIONS = 64


def _hot(decoded: DataFrame, k: int) -> DataFrame:
    """Sources of over half a partition's mean rows; with fewer sources than a sketch tracks the counts are exact."""
    rows = G.deck_pairs(decoded).select(F.explode(archetypes(F.col("own"), k)).alias("source"))
    return heavy_keys(rows, "source", HOT_PARTITIONS).select(G.to_hex(F.col("source"), k).alias("source"), "parts")


def queries() -> dict:
    q = {
        "parse_games": _parse,
        "valid_games": _valid,
        "match_keys": lambda s, d: C.with_keys(C.flatten(C.parse_games(lines(s, d)))).select("utag_lo", "utag_hi", "day", "round"),
        "temporal_gaps": _gaps,
        "dedup_exact": lambda s, d: C.dedup_exact(C.valid_games(lines(s, d))).select("line"),
        "clean_games": lambda s, d: _clean(s, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")),
        "clean_report": lambda s, d: C.clean_report(lines(s, d)),
        "reject_reasons": lambda s, d: C.reject_reasons(lines(s, d)),
        "decode_games": lambda s, d: _decks(_decoded(s, d)),
        "sorted_decks": lambda s, d: _decks(G.sorted_decks(_decoded(s, d))),
        "side_records": lambda s, d: G.side_records(_decoded(s, d)),
        "archetypes_k2": lambda s, d: G.archetype_rows(_decoded(s, d), 2),
        "matchups_k7": lambda s, d: G.matchups(_decoded(s, d), 7),
        "total_occurrences": lambda s, d: G.total_occurrences(G.packed_nodes(_decoded(s, d), 7)),
        "volume_estimate": lambda s, d: G.volume_estimate(_decoded(s, d)),
        "generation_report_k7": lambda s, d: G.generation_report(_clean(s, d), 7),
        "predictions": _predictions(7),
        "predictions_k2": _predictions(2),
        "prediction_ratio": _ratio(7),
        "linear_fit": lambda s, d: N.linear_fit(_ratio(7)(s, d)),
        "linear_fit_k2": lambda s, d: N.linear_fit(_ratio(2)(s, d)),
        "linear_fit_p": lambda s, d: N.linear_fit_p(_ratio(7)(s, d), 6, 12),
        "source_fits_p": lambda s, d: N.source_fits_p(_ratio(7)(s, d)),
        "distinct_estimate_k7": lambda s, d: _estimate_holds(_decoded(s, d), 7),
        "hot_sources_k1": lambda s, d: _hot(_decoded(s, d), 1),
        "slope_t": lambda s, d: N.slope_t(_ratio(7)(s, d)),
        "fit_line": lambda s, d: N.fit_line(_ratio(7)(s, d)),
        "sample_points": lambda s, d: N.sample_points(_ratio(7)(s, d), 5000),
        "read_nodes": lambda s, d: T.parse_node_lines(_with_bad(G.nodes(_decoded(s, d), 7), BAD_NODE_LINES)),
        "read_edges": lambda s, d: T.parse_edge_lines(_with_bad(G.edges(_decoded(s, d), 7), BAD_EDGE_LINES)),
        "output_sizing": lambda s, d: T.sizing(G.nodes(x := _decoded(s, d), 7), "nodes").union(T.sizing(G.edges(x, 7), "edges")),
    }
    q |= {f"nodes_k{k}": (lambda s, d, k=k: G.nodes(_decoded(s, d), k)) for k in range(1, 9)}
    q |= {f"edges_k{k}": (lambda s, d, k=k: G.edges(_decoded(s, d), k)) for k in range(1, 9)}
    return q


_CTE = f"""WITH {game_lines_sql()},
line AS (SELECT trim(line) AS line FROM raw WHERE length(trim(line)) > 0),
good AS (SELECT line, CASE WHEN json_valid(line) THEN line END AS js FROM line),
parsed AS (SELECT line, js, js ->> '$.date' AS date, js ->> '$.round' AS round_text, js ->> '$.winner' AS winner,
  cast(CASE WHEN js IS NULL THEN -1 ELSE coalesce(json_array_length(js, '$.players'), -1) END AS bigint) AS n_players,
  js ->> '$.players[0].utag' AS utag0, js ->> '$.players[1].utag' AS utag1, js ->> '$.players[0].deck' AS deck0, js ->> '$.players[1].deck' AS deck1 FROM good),
flat AS (SELECT *, CASE WHEN js IS NULL THEN 'not_json' WHEN n_players <> 2 THEN 'players'
  WHEN utag0 IS NULL OR utag1 IS NULL OR deck0 IS NULL OR deck1 IS NULL OR date IS NULL OR try_cast(round_text AS int) IS NULL THEN 'fields'
  WHEN length(deck0) <> 16 OR length(deck1) <> 16 THEN 'deck_length' WHEN length(date) < 10 THEN 'date_length' END AS reason,
  CASE WHEN length(date) = 20 THEN try_strptime(date, '%Y-%m-%dT%H:%M:%SZ') END AS ts FROM parsed),
keyed AS (SELECT line, least(utag0, utag1) AS utag_lo, greatest(utag0, utag1) AS utag_hi, substr(date, 1, 10) AS day, cast(round_text AS int) AS round, ts, deck0, deck1, winner
  FROM flat WHERE reason IS NULL),
valid AS (SELECT * FROM keyed WHERE ts IS NOT NULL),
gaps AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 1000000 AS gap, coalesce(lag(line) OVER w = line, false) AS same_line FROM valid
  WINDOW w AS (PARTITION BY utag_lo, utag_hi, day, round ORDER BY ts, line)),
clean AS (SELECT * FROM gaps WHERE gap IS NULL OR gap > 10),
decoded AS (SELECT lower(deck0) AS deck0, lower(deck1) AS deck1, cast(winner AS int) AS winner FROM clean
  WHERE regexp_full_match(deck0, '[0-9a-fA-F]{{16}}') AND regexp_full_match(deck1, '[0-9a-fA-F]{{16}}') AND winner IN ('-1', '0', '1')),
pairs AS (SELECT list_transform(range(8), lambda i: substr(deck0, cast(2 * i + 1 AS int), 2)) AS c0, list_transform(range(8), lambda i: substr(deck1, cast(2 * i + 1 AS int), 2)) AS c1, winner FROM decoded),
sided AS (SELECT array_to_string(list_sort(c0), '') AS own, array_to_string(list_sort(c1), '') AS other, cast(winner = 0 AS bigint) AS win FROM pairs
  UNION ALL SELECT array_to_string(list_sort(c1), ''), array_to_string(list_sort(c0), ''), cast(winner = 1 AS bigint) FROM pairs)"""


def _arch(k: int) -> str:
    """CTE arch(deck, a): the k-subsets of every distinct deck."""
    return f""",
masks AS (SELECT cast(range AS int) AS m FROM range(256) WHERE bit_count(cast(range AS int)) = {k}),
arch AS (SELECT own AS deck, array_to_string(list_filter(list_transform(range(8), lambda i: CASE WHEN (m >> cast(i AS int)) & 1 = 1 THEN substr(own, cast(2 * i + 1 AS int), 2) END), lambda x: x IS NOT NULL), '') AS a
  FROM (SELECT DISTINCT own FROM sided) d, masks)"""


def _nodes(k: int) -> str:
    return _arch(k) + ",\nnodes AS (SELECT a AS archetype, cast(sum(n) AS bigint) AS count, cast(sum(w) AS bigint) AS wins FROM (SELECT own, count(*) AS n, sum(win) AS w FROM sided GROUP BY own) s JOIN arch ON deck = own GROUP BY a)"


def _edges(k: int) -> str:
    return _nodes(k) + """,
edges AS (SELECT x.a AS source, y.a AS target, cast(sum(n) AS bigint) AS count, cast(sum(w) AS bigint) AS wins
  FROM (SELECT own, other, count(*) AS n, sum(win) AS w FROM sided GROUP BY own, other) s JOIN arch x ON x.deck = own JOIN arch y ON y.deck = other GROUP BY x.a, y.a)"""


def _predicted(k: int) -> str:
    return _edges(k) + """,
predicted AS (SELECT source, target, e.count AS observed, e.wins AS wins, s.count AS total_source, t.count AS total_target,
  cast(s.count AS double) * t.count / (SELECT cast(sum(count) AS bigint) FROM nodes) AS prediction
  FROM edges e JOIN nodes s ON s.archetype = source JOIN nodes t ON t.archetype = target),
rounded AS (SELECT source, target, observed, round(prediction, 4) AS predicted FROM predicted WHERE round(prediction, 4) > 0),
ratio AS (SELECT *, observed / predicted AS ratio FROM rounded)"""


_FIT = """SELECT regr_count(predicted, observed)::bigint AS n, round(regr_slope(predicted, observed), 6) AS slope, round(regr_intercept(predicted, observed), 6) AS intercept,
  round(corr(observed, predicted), 6) AS r, round(regr_r2(predicted, observed), 6) AS r2,
  round(sqrt((1 - regr_r2(predicted, observed)) * regr_syy(predicted, observed) / regr_sxx(predicted, observed) / (regr_count(predicted, observed) - 2)), 6) AS stderr FROM ratio"""
#: Two-sided p-value of fits(g, n, r): the tail of Student's t as a finite sum in cos(theta), theta = asin(|r|), which whole degrees of freedom have.
_TAIL = """,
angles AS (SELECT g, n, r, n - 2 AS df, 1 - r * r AS c2 FROM fits),
terms(g, r, df, c2, j, term, total) AS (SELECT g, r, df, c2, df % 2, CASE WHEN df % 2 = 1 THEN sqrt(c2) ELSE 1.0 END::double, CASE WHEN df = 1 THEN 0.0 WHEN df % 2 = 1 THEN sqrt(c2) ELSE 1.0 END::double FROM angles WHERE df > 0
  UNION ALL SELECT g, r, df, c2, j + 2, term * c2 * (j + 1) / (j + 2), total + CASE WHEN j + 4 <= df THEN term * c2 * (j + 1) / (j + 2) ELSE 0 END FROM terms WHERE j + 4 <= df),
tails AS (SELECT g, greatest(0, 1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (asin(abs(r)) + abs(r) * last) ELSE abs(r) * last END) AS p_value
  FROM (SELECT g, any_value(df) AS df, any_value(r) AS r, max(total) AS last FROM terms GROUP BY g))"""
_CARDS = "array_to_string(list_transform({0}, lambda x: cast(cast(concat('0x', x) AS int) AS varchar)), ',')"


def oracle_sql() -> dict[str, str]:
    bad = lambda rows: ", ".join(f"('{x}')" for x in rows)
    field = lambda i: f"split_part(value, ';', {i})"
    number = lambda i: f"CASE WHEN regexp_full_match({field(i)}, '[+-]?[0-9]{{1,18}}') THEN cast({field(i)} AS bigint) END"
    whole = "line, utag_lo, utag_hi, day, round, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, deck0, deck1, winner"
    sql = {
        "parse_games": "SELECT line, date, round_text AS round, winner, n_players FROM parsed WHERE js IS NOT NULL AND date IS NOT NULL",
        "valid_games": f"SELECT {whole} FROM valid",
        "match_keys": "SELECT utag_lo, utag_hi, day, round FROM keyed",
        "temporal_gaps": "SELECT line, gap FROM gaps",
        "dedup_exact": "SELECT DISTINCT line FROM valid",
        "clean_games": f"SELECT {whole} FROM clean",
        "clean_report": """, heads AS (SELECT count(*) AS input_rows, count(*) FILTER (reason IS NULL) AS valid_rows, count(*) FILTER (reason IS NULL AND ts IS NULL) AS bad_timestamps, cast(sum(length(line)) AS bigint) AS bytes_in FROM flat),
tails AS (SELECT count(*) FILTER (same_line) AS exact_copies, count(*) FILTER (gap <= 10 AND NOT same_line) AS temporal_copies, count(*) FILTER (gap IS NULL OR gap > 10) AS output_rows,
  cast(sum(length(line)) FILTER (gap IS NULL OR gap > 10) AS bigint) AS bytes_out FROM gaps)
SELECT heads.*, tails.*, round(100 - 100 * bytes_out / bytes_in, 4) AS reduction_pct FROM heads, tails""",
        "reject_reasons": "SELECT * FROM (SELECT coalesce(reason, CASE WHEN ts IS NULL THEN 'timestamp' END) AS reason, count(*) AS n FROM flat GROUP BY 1) WHERE reason IS NOT NULL",
        "decode_games": f"SELECT {_CARDS.format('c0')} AS cards0, {_CARDS.format('c1')} AS cards1, winner FROM pairs",
        "sorted_decks": f"SELECT {_CARDS.format('list_sort(c0)')} AS cards0, {_CARDS.format('list_sort(c1)')} AS cards1, winner FROM pairs",
        "side_records": "SELECT own AS deck, win FROM sided",
        "archetypes_k2": _arch(2) + " SELECT a AS archetype, win FROM sided JOIN arch ON deck = own",
        "matchups_k7": _arch(7) + " SELECT x.a AS source, y.a AS target, win FROM sided JOIN arch x ON x.deck = own JOIN arch y ON y.deck = other",
        "total_occurrences": _nodes(7) + " SELECT cast(sum(count) AS bigint) AS total FROM nodes",
        "volume_estimate": """, c(k, c) AS (VALUES (1, 8), (2, 28), (3, 56), (4, 70), (5, 56), (6, 28), (7, 8), (8, 1)), g AS (SELECT count(*) AS games FROM decoded)
SELECT k, games, games * 2 * c AS node_rows, games * 2 * c * c AS edge_rows, k <= 5 AS warn FROM c, g""",
        "generation_report_k7": _edges(7) + """ SELECT games, n - games AS skipped, games * 16 AS node_rows, games * 128 AS edge_rows, nodes, edges
FROM (SELECT count(*) AS games FROM decoded), (SELECT count(*) AS n FROM clean), (SELECT count(*) AS nodes FROM nodes), (SELECT count(*) AS edges FROM edges)""",
        "predictions": _predicted(7) + " SELECT * FROM predicted",
        "predictions_k2": _predicted(2) + " SELECT * FROM predicted",
        "prediction_ratio": _predicted(7) + " SELECT * FROM ratio",
        "linear_fit": _predicted(7) + _FIT,
        "linear_fit_k2": _predicted(2) + _FIT,
        "linear_fit_p": _predicted(7) + ", fits AS (SELECT 0 AS g, regr_count(predicted, observed)::bigint AS n, corr(observed, predicted) AS r FROM ratio)" + _TAIL + f", fit AS ({_FIT}) SELECT fit.*, round(p_value, 12) AS p_value FROM fit, tails",
        "source_fits_p": _predicted(7) + """, fits AS (SELECT source AS g, regr_count(predicted, observed)::bigint AS n, CASE WHEN regr_sxx(predicted, observed) > 0 AND regr_syy(predicted, observed) > 0 THEN corr(observed, predicted) END AS r FROM ratio GROUP BY source)""" + _TAIL + """
SELECT g AS source, n, round(fits.r, 6) AS r, round(CASE WHEN fits.r IS NOT NULL THEN p_value END, 8) AS p_value FROM fits LEFT JOIN tails USING (g)""",
        "distinct_estimate_k7": _edges(7) + " SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, true AS nodes_close, true AS edges_close",
        "hot_sources_k1": _arch(1) + f""", rows AS (SELECT x.a AS source, count(*) AS n FROM (SELECT DISTINCT own, other FROM sided) JOIN arch x ON x.deck = own GROUP BY x.a)
SELECT source, cast(ceil(n * {HOT_PARTITIONS} / (SELECT sum(n) FROM rows)::double / {PART}) AS int) AS parts FROM rows WHERE n * {HOT_PARTITIONS} / (SELECT sum(n) FROM rows)::double > {HEAVY}""",
        "slope_t": _predicted(7) + """ SELECT n, n - 2 AS df, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t FROM (SELECT regr_count(predicted, observed)::bigint AS n, corr(observed, predicted) AS r FROM ratio)""",
        "fit_line": _predicted(7) + """ SELECT point, x, round(intercept + slope * x, 6) AS y FROM (SELECT regr_slope(predicted, observed) AS slope, regr_intercept(predicted, observed) AS intercept, min(observed) AS lo, max(observed) AS hi FROM ratio),
LATERAL (SELECT cast(p AS int) AS point, CASE p WHEN 0 THEN lo ELSE hi END AS x FROM range(2) r(p))""",
        "sample_points": _predicted(7) + " SELECT * FROM ratio ORDER BY md5(concat(source, target, '42')), source, target LIMIT 5000",
        "read_nodes": _nodes(7) + f""", text(value) AS (SELECT concat_ws(';', archetype, count, wins) FROM nodes UNION ALL VALUES {bad(BAD_NODE_LINES)})
SELECT {field(1)} AS archetype, {number(2)} AS count FROM text WHERE {number(2)} IS NOT NULL""",
        "read_edges": _edges(7) + f""", text(value) AS (SELECT concat_ws(';', source, target, count, wins) FROM edges UNION ALL VALUES {bad(BAD_EDGE_LINES)})
SELECT {field(1)} AS source, {field(2)} AS target, {number(3)} AS count, coalesce({number(4)}, 0) AS wins FROM text WHERE {number(3)} IS NOT NULL""",
        "output_sizing": _edges(7) + """, text(t, line) AS (SELECT 'nodes', concat_ws(';', archetype, count, wins) FROM nodes UNION ALL SELECT 'edges', concat_ws(';', source, target, count, wins) FROM edges)
SELECT t AS table_name, count(*) AS rows, cast(sum(length(line)) AS bigint) AS bytes, cast(greatest(1, ceil(sum(length(line)) / 134217728.0)) AS bigint) AS partitions FROM text GROUP BY t""",
    }
    sql |= {f"nodes_k{k}": _nodes(k) + " SELECT * FROM nodes" for k in range(1, 9)}
    sql |= {f"edges_k{k}": _edges(k) + " SELECT * FROM edges" for k in range(1, 9)}
    return {name: (_CTE.replace("WITH ", "WITH RECURSIVE ", 1) if name.endswith("_p") else _CTE) + ("\n" if rest.startswith(("SELECT", " SELECT")) else "") + rest for name, rest in sql.items()}
