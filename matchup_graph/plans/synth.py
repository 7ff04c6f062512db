"""Deterministic game lines from the `events` table, in Spark and in DuckDB SQL.

Every event gives a base record; some also give a copy or a broken record.
"""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (condition on event_id, seconds added to the date, change of the record)
COPIES = [
    ("event_id % 10 = 0", 5, "swap"),
    ("event_id % 10 = 1", 10, "same"),
    ("event_id % 10 = 2", 11, "same"),
    ("event_id % 10 = 3", 0, "same"),
    ("event_id % 50 = 7", 7200, "short_deck"),
    ("event_id % 50 = 8", 7200, "one_player"),
    ("event_id % 50 = 9", 7200, "cut_line"),
    ("event_id % 50 = 10", 7200, "short_date"),
    ("event_id % 50 = 11", 7200, "no_hex"),
    ("event_id % 50 = 12", 7200, "no_winner"),
    ("event_id % 50 = 13", 7200, "no_round"),
]

#: The same in both engines.
_BASE = """event_id, ts, concat('#U', cast(user_id AS varchar(20))) AS tag_a, concat('#V', cast(event_id % 37 AS varchar(20))) AS tag_b,
  substr(md5(concat('d', cast(user_id % 20 AS varchar(20)))), 1, 16) AS deck_a, substr(md5(concat('d', cast(event_id % 23 AS varchar(20)))), 1, 16) AS deck_b,
  CASE WHEN event_id % 11 = 0 THEN -1 WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS winner, event_id % 3 AS round"""


def _line(date: str, change: str) -> str:
    """SQL for one record's JSON line."""
    a, b, winner = ("tag_a", "deck_a"), ("tag_b", "deck_b"), "winner"
    if change == "swap":
        a, b, winner = b, a, "CASE winner WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE winner END"
    if change == "short_deck":
        a = (a[0], "substr(deck_a, 1, 14)")
    if change == "no_hex":
        a = (a[0], "concat('zz', substr(deck_a, 3, 14))")
    if change == "short_date":
        date = f"substr({date}, 1, 10)"
    player = lambda p: f"""'{{"utag":"', {p[0]}, '","deck":"', {p[1]}, '"}}'"""
    parts = [f"""'{{"date":"', {date}, '"'"""]
    if change != "no_round":
        parts.append("""',"round":', cast(round AS varchar(20))""")
    if change != "no_winner":
        parts.append(f"""',"winner":', cast({winner} AS varchar(20))""")
    players = player(a) if change == "one_player" else f"{player(a)}, ',', {player(b)}"
    parts.append(f"""',"players":[', {players}, ']}}'""")
    line = f"concat({', '.join(parts)})"
    return f"substr({line}, 1, 40)" if change == "cut_line" else line


def game_lines(events: DataFrame) -> DataFrame:
    """(value) lines; events are scanned once and only three columns of them read."""
    base = events.select("event_id", "ts", "user_id").selectExpr(*[x.strip() for x in _split(_BASE)])
    date = lambda shift: f"date_format(timestampadd(SECOND, {shift}, ts), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    lines = [F.expr(_line(date(0), "same")), *[F.expr(f"CASE WHEN {when} THEN {_line(date(shift), change)} END") for when, shift, change in COPIES]]
    return base.select(F.explode(F.array_compact(F.array(*lines))).alias("value"))


def _split(columns: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth = [""], 0
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def game_lines_sql() -> str:
    """DuckDB CTEs `base` and `raw(line)`."""
    date = lambda shift: f"strftime(ts + to_seconds({shift}), '%Y-%m-%dT%H:%M:%SZ')"
    selects = [f"SELECT {_line(date(0), 'same')} AS line FROM base"]
    selects += [f"SELECT {_line(date(shift), change)} FROM base WHERE {when}" for when, shift, change in COPIES]
    return f"base AS (SELECT {_BASE} FROM events),\nraw AS (\n" + "\nUNION ALL ".join(selects) + ")"


def zipf_games(spark: SparkSession, games: int, decks: int = 30_000, cards: int = 110) -> DataFrame:
    """(d0, d1, winner)-like decoded games for measuring: deck n is played in proportion to 1 / n, low cards are the popular ones."""
    part = lambda *by: F.pmod(F.xxhash64(*by), F.lit(1 << 30)) / float(1 << 30)  # noqa: E731  a fraction below 1
    deck = lambda side: F.floor(F.exp(part("id", F.lit(side)) * math.log(decks))).cast("int")
    card = lambda d, i: F.floor(cards * F.pow(part(d, F.lit(i)), 2)).cast("bigint")
    drawn = spark.range(games).select("id", deck(0).alias("a"), deck(1).alias("b"))
    return drawn.select(*[F.array(*[card(d, i) for i in range(8)]).alias(f"cards{n}") for n, d in enumerate("ab")], (F.pmod("id", F.lit(3)) - 1).cast("int").alias("winner"))
