"""Parse raw game lines, validate them, and drop exact and near-simultaneous copies."""

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

#: Only the fields that a later step reads; numbers arrive as text so that "3" and 3 agree.
GAME_SCHEMA = "date string, round string, winner string, players array<struct<utag string, deck string>>"
INSTANT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.]\d{1,9})?Z$"
KEY = ["utag_lo", "utag_hi", "day", "round"]
THRESHOLD_SECONDS = 10


def parse_games(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per non-empty trimmed line; `game` is NULL where the line is no JSON object.

    The parsed value passes through a generator of one row, which neither filters
    nor projections are pushed through, so each line is parsed once however many
    of its fields later steps test.
    """
    line = F.col("line")
    game = F.when(line.startswith("{") & line.endswith("}"), F.from_json(line, GAME_SCHEMA))
    trimmed = lines.select(F.trim(F.col(column)).alias("line")).where(F.length("line") > 0)
    return trimmed.select("line", F.inline(F.array(F.struct(game.alias("game")))))


def flatten(parsed: DataFrame) -> DataFrame:
    """Parsed games -> one flat row each with the reason of rejection, NULL if the row is valid."""
    game, players = F.col("game"), F.col("game.players")
    flat = parsed.select(
        "line",
        game["date"].alias("date"),
        game["round"].alias("round_text"),
        game["winner"].alias("winner"),
        F.size(players).alias("n_players"),
        *[F.get(players, F.lit(i))[name].alias(f"{name}{i}") for i in (0, 1) for name in ("utag", "deck")],
        F.coalesce(game["date"], game["round"], game["winner"], F.when(players.isNotNull(), "")).isNull().alias("empty_game"),
    ).withColumn("round", F.expr("try_cast(round_text AS int)"))
    missing = F.lit(False)
    for name in ("utag0", "utag1", "deck0", "deck1", "date", "round"):
        missing = missing | F.col(name).isNull()
    reason = (
        F.when(F.col("empty_game"), "not_json")
        .when(F.coalesce(F.col("n_players"), F.lit(-1)) != 2, "players")
        .when(missing, "fields")
        .when((F.length("deck0") != 16) | (F.length("deck1") != 16), "deck_length")
        .when(F.length("date") < 10, "date_length")
    )
    return flat.withColumn("reason", reason)


def instant(date: Column) -> Column:
    """ISO-8601 UTC instant -> timestamp, NULL if it is anything else."""
    return F.when(date.rlike(INSTANT), F.try_to_timestamp(date))


def with_keys(flat: DataFrame) -> DataFrame:
    """Accepted rows with match key columns and `ts` (NULL where the date is no instant)."""
    return flat.where(F.col("reason").isNull()).select(
        "line",
        F.least("utag0", "utag1").alias("utag_lo"),
        F.greatest("utag0", "utag1").alias("utag_hi"),
        F.substring("date", 1, 10).alias("day"),
        "round",
        instant(F.col("date")).alias("ts"),
        "deck0",
        "deck1",
        "winner",
    )


def valid_games(lines: DataFrame, column: str = "value") -> DataFrame:
    """Raw lines -> games that pass every record check."""
    return with_keys(flatten(parse_games(lines, column))).where(F.col("ts").isNotNull())


def with_gaps(valid: DataFrame) -> DataFrame:
    """Add `gap`, whole seconds since the predecessor of the same match key, and `same_line`.

    One shuffle on the match key; the window streams over a sorted partition.
    """
    order = Window.partitionBy(*KEY).orderBy("ts", "line")
    before = F.lag("ts").over(order)
    return valid.select(
        "*",
        F.timestamp_diff("SECOND", before, F.col("ts")).alias("gap"),
        F.coalesce(F.lag("line").over(order) == F.col("line"), F.lit(False)).alias("same_line"),
    )


def drop_near_copies(valid: DataFrame, threshold_seconds: int = THRESHOLD_SECONDS) -> DataFrame:
    """Keep a game if no game of its key, kept or not, lies within the threshold before it.

    Sorted neighbours are enough, and equal lines sort side by side, so this
    removes exact copies as well.
    """
    return with_gaps(valid).where(F.col("gap").isNull() | (F.col("gap") > threshold_seconds)).drop("gap", "same_line")


def dedup_exact(valid: DataFrame) -> DataFrame:
    """One copy of each identical line."""
    return valid.dropDuplicates(["line"])


def clean_games(lines: DataFrame, threshold_seconds: int = THRESHOLD_SECONDS, column: str = "value") -> DataFrame:
    """Raw lines -> clean games."""
    return drop_near_copies(valid_games(lines, column), threshold_seconds)


def reject_reasons(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rejected rows by the first rule they break; an unusable instant counts as `timestamp`."""
    flat = flatten(parse_games(lines, column))
    reason = F.coalesce("reason", F.when(instant(F.col("date")).isNull(), "timestamp"))
    return flat.select(reason.alias("reason")).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


REASONS = ("not_json", "players", "fields", "deck_length", "date_length", "timestamp")


def observed_clean(lines: DataFrame, read: Observation, kept: Observation, threshold_seconds: int = THRESHOLD_SECONDS, column: str = "value") -> DataFrame:
    """Clean games whose one pass also fills two observations: of the lines read, and of the games and their copies."""
    reason = F.coalesce("reason", F.when(instant(F.col("date")).isNull(), "timestamp"))
    flat = flatten(parse_games(lines, column)).withColumn("why", reason).observe(read, *_read_figures(F.col("why") == "timestamp"), *[F.count(F.when(F.col("why") == r, 1)).alias(f"rejected_{r}") for r in REASONS])
    gaps = with_gaps(with_keys(flat).where(F.col("ts").isNotNull())).observe(kept, *_copy_figures(threshold_seconds))
    return gaps.where(F.col("gap").isNull() | (F.col("gap") > threshold_seconds)).drop("gap", "same_line")


def clean_and_report(lines: DataFrame, write: Callable[[DataFrame], int], threshold_seconds: int = THRESHOLD_SECONDS, column: str = "value") -> tuple[dict, dict]:
    """Clean the lines and write the games with write(frame), which returns the rows written: the report's figures, and rejected rows by reason.

    Figures are taken while the games are written, so lines are read once.
    Spark may count a task twice when an executor is lost; then the figures no
    longer add up or disagree with the rows written, and the lines are counted anew.
    """
    read, kept = Observation("read"), Observation("kept")
    written = write(observed_clean(lines, read, kept, threshold_seconds, column))
    figures, reasons = _figures(read, kept)
    rejected = sum(n for r, n in reasons.items() if r != "timestamp")
    copies = figures.get("exact_copies", 0) + figures.get("temporal_copies", 0)
    if not figures or figures["input_rows"] != figures["valid_rows"] + rejected or figures["valid_rows"] - figures["bad_timestamps"] - copies != figures["output_rows"] or figures["output_rows"] != written:
        return clean_report(lines, threshold_seconds, column).first().asDict(), {r["reason"]: r["n"] for r in reject_reasons(lines, column).collect()}
    figures["reduction_pct"] = round(100 - 100 * figures["bytes_out"] / figures["bytes_in"], 4) if figures["bytes_in"] else None
    return figures, reasons


def _figures(read: Observation, kept: Observation) -> tuple[dict, dict]:
    """What both have observed, and the rejected rows by reason; nothing where Spark saw beforehand that no rows come and left them out."""
    try:
        figures = read.get | kept.get
    except Py4JJavaError:
        return {}, {}
    return figures, {r: n for r in REASONS if (n := figures.pop(f"rejected_{r}"))}


def _read_figures(bad: Column) -> list[Column]:
    """Figures of flat rows; bad marks accepted rows without a usable instant."""
    return [
        F.count("*").alias("input_rows"),
        F.count(F.when(F.col("reason").isNull(), 1)).alias("valid_rows"),
        F.count(F.when(F.col("reason").isNull() & bad, 1)).alias("bad_timestamps"),
        F.coalesce(F.sum(F.length("line")), F.lit(0)).cast("bigint").alias("bytes_in"),
    ]


def _copy_figures(threshold_seconds: int) -> list[Column]:
    """Figures of games with their gaps."""
    kept = F.col("gap").isNull() | (F.col("gap") > threshold_seconds)
    return [
        F.count(F.when(F.col("same_line"), 1)).alias("exact_copies"),
        F.count(F.when(~kept & ~F.col("same_line"), 1)).alias("temporal_copies"),
        F.count(F.when(kept, 1)).alias("output_rows"),
        F.coalesce(F.sum(F.when(kept, F.length("line"))), F.lit(0)).cast("bigint").alias("bytes_out"),
    ]


def copies_report(gaps: DataFrame, threshold_seconds: int = THRESHOLD_SECONDS) -> DataFrame:
    """One row: exact and temporal copies, rows and bytes out, of games with their gaps."""
    return gaps.agg(*_copy_figures(threshold_seconds))


def clean_report(lines: DataFrame, threshold_seconds: int = THRESHOLD_SECONDS, column: str = "value") -> DataFrame:
    """One row: rows in, valid, exact and temporal copies, bad instants, rows and bytes out.

    Lines are read twice but the wide rows are shuffled once.
    """
    flat = flatten(parse_games(lines, column))
    heads = flat.agg(*_read_figures(instant(F.col("date")).isNull()))
    tails = copies_report(with_gaps(with_keys(flat).where(F.col("ts").isNotNull())), threshold_seconds)
    return heads.crossJoin(F.broadcast(tails)).withColumn(
        "reduction_pct", F.when(F.col("bytes_in") > 0, F.round(100 - 100 * F.col("bytes_out") / F.col("bytes_in"), 4))
    )
