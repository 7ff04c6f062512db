"""Archetype nodes and directed match-up edges."""

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cards import DECK_SIZE, archetypes, card_ids, check_k, is_hex_deck, pack_deck, to_hex
from .skew import deal

WARN_K = 5


def rows_per_game(k: int) -> tuple[int, int]:
    """Node and edge records that one game gives."""
    c = comb(DECK_SIZE, check_k(k))
    return 2 * c, 2 * c * c


def decodable() -> Column:
    """True where both decks of a clean game are hex and the winner is -1, 0 or 1."""
    return F.coalesce(is_hex_deck(F.col("deck0")) & is_hex_deck(F.col("deck1")) & F.col("winner").isin("-1", "0", "1"), F.lit(False))


def decode_games(clean: DataFrame) -> DataFrame:
    """Clean games -> (cards0, cards1, winner); undecodable decks and winners outside -1, 0, 1 go."""
    return clean.where(decodable()).select(
        card_ids(F.col("deck0")).alias("cards0"), card_ids(F.col("deck1")).alias("cards1"), F.col("winner").cast("int").alias("winner")
    )


def sorted_decks(decoded: DataFrame) -> DataFrame:
    """Cards ascending, repeats kept."""
    return decoded.select(F.array_sort("cards0").alias("cards0"), F.array_sort("cards1").alias("cards1"), "winner")


def sides(decoded: DataFrame) -> DataFrame:
    """Two rows per game: own packed deck, the other one, and 1 if the own side won."""
    packed = decoded.select(pack_deck(F.col("cards0")).alias("d0"), pack_deck(F.col("cards1")).alias("d1"), "winner")
    both = F.array(
        F.struct(F.col("d0").alias("own"), F.col("d1").alias("other"), (F.col("winner") == 0).cast("bigint").alias("win")),
        F.struct(F.col("d1").alias("own"), F.col("d0").alias("other"), (F.col("winner") == 1).cast("bigint").alias("win")),
    )
    return packed.select(F.inline(both))


def side_records(decoded: DataFrame) -> DataFrame:
    """Two rows per game: sorted deck in hex and its win flag."""
    return sides(decoded).select(to_hex(F.col("own"), DECK_SIZE).alias("deck"), "win")


def archetype_rows(decoded: DataFrame, k: int) -> DataFrame:
    """One row per game, side and card subset."""
    return sides(decoded).select(F.explode(archetypes(F.col("own"), k)).alias("a"), "win").select(to_hex(F.col("a"), k).alias("archetype"), "win")


def matchups(decoded: DataFrame, k: int) -> DataFrame:
    """One row per game, direction and pair of subsets: the plain form, for small inputs and checks."""
    return (
        sides(decoded)
        .select(F.explode(archetypes(F.col("own"), k)).alias("s"), "other", "win")
        .select("s", F.explode(archetypes(F.col("other"), k)).alias("t"), "win")
        .select(to_hex(F.col("s"), k).alias("source"), to_hex(F.col("t"), k).alias("target"), "win")
    )


def packed_nodes(decoded: DataFrame, k: int) -> DataFrame:
    """Occurrences and wins by packed archetype; whole decks are counted first."""
    decks = sides(decoded).groupBy("own").agg(F.count("*").alias("count"), F.sum("win").alias("wins"))
    return (
        decks.select(F.explode(archetypes(F.col("own"), k)).alias("archetype"), "count", "wins")
        .groupBy("archetype")
        .agg(F.sum("count").alias("count"), F.sum("wins").alias("wins"))
    )


def deck_pairs(decoded: DataFrame) -> DataFrame:
    """Games and own wins by directed pair of whole decks."""
    return sides(decoded).groupBy("own", "other").agg(F.count("*").alias("count"), F.sum("win").alias("wins"))


def _count_targets(dealt: DataFrame, keys: list[str], k: int, sums: list[str]) -> DataFrame:
    """Rows that are dealt by `keys` -> sums by keys and target, without another shuffle."""
    totals = [F.sum(c).alias(c) for c in sums]
    by_deck = dealt.groupBy(*keys, "other").agg(*totals)
    return by_deck.select(*keys, F.explode(archetypes(F.col("other"), k)).alias("target"), *sums).groupBy(*keys, "target").agg(*totals)


def edges_of_pairs(pairs: DataFrame, k: int, partitions: int | None = None) -> DataFrame:
    """Pairs of decks (own, other, sums...) -> the sums by packed (source, target), however popular a source is.

    Pairs are counted before, so a pair that holds a third of all games is one
    row for each of its sources.  A sketch of the sources finds those too heavy
    for a task; only they are spread, by the other deck, and summed again.  All
    three uses of the pairs read the same shuffle.
    """
    sums = [c for c in pairs.columns if c not in ("own", "other")]
    rows = pairs.select(F.explode(archetypes(F.col("own"), k)).alias("source"), "other", *sums)
    light, split = deal(rows, "source", "other", partitions)
    spread = _count_targets(split, ["source", "salt"], k, sums).groupBy("source", "target").agg(*[F.sum(c).alias(c) for c in sums])
    return _count_targets(light, ["source"], k, sums).unionByName(spread)


def packed_edges(decoded: DataFrame, k: int, salt: int | None = None, partitions: int | None = None) -> DataFrame:
    """Match-ups by packed (source, target).

    Rows are dealt by source while they still carry the whole other deck:
    2 C(8,k) rows a game are shuffled at most and not 2 C(8,k)^2, and both counts
    after it keep that partitioning.  Hot sources are found and spread by
    themselves; salt sets the plain form instead, where each source has so many
    parts: 1 deals once and doesn't look for hot sources.
    """
    if salt is None:
        return edges_of_pairs(deck_pairs(decoded), k, partitions)
    if salt < 1:
        raise ValueError(f"salt must be at least 1, not {salt}")
    rows = sides(decoded).select(F.explode(archetypes(F.col("own"), k)).alias("source"), "other", F.lit(1).cast("bigint").alias("count"), F.col("win").alias("wins"))
    keys = ["source"]
    if salt > 1:
        rows, keys = rows.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(salt))), ["source", "salt"]
    counted = _count_targets(rows.repartition(partitions, *keys) if partitions else rows.repartition(*keys), keys, k, ["count", "wins"])
    if salt > 1:
        counted = counted.groupBy("source", "target").agg(F.sum("count").alias("count"), F.sum("wins").alias("wins"))
    return counted


def hex_nodes(nodes: DataFrame, k: int) -> DataFrame:
    return nodes.select(to_hex(F.col("archetype"), k).alias("archetype"), "count", "wins")


def hex_edges(edges: DataFrame, k: int) -> DataFrame:
    return edges.select(to_hex(F.col("source"), k).alias("source"), to_hex(F.col("target"), k).alias("target"), "count", "wins")


def nodes(decoded: DataFrame, k: int) -> DataFrame:
    """(archetype, count, wins) with archetypes in hex."""
    return hex_nodes(packed_nodes(decoded, k), k)


def edges(decoded: DataFrame, k: int, salt: int | None = None, partitions: int | None = None, max_rows: int | None = None) -> DataFrame:
    """(source, target, count, wins) with archetypes in hex.

    max_rows: refuse, before any shuffle, a job that would give more match-up records.
    """
    if max_rows is not None and (n := decoded.count() * rows_per_game(k)[1]) > max_rows:
        raise ValueError(f"k={k} would give {n} match-up records; the limit is {max_rows}")
    return hex_edges(packed_edges(decoded, k, salt, partitions), k)


def total_occurrences(node_rows: DataFrame) -> DataFrame:
    """Sum of the node counts."""
    return node_rows.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total"))


def volume_estimate(decoded: DataFrame) -> DataFrame:
    """Records that each k would give, with a warning flag for the heavy ones."""
    table = F.array(
        *[F.struct(F.lit(k).alias("k"), *[F.lit(n).cast("bigint").alias(name) for name, n in zip(("node_rows", "edge_rows"), rows_per_game(k), strict=True)], F.lit(k <= WARN_K).alias("warn")) for k in range(1, DECK_SIZE + 1)]
    )
    games = decoded.agg(F.count("*").alias("games"))
    return games.select("games", F.inline(table)).select("k", "games", (F.col("games") * F.col("node_rows")).alias("node_rows"), (F.col("games") * F.col("edge_rows")).alias("edge_rows"), "warn")


#: 2**14 registers: a standard error of 0.8 %.
SKETCH_BITS = 14
SKETCH_GROUPS = 64


def _distinct(codes: DataFrame) -> DataFrame:
    """One row, `n`: about how many distinct codes there are.

    Each group of tasks merges its sketches, then the groups' are merged, so no
    task gets the sketches of all tasks; nothing else is shuffled.
    """
    grouped = codes.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("group")).agg(F.hll_sketch_agg("code", F.lit(SKETCH_BITS)).alias("sketch"))
    return grouped.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast("bigint").alias("n"))


def distinct_estimate(decoded: DataFrame, k: int) -> DataFrame:
    """One row: about how many distinct nodes and edges a job for k will give, from sketches of the archetype codes.

    Pairs of decks are counted first, so a repeated game costs nothing more;
    match-ups are generated and forgotten in the map tasks.
    """
    pairs = deck_pairs(decoded).select("own", "other")
    # each deck is an `own` somewhere, since every game gives both directions
    node_codes = pairs.select(F.explode(archetypes(F.col("own"), k)).alias("code"))
    edge_codes = pairs.select(F.explode(archetypes(F.col("own"), k)).alias("s"), "other").select("s", F.explode(archetypes(F.col("other"), k)).alias("t")).select(F.xxhash64("s", "t").alias("code"))
    nodes_n, edges_n = _distinct(node_codes).withColumnRenamed("n", "nodes"), _distinct(edge_codes).withColumnRenamed("n", "edges")
    return nodes_n.crossJoin(F.broadcast(edges_n))


def line_bytes(k: int, names: int) -> int:
    """About how long a text line is that has so many archetypes, and counts of a few digits."""
    return 2 * k * names + names + 6


def generation_report(clean: DataFrame, k: int) -> DataFrame:
    """One row: games processed and skipped, records emitted, distinct nodes and edges.

    Games are counted by pair of decks first; all figures come from that one
    shuffle, which Spark reuses, so lines are cleaned once.  Undecodable games
    are one pair of NULL decks.  Hot sources are spread as for the edges.
    """
    node_n, edge_n = rows_per_game(k)
    decks = [F.when(decodable(), pack_deck(card_ids(F.col(f"deck{i}")))).alias(f"d{i}") for i in (0, 1)]
    pairs = clean.select(*decks).groupBy("d0", "d1").agg(F.count("*").alias("games"))
    both = F.array(*[F.struct(F.col(a).alias("own"), F.col(b).alias("other"), "games") for a, b in (("d0", "d1"), ("d1", "d0"))])
    edge_rows = edges_of_pairs(pairs.select(F.inline(both)).where("own IS NOT NULL").groupBy("own", "other").agg(F.sum("games").alias("games")), k)
    by_source = edge_rows.groupBy("source").agg(F.count("target").alias("targets"))
    known = F.col("d0").isNotNull()
    games = pairs.agg(*[F.coalesce(F.sum(F.when(x, F.col("games"))), F.lit(0)).cast("bigint").alias(n) for n, x in (("games", known), ("skipped", ~known))])
    sizes = by_source.agg(F.count("source").alias("nodes"), F.coalesce(F.sum("targets"), F.lit(0)).cast("bigint").alias("edges"))
    return games.crossJoin(F.broadcast(sizes)).select("games", "skipped", (F.col("games") * node_n).alias("node_rows"), (F.col("games") * edge_n).alias("edge_rows"), "nodes", "edges")
