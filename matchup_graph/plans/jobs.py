"""Command line: clean, nodesedges, stats, analysis.

python -m matchup_graph.plans.jobs clean INPUT OUTPUT [PARTITIONS] [--no-report]
python -m matchup_graph.plans.jobs nodesedges INPUT OUTPUT K [N_EDGES | N_NODES N_EDGES] [--salt N] [--max-rows N] [--sequence] [--tables NAME]
python -m matchup_graph.plans.jobs stats BASE OUTPUT [--single] [--tables NAME]
python -m matchup_graph.plans.jobs analysis PREDICTIONS [OUTPUT] [--sample N]
"""

import argparse
import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cards import check_k
from ..operators import clean as C
from ..operators import graph as G
from ..operators import nullmodel as N
from ..sources import tables as T


def say(title: str, figures: dict) -> None:
    print(f"{title}: " + ", ".join(f"{k}={v}" for k, v in figures.items()))


def clean_job(spark: SparkSession, source: str, target: str, partitions: int | None = None, report: bool = True) -> None:
    """Write clean games; report: what was dropped and why, counted while they are written."""

    def write(games: DataFrame) -> int:
        T.write_clean(games, target, partitions)
        return T.read_clean(spark, target).count()  # from the files' footers

    lines = T.read_game_lines(spark, source)
    if not report:
        T.write_clean(C.clean_games(lines), target, partitions)
        return
    figures, reasons = C.clean_and_report(lines, write)
    say("clean", figures)
    for reason, n in reasons.items():
        say("rejected", {"reason": reason, "n": n})


def nodesedges_job(
    spark: SparkSession,
    source: str,
    target: str,
    k: int,
    n_nodes: int | None = None,
    n_edges: int | None = None,
    salt: int | None = None,
    max_rows: int | None = None,
    sequence: bool = False,
    tables: str | None = None,
    file_bytes: int = T.TARGET_FILE_BYTES,
) -> None:
    """Write nodes and edges of clean games.

    The volume is counted first: a warning for heavy k, an error above max_rows.
    Distinct nodes and edges are estimated by sketches; unless the caller sets
    them, the numbers of files follow from that, so that files have about
    file_bytes.  Wall times, and the tables' sizes with the files that fit them,
    are printed afterwards.  sequence: the input is old sequence files of clean
    lines.  tables: also write bucketed tables <tables>_nodes and <tables>_edges.
    """
    check_k(k)
    clean = C.valid_games(T.read_sequence_lines(spark, source)) if sequence else T.read_clean(spark, source)
    decoded = G.decode_games(clean)
    counted = clean.select(F.count("*").alias("total"), F.count(F.when(G.decodable(), 1)).alias("games")).first()
    total, games = counted["total"], counted["games"]
    node_rows, edge_rows = (games * n for n in G.rows_per_game(k))
    print(f"games: {games}, skipped: {total - games}, node_rows: {node_rows}, edge_rows: {edge_rows}")
    if max_rows is not None and edge_rows > max_rows:
        raise ValueError(f"k={k} would give {edge_rows} match-up records; the limit is {max_rows}")
    if k <= G.WARN_K:
        print(f"warning: k={k} gives {G.rows_per_game(k)[1]} match-up records a game")
    about = G.distinct_estimate(decoded, k).first().asDict()
    sizes = {"nodes": n_nodes or T.files_for(about["nodes"], G.line_bytes(k, 1), file_bytes), "edges": n_edges or T.files_for(about["edges"], G.line_bytes(k, 2), file_bytes)}
    say("estimated", about | {f"{t}_files": n for t, n in sizes.items()})
    for table, keys, rows in (("nodes", ["archetype"], G.nodes(decoded, k)), ("edges", ["source", "target"], G.edges(decoded, k, salt=salt))):
        began = time.time()
        T.write_lines(rows, f"{target}/{table}", keys, sizes[table])
        wall = round(time.time() - began, 3)
        row = T.line_sizing(T.read_game_lines(spark, f"{target}/{table}"), table).first().asDict()
        say("written", row | {"wall_s": wall, "mb_per_s": round(row["bytes"] / 1e6 / max(wall, 1e-3), 3)})
        if tables:
            schema = "archetype string, count bigint, wins bigint" if table == "nodes" else "source string, target string, count bigint, wins bigint"
            T.write_bucketed(spark.read.schema(schema).option("sep", ";").csv(f"{target}/{table}"), f"{tables}_{table}", keys[0], f"{target}/{table}_bucketed")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stats_job(spark: SparkSession, base: str, target: str, single: bool = False, tables: str | None = None) -> None:
    """Write predictions; tables: from the bucketed tables of that name, whose edges aren't shuffled for their sources."""
    if tables:
        nodes, edges = spark.table(f"{tables}_nodes"), spark.table(f"{tables}_edges")
    else:
        for table in ("nodes", "edges"):
            if not exists(spark, f"{base}/{table}"):
                raise FileNotFoundError(f"{base}/{table} is missing; run nodesedges first")
        nodes, edges = T.read_nodes(spark, f"{base}/nodes"), T.read_edges(spark, f"{base}/edges")
    T.write_predictions(N.predictions(edges, nodes), target, single)


def analysis_job(spark: SparkSession, source: str, target: str = "analysis", sample: int = 50_000) -> None:
    ratio = N.prediction_ratio(T.read_predictions(spark, source)).persist(StorageLevel.DISK_ONLY)
    N.linear_fit_p(ratio).write.mode("overwrite").parquet(f"{target}/fit")
    N.fit_line(ratio).write.mode("overwrite").parquet(f"{target}/line")
    N.sample_points(ratio, sample).write.mode("overwrite").parquet(f"{target}/points")
    ratio.unpersist()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="matchup_graph")
    jobs = parser.add_subparsers(dest="job", required=True)
    p = jobs.add_parser("clean")
    p.add_argument("input"), p.add_argument("output"), p.add_argument("partitions", type=int, nargs="?"), p.add_argument("--no-report", action="store_true")
    p = jobs.add_parser("nodesedges")
    p.add_argument("input"), p.add_argument("output"), p.add_argument("k", type=int), p.add_argument("partitions", type=int, nargs="*")
    p.add_argument("--salt", type=int), p.add_argument("--tables"), p.add_argument("--max-rows", type=int), p.add_argument("--sequence", action="store_true")
    p = jobs.add_parser("stats")
    p.add_argument("base"), p.add_argument("output"), p.add_argument("--single", action="store_true"), p.add_argument("--tables")
    p = jobs.add_parser("analysis")
    p.add_argument("file"), p.add_argument("output", nargs="?", default="analysis"), p.add_argument("--sample", type=int, default=50_000)
    a = parser.parse_args(args)
    if a.job == "nodesedges" and len(a.partitions) > 2:
        parser.error("at most two partition counts")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.job == "clean":
        clean_job(spark, a.input, a.output, a.partitions, not a.no_report)
    elif a.job == "nodesedges":
        n_nodes, n_edges = ([None, None, *a.partitions])[-2:] if len(a.partitions) != 1 else (None, a.partitions[0])
        nodesedges_job(spark, a.input, a.output, a.k, n_nodes, n_edges, a.salt, a.max_rows, a.sequence, a.tables)
    elif a.job == "stats":
        stats_job(spark, a.base, a.output, a.single, a.tables)
    else:
        analysis_job(spark, a.file, a.output, a.sample)


if __name__ == "__main__":
    main()
