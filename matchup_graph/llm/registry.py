"""The registered queries of this subpackage."""

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, counts, exact, language, lm, negatives, packing, quality, resampling, sharding, simhash, substrings
from .common import SPACE, documents


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it lies at the repository's top, which the subpackage alone doesn't need

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    over = lambda op: lambda spark, sf_dir: op(documents(spark, sf_dir))
    return {
        "op1_quality_rules": over(quality.op1),
        "op2_lm_scoring": over(lm.op2),
        "op3_simhash": over(simhash.op3),
        "op4_bpe_round_trip": over(bpe.op4),
        "op5_substring_dedup": over(substrings.op5),
        "op6_token_counts": over(counts.op6),
        "op7_exact_dedup": over(exact.op7),
        "op8_language_id": over(language.op8),
        "op9_chat_formatting": lambda spark, sf_dir: chat.op9(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
        "op10_best_fit_packing": over(packing.op10),
        "op11_hilbert_sharding": over(sharding.op11),
        "op12_importance_resampling": lambda spark, sf_dir: resampling.op12(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
        "op13_hard_negatives": lambda spark, sf_dir: negatives.op13(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "pipeline": pipeline,
    }


_OP7_SQL = f"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256 FROM d WINDOW g AS (PARTITION BY text_sha256)"""


def oracle_sql() -> dict[str, str]:
    """SQL of op7, op9 and op11 to op13; no SQL expresses the pipeline's near-duplicate and passage stages (corpus_pipeline.ORACLE_SQL is None)."""
    return {
        "op7_exact_dedup": _OP7_SQL,
        "op9_chat_formatting": chat.OP9_SQL,
        "op11_hilbert_sharding": sharding.OP11_SQL,
        "op12_importance_resampling": resampling.OP12_SQL,
        "op13_hard_negatives": negatives.OP13_SQL,
    }
