"""What a run's stages add up to; each is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _per(total: Column, count: Column) -> Column:
    return F.coalesce(total / F.nullif(count, F.lit(0)), F.lit(0.0))


def build_summary(items: DataFrame, artifacts: DataFrame, hits: int = 0, misses: int = 0) -> DataFrame:
    """items: item_id; artifacts: scope_id, unit_count. Items without an artifact have failed."""
    rows = items.join(artifacts.select(F.col("scope_id").alias("item_id"), "unit_count"), "item_id", "left")
    n, total = F.count("unit_count"), F.coalesce(F.sum("unit_count"), F.lit(0))
    return rows.agg(F.count("*").alias("item_count"), n.alias("artifact_count"), (F.count("*") - n).alias("failed_count"), total.alias("unit_count"), _per(total, n).alias("avg_units_per_item"), F.lit(hits).alias("cache_hits"), F.lit(misses).alias("cache_misses"))


def index_summary(indexed: DataFrame) -> DataFrame:
    """indexed: supported. Only an explicit false isn't counted as indexed."""
    return indexed.agg(F.count("*").alias("record_count"), F.count_if(F.coalesce("supported", F.lit(True))).alias("indexed_count"))


def answer_summary(answers: DataFrame, hits: int = 0, misses: int = 0) -> DataFrame:
    total = F.coalesce(F.sum("context_tokens"), F.lit(0))
    return answers.agg(F.count("*").alias("question_count"), F.count("answer").alias("answered_count"), total.alias("context_tokens"), _per(total, F.count("context_tokens")).alias("avg_context_tokens"), F.lit(hits).alias("cache_hits"), F.lit(misses).alias("cache_misses"))


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs' evaluations of the same questions: how often both, either or neither pass."""
    both = left.select("item_id", "question_id", F.col("passed").alias("l")).join(right.select("item_id", "question_id", F.col("passed").alias("r")), ["item_id", "question_id"]).where("l is not null and r is not null")
    return both.agg(F.count("*").alias("question_count"), F.count_if(F.expr("l and r")).alias("both"), F.count_if(F.expr("l and not r")).alias("left_only"), F.count_if(F.expr("r and not l")).alias("right_only"), F.count_if(F.expr("not l and not r")).alias("neither"))
