"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, importance, lm_scoring, mixing, ngram_join, packing, pii, quality_rules, sharding, spelling, substring_dedup, toxicity
from .common import app_dir, table
from .sql import SQL


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str, n_shards: int = sharding.N_SHARDS) -> DataFrame:
    """The slot map is kept in the shared folder, a store for each input; called again, the query
    edits its last version."""
    store = f"{app_dir(spark)}/slot-maps/{hashlib.md5(sf_dir.encode()).hexdigest()}"
    return sharding.shard(table(spark, sf_dir, "documents"), n_shards, store=store)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    got = chat_format.read_back(chat_format.format_conversations(rows.unionByName(chat_format.probe(spark))))
    return got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat(s["start"], F.lit(":"), s["end"])), ";")
    return got.select("doc_id", "text", "n_sentences", "n_removed", spans.alias("removed"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decisions(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.decisions(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_lm_scoring, op3_sharding, op4_quality_rules, op5_packing, op6_chat_format, op7_toxicity, op8_substring_dedup, op9_mixing, op10_ngram_join, op11_pii, op12_spelling, op13_importance)}

__all__ = ["QUERIES", "SQL"]
