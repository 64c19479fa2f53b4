"""Records as JSON and back, without loss: nulls, empty lists and order are kept.

A shape is the schema of a kind of record. Columns that a shape doesn't name aren't written, those
that rows lack are null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.units import GENERATION

SCOPE = "scope_id string, dataset string, subject_id string, timeline_id string, metadata string"
REQUEST = "query string, query_id string, query_time string, top_k int, context_budget_tokens int, metadata string"
CONTEXT = "text string, token_count long, block_count long, timepoint_count long"
UNIT = f"scope_id string, unit_id string, text string, ts_raw string, available_at_raw string, source_time_start string, source_time_end string, source_ids array<string>, memory_type string, tags array<string>, role string, generation {GENERATION}"



def _struct(shape: str) -> str:
    return f"struct<{shape}>"


#: Records within records are structs; open metadata and stats are JSON strings.
SHAPES = {
    "scope": SCOPE,
    "request": REQUEST,
    "context": CONTEXT,
    "build": f"item_id string, artifact struct<artifact_id: string, system_name: string, scope: {_struct(SCOPE)}, units: array<{_struct(UNIT)}>, metadata: string>, stats string",
    "index": "item_id string, memory_artifact_id string, system_name string, stats string",
    "read_result": f"request {_struct(REQUEST)}, ranked_units array<struct<unit: {_struct(UNIT)}, rank: int, score: double, retrieval_text: string, score_breakdown: string>>, context {_struct(CONTEXT)}, stats string, trace_ref string",
    "unit": UNIT,
    "artifact": "scope_id string, artifact_id string, unit_count long",
    "ranked": f"question_id string, rank int, score double, {UNIT}",
    "read": "item_id string, question_id string, scope_id string, query_text string, query_time_raw string, artifact_id string, context string, context_tokens long, context_blocks long, context_timepoints long",
    "answer": "item_id string, question_id string, answer string, agent_name string, artifact_id string, context string, context_tokens long, context_blocks long, reference string, evidence_ids array<string>, reasoning string",
    "evaluation": "item_id string, question_id string, query string, category string, answer string, score double, passed boolean, reference string, evaluator_name string, skip_reason string, judge_label string, judge_raw string, judge_source string",
}


def encode(rows: DataFrame, shape: str) -> DataFrame:
    """(shape, payload): each row as JSON."""
    wanted = T._parse_datatype_string(SHAPES[shape])
    cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    return rows.select(F.lit(shape).alias("shape"), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("payload"))


def decode(payloads: DataFrame, shape: str) -> DataFrame:
    """The rows of a shape; a payload that can't be read is an error."""
    rows = payloads.where(F.col("shape") == shape).select(F.from_json("payload", SHAPES[shape], {"mode": "FAILFAST"}).alias("r"))
    return rows.select("r.*")
