"""Writers: unified files, records, reports, run folders, events."""

from __future__ import annotations

import csv
import datetime as dt
import io
import itertools
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import jsonable, redacted
from . import files
from .tables import LINES, SCHEMA_VERSION, Dataset


def unified_items(dataset: Dataset) -> DataFrame:
    """A row for each item: item_ord, and the item as unified files nest it. Positions give back
    the order of the source."""
    m = F.struct("msg_ix", F.struct("message_id", "role", "speaker", "content", F.col("ts_raw").alias("timestamp"), "metadata").alias("m"))
    talks = dataset.messages.groupBy("item_id", "conv_ix").agg(F.transform(F.array_sort(F.collect_list(m)), lambda x: x["m"]).alias("talk"))
    talks = talks.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("conv_ix", "talk"))), lambda x: x["talk"]).alias("conversations"))
    label = F.when(F.col("has_label"), F.struct(F.col("reference").alias("reference_answer"), "evidence_ids", F.col("label_metadata").alias("metadata")))
    labels = dataset.labels.select("item_id", "question_id", "reference", "evidence_ids", F.col("metadata").alias("label_metadata"), F.lit(True).alias("has_label"))
    asked = dataset.questions.join(labels, ["item_id", "question_id"], "left")
    q = F.struct("q_ord", F.struct("question_id", "query", F.col("query_time_raw").alias("query_time"), "metadata", label.alias("label")).alias("q"))
    asked = asked.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(q)), lambda x: x["q"]).alias("questions"))
    rows = dataset.items.join(talks, "item_id", "left").join(asked, "item_id", "left")
    return rows.select("item_ord", F.struct("item_id", "subject_id", "metadata", "conversations", "questions").alias("item"))


def write_unified(dataset: Dataset, path: str) -> None:
    """The dataset as a folder of lines that read_unified takes: an item each, with its place and
    the schema version. Written and read in parts."""
    rows = unified_items(dataset).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(dataset.name).alias("dataset_name"), "item_ord", "item")
    rows.write.json(f"{path}/{LINES}")


def write_unified_object(dataset: Dataset, path: str) -> None:
    """The dataset as one JSON object in one file, for tools that want it so. Items pass through
    the driver one partition at a time, in order."""

    def opened(x: Any) -> Any:
        """Metadata, and references that are lists, as JSON values."""
        if isinstance(x, dict):
            return {k: _json_or(v) if k in ("metadata", "reference_answer") and isinstance(v, str) and v[:1] in "{[" else opened(v) for k, v in x.items()}
        return [opened(v) for v in x] if isinstance(x, list) else x

    rows = unified_items(dataset).orderBy("item_ord").select(F.to_json("item", {"ignoreNullFields": "false"}).alias("j"))
    head = json.dumps({"schema_version": SCHEMA_VERSION, "dataset_name": dataset.name, "split": None, "metadata": {}}, ensure_ascii=False)[:-1]
    body = (("" if i == 0 else ",\n") + json.dumps(opened(json.loads(r.j)), ensure_ascii=False) for i, r in enumerate(rows.toLocalIterator(prefetchPartitions=True)))
    files.write_parts(dataset.items.sparkSession, path, itertools.chain([head, ', "items": [\n'], body, ["\n]}\n"]))


def _json_or(s: str) -> Any:
    try:
        return json.loads(s)
    except ValueError:
        return s


def export_summary(dataset: Dataset) -> dict[str, int]:
    return {"item_count": dataset.items.count(), "message_count": dataset.messages.count(), "question_count": dataset.questions.count()}


def answer_record(answers: DataFrame) -> DataFrame:
    """The public columns of an answer: no prompt, no raw reply, no ranked units. The context is
    that of its blocks that aren't empty."""
    keep = ["item_id", "question_id", "answer", "agent_name", "artifact_id", "context", "context_tokens", "context_blocks", "reference", "evidence_ids", "reasoning"]
    return answers.select(*(c for c in keep if c in answers.columns))


def append_lines(records: DataFrame, path: str) -> None:
    """Records as they come, as JSON lines in a folder that grows."""
    records.write.mode("append").json(path)


def evaluation_record(evaluations: DataFrame) -> DataFrame:
    keep = ["item_id", "question_id", "query", "category", "answer", "score", "passed", "reference", "evaluator_name", "skip_reason", "judge_label", "judge_raw", "judge_source"]
    return evaluations.select(*(c for c in keep if c in evaluations.columns))


# The columns of a report, in order.
REPORT_COLUMNS = [
    "run_id", "dataset", "memory_system", "agent", "evaluator", "item_count", "question_count", "accuracy", "avg_score", "passed_count", "evaluated_count", "total_units", "avg_units_per_item",
    "memory_read_count", "total_context_tokens", "avg_context_tokens", "storage_generation_tokens", "build_cache_hit_count", "answer_cache_hit_count", "evaluation_cache_hit_count",
]


def report_row(**values: Any) -> dict[str, Any]:
    return {c: values.get(c) for c in REPORT_COLUMNS}


def report_text(rows: list[dict[str, Any]], kind: str) -> str:
    """A small table as json, md or csv."""
    if kind == "json":
        return json.dumps(rows, ensure_ascii=False, indent=2, sort_keys=False)
    if kind == "md":
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        lines = ["| " + " | ".join(REPORT_COLUMNS) + " |", "|" + " --- |" * len(REPORT_COLUMNS)]
        return "\n".join([*lines, *("| " + " | ".join(cell(r.get(c)) for c in REPORT_COLUMNS) + " |" for r in rows)]) + "\n"
    out = io.StringIO()
    w = csv.DictWriter(out, REPORT_COLUMNS, extrasaction="ignore")
    w.writeheader()
    w.writerows(rows)
    return out.getvalue()


def write_report(spark: SparkSession, rows: list[dict[str, Any]], path: str) -> None:
    suffix = path.rsplit(".", 1)[-1]
    files.write_text(spark, path, report_text(rows, suffix if suffix in ("json", "md") else "csv"))


def category_text(rows: list[dict[str, Any]], kind: str) -> str:
    """Accuracies by category, as json or csv."""
    if kind == "json":
        return json.dumps({r["category"]: {k: v for k, v in r.items() if k != "category"} for r in rows}, ensure_ascii=False, indent=2)
    out = io.StringIO()
    w = csv.DictWriter(out, ["category", "question_count", "evaluated_count", "passed_count", "accuracy", "avg_score"], extrasaction="ignore")
    w.writeheader()
    w.writerows(rows)
    return out.getvalue()


def write_run(spark: SparkSession, folder: str, run_id: str, spec: Any, tables: dict[str, DataFrame], report: dict[str, Any]) -> dict[str, Any]:
    """A run's folder: its tables as Parquet, answers and evaluations as JSON lines too, accuracies
    by category as JSON and CSV, the report three ways, and a manifest without secrets that names
    all of them."""
    made = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        made[name] = name
    for name in ("index", "answers", "evaluations", "failures"):
        if name in tables:
            append_lines(spark.read.parquet(f"{folder}/{name}"), f"{folder}/{name}.jsonl")
            made[f"{name}_lines"] = f"{name}.jsonl"
    if "categories" in tables:
        rows = [r.asDict() for r in spark.read.parquet(f"{folder}/categories").orderBy("category").collect()]  # a row for each category
        for suffix in ("json", "csv"):
            files.write_text(spark, f"{folder}/categories.{suffix}", category_text(rows, suffix))
            made[f"categories_{suffix}"] = f"categories.{suffix}"
    for suffix in ("json", "md", "csv"):
        write_report(spark, [report], f"{folder}/report.{suffix}")
        made[f"report_{suffix}"] = f"report.{suffix}"
    manifest = {"run_id": run_id, "spec": redacted(spec), "artifacts": made, "report": jsonable(report)}
    files.write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2))
    return manifest


#: The columns of the table of events.
EVENTS = "seq long, at timestamp, phase string, state string, seconds double, note string, numbers map<string, double>"


class EventTable:
    """What happens in a run, as rows of EVENTS. Rows are kept, and each goes to `tell` as it
    comes; store() adds those since the last time to a table in a folder."""

    def __init__(self, tell: Callable[[dict[str, Any]], None] | None = None) -> None:
        self.rows: list[dict[str, Any]] = []
        self.tell, self.stored = tell, 0

    def add(self, phase: str, state: str, seconds: float | None = None, note: str = "", **numbers: float | None) -> None:
        kept = {k: float(v) for k, v in numbers.items() if v is not None}
        self.rows.append({"seq": len(self.rows), "at": dt.datetime.now(dt.UTC), "phase": phase, "state": state, "seconds": seconds, "note": note, "numbers": kept})
        if self.tell:
            self.tell(self.rows[-1])

    def phases(self, state: str) -> list[str]:
        return [r["phase"] for r in self.rows if r["state"] == state]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.rows[self.stored :]], EVENTS)

    def store(self, spark: SparkSession, folder: str) -> None:
        if self.stored < len(self.rows):
            self.frame(spark).coalesce(1).write.mode("append").json(f"{folder}/events")
            self.stored = len(self.rows)


def on_screen(row: dict[str, Any]) -> None:
    took = f" after {row['seconds']:.1f} s" if row["seconds"] is not None else ""
    print(f"{row['phase']}: {row['state']}{took} {row['note']} {row['numbers'] or ''}".rstrip(), flush=True)
