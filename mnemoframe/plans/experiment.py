"""Experiments: build, answer, evaluate, report; each stage takes and gives tables."""

from __future__ import annotations

import argparse
import functools
import inspect
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import keys
from ..operators import evaluate, prompts, retrieve, summaries, units
from ..operators.cache import StageCache
from ..operators.calls import Calls
from ..sources import sinks, tables
from . import backends, systems


@dataclass
class Result:
    tables: dict[str, DataFrame]
    summaries: dict[str, dict[str, Any]]
    report: dict[str, Any]
    events: sinks.EventTable


NO_COUNTS = {"cache_hits": 0, "cache_misses": 0}


@dataclass
class Experiment:
    """fail_fast: a question without an answer, or a call to a model that fails, stops the run; else
    the question isn't evaluated, or its verdict stays open, and it is listed under failures with
    the error. workers: calls that a task makes at once. live: a folder in which a model's
    replies can be read as they come, also those of a run that fails. templates: the judge's wordings. Stages
    are build, index, read, answer and evaluate; each leaves events.

    With a cache, keys hold the identity of the system, the agent and the judge (keys.identity),
    and what has none is refused."""

    system: systems.MemorySystem
    agent: Callable[[DataFrame], DataFrame] = systems.fixed_query_answers
    need_all: bool = False
    judge: Callable[[list[str]], list[str]] | None = None
    templates: dict[str, str] | None = None
    workers: int = 1
    live: str | None = None
    top_k: int | None = None
    budget: int | None = None
    fail_fast: bool = True
    cache: StageCache | None = None
    events: sinks.EventTable = field(default_factory=sinks.EventTable)

    def _stage(self, name: str, run: Callable[[], Any]) -> Any:
        began = time.time()
        self.events.add(name, "begun")
        try:
            out = run()
        except Exception as e:
            self.events.add(name, "failed", time.time() - began, str(e)[:500])
            raise
        self.events.add(name, "done", time.time() - began)
        return out

    @property
    def calls(self) -> Calls:
        return Calls(self.workers, self.fail_fast)

    def build(self, data: tables.Dataset) -> tuple[DataFrame, dict[str, int]]:
        """Units of each item, from the cache where its messages and the system haven't changed."""
        if self.cache is None:
            return self.system.build(data.messages), NO_COUNTS
        cols = [c for c in data.messages.columns if c != "scope_id"]
        digest = F.sha2(F.array_join(F.sort_array(F.collect_list(keys.content_key(*cols))), ""), 256)
        wanted = data.messages.groupBy("scope_id").agg(F.sha2(F.concat_ws("|", F.lit(keys.config_key(self.system)), "scope_id", digest), 256).alias("cache_key"))
        nested = lambda miss: self.system.build(data.messages.join(miss.select("scope_id"), "scope_id", "left_semi")).join(miss, "scope_id")
        got, counts = self.cache.through("build", wanted, nested)
        return got.drop("cache_key", "error"), counts

    def artifacts(self, data: tables.Dataset, built: DataFrame) -> DataFrame:
        """(scope_id, artifact_id, unit_count) of every item; one without units has an artifact too."""
        strict = self.cache is not None
        made = keys.artifact_ids(built, self.system.name, self.system, strict)
        none = F.lit(f"{self.system.name}:{keys.stable_hash(['no units', keys.config_key(self.system, strict)])}")
        every = data.items.select(F.col("item_id").alias("scope_id")).join(made, "scope_id", "left")
        return every.select("scope_id", F.coalesce("artifact_id", none).alias("artifact_id"), F.coalesce("unit_count", F.lit(0)).cast("long").alias("unit_count"))

    def index(self, data: tables.Dataset, built: DataFrame, artifacts: DataFrame) -> DataFrame:
        """item_id, artifact_id, system_name, supported, embedded: what the system could prepare
        before it is asked. An item without an artifact is an error."""
        warm = getattr(self.system, "index", None)
        counts = warm(built) if warm else None
        items = data.items.select("item_id")
        rows = evaluate.strict_join(items, artifacts.withColumnRenamed("scope_id", "item_id"), ["item_id"], "artifact")
        return rows.select("item_id", "artifact_id", F.lit(self.system.name).alias("system_name"), F.lit(counts is not None).alias("supported"), F.lit((counts or {}).get("cache_misses")).cast("long").alias("embedded"))

    def _through(self, stage: str, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, int]]:
        """By the cache, if there is one, else stored for this run, so that no model is asked twice;
        wanted has cache_key, and so must compute's result. Adds error."""
        if self.cache is not None:
            return self.cache.through(stage, wanted, compute)
        return StageCache(session.scratch(wanted.sparkSession, "stages")).through(stage, wanted, compute)[0], NO_COUNTS

    def read(self, data: tables.Dataset, built: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        """Contexts for the questions, which labels take no part in. A cached context counts as
        long as its question, its item's units, the system and the limits are the same, whatever
        agent reads it. A question of an item without an artifact is an error."""
        asks = data.requests().select("item_id", "question_id", "scope_id", retrieve.query_text().alias("query_text"), "query_time_raw")
        asks = evaluate.strict_join(asks, artifacts.select("scope_id", "artifact_id"), ["scope_id"], "artifact")
        how = keys.stable_hash([self.system.name, self._identity(self.system), self.top_k, self.budget], 64)
        asks = asks.withColumn("cache_key", keys.content_key(F.lit(how).alias("how"), "item_id", "question_id", "query_text", "query_time_raw", "artifact_id"))

        def compute(some: DataFrame) -> DataFrame:
            one = some.withColumnRenamed("question_id", "qid").withColumn("question_id", F.concat_ws("\x1f", "item_id", "qid"))
            return self.system.read(one, built, self.top_k, self.budget).join(one, "question_id").withColumn("question_id", F.col("qid")).drop("qid")

        if self.cache is None:
            return compute(asks).drop("cache_key"), NO_COUNTS
        got, counts = self._through("context", asks, compute)
        return got.drop("cache_key", "error"), counts

    def _identity(self, of: Any) -> Any:
        return keys.identity(of, strict=self.cache is not None)

    def answer(self, reads: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        """Answers, with the error of those that failed."""
        how = keys.stable_hash([self._identity(self.agent), prompts.version()], 64)
        agent = self.agent
        takes, given = inspect.signature(agent).parameters, getattr(agent, "keywords", {})
        ours = {"calls": self.calls} | ({"live": f"{self.live}/answers"} if self.live else {})
        agent = functools.partial(agent, **{k: v for k, v in ours.items() if k in takes and k not in given})
        asked = reads.withColumn("cache_key", keys.content_key(F.lit(how).alias("how"), "item_id", "question_id", "query_text", "query_time_raw", "artifact_id", "context"))
        got, counts = self._through("answer", asked, agent)
        return got.drop("cache_key"), counts

    def evaluate(self, data: tables.Dataset, answers: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        """Evaluations, with the error of those whose judge failed. Questions without an answer are
        an error, or, unless fail_fast, left out."""
        q = data.questions.select("item_id", "question_id", "query", "question_type", F.col("metadata").alias("question_metadata"), evaluate.category("question_type").alias("category"))
        said = answers.select("item_id", "question_id", "answer")
        asked = evaluate.strict_join(q, said, evaluate.KEYS, "answer") if self.fail_fast else q.join(said, evaluate.KEYS)
        rows = asked.join(data.labels.select("item_id", "question_id", "reference", "references", "incorrect_answers", F.col("metadata").alias("label_metadata")), evaluate.KEYS, "left")
        # What a persona's judge is told of the case, from either side's metadata.
        case = {c: F.get_json_object("question_metadata", f"$.{c}") for c in ("relation_type", "relation_subtype", "topic", "source")}
        rows = rows.withColumns(case | {"facts": F.from_json(F.get_json_object("label_metadata", "$.facts"), "array<string>"), "case": F.get_json_object("label_metadata", "$.case")}).drop("question_metadata", "label_metadata")
        how = keys.stable_hash([data.name, self.need_all, self._identity(self.judge), self.templates, prompts.version() if self.judge else None], 64)
        rows = rows.withColumn("cache_key", keys.content_key(F.lit(how).alias("how"), *rows.columns))

        def compute(some: DataFrame) -> DataFrame:
            if self.judge is not None:
                return evaluate.judge(some.withColumns({"dataset": F.lit(data.name), "question": F.col("query")}), self.judge, templates=self.templates, calls=self.calls).withColumn("evaluator_name", F.lit("judge"))
            return some.withColumns(evaluate.contains(need_all=self.need_all)).withColumn("evaluator_name", F.lit("contains"))

        got, counts = self._through("evaluate", rows, compute)
        return got.drop("cache_key"), counts

    def run(self, data: tables.Dataset, run_id: str = "run") -> Result:
        self.events.add("run", "begun", note=run_id)
        built, counts = self._stage("build", lambda: self.build(data))
        built = built.persist()
        artifacts = self.artifacts(data, built)
        indexed = self._stage("index", lambda: self.index(data, built, artifacts))
        reads, read_counts = self._stage("read", lambda: self.read(data, built, artifacts))
        said, answer_counts = self._stage("answer", lambda: self.answer(reads))
        answers = said.where("error is null").drop("error")
        graded_rows, evaluation_counts = self._stage("evaluate", lambda: self.evaluate(data, answers))
        evaluations = graded_rows.drop("error")
        failures = said.where("error is not null").select("item_id", "question_id", F.lit("answer").alias("stage"), "error")
        failures = failures.unionByName(graded_rows.where("error is not null").select("item_id", "question_id", F.lit("evaluate").alias("stage"), "error"))
        one = lambda df: df.first().asDict()
        stats = units.token_stats(data.messages, built)
        spent = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("source_tokens", "unit_tokens", "generation_total_tokens", "generation_call_count") if c in stats.columns]
        sums = {
            "build": one(summaries.build_summary(data.items, artifacts, counts["cache_hits"], counts["cache_misses"])), "index": one(summaries.index_summary(indexed)), "read": read_counts,
            "answer": one(summaries.answer_summary(answers, **{k.removeprefix("cache_"): v for k, v in answer_counts.items()})), "evaluate": one(evaluate.accuracy(evaluations)), "tokens": one(stats.agg(*spent)),
        }
        for stage in ("answer", "evaluate"):
            sums[stage]["failed_count"] = 0
        for r in failures.groupBy("stage").count().collect():
            sums[r.stage]["failed_count"] = r["count"]
        built_sum, answered, graded = sums["build"], sums["answer"], {k: v for k, v in sums["evaluate"].items() if k != "failed_count"}
        report = sinks.report_row(
            run_id=run_id, dataset=data.name, memory_system=self.system.name, agent="fixed_query" if self.agent is systems.fixed_query_answers else "model", evaluator="judge" if self.judge else "contains",
            total_units=built_sum["unit_count"], memory_read_count=answered["question_count"], total_context_tokens=answered["context_tokens"], build_cache_hit_count=counts["cache_hits"], answer_cache_hit_count=answer_counts["cache_hits"], evaluation_cache_hit_count=evaluation_counts["cache_hits"],
            storage_generation_tokens=sums["tokens"].get("generation_total_tokens", 0), **{k: built_sum[k] for k in ("item_count", "avg_units_per_item")}, avg_context_tokens=answered["avg_context_tokens"], **graded,
        )
        for name, s in sums.items():
            self.events.add(name, "totals", **{k: v for k, v in s.items() if isinstance(v, int | float)})
        self.events.add("run", "done", note=run_id)
        by_category = evaluate.accuracy(evaluations, "category")
        labelled = evaluate.with_labels(answers, data.labels)
        out = {"units": built, "artifacts": artifacts, "index": indexed, "answers": sinks.answer_record(labelled), "evaluations": sinks.evaluation_record(evaluations), "categories": by_category, "failures": failures}
        return Result(out, sums, report, self.events)


READERS = ("unified", "turn_records", "haystack", "persona")


@dataclass(frozen=True)
class Spec:
    """A run as JSON: data, reader, system, agent and evaluator with their options, limits, output.
    Models are options of a backend, or the place of a function ("module:name"): `model` of an
    agent or a judge, `extract` and `embed` of the system of facts."""

    run_id: str
    data: str
    output: str
    reader: str = "unified"
    instances: str | None = None
    system: str = "facts"
    system_options: dict[str, Any] = field(default_factory=dict)
    agent: str = "fixed_query"
    agent_options: dict[str, Any] = field(default_factory=dict)
    evaluator: str = "contains"
    evaluator_options: dict[str, Any] = field(default_factory=dict)
    need_all: bool = False
    workers: int = 1
    fail_fast: bool = True
    templates: dict[str, str] | None = None
    live: str | None = None
    top_k: int | None = None
    budget: int | None = None
    max_items: int | None = None
    max_questions: int | None = None
    cache: str | None = None

    @classmethod
    def load(cls, path: str) -> Spec:
        got = json.loads(Path(path).read_text())
        unknown = set(got) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**got)

    def dataset(self, spark: SparkSession) -> tables.Dataset:
        name = Path(self.data).stem
        if self.reader == "unified":
            data = tables.read_unified(spark, self.data)
        elif self.reader == "turn_records":
            data = tables.from_turn_records(tables.json_array(spark, self.data, tables.TURNS), name)
        elif self.reader == "haystack":
            data = tables.from_haystack(tables.json_array(spark, self.data, tables.HAYSTACK), name)
        elif self.reader == "persona":
            data = tables.from_persona(tables.json_array(spark, self.data, tables.PERSONA_SESSIONS), tables.json_array(spark, self.instances, tables.PERSONA_INSTANCES), name)
        else:
            raise ValueError(f"unknown reader {self.reader!r}; there are {READERS}")
        return data.head(self.max_items, self.max_questions)

    def memory(self) -> systems.MemorySystem:
        kinds = {"facts": systems.FactMemory, "raw": systems.RawMemory, "null": systems.NullMemory}
        options = {k: tuple(v) if isinstance(v, list) else v for k, v in self.system_options.items()}
        for name, kind in (("extract", backends.ChatModel), ("embed", backends.EmbeddingModel)):
            if options.get(name):
                options[name] = backends.made(options[name], kind)
        if "retry" in options:
            options["retry"] = systems.Retry(**options["retry"])
        return _chosen("system", self.system, kinds)(**options)

    def answering(self) -> Callable[[DataFrame], DataFrame]:
        def fixed(**options: Any) -> Callable[[DataFrame], DataFrame]:
            return functools.partial(systems.fixed_query_answers, **options) if options else systems.fixed_query_answers

        def model(model: Any, with_time: bool = True) -> Callable[[DataFrame], DataFrame]:
            return functools.partial(systems.model_answers, complete=_many(model), with_time=with_time)

        return _chosen("agent", self.agent, {"fixed_query": fixed, "model": model})(**self.agent_options)

    def judging(self) -> Callable[[list[str]], list[str]] | None:
        return _chosen("evaluator", self.evaluator, {"contains": lambda: None, "judge": lambda model: _many(model)})(**self.evaluator_options)


def _chosen(what: str, name: str, kinds: dict[str, Any]) -> Any:
    if name not in kinds:
        raise ValueError(f"unknown {what} {name!r}; there are {sorted(kinds)}")
    return kinds[name]


def _many(model: Any) -> Callable[[list[str]], list[str]]:
    got = backends.made(model, backends.ChatModel)
    return got.many if isinstance(got, backends.ChatModel) else got


def run_spec(spark: SparkSession, spec: Spec) -> dict[str, Any]:
    events = sinks.EventTable(sinks.on_screen)
    ex = Experiment(spec.memory(), spec.answering(), need_all=spec.need_all, judge=spec.judging(), templates=spec.templates, workers=spec.workers, fail_fast=spec.fail_fast, live=spec.live, top_k=spec.top_k, budget=spec.budget, cache=StageCache(spec.cache) if spec.cache else None, events=events)
    try:
        result = ex.run(spec.dataset(spark), spec.run_id)
        return sinks.write_run(spark, spec.output, spec.run_id, spec, result.tables, result.report)
    finally:
        events.store(spark, spec.output)


def main(argv: list[str] | None = None) -> int:
    """python -m mnemoframe.plans.experiment SPEC.json: runs it and prints its report as JSON."""
    from ..session import build

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("spec")
    manifest = run_spec(build(), Spec.load(p.parse_args(argv).spec))
    print(json.dumps(manifest["report"], ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
