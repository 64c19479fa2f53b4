"""Memory systems, agents and evaluators, each a composition of DataFrame transforms.

A system builds units from messages and reads contexts for questions, all of them in one plan."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, embedding, prompts, retrieve, units
from ..operators.calls import Calls, Complete, replied

# Parts of error messages after which a call is tried again.
RETRYABLE = ("timeout", "rate_limit", "ratelimit", "rate limit", "server_error", "server error", "connection", "temporarily", "429", "500", "502", "503", "504")


@dataclass(frozen=True)
class Reply:
    """What a model said and used. Models are functions from a prompt to a Reply, or to a string."""

    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    total_tokens: int = 0


Model = Callable[[str], "Reply | str"]


class Malformed(ValueError):
    """A reply that can't be read; it is asked for again like a call that failed."""


@dataclass(frozen=True)
class Outcome:
    """reply is null where no attempt gave a readable one; said is "ok", or what went wrong."""

    reply: Reply | None
    said: str
    attempts: int


@dataclass(frozen=True)
class Retry:
    attempts: int = 3
    delay: float = 1.0
    backoff: float = 2.0
    retryable: tuple[str, ...] = RETRYABLE

    def again(self, e: Exception) -> bool:
        said = f"{type(e).__name__} {e}".lower()
        return isinstance(e, Malformed) or not self.retryable or any(x.lower() in said for x in self.retryable)

    def call(self, f: Model, prompt: str, check: Callable[[str], None] = lambda _: None) -> Outcome:
        """Asks f until check finds its reply readable, an error is of no kind that passes, or the
        attempts are used up."""
        wait, most = max(0.0, self.delay), max(1, self.attempts)
        for k in range(1, most + 1):
            try:
                got = f(prompt)
                reply = got if isinstance(got, Reply) else Reply(got or "")
                check(reply.text)
                return Outcome(reply, "ok", k)
            except Exception as e:
                if k >= most or not self.again(e):
                    return Outcome(None, f"{type(e).__name__}: {e}", k)
                time.sleep(wait)
                wait *= max(1.0, self.backoff)
        raise AssertionError("no attempt was made")


class MemorySystem(Protocol):
    name: str

    def build(self, messages: DataFrame) -> DataFrame: ...

    def read(self, questions: DataFrame, units: DataFrame, top_k: int | None = None, budget: int | None = None) -> DataFrame: ...


@dataclass(frozen=True)
class NullMemory:
    """No units; every context is empty."""

    name: str = "null"

    def build(self, messages: DataFrame) -> DataFrame:
        return units.raw_units(messages).limit(0)

    def read(self, questions, units, top_k=None, budget=None):
        return context.null_context(questions)


@dataclass(frozen=True)
class RawMemory:
    """Messages as they are, ranked by shared words, packed by rank."""

    target_roles: tuple[str, ...] = ()
    top_k: int = retrieve.TOP_K
    budget: int = context.BUDGET
    timestamps: bool = True
    name: str = "raw"

    def build(self, messages: DataFrame) -> DataFrame:
        return units.raw_units(messages, list(self.target_roles))

    def rank(self, questions: DataFrame, units: DataFrame, top_k: int | None = None) -> DataFrame:
        return retrieve.lexical_top(questions, units, retrieve.effective(top_k, self.top_k))

    def read(self, questions, units, top_k=None, budget=None):
        return context.pack_lines(questions, self.rank(questions, units, top_k), retrieve.effective(budget, self.budget), self.timestamps, joiner="\n", style="list")


RENDERS = ("adaptive", "timeline", "ranked_list")


@dataclass(frozen=True)
class FactMemory:
    """Attributed sentences, or facts that a model extracts, ranked by hashed vectors, or by those
    that `embed` gives, rendered by one of RENDERS. identity names the embedding model and its
    settings; vectors is the folder of its store. count counts the tokens of a text, for chunks and
    budgets, where the engine's own pattern is not to; tokens need not add up. calls: how models are called.
    A call for facts that fails gives none; a text that can't be embedded has no vector, unless
    calls.fail_fast ends the job there."""

    chunk_tokens: int = units.CHUNK_TOKENS
    top_k: int = retrieve.TOP_K
    budget: int = context.BUDGET
    fields: tuple[str, ...] = ("text", "tags")
    render: str = "adaptive"
    timestamps: bool = True
    merge: bool = False
    min_group: int = 2
    by_time: bool = False
    extract: Model | None = None
    retry: Retry = field(default_factory=Retry)
    embed: embedding.Embed | None = None
    calls: Calls = Calls()
    identity: str = ""
    vectors: str | None = None
    count: Callable[[str], int] | None = None
    name: str = "facts"

    def __post_init__(self) -> None:
        if self.render not in RENDERS:
            raise ValueError(f"unknown rendering {self.render!r}")
        if self.embed is not None and not (self.identity and self.vectors):
            raise ValueError("an embedding needs an identity and a folder for its vectors")

    def _counts(self) -> units.Count | None:
        one = self.count
        return None if one is None else lambda ts: [one(t) for t in ts]

    def build(self, messages: DataFrame) -> DataFrame:
        if self.extract is None:
            return units.fact_units(messages, self.chunk_tokens, count=self._counts())
        return extracted_units(messages, self.extract, self.chunk_tokens, self.retry, self._counts(), self.calls.workers)[0]

    def index(self, built: DataFrame) -> dict[str, int] | None:
        """Embeds what isn't embedded yet, before anything is asked; None without an embedding."""
        if self.embed is None:
            return None
        said = units.retrieval_text(list(self.fields))
        return embedding.VectorStore(self.vectors).warm(built.select(said.alias("text")), self.embed, self.identity, self.calls)

    def rank(self, questions: DataFrame, built: DataFrame, top_k: int | None = None) -> DataFrame:
        most = retrieve.effective(top_k, self.top_k)
        if self.embed is None:
            return retrieve.ranked(retrieve.hashed_scores(questions, built, list(self.fields)), most)
        said, store = units.retrieval_text(list(self.fields)), embedding.VectorStore(self.vectors)
        of_q = store.vectors(questions.select(F.col("query_text").alias("text")), self.embed, self.identity, self.calls)
        of_u = store.vectors(built.select(said.alias("text")), self.embed, self.identity, self.calls)
        return retrieve.ranked(retrieve.embedded_scores(questions, built, of_q, of_u, said), most)

    def read(self, questions, units, top_k=None, budget=None):
        found, most = self.rank(questions, units, top_k), retrieve.effective(budget, self.budget)
        how = {"timestamps": self.timestamps, "by_time": self.by_time}
        if self.count is not None:
            how["count"] = self.count
        if self.render == "adaptive":
            return context.pack_each(questions, found, context.adaptive, most, min_group=self.min_group, **how)
        if self.merge:
            return context.pack_each(questions, found, context.merged, most, **how)
        if self.count is not None:
            return context.pack_each(questions, found, context.prefix, most, **how)
        return context.pack_lines(questions, found, most, self.timestamps, by_time=self.by_time)


def extracted_units(messages: DataFrame, extract: Model, chunk_tokens: int, retry: Retry = Retry(), count: units.Count | None = None, workers: int = 1) -> tuple[DataFrame, DataFrame]:
    """Facts that a model finds in each speaker's part of each chunk: (units, calls). A reply that
    can't be read is asked for again; a call that fails to the end gives no facts, and calls say
    why. Units carry what their call cost, all attempts counted (generation)."""
    rows = units.chunked(messages, chunk_tokens, count).withColumn("speaker_key", units.speaker_key())
    chunk = ["scope_id", "conv_ix", "chunk"]
    from ..functions import times

    line = F.concat("speaker_key", F.lit(": "), "content")
    place = F.format_string("c%d:m%d", "conv_ix", "msg_ix")
    whole = rows.groupBy(*chunk).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_ix", line.alias("l")))), lambda x: x["l"]), "\n").alias("talk"), times.earliest("ts_raw", "msg_ix").alias("source_time_start"), times.latest("ts_raw", "msg_ix").alias("source_time_end"),
        F.transform(F.array_sort(F.collect_list(F.struct("msg_ix", place.alias("p")))), lambda x: x["p"]).alias("source_ids"),
    )
    speakers = rows.groupBy(*chunk, "speaker_key").agg(F.max_by("ts_raw", "msg_ix").alias("ts_raw"))
    asks = speakers.join(whole, chunk).withColumn("prompt", F.concat(F.lit(prompts.FACTS_PROMPT), F.lit("Speaker: "), "speaker_key", F.lit("\n\n"), "talk"))
    call_id = F.concat("scope_id", F.format_string(":c%d:chunk_%d:speaker_", "conv_ix", "chunk"), units.speaker_id())

    def run(batches):
        for b in batches:
            got = [o for o, _ in Calls(workers).each(lambda p: retry.call(extract, p, prompts.check_facts), b["prompt"].tolist())]
            r = [o.reply or Reply("") for o in got]
            yield b.assign(
                reply=pd.Series([o.reply.text if o.reply else None for o in got], dtype=object), outcome=[o.said for o in got], prompt_tokens=[x.prompt_tokens for x in r],
                completion_tokens=[x.completion_tokens for x in r], total_tokens=[x.total_tokens or x.prompt_tokens + x.completion_tokens for x in r], call_count=[o.attempts for o in got],
            )

    asks = asks.withColumn("call_id", call_id)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asks.schema)
    replied = asks.mapInPandas(run, f"{kinds}, reply string, outcome string, prompt_tokens long, completion_tokens long, total_tokens long, call_count int").withColumn("facts", prompts.parse_facts("reply"))
    cost = F.struct("call_id", "prompt_tokens", "completion_tokens", "total_tokens", "call_count")
    calls = replied.select("scope_id", cost.alias("generation"), F.when(F.col("outcome") != "ok", F.col("outcome")).when(F.coalesce(F.size("facts"), F.lit(0)) <= 0, F.lit("empty")).otherwise(F.lit("ok")).alias("outcome"))
    facts = replied.select("*", F.posexplode("facts").alias("at", "fact"))
    unit_id = F.concat("scope_id", F.format_string(":c%d:fact_%d_%d:speaker_", "conv_ix", "chunk", F.col("at") + 1), units.speaker_id())
    out = facts.select(
        "scope_id", unit_id.alias("unit_id"), F.col("fact.text").alias("text"), "ts_raw", F.coalesce("source_time_end", "ts_raw").alias("available_at_raw"), "source_time_start", "source_time_end", "source_ids", F.lit("fact").alias("memory_type"), F.col("fact.tags").alias("tags"),
        F.col("speaker_key").alias("role"), cost.cast(units.GENERATION).alias("generation"),
    )
    return out, calls


def fixed_query_answers(reads: DataFrame, empty: str = "") -> DataFrame:
    """The context itself as the answer."""
    return reads.withColumns({"answer": F.coalesce(F.nullif(F.col("context"), F.lit("")), F.lit(empty)), "agent_name": F.lit("fixed_query")})


def model_answers(reads: DataFrame, complete: Complete, with_time: bool = True, calls: Calls = Calls(), live: str | None = None) -> DataFrame:
    """reads: question_id, query_text, query_time_raw, context. complete: replies to prompts. error
    says why a question has no reply. live: a folder where replies can be read as they come."""
    asked = reads.withColumn("prompt", prompts.answer_prompt(with_time=with_time))
    got = replied(asked, complete, calls, live=live)
    return got.withColumns({"answer": prompts.clean_reply("reply"), "final_answer": prompts.final_answer("reply"), "agent_name": F.lit("model")})
