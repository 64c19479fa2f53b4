"""Memory units from messages.

messages: scope_id, conv_ix, msg_ix (both from 1), message_id, role, speaker, content, ts_raw."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, times

UNIT_COLUMNS = ["scope_id", "unit_id", "text", "ts_raw", "available_at_raw", "source_time_start", "source_time_end", "source_ids", "memory_type", "tags"]
CHUNK_TOKENS = 1024


def message_accessors(rows: DataFrame) -> DataFrame:
    """Role, speaker, content, time and id from the fields that sources use for them, stripped. A
    speaker that is in no field of its own may be in the JSON column metadata."""

    def get(*names: str) -> Column:
        have = [F.col(n) for n in names if n in rows.columns]
        return text.first_text(*have) if have else F.lit(None).cast("string")

    speaker = [get("speaker")] + [F.get_json_object("metadata", "$.speaker")] * ("metadata" in rows.columns)
    return rows.withColumns({
        "role": text.text_or_empty(get("role", "speaker")), "speaker": text.text_or_null(F.coalesce(*speaker)), "content": text.text_or_empty(get("content", "text")),
        "ts_raw": text.text_or_null(get("ts_raw", "timestamp", "time", "created_at")), "message_id": get("message_id", "id", "turn_id", "record_id"),
    })


def raw_units(messages: DataFrame, target_roles: list[str] | None = None) -> DataFrame:
    """One unit a message, stripped. Positions count all messages, filtered or not; roles are
    compared without case, a speaker standing in only where there is no role."""
    role = message_role()
    kept = messages.where(text.text_or_empty("content") != "")
    if target_roles:
        kept = kept.where(role.isin([r.lower() for r in target_roles]))
    place = F.format_string("c%d:m%d", "conv_ix", "msg_ix")
    ts = text.text_or_null("ts_raw").alias("ts_raw")
    return kept.select(
        "scope_id", F.concat_ws(":", "scope_id", place).alias("unit_id"), text.strip("content").alias("text"), ts, ts.alias("available_at_raw"), ts.alias("source_time_start"),
        ts.alias("source_time_end"), F.array(F.coalesce("message_id", place)).alias("source_ids"), F.lit("raw_message").alias("memory_type"), F.array().cast("array<string>").alias("tags"),
        role.alias("role"),
    )


def message_role(role: str = "role", speaker: str = "speaker") -> Column:
    return F.lower(text.text_or_empty(F.coalesce(text.first_text(role, speaker), F.lit(""))))


def speaker_key(role: str = "role", speaker: str = "speaker") -> Column:
    return F.coalesce(text.text_or_null(speaker), text.text_or_null(message_role(role, speaker)), F.lit("unknown"))


def speaker_id(key: str = "speaker_key") -> Column:
    """The first eight digits of the SHA-1 of the name as a JSON string."""
    as_json = F.regexp_extract(F.to_json(F.struct(F.col(key).alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    return F.substring(F.sha1(as_json), 1, 8)


Count = Callable[[list[str]], list[int]]


def chunked(messages: DataFrame, chunk_tokens: int = CHUNK_TOKENS, count: Count | None = None) -> DataFrame:
    """messages that aren't blank, with chunk (from 1): a conversation's messages are appended to
    a chunk as long as the tokens of its joined text allow; one that is too large stands alone. By
    the engine's own pattern tokens of messages add up, and only positions and counts are gathered
    for a conversation; with count, which need not add up, the chunk's text itself is counted."""
    rendered = F.concat(F.lit("speaker: "), speaker_key(), F.lit("\ncontent: "), F.col("content"))
    said = messages.withColumn("content", text.text_or_empty("content")).where("content != ''")
    most = max(1, chunk_tokens)
    if count is not None:
        return _chunked_by(said, rendered, most, count)
    kept = said.withColumn("tok", text.token_count(rendered))

    def add(a: Column, m: Column) -> Column:
        new = (a["n"] > 0) & (a["tok"] + m["tok"] > most)
        chunk = F.when(new, a["chunk"] + 1).otherwise(a["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(new, m["tok"]).otherwise(a["tok"] + m["tok"]).alias("tok"), (a["n"] + 1).alias("n"), F.when(new | (a["n"] == 0), F.concat(a["starts"], F.array(m["ix"]))).otherwise(a["starts"]).alias("starts"))

    zero = F.struct(F.lit(1).alias("chunk"), F.lit(0).cast("long").alias("tok"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts"))
    order = F.array_sort(F.collect_list(F.struct(F.col("msg_ix").cast("int").alias("ix"), "tok")))
    starts = kept.groupBy("scope_id", "conv_ix").agg(F.aggregate(order, zero, add, lambda a: a["starts"]).alias("starts"))
    return kept.join(starts, ["scope_id", "conv_ix"]).withColumn("chunk", F.size(F.filter("starts", lambda s: s <= F.col("msg_ix")))).drop("starts", "tok")


def _chunked_by(said: DataFrame, rendered: Column, most: int, count: Count) -> DataFrame:
    """Conversations pass through their tasks message by message, in order; what is held of one is
    the text of its open chunk, which the limit bounds, and its number."""
    key = ["scope_id", "conv_ix"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, chunk = None, None, 0
        for b in batches:
            chunks = []
            for scope, conv, line in zip(b["scope_id"], b["conv_ix"], b["_said"], strict=True):
                if (scope, conv) != at:
                    at, held, chunk = (scope, conv), None, 1
                longer = line if held is None else f"{held}\n{line}"
                if held is not None and count([longer])[0] > most:
                    held, chunk = line, chunk + 1
                else:
                    held = longer
                chunks.append(chunk)
            yield b.drop(columns="_said").assign(chunk=chunks)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in said.schema)
    return said.withColumn("_said", rendered).repartition(*key).sortWithinPartitions(*key, "msg_ix").mapInPandas(walk, f"{kinds}, chunk int")


def fact_units(messages: DataFrame, chunk_tokens: int = CHUNK_TOKENS, max_tokens: int = text.SEGMENT_TOKENS, count: Count | None = None) -> DataFrame:
    """Units of sentences, attributed to their speakers. A unit becomes visible with the latest
    message of its whole chunk, whoever said it."""
    rows = chunked(messages, chunk_tokens, count).withColumn("speaker_key", speaker_key())
    chunk = ["scope_id", "conv_ix", "chunk"]
    place = F.format_string("c%d:m%d", "conv_ix", "msg_ix")
    spans = rows.groupBy(*chunk).agg(
        times.earliest("ts_raw", "msg_ix").alias("source_time_start"), times.latest("ts_raw", "msg_ix").alias("source_time_end"),
        F.transform(F.array_sort(F.collect_list(F.struct("msg_ix", place.alias("p")))), lambda x: x["p"]).alias("source_ids"),
    )
    said = Window.partitionBy(*chunk, "speaker_key")
    rows = rows.withColumn("unit_ts", F.last("ts_raw").over(said.orderBy("msg_ix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    facts = rows.select("*", F.posexplode(text.sentences("content")).alias("sent_ix", "sentence")).select("*", F.posexplode(text.segments("sentence", max_tokens)).alias("seg_ix", "segment"))
    prefix = F.concat("speaker_key", F.lit(" said"))
    body = F.when(F.startswith(F.lower("segment"), F.lower(prefix)), F.col("segment")).otherwise(F.concat(prefix, F.lit(" "), "segment"))
    facts = facts.withColumn("fact", F.row_number().over(said.orderBy("msg_ix", "sent_ix", "seg_ix")))
    unit_id = F.concat("scope_id", F.format_string(":c%d:fact_%d_%d:speaker_", "conv_ix", "chunk", "fact"), speaker_id())
    return facts.join(spans, chunk).select(
        "scope_id", unit_id.alias("unit_id"), body.alias("text"), F.col("unit_ts").alias("ts_raw"), F.coalesce("source_time_end", "unit_ts").alias("available_at_raw"),
        "source_time_start", "source_time_end", "source_ids", F.lit("fact").alias("memory_type"), F.array().cast("array<string>").alias("tags"),
        F.col("speaker_key").alias("role"), F.array("message_id").alias("message_ids"), F.lit(None).cast(GENERATION).alias("generation"),
    )


def speaker_phrases(messages: DataFrame, fallback: str = "user") -> DataFrame:
    """(scope_id, conv_ix, phrases): who speaks, in order of appearance."""
    firsts = messages.groupBy("scope_id", "conv_ix", text.first_text("speaker").alias("s")).agg(F.min("msg_ix").alias("at")).where("s is not null")
    names = F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: F.concat(x["s"], F.lit(" said")))
    every = messages.select("scope_id", "conv_ix").distinct()
    held = firsts.groupBy("scope_id", "conv_ix").agg(F.array_join(names, "; ").alias("phrases"))
    return every.join(held, ["scope_id", "conv_ix"], "left").withColumn("phrases", F.coalesce("phrases", F.lit(f"{fallback} said")))


def retrieval_text(fields: list[str]) -> Column:
    """The text that a unit is ranked by: columns, lists, or paths of the JSON column metadata
    ("metadata.place.name"; "structured" are the texts and tags of its facts), whose lists count
    by their elements; blanks dropped, joined by spaces."""

    def part(f: str) -> list[Column]:
        if f == "timestamp":
            return [F.array(F.col("ts_raw"))]
        if f in ("tags", "source_ids"):
            return [F.col(f)]
        if f.startswith("structured"):
            facts = F.try_variant_get(F.try_parse_json("metadata"), "$.structured.facts", "array<variant>")
            of = lambda x: F.concat(F.array(F.try_variant_get(x, "$.text", "string")), F.coalesce(F.try_variant_get(x, "$.tags", "array<string>"), F.array().cast("array<string>")))
            return [F.coalesce(F.flatten(F.transform(facts, of)), F.array().cast("array<string>"))]
        return [text.metadata_texts("metadata", f.removeprefix("metadata."))] if f.startswith("metadata.") else [F.array(F.col(f).cast("string"))]

    parts = [c for f in fields for c in part(f)]
    flat = F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull() & (text.strip(x) != ""))
    return text.strip(F.array_join(flat, " "))


#: What a call to a model cost; a unit that no call made has none.
GENERATION = "struct<call_id: string, prompt_tokens: long, completion_tokens: long, total_tokens: long, call_count: int>"


def generation_totals(units: DataFrame) -> DataFrame:
    """Per scope, prompt, completion and total tokens and calls: each call once, however many units
    it made; calls without an id each on their own."""
    g = units.select("scope_id", "generation.*").where("call_count > 0")
    sums = ["prompt_tokens", "completion_tokens", "total_tokens", "call_count"]
    once = g.where("call_id <> ''").groupBy("scope_id", "call_id").agg(*(F.min(c).alias(c) for c in sums)).drop("call_id")
    every = once.unionByName(g.where("coalesce(call_id, '') = ''").select("scope_id", *sums))
    return every.groupBy("scope_id").agg(*(F.sum(c).alias(f"generation_{c}") for c in sums))


def token_stats(messages: DataFrame, units: DataFrame) -> DataFrame:
    """Per scope: tokens of sources and units, with the ratio of the two, and of the calls that
    made units, where units say so (generation)."""
    source = messages.groupBy("scope_id").agg(F.sum(text.token_count(text.text_or_empty("content"))).alias("source_tokens"))
    n = text.token_count("text")
    made = units.groupBy("scope_id").agg(F.count("*").alias("unit_count"), F.sum(n).alias("unit_tokens"), F.avg(n).alias("avg_unit_tokens"), F.max(n).alias("max_unit_tokens"))
    out = source.join(made, "scope_id", "full").withColumn("compression", F.col("unit_tokens") / F.nullif(F.col("source_tokens"), F.lit(0)))
    if "generation" not in units.columns:
        return out
    out = out.join(generation_totals(units), "scope_id", "left")
    out = out.fillna(0, [c for c in out.columns if c.startswith("generation_")])
    return out.withColumn("generation_to_unit", F.col("generation_total_tokens") / F.nullif(F.col("unit_tokens"), F.lit(0)))
