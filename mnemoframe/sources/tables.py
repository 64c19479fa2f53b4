"""The normalized tables, and readers of nested conversation datasets into them.

All readers give a Dataset of DataFrames: items, messages, questions, labels. Labels are a table
of their own, so that no plan for answering can see them. Positions from the files are kept as
columns (conv_ix and msg_ix from 1; item_ord and q_ord from 0)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import units
from . import arrays, files

# Fixed value: the version that unified files must carry, after the name of what wrote them.
SCHEMA_VERSIONS = r"[a-z_]+\.unified_dataset\.v1"
SCHEMA_VERSION = "mnemoframe.unified_dataset.v1"


@dataclass(frozen=True)
class Dataset:
    name: str
    items: DataFrame
    messages: DataFrame
    questions: DataFrame
    labels: DataFrame

    def head(self, items: int | None = None, questions: int | None = None) -> Dataset:
        """The first items, and of each the first questions."""
        kept, q = self.items, self.questions
        if items is not None:
            kept = kept.where(F.col("item_ord") < items)
        if questions is not None:
            nth = F.row_number().over(Window.partitionBy("item_id").orderBy("q_ord"))
            q = q.withColumn("_n", nth).where(F.col("_n") <= questions).drop("_n")
        ids = kept.select("item_id")
        q = q.join(ids, "item_id", "left_semi")
        return Dataset(self.name, kept, self.messages.join(ids, "item_id", "left_semi"), q, self.labels.join(q.select("item_id", "question_id"), ["item_id", "question_id"], "left_semi"))

    def requests(self) -> DataFrame:
        """Read requests: questions without anything of their labels."""
        return self.questions.select("item_id", "question_id", F.col("item_id").alias("scope_id"), "query", "query_time_raw")


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The records of a JSON array of objects, or of JSON lines, in order (ord). What isn't such
    an array is refused. One array in one file is read in parts (arrays)."""
    head = files.first_character(spark, path)
    if head not in ("[", "{"):
        raise ValueError(f"{path} holds no array of objects")
    if head == "[" and (uri := arrays.readable(spark, path)):
        return arrays.read_array(spark, uri, schema)
    read = spark.read.schema(schema).option("mode", "FAILFAST")
    rows = read.option("multiLine", True).json(path) if head == "[" else read.json(path)
    return rows.withColumn("ord", F.monotonically_increasing_id())


def numbered(rows: DataFrame, name: str, *then: str) -> DataFrame:
    """rows with their place from 0, by ord and `then`. ord holds a partition and a place in it
    (monotonically_increasing_id): partitions are counted, and each numbers its own rows, so that
    no task sees them all. rows should be narrow, as they are dealt by partition. They are read
    twice: ord must come out the same, as from a stored table or a scan of files."""
    part = F.shiftright("ord", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the source
    starts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("ord", *then)) - 1
    return rows.withColumn("_part", part).withColumn(name, nth).join(starts, "_part").withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")


ITEM = """item_id: string, subject_id: string, metadata: string,
    conversations: array<array<struct<message_id: string, id: string, role: string, speaker: string, content: string, text: string, timestamp: string, time: string, created_at: string, metadata: string>>>,
    questions: array<struct<question_id: string, query: string, query_time: string, metadata: string, label: struct<reference_answer: string, evidence_ids: array<string>, metadata: string>>>"""
UNIFIED = f"schema_version string, dataset_name string, split string, items array<struct<{ITEM}>>"
UNIFIED_LINE = f"schema_version string, dataset_name string, item_ord long, item struct<{ITEM}>"
#: Where, in a folder, write_unified puts its lines.
LINES = "items.jsonl"
MESSAGES = ("item_id", "scope_id", "conv_ix", "msg_ix", "message_id", "role", "speaker", "content", "ts_raw", "session_id", "metadata")
QUESTIONS = ("item_id", "question_id", "q_ord", "query", "query_time_raw", "question_type", "metadata")
LABELS = ("item_id", "question_id", "reference", "references", "evidence_ids", "evidence_level", "incorrect_answers", "metadata")


def references(raw: Column) -> Column:
    """The accepted answers of a reference that is a JSON list, or one value."""
    many = F.from_json(F.when(text.strip(raw).startswith("["), raw), "array<string>")
    one = F.when(text.text_or_null(raw).isNotNull(), F.array(raw)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.filter(many, lambda x: x.isNotNull()), one)


def _meta(col: str, key: str) -> Column:
    return F.get_json_object(col, f"$.{key}")


def _root(spark: SparkSession, path: str) -> DataFrame:
    """(schema_version, dataset_name, item_ord, i): of one object with all items, or of a folder
    of lines (write_unified) with an item and its place each."""
    if files.exists(spark, f"{path}/{LINES}"):
        return spark.read.schema(UNIFIED_LINE).option("mode", "FAILFAST").json(f"{path}/{LINES}").select("schema_version", "dataset_name", "item_ord", F.col("item").alias("i"))
    whole = spark.read.schema(UNIFIED).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select("schema_version", "dataset_name", F.posexplode_outer("items").alias("item_ord", "i"))


def read_unified(spark: SparkSession, path: str) -> Dataset:
    """A unified file: one object with items, conversations and questions; or such a dataset as a
    folder of lines, an item each."""
    root = _root(spark, path)
    head = root.select("schema_version", "dataset_name").first()
    if head is None or not re.fullmatch(SCHEMA_VERSIONS, head.schema_version or ""):
        raise ValueError(f"schema_version must be like {SCHEMA_VERSION}, not {head and head.schema_version}")
    items = root.where("item_ord is not null").select("item_ord", text.text_or_empty("i.item_id").alias("item_id"), "i")
    talks = items.select("item_id", F.posexplode("i.conversations").alias("c", "msgs")).select("item_id", (F.col("c") + 1).alias("conv_ix"), F.posexplode("msgs").alias("m", "x"))
    flat = units.message_accessors(talks.select("item_id", "conv_ix", (F.col("m") + 1).alias("msg_ix"), "x.*"))
    messages = flat.select("item_id", F.col("item_id").alias("scope_id"), "conv_ix", "msg_ix", "message_id", "role", "speaker", "content", "ts_raw", _meta("metadata", "session_id").alias("session_id"), "metadata")
    asked = items.select("item_id", F.posexplode("i.questions").alias("q_ord", "q"))
    qid = text.text_or_empty("q.question_id").alias("question_id")
    kind = F.coalesce(*(text.text_or_null(_meta("q.metadata", k)) for k in ("question_category", "category", "question_type", "type")))
    questions = asked.select("item_id", qid, "q_ord", F.coalesce("q.query", F.lit("")).alias("query"), text.text_or_null("q.query_time").alias("query_time_raw"), kind.alias("question_type"), F.col("q.metadata").alias("metadata"))
    wrong = F.from_json(_meta("q.label.metadata", "incorrect_answers"), "array<string>")
    labels = asked.where("q.label is not null").select(
        "item_id", qid, F.col("q.label.reference_answer").alias("reference"), references(F.col("q.label.reference_answer")).alias("references"), text.string_list("q.label.evidence_ids").alias("evidence_ids"),
        _meta("q.label.metadata", "evidence_level").alias("evidence_level"), F.coalesce(wrong, F.array().cast("array<string>")).alias("incorrect_answers"), F.col("q.label.metadata").alias("metadata"),
    )
    subject = F.coalesce(text.text_or_null("i.subject_id"), F.col("item_id"))
    return Dataset(head.dataset_name or "unified", items.select("item_ord", "item_id", subject.alias("subject_id"), F.col("i.metadata").alias("metadata")), messages, questions, labels)


TURNS = """example_id string, source_sample_id string, question_id string, question_type string, question string, answer string, question_date string, participants array<string>,
    turn_records array<struct<record_id: string, id: string, session_id: string, turn_index: int, speaker: string, text: string, timestamp: string, metadata: struct<session_key: string, dia_id: string, img_url: string>>>,
    session_records array<struct<record_id: string, session_index: int, text: string, timestamp: string>>,
    gold_session_ids array<string>, gold_turn_ids array<string>, metadata struct<dataset_file: string, category: string>"""


def from_turn_records(rows: DataFrame, name: str) -> Dataset:
    """One record a question. The item is the sample; its conversations are those of its first
    record only, turns grouped by session in order of appearance; without turns, each session
    record is one message."""
    key = F.coalesce(text.text_or_null("source_sample_id"), text.text_or_null("example_id"))
    rows = rows.withColumn("item_id", F.when(key.isNull(), F.raise_error(F.lit("a record has neither source_sample_id nor example_id"))).otherwise(key))
    first = rows.groupBy("item_id").agg(F.min("ord").alias("ord"))
    heads = rows.join(numbered(first, "item_ord"), ["item_id", "ord"])
    meta = F.to_json(F.struct(F.coalesce(text.text_or_null("source_sample_id"), F.col("item_id")).alias("source_sample_id"), F.nullif(text.string_list("participants"), F.array().cast("array<string>")).alias("participants"), "metadata.dataset_file", "metadata.category"))
    items = heads.select("item_ord", "item_id", F.col("item_id").alias("subject_id"), meta.alias("metadata"))
    turns = heads.select("item_id", F.posexplode("turn_records").alias("p", "t"))
    session = F.coalesce(text.text_or_null("t.session_id"), F.lit("unknown_session"))
    turns = turns.withColumn("sid", session).withColumn("start", F.min("p").over(Window.partitionBy("item_id", "sid")))
    talk = Window.partitionBy("item_id")
    speaker = text.text_or_null("t.speaker")
    from_turns = turns.select(
        "item_id", F.col("item_id").alias("scope_id"), F.dense_rank().over(talk.orderBy("start")).alias("conv_ix"), F.row_number().over(Window.partitionBy("item_id", "sid").orderBy("p")).alias("msg_ix"),
        F.coalesce(text.text_or_null("t.record_id"), text.text_or_null("t.id")).alias("message_id"), F.lit("participant").alias("role"), speaker.alias("speaker"), text.text_or_empty("t.text").alias("content"),
        text.text_or_null("t.timestamp").alias("ts_raw"), text.text_or_null("t.session_id").alias("session_id"),
        F.to_json(F.struct(speaker.alias("speaker"), text.text_or_null("t.session_id").alias("session_id"), "t.turn_index", "t.metadata.session_key", "t.metadata.dia_id", "t.metadata.img_url")).alias("metadata"),
    )
    whole = heads.where(F.coalesce(F.size("turn_records"), F.lit(0)) <= 0).select("item_id", F.posexplode("session_records").alias("p", "s"))
    sid = F.coalesce(text.text_or_null("s.record_id"), F.concat(F.lit("session_"), F.col("p") + 1))
    from_sessions = whole.select(
        "item_id", F.col("item_id").alias("scope_id"), (F.col("p") + 1).alias("conv_ix"), F.lit(1).alias("msg_ix"), sid.alias("message_id"), F.lit("conversation").alias("role"), F.lit(None).cast("string").alias("speaker"),
        text.text_or_empty("s.text").alias("content"), text.text_or_null("s.timestamp").alias("ts_raw"), sid.alias("session_id"), F.to_json(F.struct(sid.alias("session_id"), F.coalesce("s.session_index", F.col("p") + 1).alias("session_index"))).alias("metadata"),
    )
    q_ord = F.row_number().over(Window.partitionBy("item_id").orderBy("ord")) - 1
    questions = rows.select("item_id", text.text_or_empty("question_id").alias("question_id"), q_ord.alias("q_ord"), text.text_or_empty("question").alias("query"), text.text_or_null("question_date").alias("query_time_raw"), text.text_or_null("question_type").alias("question_type"), F.to_json(F.struct(text.text_or_null("question_type").alias("question_type"), text.text_or_null("example_id").alias("source_example_id"))).alias("metadata"))
    gold_turns, gold_sessions = text.string_list("gold_turn_ids"), text.string_list("gold_session_ids")
    by_turn = F.size(gold_turns) > 0
    labels = rows.select(
        "item_id", text.text_or_empty("question_id").alias("question_id"), F.col("answer").alias("reference"), references(F.col("answer")).alias("references"), F.when(by_turn, gold_turns).otherwise(gold_sessions).alias("evidence_ids"),
        F.when(by_turn, F.lit("message")).when(F.size(gold_sessions) > 0, F.lit("conversation")).alias("evidence_level"), F.array().cast("array<string>").alias("incorrect_answers"), F.to_json(F.struct(gold_sessions.alias("gold_session_ids"))).alias("metadata"),
    )
    return Dataset(name, items, from_turns.unionByName(from_sessions), questions, labels)


HAYSTACK = """question_id string, question_type string, question string, question_date string, answer string, answer_session_ids array<string>, haystack_dates array<string>, haystack_session_ids array<string>,
    haystack_sessions array<array<struct<role: string, content: string, speaker: string>>>"""


def from_haystack(rows: DataFrame, name: str) -> Dataset:
    """One item a question. Sessions meet their ids and dates by position, after nulls have gone
    from those lists; a missing id is session_N, a missing date null."""
    item = text.text_or_empty("question_id")
    rows = rows.withColumn("item_id", item)
    items = numbered(rows.select("item_id", "ord"), "item_ord").select("item_ord", "item_id", F.col("item_id").alias("subject_id"), F.lit("{}").alias("metadata"))
    talks = rows.select("item_id", text.string_list("haystack_session_ids").alias("ids"), text.string_list("haystack_dates").alias("dates"), F.posexplode("haystack_sessions").alias("c", "turns"))
    at = F.col("c")
    talks = talks.select("item_id", (at + 1).alias("conv_ix"), F.coalesce(F.nullif(F.get("ids", at), F.lit("")), F.concat(F.lit("session_"), at + 1)).alias("session_id"), F.nullif(F.get("dates", at), F.lit("")).alias("ts_raw"), F.posexplode("turns").alias("m", "t"))
    role = F.coalesce(text.text_or_null("t.role"), F.lit("unknown"))
    n = F.col("m") + 1
    messages = talks.select(
        "item_id", F.col("item_id").alias("scope_id"), "conv_ix", n.alias("msg_ix"), F.concat("session_id", F.lit(":m"), n).alias("message_id"), role.alias("role"), F.coalesce(text.text_or_null("t.speaker"), role).alias("speaker"),
        text.text_or_empty("t.content").alias("content"), "ts_raw", "session_id", F.to_json(F.struct("session_id", F.col("conv_ix").alias("session_index"), n.alias("turn_index"))).alias("metadata"),
    )
    kind = text.text_or_null("question_type")
    questions = rows.select("item_id", item.alias("question_id"), F.lit(0).alias("q_ord"), text.text_or_empty("question").alias("query"), text.text_or_null("question_date").alias("query_time_raw"), kind.alias("question_type"), F.to_json(F.struct(kind.alias("question_type"))).alias("metadata"))
    labels = rows.select("item_id", item.alias("question_id"), F.col("answer").alias("reference"), references(F.col("answer")).alias("references"), text.string_list("answer_session_ids").alias("evidence_ids"), F.lit("conversation").alias("evidence_level"), F.array().cast("array<string>").alias("incorrect_answers"), F.lit("{}").alias("metadata"))
    return Dataset(name, items, messages, questions, labels)


PERSONA_SESSIONS = "session_id string, persona_id string, case_id string, source string, conversation_type string, conversation_flow string, persona_signal_level string, `order` int, timestamp string, history array<struct<role: string, content: string>>"
PERSONA_INSTANCES = """instance_id string, persona_id string, persona_str string, case_id string, `case` string, facts array<string>, session_ids array<string>, relation_type string, relation_subtype string, topic string, source string,
    qas array<struct<query: string, correct_answers: array<string>, incorrect_answers: array<string>>>"""


def from_persona(sessions: DataFrame, instances: DataFrame, name: str) -> Dataset:
    """One persona's sessions and the instances asked about them: one item. Its id and its name
    are the first that instances, then sessions, give; nothing else of the persona is kept."""
    every = instances.select(F.lit(0).alias("k"), "ord", text.text_or_null("persona_id").alias("id")).unionByName(sessions.select(F.lit(1).alias("k"), "ord", text.text_or_null("persona_id").alias("id"))).where("id is not null")
    head = every.agg(F.min_by("id", F.struct("k", "ord")).alias("id"))
    called = instances.select("ord", text.text_or_null(F.get_json_object("persona_str", "$.name")).alias("called")).where("called is not null").agg(F.min_by("called", "ord").alias("called"))
    who = head.join(called).select(F.coalesce("id", F.lit("persona")).alias("item_id"), "called")  # one row
    items = who.select(F.lit(0).alias("item_ord"), "item_id", F.col("item_id").alias("subject_id"), F.lit("{}").alias("metadata"))
    places = numbered(sessions.select("ord"), "conv_at").select("ord", (F.col("conv_at") + 1).cast("int").alias("conv_ix"))
    talks = sessions.join(places, "ord").join(F.broadcast(who)).select("item_id", "called", "conv_ix", text.text_or_empty("session_id").alias("session_id"), text.text_or_null("timestamp").alias("ts_raw"), "case_id", "source", "conversation_type", "conversation_flow", "persona_signal_level", "order", F.posexplode("history").alias("m", "t"))
    role = F.coalesce(text.text_or_null("t.role"), F.lit("unknown"))
    low = F.lower(text.strip(role))
    n = F.col("m") + 1
    details = [text.text_or_null(c).alias(c) for c in ("case_id", "source", "conversation_type", "conversation_flow", "persona_signal_level")]
    messages = talks.select(
        "item_id", F.col("item_id").alias("scope_id"), "conv_ix", n.alias("msg_ix"), F.concat("session_id", F.lit(":m"), n).alias("message_id"), role.alias("role"), F.when(low == "user", F.coalesce("called", F.lit("user"))).otherwise(low).alias("speaker"),
        text.text_or_empty("t.content").alias("content"), "ts_raw", "session_id", F.to_json(F.struct("session_id", n.alias("turn_index"), *details, "order")).alias("metadata"),
    )
    asked = instances.join(F.broadcast(who.select("item_id"))).select("*", F.posexplode("qas").alias("q", "qa"))
    order = numbered(asked.select("ord", "q"), "q_ord", "q")
    qid = F.concat(text.text_or_empty("instance_id"), F.lit(":q"), F.col("q") + 1)
    known = [text.text_or_null(c).alias(c) for c in ("instance_id", "case_id", "persona_id", "relation_type", "relation_subtype", "topic", "source")]
    questions = asked.join(order, ["ord", "q"]).select("item_id", qid.alias("question_id"), F.col("q_ord").cast("int").alias("q_ord"), text.text_or_empty("qa.query").alias("query"), F.lit(None).cast("string").alias("query_time_raw"), text.text_or_null("relation_type").alias("question_type"), F.to_json(F.struct(*known)).alias("metadata"))
    trimmed = lambda c: F.filter(F.transform(text.string_list(c), text.strip), lambda x: x != "")
    labels = asked.select(
        "item_id", qid.alias("question_id"), F.to_json("qa.correct_answers").alias("reference"), trimmed("qa.correct_answers").alias("references"), trimmed("session_ids").alias("evidence_ids"), F.lit("conversation").alias("evidence_level"),
        trimmed("qa.incorrect_answers").alias("incorrect_answers"), F.to_json(F.struct(trimmed("facts").alias("facts"), text.text_or_null("case").alias("case"))).alias("metadata"),
    )
    return Dataset(name, items, messages, questions, labels)
