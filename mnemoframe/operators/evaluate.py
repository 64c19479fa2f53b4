"""Answers against references: contained text, judged verdicts, and what they add up to.

answers: item_id, question_id, answer; labels: item_id, question_id, references array<string>,
metadata columns. score and passed are null where nothing was evaluated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .calls import Calls, Complete, replied

KEYS = ["item_id", "question_id"]


def last_answers(answers: DataFrame, order: str) -> DataFrame:
    """Of answers to one question, the last."""
    return answers.withColumn("_n", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def with_labels(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Answers with their reference and evidence, which they get only once they are given."""
    return answers.join(labels.select(*KEYS, "reference", "evidence_ids"), KEYS, "left")


def strict_join(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    """An inner join that fails on a row of left without a match."""
    marked = left.join(right.withColumn("_hit", F.lit(True)), keys, "left")
    said = F.concat(F.lit(f"{what} missing for "), F.to_json(F.struct(*keys)))
    return marked.where(F.when(F.col("_hit").isNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True))).drop("_hit")


def contains(answer: str = "answer", references: str = "references", need_all: bool = False) -> dict[str, Column]:
    """score and passed: whether the answer holds any, or all, of the references. References that
    are blank don't count; without one, both are null."""
    said = text.normalized(F.coalesce(F.col(answer), F.lit("")))
    want = F.filter(F.transform(F.coalesce(F.col(references), F.array().cast("array<string>")), text.normalized), lambda r: r.isNotNull() & (r != ""))
    hit, n = F.size(F.filter(want, lambda r: F.contains(said, r))), F.size(want)
    if need_all:
        return {"score": F.when(n > 0, hit / n), "passed": F.when(n > 0, hit == n)}
    return {"score": F.when(n > 0, F.when(hit > 0, 1.0).otherwise(0.0)), "passed": F.when(n > 0, hit > 0)}


#: Words by which texts and references meet.
ANCHOR = 3


def containing(texts: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the normalized text holds the normalized reference. texts: doc_id,
    text; references: item_id, reference. A reference's words but the first and last stand whole
    in a text that holds it, so that runs of ANCHOR words lead to the few pairs that are compared;
    references without such a run are compared with each text, one of each kind."""
    d = texts.select("doc_id", text.normalized("text").alias("said"))
    b = references.select("item_id", text.normalized("reference").alias("ref")).where("ref is not null")
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (ANCHOR - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(ANCHOR)))))
    b = b.withColumn("w", F.split("ref", " ")).withColumn("long", F.size("w") >= ANCHOR + 2)
    anchors = b.where("long").select("item_id", F.xxhash64(F.slice("w", 2, ANCHOR)).alias("h"))
    places = d.select("doc_id", F.split("said", " ").alias("w")).where(F.size("w") >= ANCHOR).select("doc_id", F.explode(runs(F.col("w"))).alias("h"))
    near = places.join(anchors, "h").select("doc_id", "item_id").distinct()
    found = near.join(d, "doc_id").join(b.select("item_id", "ref"), "item_id").where(F.contains("said", "ref")).select("doc_id", "item_id")
    short = b.where("not long").groupBy("ref").agg(F.collect_list("item_id").alias("items"))
    held = d.join(short, F.contains("said", "ref")).select("doc_id", F.explode("items").alias("item_id"))
    return found.unionByName(held)


# Parts of dataset names by which a family is known, and the category that isn't judged.
FAMILIES = {"locomo": "turns", "longmemeval": "haystack", "mbench": "persona", "subtlememory": "persona"}
SKIPPED_CATEGORY = "5"
ABSTENTION_MARK = "_abs"


def family(dataset: str | Column) -> Column:
    name = F.lower(F.col(dataset) if isinstance(dataset, str) else dataset)
    out = F.raise_error(F.concat(F.lit("no family is known for the dataset "), name)).cast("string")
    for part, kind in reversed(FAMILIES.items()):
        out = F.when(F.contains(name, F.lit(part)), F.lit(kind)).otherwise(out)
    return out


def parse_turn_label(raw: str | Column, strict: bool = False) -> Column:
    """CORRECT or WRONG from a judge's reply: its JSON label, else its text. As published, a label
    passes if CORRECT occurs in it at all; strict wants the whole word."""
    r = F.upper(F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit("")))
    label = F.upper(F.coalesce(F.get_json_object(F.col(raw) if isinstance(raw, str) else raw, "$.label"), F.lit("")))

    def of(x: Column) -> Column:
        right = x.rlike(r"\bCORRECT\b") & ~x.rlike(r"\b(WRONG|INCORRECT)\b") if strict else F.contains(x, F.lit("CORRECT"))
        return F.when(right, F.lit("CORRECT")).when(F.contains(x, F.lit("WRONG")) | F.contains(x, F.lit("INCORRECT")), F.lit("WRONG"))

    return F.coalesce(of(label), of(r), F.lit("WRONG"))


# The forms in which replies give a JSON object with a label, fenced and inside text.
FENCED_OBJECT = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
LABELLED_OBJECT = r'(?s)(\{[^{}]*"label"\s*:[^{}]*\})'


def parse_persona_label(raw: str | Column) -> Column:
    """The label of the reply's JSON object, bare, fenced or inside the text; else whole words,
    WRONG and INCORRECT before CORRECT; else WRONG."""
    r = F.col(raw) if isinstance(raw, str) else raw
    forms = [text.strip(r), F.regexp_extract(r, FENCED_OBJECT, 1), F.regexp_extract(r, LABELLED_OBJECT, 1)]
    labels = [F.upper(text.strip(F.get_json_object(f, "$.label"))) for f in forms]
    found = F.coalesce(*(F.when(x.isin("CORRECT", "WRONG"), x) for x in labels))
    u = F.upper(F.coalesce(r, F.lit("")))
    return F.coalesce(found, F.when(u.rlike(r"\b(WRONG|INCORRECT)\b"), F.lit("WRONG")).when(u.rlike(r"\bCORRECT\b"), F.lit("CORRECT")), F.lit("WRONG"))


def exact_verdict(answer: str = "answer", correct: str = "references", incorrect: str = "incorrect_answers") -> Column:
    """CORRECT or WRONG where the answer equals a known one, else null."""
    said = text.normalized(F.coalesce(F.col(answer), F.lit("")))

    def known(c: str) -> Column:
        return F.coalesce(F.array_contains(F.transform(F.col(c), text.normalized), said), F.lit(False))

    return F.when(said == "", F.lit(None).cast("string")).when(known(correct), F.lit("CORRECT")).when(known(incorrect), F.lit("WRONG"))


def judge(rows: DataFrame, complete: Complete, dataset: str = "dataset", strict: bool = False, templates: dict[str, str] | None = None, calls: Calls = Calls()) -> DataFrame:
    """rows: the keys, dataset, question, answer, references, question_type, incorrect_answers and
    the metadata that prompts use. Adds family, prompt_name, skip_reason, judge_source, judge_label,
    score, passed and error. Only rows that no rule settles reach the judge; those whose call failed
    have an error, and neither label nor score."""
    from . import prompts

    gold = F.coalesce(F.exists(F.col("references"), lambda r: text.collapse(r) != ""), F.lit(False))
    kind = F.coalesce(F.col("question_type"), F.lit("unknown"))
    base = rows.withColumn("family", family(dataset)).withColumn(
        "skip_reason", F.when(~gold, F.lit("empty_gold_answer")).when((F.col("family") == "turns") & (kind == SKIPPED_CATEGORY), F.lit("category_5"))
    )
    base = base.withColumn("exact", F.when(F.col("skip_reason").isNull() & (F.col("family") == "persona"), exact_verdict()))
    base = base.withColumn("prompt_name", F.concat(F.col("family"), F.lit("_v1")))
    done = base.where(F.col("skip_reason").isNotNull() | F.col("exact").isNotNull()).withColumns({"judge_raw": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    ask = base.where(F.col("skip_reason").isNull() & F.col("exact").isNull()).withColumn("prompt", prompts.judge_prompt(base.columns, templates))
    every = done.unionByName(replied(ask, complete, calls, reply="judge_raw").drop("prompt"))
    yes = F.contains(F.lower("judge_raw"), F.lit("yes"))
    if strict:
        yes = F.lower("judge_raw").rlike(r"\byes\b")
    label = F.coalesce(
        F.col("exact"),
        F.when(F.col("family") == "turns", parse_turn_label("judge_raw", strict)).when(F.col("family") == "persona", parse_persona_label("judge_raw")).otherwise(F.when(F.coalesce(yes, F.lit(False)), F.lit("CORRECT")).otherwise(F.lit("WRONG"))),
    )
    out = every.withColumn("judge_label", F.when(F.col("skip_reason").isNull() & F.col("error").isNull(), label))
    source = F.when(F.col("exact").isNotNull(), F.lit("exact_reference")).when(F.col("skip_reason").isNull() & F.col("error").isNull(), F.lit("judge"))
    return out.withColumns({"judge_source": source, "passed": F.col("judge_label") == "CORRECT"}).withColumn("score", F.col("passed").cast("double")).drop("exact")


def category(*cols: str) -> Column:
    """The first that isn't blank, else unknown."""
    return F.coalesce(*(text.text_or_null(c) for c in cols), F.lit("unknown"))


def accuracy(evaluations: DataFrame, *by: str) -> DataFrame:
    """question_count, evaluated_count, passed_count, accuracy, avg_score; nulls don't count."""
    n, p = F.count("passed"), F.count_if(F.col("passed"))
    rows = evaluations.groupBy(*by) if by else evaluations.groupBy()
    return rows.agg(F.count("*").alias("question_count"), n.alias("evaluated_count"), p.alias("passed_count"), (p / F.nullif(n, F.lit(0))).alias("accuracy"), F.avg("score").alias("avg_score"))


def accuracy_all(evaluations: DataFrame, by: str = "category") -> DataFrame:
    """Each category and, with a null one, all of them, in one pass."""
    n, p = F.count("passed"), F.count_if(F.col("passed"))
    return evaluations.rollup(by).agg(F.count("*").alias("question_count"), n.alias("evaluated_count"), p.alias("passed_count"), (p / F.nullif(n, F.lit(0))).alias("accuracy"), F.avg("score").alias("avg_score"))


def evidence_recall(ranked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Per question: recall among the first k, hit, and the reciprocal rank of the first hit.
    ranked: question_id, rank, source_ids; labels: question_id, evidence_ids."""
    want = labels.where(F.size("evidence_ids") > 0).select("question_id", F.explode(F.array_distinct("evidence_ids")).alias("id"))
    got = ranked.where(F.col("rank") <= k).select("question_id", "rank", F.explode(F.array_distinct("source_ids")).alias("id")).groupBy("question_id", "id").agg(F.min("rank").alias("rank"))
    each = want.join(got, ["question_id", "id"], "left")
    return each.groupBy("question_id").agg((F.count("rank") / F.count("*")).alias("recall"), (F.count("rank") > 0).alias("hit"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))
