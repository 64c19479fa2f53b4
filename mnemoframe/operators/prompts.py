"""Prompts and the cleaning of replies. Wordings are this engine's own; slots and reply formats
are what the parsers in evaluate expect."""

from __future__ import annotations

import functools
import inspect
import json
import re
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import keys, text

NO_MEMORIES = "(no memories were found)"
# Marks in replies.
THINK = r"(?is)<think\b[^>]*>.*?</think>"
MESSAGE_MARK = r"(?i)<\|message\|>"
FINAL_MARK = r"(?is)^(?:.*\n)?[\s*_#]*final\s+answer[\s*_]*[:：]?[\s*_]*"


@functools.cache
def version() -> str:
    """Changes with anything in this module: the wordings, and how replies are read."""
    return keys.stable_hash(inspect.getsource(sys.modules[__name__]))


def answer_prompt(context: str = "context", question: str = "query_text", question_time: str = "query_time_raw", with_time: bool = True) -> Column:
    asked = F.when(text.text_or_null(question_time).isNotNull(), F.concat(F.lit("\nThe question was asked at: "), F.col(question_time))).otherwise(F.lit("")) if with_time else F.lit("")
    seen = F.coalesce(text.text_or_null(context), F.lit(NO_MEMORIES))
    return F.concat(F.lit("Answer the question from the memories below. Reason in steps, then end with a line 'Final answer: ...'.\n\nMemories:\n"), seen, F.lit("\n\nQuestion: "), F.col(question), asked)


def clean_reply(reply: str | Column) -> Column:
    """Without thinking blocks; what follows the last message mark, if there is one."""
    r = F.col(reply) if isinstance(reply, str) else reply
    return text.strip(F.element_at(F.split(F.regexp_replace(F.coalesce(r, F.lit("")), THINK, ""), MESSAGE_MARK), -1))


def final_answer(reply: str | Column) -> Column:
    """What follows the last mark of a final answer, else the whole cleaned reply."""
    cleaned = clean_reply(reply)
    return F.coalesce(text.text_or_null(F.when(cleaned.rlike(FINAL_MARK), F.regexp_replace(cleaned, FINAL_MARK, ""))), cleaned)


# The question types that are judged plainly, and those with a rule of their own.
PLAIN_TYPES = ("single-session-user", "single-session-assistant", "multi-session")
TYPE_RULES = {
    "temporal-reasoning": "Do not count it as an error if a number of days, weeks or months is off by one.",
    "knowledge-update": "If earlier information is given along with the updated answer, the updated one counts.",
    "single-session-preference": "The references describe what a good personal reply contains; it need not contain everything, but must use what is known of the person rightly.",
}


def _listed(col: str) -> Column:
    items = F.filter(F.transform(F.col(col), text.collapse), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("")), F.lit("(none)"))


# The relations between memories that cases are about, their kinds, other names of
# kinds, and where cases come from. What is said of each is in this engine's words.
RELATIONS = {
    "complementary": "All memories hold together; the answer must combine what agrees.",
    "nuanced": "Each memory holds under a condition of time or context; the answer must pick the one whose condition the question meets.",
    "contradictory": "The memories can't be reconciled; the answer must own up to that and not settle on one of them with confidence.",
}
KINDS = {
    "K=1": "One memory decides; background that merely fits it is not enough.",
    "K>1": "Several memories must be combined; everything that is asked for must be there.",
    "any_one": "Any one of several memories is enough.",
    "Temporal": "Time decides which memory holds.",
    "Context": "Context decides which memory holds.",
    "contradictory": "No condition that is known reconciles the memories.",
    "non_persona_contradiction": "The contradiction is one of facts; nothing about the person follows from its name.",
}
KIND_ALIASES = {"a_user_vs_user": "non_persona_contradiction", "b_user_vs_non_user": "non_persona_contradiction", "c_non_user_vs_non_user": "non_persona_contradiction"}
SOURCES = {
    "user-related": "The question is about the user; judge preferences, habits and circumstances by the accepted answers alone.",
    "user-unrelated": "The question is not about the user; judge by the accepted answers and the relation alone.",
}
#: Columns that a persona's prompt shows where rows have them.
CASE_COLUMNS = ("facts", "case", "relation_type", "relation_subtype", "topic", "source")


def _looked_up(value: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, said in reversed(table.items()):
        out = F.when(value == key, F.lit(said)).otherwise(out)
    return out


def case_guidance(columns: list[str]) -> Column:
    """What a persona's judge is told of the case: its facts, and the guidance of its relation,
    kind and source."""
    have = {c: text.text_or_empty(c) if c in columns and c != "facts" else F.lit("") for c in CASE_COLUMNS}
    facts = _listed("facts") if "facts" in columns else F.lit("(none)")
    kind = have["relation_subtype"]
    for alias, name in KIND_ALIASES.items():
        kind = F.when(kind == alias, F.lit(name)).otherwise(kind)
    shown = [F.concat(F.lit(f"\n{label}: "), F.coalesce(F.nullif(have[c], F.lit("")), F.lit("(none)"))) for label, c in (("Case", "case"), ("Relation", "relation_type"), ("Kind of relation", "relation_subtype"), ("Topic", "topic"), ("Source", "source"))]
    told = [_looked_up(have["relation_type"], RELATIONS, "Judge by the accepted answers alone."), _looked_up(kind, KINDS, "No more is known of the relation."), _looked_up(have["source"], SOURCES, "Judge without regard to where the case comes from.")]
    return F.concat(F.lit("\nFacts:\n"), facts, *shown, F.lit("\nGuidance: "), F.concat_ws(" ", *told))


def filled(template: str, slots: dict[str, Column]) -> Column:
    """The template with each {slot} filled; what is filled in isn't looked at again. Other braces
    stay."""
    parts = re.split(r"(\{(?:" + "|".join(map(re.escape, slots)) + r")\})", template)
    return F.concat(*(slots[p[1:-1]] if p[:1] == "{" and p[1:-1] in slots else F.lit(p) for p in parts if p))


def judge_prompt(columns: list[str] | None = None, templates: dict[str, str] | None = None) -> Column:
    """By family; of rows with question, answer, references, incorrect_answers, question_type and
    question_id. columns: those that rows have; of CASE_COLUMNS, a persona's prompt shows these.
    templates: by family, wordings other than the engine's own, with the slots question, answer,
    references, incorrect_answers, rule (of a haystack's question type) and case."""
    slots = F.concat(F.lit("\n\nQuestion: "), F.col("question"), F.lit("\nAccepted answers:\n"), _listed("references"), F.lit("\nGiven answer: "), F.coalesce("answer", F.lit("")))
    turns = F.concat(F.lit('Decide whether the given answer agrees with an accepted one; be generous about wording, formats and relative dates. Reply with JSON: {"label": "CORRECT"} or {"label": "WRONG"}.'), slots)
    kind = F.coalesce(F.col("question_type"), F.lit("unknown"))
    rule = F.when(F.contains("question_id", F.lit("_abs")), F.lit("The question can't be answered from what was said; the answer is right only if it says so."))
    rule = rule.when(kind.isin(*PLAIN_TYPES), F.lit("The answer is right if it says the same as, or contains, an accepted one."))
    for name, words in TYPE_RULES.items():
        rule = rule.when(kind == name, F.lit(words))
    rule = rule.otherwise(F.raise_error(F.concat(F.lit("no judging rule for the question type "), kind)).cast("string"))
    haystack = F.concat(F.lit("Is the given answer right? "), rule, F.lit(" Reply yes or no only."), slots)
    persona = F.concat(F.lit('Decide whether the given answer agrees with an accepted one and with none of the wrong ones. Reply with JSON: {"label": "CORRECT" or "WRONG", "reason": "..."}.'), slots, F.lit("\nWrong answers:\n"), _listed("incorrect_answers"), case_guidance(columns or []))
    own = {"turns": turns, "haystack": haystack, "persona": persona}
    slots = {"question": F.col("question"), "answer": F.coalesce("answer", F.lit("")), "references": _listed("references"), "incorrect_answers": _listed("incorrect_answers"), "case": case_guidance(columns or [])}
    own |= {k: filled(t, slots | ({"rule": rule} if k == "haystack" else {"rule": F.lit("")})) for k, t in (templates or {}).items()}
    return F.when(F.col("family") == "turns", own["turns"]).when(F.col("family") == "haystack", own["haystack"]).otherwise(own["persona"])


FACTS_PROMPT = "List the lasting facts that the speaker states in the conversation below, one short sentence each. Reply with JSON: {\"facts\": [{\"text\": \"...\", \"tags\": [\"...\"]}]}.\n\n"
MAX_TAGS = 6
FACT_KINDS = "array<struct<text: string, tags: array<string>>>"


def parse_facts(reply: str | Column) -> Column:
    """The facts of a reply, as array<struct<text, tags>>: objects or bare strings, blanks
    dropped, six tags at most; null if the reply holds no JSON object with facts."""
    r = F.col(reply) if isinstance(reply, str) else reply
    body = F.regexp_extract(r, r"(?s)(\{.*\})", 1)
    items = F.from_json(F.get_json_object(body, "$.facts"), "array<string>")

    def one(x: Column) -> Column:
        is_object = text.strip(x).startswith("{")
        said = F.when(is_object, F.get_json_object(x, "$.text")).otherwise(x)
        tags = F.when(is_object, F.from_json(F.get_json_object(x, "$.tags"), "array<string>"))
        tags = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isNotNull() & (text.strip(t) != ""))
        return F.struct(text.text_or_empty(said).alias("text"), F.slice(F.transform(tags, text.strip), 1, MAX_TAGS).alias("tags"))

    return F.filter(F.transform(items, one), lambda x: x["text"] != "")


def check_facts(reply: str) -> None:
    """Raises where a reply is no JSON object with a list of facts (or null for none)."""
    from ..plans.systems import Malformed

    body = reply.strip()
    for form in (body, body[body.find("{") : body.rfind("}") + 1]):
        try:
            got = json.loads(form)
            break
        except ValueError:
            continue
    else:
        raise Malformed("no JSON in the reply")
    if not isinstance(got, dict) or "facts" not in got:
        raise Malformed("no facts in the reply")
    if not isinstance(got["facts"] or [], list):
        raise Malformed("facts are no list")
