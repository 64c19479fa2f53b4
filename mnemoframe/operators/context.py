"""Contexts: ranked units as text within a budget of tokens.

ranked: question_id, unit_id, text, ts_raw, score, rank. Contexts come one for each question of
`questions`, empty where nothing fits or nothing was found."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, times

BUDGET = 1000
EMPTY = {"context": "", "context_tokens": 0, "context_blocks": 0, "context_timepoints": 0}
SCHEMA = "question_id {kind}, context string, context_tokens long, context_blocks long, context_timepoints long"


def full_date() -> Column:
    """yyyy-MM-dd, the raw string where it can't be read, or unknown."""
    return F.coalesce(F.date_format(times.parse("ts_raw"), "yyyy-MM-dd"), text.text_or_null("ts_raw"), F.lit("unknown"))


def _whole(questions: DataFrame, packed: DataFrame) -> DataFrame:
    return questions.select("question_id").join(packed, "question_id", "left").fillna(EMPTY)


def pack_lines(questions: DataFrame, ranked: DataFrame, budget: int | None = None, timestamps: bool = True, joiner: str = "\n\n", by_time: bool = False, style: str = "stamped") -> DataFrame:
    """Blocks by rank as long as their tokens fit; the first that doesn't ends the context.
    Tokens add up, so that a running sum over the rank decides. by_time orders what was taken by
    time, for which a block's turn in the budget stays its rank. style: "stamped" blocks are
    [time] text, "list" blocks - time: text, without the time where there is none."""
    from .retrieve import effective

    stamp = F.coalesce(text.text_or_null("ts_raw"), F.lit("unknown"))
    if style == "list":
        when = F.concat("ts_raw", F.lit(": ")) if timestamps else F.lit("")
        block = F.concat(F.lit("- "), F.when(F.col("ts_raw") != "", when).otherwise(F.lit("")), F.col("text"))
    else:
        block = F.concat(F.lit("["), stamp, F.lit("] "), F.col("text")) if timestamps else F.col("text")
    rows = ranked.withColumns({"block": block, "stamp": stamp, "ts": times.parse("ts_raw")}).withColumn("tok", text.token_count("block"))
    so_far = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = rows.withColumn("sum", F.sum("tok").over(so_far)).where(F.col("sum") <= effective(budget, BUDGET))
    key = F.struct(F.col("ts").isNull().alias("n"), "ts", "rank", "unit_id", "block") if by_time else F.struct("rank", "block")
    blocks = F.transform(F.array_sort(F.collect_list(key)), lambda x: x["block"])
    return _whole(questions, taken.groupBy("question_id").agg(
        F.array_join(blocks, joiner).alias("context"), F.sum("tok").alias("context_tokens"), F.count("*").alias("context_blocks"), F.count_distinct("stamp").alias("context_timepoints"),
    ))


# What follows picks among whole renderings, which isn't monotone in the units taken: it runs on
# one question's ranked units at a time, top_k rows at most.

_TOKEN = re.compile(text.TOKEN_PATTERN)


def count_tokens(s: str) -> int:
    return len(_TOKEN.findall(s))


@dataclass(frozen=True)
class Line:
    unit_id: str
    text: str
    raw: str | None
    ts: datetime | None
    rank: int
    score: float

    def label(self, pattern: str) -> str:
        if self.ts is not None:
            return self.ts.strftime(pattern)
        return (self.raw or "").strip() or "unknown"


def _ordered(lines: list[Line], by_time: bool) -> list[Line]:
    if by_time:
        return sorted(lines, key=lambda x: (x.ts is None, x.ts or datetime.min, x.rank, x.unit_id))
    return sorted(lines, key=lambda x: (x.rank, x.unit_id))


def _groups(lines: list[Line], pattern: str, by_time: bool) -> list[tuple[str | None, list[Line]]]:
    """Lines by a label of their time, in order of each group's first line; unread times last
    when by time, else where their best rank puts them."""
    held: dict[str | None, list[Line]] = {}
    for x in _ordered(lines, by_time):
        held.setdefault(x.ts.strftime(pattern) if x.ts else None, []).append(x)
    return list(held.items())


def render_flat(lines: list[Line], timestamps: bool, by_time: bool) -> str:
    return "\n".join(f"- {x.label('%Y-%m-%d')}: {x.text}" if timestamps else f"- {x.text}" for x in _ordered(lines, by_time))


def render_grouped(lines: list[Line], depth: int, by_time: bool, min_group: int) -> str:
    """depth 1: years; 2: months; 3: days, with a heading of their own from min_group lines on."""
    out: list[str] = []
    for year, of_year in _groups(lines, "%Y", by_time):
        if year is None:
            out += ["# Unknown", *(f"- {x.text}" for x in of_year)]
            continue
        out.append(f"# {year}")
        if depth == 1:
            out += [f"- {x.label('%m-%d')}: {x.text}" for x in of_year]
            continue
        for month, of_month in _groups(of_year, "%m", by_time):
            out.append(f"## {month}")
            if depth == 2:
                out += [f"- {x.label('%d')}: {x.text}" for x in of_month]
                continue
            for day, of_day in _groups(of_month, "%d", by_time):
                if len(of_day) >= min_group:
                    out += [f"### {day}", *(f"- {x.text}" for x in of_day)]
                else:
                    out += [f"- {day}: {x.text}" for x in of_day]
    return "\n".join(out)


def best_rendering(lines: list[Line], timestamps: bool, by_time: bool, min_group: int, count: Callable[[str], int] = count_tokens) -> tuple[int, str]:
    """Fewest tokens; of equals, the deepest."""
    made = [(render_flat(lines, timestamps, by_time), 0)]
    if timestamps and sum(x.ts is not None for x in lines) >= max(1, min_group):
        made += [(render_grouped(lines, d, by_time, min_group), d) for d in (1, 2, 3)]
    n, _, s = min((count(s), -d, s) for s, d in made)
    return n, s


def adaptive(lines: list[Line], budget: int, timestamps: bool = True, by_time: bool = False, min_group: int = 2, count: Callable[[str], int] = count_tokens) -> tuple[str, int, int, int]:
    """The best rendering that fits; while none does, the line of least use for its tokens goes."""
    left = [x for x in lines if x.text.strip()]
    worth = lambda x: ((1 / max(1, x.rank) + max(0.0, x.score)) / max(1, count(x.text)), -x.rank, x.unit_id)
    drop = sorted(left, key=worth)
    while left:
        n, s = best_rendering(left, timestamps, by_time, min_group, count)
        if n <= budget:
            return s, n, len(left), len({x.raw for x in left if (x.raw or "").strip() and x.raw.strip().lower() != "unknown"})
        gone = drop.pop(0)
        left = [x for x in left if x is not gone]
    return "", 0, 0, 0


def merged(lines: list[Line], budget: int, timestamps: bool = True, by_time: bool = False, joiner: str = "\n\n", count: Callable[[str], int] = count_tokens) -> tuple[str, int, int, int]:
    """Blocks of lines with the same raw time, joined by a bar; ends before the first line with
    which the whole no longer fits."""
    best = ("", 0, 0, 0)
    for k in range(1, len(lines) + 1):
        held: dict[str, list[str]] = {}
        for x in _ordered(sorted(lines, key=lambda x: x.rank)[:k], by_time):
            held.setdefault((x.raw or "").strip() or "unknown", []).append(x.text)
        blocks = [f"[{raw}] {' | '.join(ts)}" if timestamps else " | ".join(ts) for raw, ts in held.items()]
        s = joiner.join(blocks)
        if (n := count(s)) > budget:
            break
        best = (s, n, len(blocks), len(held))
    return best


def prefix(lines: list[Line], budget: int, timestamps: bool = True, by_time: bool = False, joiner: str = "\n\n", style: str = "stamped", count: Callable[[str], int] = count_tokens) -> tuple[str, int, int, int]:
    """As pack_lines(), for a count of tokens that need not add up: blocks by rank as long as the
    whole text fits."""
    taken: list[Line] = []
    best = ("", 0, 0, 0)
    for x in sorted(lines, key=lambda x: x.rank):
        taken.append(x)
        order = _ordered(taken, True) if by_time else taken
        if style == "list":
            blocks = [f"- {y.raw}: {y.text}" if timestamps and y.raw else f"- {y.text}" for y in order]
        else:
            blocks = [f"[{(y.raw or '').strip() or 'unknown'}] {y.text}" if timestamps else y.text for y in order]
        s = joiner.join(blocks)
        if (n := count(s)) > budget:
            break
        best = (s, n, len(blocks), len({(y.raw or "").strip() or "unknown" for y in taken}))
    return best


def pack_each(questions: DataFrame, ranked: DataFrame, render: Callable[..., tuple[str, int, int, int]], budget: int | None = None, **options) -> DataFrame:
    """Contexts by adaptive() or merged()."""
    from .retrieve import effective

    most = effective(budget, BUDGET)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lines = [Line(r.unit_id, r.text, r.ts_raw, r.ts.to_pydatetime() if pd.notna(r.ts) else None, int(r.rank), float(r.score)) for r in rows.itertuples()]
        return pd.DataFrame([(key[0], *render(sorted(lines, key=lambda x: x.rank), most, **options))], columns=["question_id", *EMPTY])

    kind = ranked.schema["question_id"].dataType.simpleString()
    rows = ranked.select("question_id", "unit_id", F.coalesce("text", F.lit("")).alias("text"), "ts_raw", times.parse("ts_raw").alias("ts"), "rank", "score")
    return _whole(questions, rows.groupBy("question_id").applyInPandas(run, SCHEMA.format(kind=kind)))


def null_context(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", *(F.lit(v).cast("string" if isinstance(v, str) else "long").alias(k) for k, v in EMPTY.items()))


