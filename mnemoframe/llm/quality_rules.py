"""Quality rules with risk-controlled thresholds.

Each rule is a score of the text, higher for worse, with a fixed grid of cutoffs from lenient to
strict. Labelled good documents serve as the holdout: nothing else is learnt from them. In each
stratum (the language) and for each rule, cutoffs are tested in the order of the grid; a cutoff
passes if the exact binomial tail P(Bin(n, a) <= k) is at most d / m, where k of n good holdout
documents score above it, a is the rule's share of the allowed false rejection, and m is the
number of strata times rules (Bonferroni; along the grid, fixed-sequence testing needs no more
correction). The strictest cutoff before the first that fails is used; without one, the rule
never rejects in that stratum. With probability 1 - d, then, no stratum loses more than
MAX_FALSE_REJECTION of its good documents to the learnt rules.

A null text has no words, a null stratum is one of its own, null labels are no labels, a document
labelled more than once counts as good only if all its labels say so. Rows that repeat or tie are
measured and judged each, and count each in the holdout. A very long text is measured whole, in the
task that reads it. Other columns of the input, whatever their names, play no part, and pass
through ``keep_good`` untouched. Empty tables give empty
results; without labels only the base rule rejects. Only DataFrame functions are used; all counts
are taken within a row, so that no word is ever shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TMP, WS_RUN, let, materialize, text_or_empty, words

MAX_FALSE_REJECTION = 0.08
CONFIDENCE_MISS = 0.05
#: Labelled ids that are broadcast, at most, by count.
MAX_BROADCAST = 500_000
#: Rule, and its cutoffs from lenient to strict; a text is rejected when its score is above.
GRID = {
    "symbols": (0.5, 0.3, 0.2, 0.1, 0.05, 0.03),
    "dup_lines": (0.9, 0.7, 0.5, 0.4, 0.35),
    "repeats": (0.18, 0.15, 0.12, 0.1, 0.08),  # the base rule rejects above 0.2
    "capitals": (0.8, 0.6, 0.5, 0.4, 0.35),
}
WINDOW = 5


def repeated_words(w: Column, size: int = WINDOW) -> Column:
    """How many of the words w lie in a window of size words that is found twice or more in w.
    Windows are compared by 64-bit hash, counted by sorting; their union is measured on the
    sorted starts."""

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(by_hash, lambda s: let(F.sort_array(F.transform(F.filter(s, lambda x, k: _twin(s, k - 1, x) | _twin(s, k + 1, x)), lambda x: x["i"])), union))

    def _twin(s: Column, k: Column, x: Column) -> Column:
        return F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))

    def union(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda a, p: F.struct((a["n"] + p + size - F.greatest(a["end"], p)).alias("n"), (p + size).alias("end")), lambda a: a["n"])

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))
    return F.when(F.size(w) <= size, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def features(text: Column) -> dict[str, Column]:
    """Counts of the whole text, which must not be null."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    per_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    per_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return {
        f"{TMP}w": per_words,
        f"{TMP}l": per_lines,
        "word_chars": F.length(F.regexp_replace(text, WS_RUN, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
    }


def measured(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """keep, then n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_capitals (long) and base_failed."""
    got = docs.select(*keep, text_or_empty(text_col).alias(f"{TMP}text"))
    names = got.columns[:-1]
    got = got.withColumns(features(F.col(f"{TMP}text")))
    w, x = F.col(f"{TMP}w"), F.col(f"{TMP}l")
    got = got.select(
        *(F.col(f"`{c}`") for c in names),
        w["n"].cast("long").alias("n_words"), "word_chars", "n_symbols", x["n"].cast("long").alias("n_lines"),
        x["d"].cast("long").alias("n_dup_lines"), w["r"].cast("long").alias("n_repeat_words"), "n_capitals",
    )
    return got.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def scores() -> dict[str, Column]:
    """Score of each rule, from the columns of measured()."""

    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars")}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly summed in logarithms; 1 where k > p * n, which no test passes."""
    step, first = math.log(p) - math.log1p(-p), n * math.log1p(-p)

    def add(a: Column, j: Column) -> Column:
        term = a["t"] + F.log((n - j + 1) / j) + step
        top, low = F.greatest(a["s"], term), F.least(a["s"], term)
        return F.struct(term.alias("t"), (top + F.log1p(F.exp(low - top))).alias("s"))

    zero = F.struct(first.cast("double").alias("t"), first.cast("double").alias("s"))
    whole = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), zero, add, lambda a: F.exp(a["s"]))
    return F.when(k > p * n, F.lit(1.0)).otherwise(whole)


def thresholds(measures: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "stratum", max_false_rejection: float = MAX_FALSE_REJECTION, miss: float = CONFIDENCE_MISS) -> DataFrame:
    """(stratum, one cutoff per rule or null). One row for each stratum with a labelled good
    document; sums over the holdout are all that is shuffled."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias(f"{TMP}good")).where(F.col(f"{TMP}good") == 1)
    held = measures.join(good.select(F.col("doc_id").alias(f"{TMP}label")), F.col(id_col) == F.col(f"{TMP}label"))
    rule_scores = scores()
    above = {f"{rule}_{g}": F.count_if(rule_scores[rule] > c) for rule, grid in GRID.items() for g, c in enumerate(grid)}
    counts = materialize(held.groupBy(stratum).agg(F.count("*").alias("n"), *(c.alias(name) for name, c in above.items())), "holdout")
    tests = counts.count() * len(GRID)
    level, share = miss / max(1, tests), max_false_rejection / len(GRID)

    def strictest(rule: str) -> Column:
        best = F.lit(None).cast("double")
        for g in reversed(range(len(GRID[rule]))):
            passed = binomial_tail(F.col(f"{rule}_{g}"), F.col("n"), share) <= level
            best = F.when(passed, F.coalesce(best, F.lit(GRID[rule][g])))
        return best

    return counts.select(stratum, *(strictest(rule).alias(f"cut_{rule}") for rule in GRID))


def _judged(measures: DataFrame, cuts: DataFrame) -> DataFrame:
    rule_scores = scores()
    bad = F.lit(False)
    for rule in GRID:
        bad = bad | F.coalesce(rule_scores[rule] > F.col(f"cut_{rule}"), F.lit(False))
    joined = measures.join(cuts.withColumnRenamed("stratum", f"{TMP}s"), F.col("stratum") == F.col(f"{TMP}s"), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad).drop(f"{TMP}s")


def decisions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row for each row of docs: doc_id, the counts, base_failed, stratum, the cutoffs that
    hold there, and kept."""
    measures = materialize(measured(docs, [F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum")], text_col), "measures")
    return _judged(measures, materialize(thresholds(measures, labels), "cutoffs"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns. The cutoffs come from a
    first pass over the labelled rows alone; whole rows are then judged where they are read. No
    text is shuffled: labels that are few by count travel to the texts."""
    names = docs.columns
    inner = F.coalesce(F.col(f"{TMP}0.{stratum_col}").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias(f"{TMP}0"))
    said = docs.select(id_col, text_col, stratum_col)
    good = materialize(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct(), "good")
    if good.count() <= MAX_BROADCAST:  # else all rows are measured, and counts alone meet the labels
        said = said.join(F.broadcast(good), id_col, "left_semi")
    held = measured(said, [F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum")], text_col)
    cuts = materialize(thresholds(held, labels), "cutoffs")
    judged = _judged(measured(rows.withColumn(f"{TMP}t", F.col(f"{TMP}0.{text_col}")), [F.col(f"{TMP}0"), inner.alias("stratum")], f"{TMP}t"), cuts)
    return judged.where("kept").select(*(F.col(f"{TMP}0.`{c}`").alias(c) for c in names))
