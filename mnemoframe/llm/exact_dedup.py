"""Exact dedup by a heavy-hitter split.

Texts are equal when they are identical after all white space is deleted; a null text counts as
empty. Of equal texts, the row with the most code points stays, then the smallest doc_id (null
last); of rows that still tie (the same doc_id), exactly one stays.

1. A Misra-Gries pass over the digests (Spark's freqItems, a partial aggregate with at most
   1/support counters a task) names every digest that more than support * rows rows have. A
   digest that is there once is never heavy, however few the rows.
2. An exact count verifies them. Fewer than 1/support digests can pass, so that the winners are
   broadcast safely, and rows of those digests are settled map-side.
3. All other digests go through one ordinary shuffle. No group there exceeds support * rows rows,
   or one row.

A very long text is digested whole, in the task that reads it. Empty tables give empty results. Further columns, whatever their names, pass through
``deduplicate`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TMP, WS_RUN, materialize, text_or_empty

SUPPORT = 1 / 2000


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space, in UTF-8, as lowercase hex."""
    return F.sha2(F.regexp_replace(text, WS_RUN, "").cast("binary"), 256)


def _order() -> Column:
    return F.struct((-F.col(f"{TMP}len")).alias("l"), F.col(f"{TMP}id").isNull().alias("n"), F.col(f"{TMP}id").alias("i"), F.col(f"{TMP}row").alias("r"))


def heavy_winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(sha, best, size) of every digest that more than support * rows rows have, and two at least:
    fewer than 1/support digests. digests: the columns sha, len, id and row, each with the prefix of TMP."""
    sha, key = f"{TMP}sha", f"{TMP}key"
    rows = digests.count()
    keyed = digests.withColumn(key, F.xxhash64(sha))
    named = keyed.stat.freqItems([key], support).select(F.explode(f"{key}_freqItems").alias(key))
    counted = keyed.join(F.broadcast(named), key, "left_semi").groupBy(sha).agg(F.count("*").alias(f"{TMP}size"), F.min(_order()).alias(f"{TMP}best"))
    return materialize(counted.where(F.col(f"{TMP}size") > max(1.0, support * rows)), "heavy")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    text = text_or_empty(text_col)
    digests = materialize(
        docs.select(F.col(id_col).alias(f"{TMP}id"), F.length(text).alias(f"{TMP}len"), text_digest(text).alias(f"{TMP}sha"), F.monotonically_increasing_id().alias(f"{TMP}row")),
        "digests",
    )
    sha = f"{TMP}sha"
    heavy = F.broadcast(heavy_winners(digests, support))
    settled = digests.join(heavy, sha).select(
        F.col(f"{TMP}id").alias("doc_id"),
        F.col(f"{TMP}best.i").alias("keep_id"),
        F.col(f"{TMP}size").alias("group_size"),
        (F.col(f"{TMP}row") == F.col(f"{TMP}best.r")).alias("kept"),
        F.col(sha).alias("text_sha256"),
    )
    group = Window.partitionBy(sha)
    best_first = group.orderBy(F.desc(f"{TMP}len"), F.asc_nulls_last(f"{TMP}id"), f"{TMP}row")
    shuffled = digests.join(heavy, sha, "left_anti").select(
        F.col(f"{TMP}id").alias("doc_id"),
        F.first(f"{TMP}id").over(best_first).alias("keep_id"),
        F.count("*").over(group).alias("group_size"),
        (F.row_number().over(best_first) == 1).alias("kept"),
        F.col(sha).alias("text_sha256"),
    )
    return settled.unionByName(shuffled)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows of heavy digests that aren't the
    best of their group are dropped map-side, before the only shuffle that carries whole rows."""
    text = text_or_empty(text_col)
    sha, n, i, row = (f"{TMP}{x}" for x in ("sha", "len", "id", "row"))
    keyed = docs.withColumns({sha: text_digest(text), n: F.length(text), i: F.col(id_col)})
    heavy = heavy_winners(materialize(keyed.select(sha, n, i, F.lit(0).alias(row)), "digests"), support)
    best = F.broadcast(heavy.select(sha, F.col(f"{TMP}best.l").alias(f"{TMP}l"), F.col(f"{TMP}best.i").alias(f"{TMP}i")))
    lost = F.col(f"{TMP}l").isNotNull() & ~((F.col(f"{TMP}l") == -F.col(n)) & F.col(f"{TMP}i").eqNullSafe(F.col(i)))
    best_first = Window.partitionBy(sha).orderBy(F.desc(n), F.asc_nulls_last(i), F.col(text_col))
    left = keyed.join(best, sha, "left").where(~lost).withColumn(row, F.row_number().over(best_first)).where(F.col(row) == 1)
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
