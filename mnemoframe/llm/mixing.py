"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources, by code point with null last, weigh 1, 2, 3, 1, 2, 3 and so on, and share all words by
weight; a target stops at MAX_REPEATS times its source's words, and the excess is shared again by
weight among the others, which water-filling over the sources sorted by cap / weight solves at
once. The words are cut into equal blocks of BLOCK_WORDS. Blocks go to sources by the highest
quotients target / (2k + 1), then, in the same way, to the shards of each source by their words:
integer quotas for each shard. A shard's documents lie in an order seeded by a hash of doc_id, and
its quota of blocks is taken from the front of that order, all of it again as often as the quota
holds it whole: with the order being random, so is the choice. A block may end inside a document.

A null text has no words. Null doc_ids share one place in the order; ties in it go by size and row.
A very long text is one document, which a block may end inside. Other columns of the input,
whatever their names, play no part, and pass through ``mix`` untouched. A source with few words may
get no block; a source's taken words differ from its target by about a block. No document is
taken more than MAX_REPEATS times. Empty tables give empty results. Only DataFrame functions are
used. The quotients that are ranked are those near the result (about two a source), never one row
for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TMP, broadcast_if_small, materialize, n_words, text_or_empty

BLOCK_WORDS = 32
MAX_REPEATS = 3
SEED = 17
#: Rows of a source that one shard should hold; shards follow from it.
ROWS_A_SHARD = 20_000
#: Sources or shards up to which their table is broadcast; above, joins shuffle.
MAX_BROADCAST = 100_000


def sainte_lague(df: DataFrame, group: list[str], key: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Adds out: the seats that each row gets of its group's seats. Ties go by key.

    With S rows, M seats and total weight W, no row ends below round(w * (M - S) / W) or above
    round(w * (M + S) / W) seats, as the divisors W / (M - S) and W / (M + S) give too few and
    too many seats in all. Only quotients between the two are ranked."""
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    s, total = F.count("*").over(g), F.sum(weight).over(g)
    share = F.when(total > 0, F.col(weight) / total).otherwise(F.lit(0.0))
    low, high, rest, k, rank = (f"{TMP}{x}" for x in ("low", "high", "rest", "k", "rank"))
    bound = df.withColumns({low: F.floor(F.greatest(F.lit(0), share * (F.col(seats) - s)) + 0.5).cast("long"), high: (F.floor(share * (F.col(seats) + s) + 0.5) + 1).cast("long")})
    bound = bound.withColumn(rest, F.when(total > 0, F.col(seats)).otherwise(F.lit(0)) - F.sum(low).over(g))
    by_quotient = g.orderBy(F.desc(F.col(weight) / (2 * F.col(k) + 1)), *(F.asc_nulls_last(c) for c in key))
    ranked = bound.withColumn(k, F.explode(F.sequence(low, high))).withColumn(rank, F.row_number().over(by_quotient))
    same = Window.partitionBy(*group, *key)
    won = ranked.withColumn(out, F.sum((F.col(rank) <= F.col(rest)).cast("long")).over(same) + F.col(low)).where(F.col(k) == F.col(low))
    return won.drop(low, high, rest, k, rank)


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sources: (source, source_size, source_rows). Adds weight and target (double)."""
    every = Window.partitionBy(F.lit(0))
    weighed = sources.withColumn("weight", ((F.row_number().over(every.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1).cast("double"))
    cap, level = F.col("source_size") * max_repeats, f"{TMP}level"
    fill = every.orderBy(cap / F.col("weight"), F.asc_nulls_last("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = weighed.withColumn(level, left / weight_left)
    open_level = F.min(F.when(cap > F.col("weight") * F.col(level), F.struct((cap / F.col("weight")).alias("o"), F.col(level).alias("l")))).over(every)["l"]
    level_all = F.coalesce(open_level, F.max(F.col(level)).over(every))
    return filled.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level_all)).drop(level)


def sized(docs: DataFrame, keep: list[Column], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """keep, then source, size in words and the key of the seeded order."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return docs.select(*keep, F.col(source_col).cast("string").alias("source"), n_words(text_or_empty(text_col)).alias("size"), key.alias(f"{TMP}key"))


def _shard(rows_col: str) -> Column:
    n = F.ceil(F.col(rows_col) / ROWS_A_SHARD).cast("long")
    return F.conv(F.substring(f"{TMP}key", 1, 8), 16, 10).cast("long") % n


def quotas(rows: DataFrame, block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """Of sized rows, a table of sources with targets, and one of shards (source, shard, whole,
    part): the times that a shard is taken whole, and the words taken once more from its front."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    aimed = targets(sums, max_repeats)
    every = Window.partitionBy(F.lit(0))
    blocks = F.round(F.sum("source_size").over(every) / block_words).cast("long")
    given = sainte_lague(aimed.withColumn("blocks", blocks), [], ["source"], "target", "blocks", "quota")
    sources = broadcast_if_small(given.select("source", "source_size", "source_rows", "weight", "target", "quota"), "sources", MAX_BROADCAST)
    parts = _with(rows, sources, ["source"], ["source_rows", "quota"]).withColumn("shard", _shard("source_rows"))
    shards = parts.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    shared = sainte_lague(shards, ["source"], ["shard"], "shard_size", "quota", "shard_quota")
    take = F.least(F.col("shard_quota") * block_words, F.col("shard_size") * max_repeats)
    whole = F.when(F.col("shard_size") > 0, F.floor(take / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    cut = shared.select("source", "shard", "shard_quota", whole.alias("whole"), (take - whole * F.col("shard_size")).alias("part"))
    return sources, broadcast_if_small(cut, "shards", MAX_BROADCAST)


def _with(rows: DataFrame, other: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """rows with columns of other, joined null-safely."""
    named = other.select(*(F.col(c).alias(f"{TMP}j_{c}") for c in keys), *wanted)
    on = [F.coalesce(F.col(c).cast("string"), F.lit("")).eqNullSafe(F.coalesce(F.col(f"{TMP}j_{c}").cast("string"), F.lit(""))) & F.col(c).isNull().eqNullSafe(F.col(f"{TMP}j_{c}").isNull()) for c in keys]
    return rows.join(named, [*on], "left").drop(*(f"{TMP}j_{c}" for c in keys))


def chosen(rows: DataFrame, sources: DataFrame, shards: DataFrame, ties: list[str]) -> DataFrame:
    """rows with source_size, target, whole, and again: the words of the document that are taken
    once more. ties: columns that order rows of one key."""
    placed = _with(rows, sources, ["source"], ["source_size", "source_rows", "target"]).withColumn("shard", _shard("source_rows"))
    placed = _with(placed, shards, ["source", "shard"], ["shard_quota", "whole", "part"])
    order = Window.partitionBy("source", "shard").orderBy(f"{TMP}key", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum("size").over(order) - F.col("size")
    return placed.withColumn("again", F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - start)))


def decisions(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, source, shard,
    shard_quota."""
    rows = materialize(sized(docs, [F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias(f"{TMP}row")], id_col, source_col, text_col), "sized")
    sources, shards = quotas(rows)
    got = chosen(rows, sources, shards, ["size", f"{TMP}row"])
    return got.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("again")).alias("taken"), "source", "shard", "shard_quota")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is taken
    whole, and one with its first words, white space kept, where a block ends inside it. A column
    n_chars gets the length of such a cut text."""
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias(f"{TMP}0"), F.col(id_col).alias(f"{TMP}id"), F.col(source_col).alias(f"{TMP}src"), F.col(text_col).alias(f"{TMP}text"))
    every = sized(rows, [F.col(f"{TMP}0"), F.col(f"{TMP}id"), F.crc32(text_or_empty(f"{TMP}text").cast("binary")).alias(f"{TMP}crc")], f"{TMP}id", f"{TMP}src", f"{TMP}text")
    # The full rows' sums must come from the same columns, without carrying the texts.
    sources, shards = quotas(materialize(every.select("source", "size", f"{TMP}key"), "sized"))
    got = chosen(every, sources, shards, ["size", f"{TMP}crc"])
    text = F.col(f"{TMP}0.`{text_col}`")
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.substring(text, 1, 1).rlike(r"[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.array_join(F.slice(pieces, F.lit(1), (F.col("again") + lead).cast("int")), "")
    partial = (F.col("again") > 0) & (F.col("again") < F.col("size"))
    times = F.col("whole") + (F.col("again") > 0).cast("long")
    n = F.col(f"{TMP}n")
    out = got.where(times > 0).withColumn(f"{TMP}n", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    last = partial & (n == times)

    def column(c: str) -> Column:
        was = F.col(f"{TMP}0.`{c}`")
        if c == text_col:
            return F.when(last, cut).otherwise(was).alias(c)
        if c == "n_chars":
            return F.when(last, F.length(cut).cast(docs.schema[c].dataType)).otherwise(was).alias(c)
        return was.alias(c)

    return out.select(*(column(c) for c in names))
