"""Grouping of spelling variants: words that one edit makes of each other.

Words are runs of letters with capitals of ASCII lowered; one in MISPRINTS loses a letter, by a
hash of the document and the word, as planted misprints. Words of MIN_LENGTH letters and MIN_COUNT
occurrences over all texts are compared:

1. Bigrams are ordered by the words that hold them, rare first. One edit breaks two bigrams at most
   and moves others by one place at most, so of a word's three rarest (and of what ties with the
   third by being the same bigram again) one is whole in every near word, at that place or the
   next, and is among that word's own: if the third of one word comes first in the order, all up to
   it are among the other's.
2. Words are joined on those bigrams. The edit is on one side of a shared bigram, so the other side
   is equal, which fixes the place, and of the side with the edit its first or last half is equal:
   the join's key holds the bigram with the equal side and the equal half, for the length of the
   shorter word.
3. Pairs that meet are verified by their edit distance.

A word's form is its near word of most occurrences, if those are FORM_RATIO times its own; roots
follow forms, whose counts grow tenfold each time, by doubling pointers.

A null or empty text has no words; a null doc_id is hashed as an empty string. Repeated rows count
each. A very long text is read whole. Words that tie are ordered by code point. Other columns of the
input, whatever their names, play no part. Empty tables give empty results. The ranks of bigrams
are broadcast: there are 90 letters, so 8,100 of them at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, text_or_empty

# Fixed value: what a run of letters is.
LETTERS = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MISPRINTS = 31
MIN_LENGTH = 7
MIN_COUNT = 2
FORM_RATIO = 10
#: Bigrams that one edit breaks at most, and one more.
RAREST = 3


def misprinted(doc_id: Column, run: Column, every: int = MISPRINTS) -> Column:
    """The run, without one letter where its hash with the document says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))

    def cut(x: Column) -> Column:
        at = (x % F.length(run)).cast("int")
        return F.when(x % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    return let(h, cut)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are compared."""
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.translate(text_or_empty(text_col), _UPPER, _LOWER), F.lit(LETTERS), 0)).alias("run"))
    # A run only loses letters, so that a shorter one can't be a word.
    said = runs.where(F.length("run") >= min_length).select(misprinted(F.col("doc_id"), F.col("run")).alias("word"))
    return said.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """Place of each bigram by the occurrences in distinct words, rare first, ties by code point."""
    at = F.sequence(F.lit(1), F.length("word") - 1)
    found = words.select(F.explode(F.transform(at, lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    return {r.g: i for i, r in enumerate(sorted(found.collect(), key=lambda r: (r.n, r.g)))}


def rarest(word: str, ranks: dict[str, int], most: int = RAREST) -> list[int]:
    """Places of the word's rarest bigrams, with all places of the last of them."""
    order = sorted((ranks[word[i : i + 2]], i) for i in range(len(word) - 1))
    last = order[min(most, len(order)) - 1][0] if order else -1
    return [i for r, i in order if r <= last]


def keys(word: str, ranks: dict[str, int]) -> list[tuple[str, bool]]:
    """(key, own) of a word: what a near word of the same length, or one letter longer or shorter,
    has in common with it around a shared bigram. own: of keys for words of this length, in which
    the other word is as long, or longer; the rest are for this word as the longer one."""
    out = set()
    for i in rarest(word, ranks):
        for side, equal, edited in (("<", word[: i + 2], word[i + 2 :]), (">", word[i:], word[:i])):
            for shorter in {len(edited), len(edited) - 1} - {-1}:
                half, own = shorter // 2, shorter == len(edited)
                out.add((f"{side}{shorter}[{edited[:half]} {equal}", own))
                out.add((f"{side}{shorter}]{edited[len(edited) - half :]} {equal}", own))
    return sorted(out)


def candidates(words: DataFrame) -> DataFrame:
    """(key, own, word, n): words to be joined on key."""
    held = words.sparkSession.sparkContext.broadcast(bigram_ranks(words))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                key, own, row = [], [], []
                for k, w in enumerate(part.column("word").to_pylist()):
                    for text, mine in keys(w, ranks):
                        key.append(xxhash.xxh3_64_intdigest(text) - (1 << 63))
                        own.append(mine)
                        row.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(own, pa.bool_()), *(part.column(c).take(pa.array(row, pa.int32())) for c in ("word", "n"))], ["key", "own", "word", "n"])

    return words.mapInArrow(place, "key long, own boolean, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of near words once, the shorter or lesser as a."""
    rows = materialize(candidates(words), "keys")
    left = rows.where("own").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = rows.select("key", "own", F.col("word").alias("b"), F.col("n").alias("b_n"))
    # Keys may collide; the distance decides.
    once = F.when(F.col("own"), (F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))).otherwise(F.length("a") < F.length("b"))
    return left.join(right, "key").where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """forms: (word, form). (word, root): where following forms ends. Each round doubles the steps
    that a pointer makes; a chain has 19 steps at most, as counts are tenfold each time."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word."""
    words = materialize(vocabulary(docs, id_col, text_col, min_length, min_count), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(*(F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in ("ab", "ba")))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    counts = F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best"))
    near = materialize(near.select("word", "n_near", counts["form"].alias("form"), (-counts["m"]).alias("form_n")), "near")
    ends = roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
