"""Substring dedup by sliding sentence spans.

A text is cut into sentences after . ! or ? before white space and at line ends. Every run of RUN
consecutive sentences, or of as many more as MIN_WORDS words take, is hashed (64 bits, over its
words, so that white space doesn't matter). Runs are joined over all documents; of runs that are
equal, the first by (doc_id, place) stays, and each sentence that any other one covers is removed,
with the white space after it. Sentences are kept or removed whole: where a repeat begins or ends
inside a sentence, that sentence stays. Short lines that many texts share, which no run of
MIN_WORDS words lies in, stay as well.

Rows of the same doc_id and text are one document and are treated alike; other ties can't be. A
null doc_id comes last; a null text is empty. Texts without a run stay as they are. A very long
text is cut like any other, whole, in one task; its runs are rows of their own. Other columns of
the input, whatever their names, play no part. Empty tables give empty results.

Only hashes are shuffled to find what repeats. Hashes of more than HOT occurrences are so few that
they are broadcast, and their occurrences are settled where they are read; the others meet their
first places in a join whose largest group is bounded by HOT. Whole texts are shuffled once, by
document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TMP, materialize, text_or_empty

RUN = 2
MIN_WORDS = 20
#: Most hashes that are broadcast; HOT, the occurrences beyond which one is, grows with the input.
MAX_HOT = 20_000
LEAST_HOT = 1000

_END = re.compile(r"(?:(?<=[.!?])[\x20\x09\x0B-\x0D]+|[\x20\x09\x0B-\x0D]*\n)[\x20\x09-\x0D]*")


def sentences(text: str) -> tuple[list[int], list[bytes], list[int]]:
    """Where each sentence ends (white space after it counted), its words, and how many they are.
    White space at the start belongs to the first sentence."""
    ends: list[int] = []
    bodies: list[bytes] = []
    counts: list[int] = []
    start = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if words := text[start:end].encode().split():
            ends.append(end)
            bodies.append(b" ".join(words))
            counts.append(len(words))
            start = end
        elif end > start and ends:
            ends[-1] = start = end  # at the start of the text, it goes with what follows
    return ends, bodies, counts


def run_ends(counts: list[int], run: int = RUN, min_words: int = MIN_WORDS) -> np.ndarray:
    """For each sentence that a run begins with, the sentence after the run."""
    before = np.r_[0, np.cumsum(np.array(counts, np.int64))]
    start = np.arange(len(counts))
    end = np.maximum(start + run, np.searchsorted(before, before[:-1] + min_words))
    return end[end <= len(counts)]  # ends never fall, so that the last starts are without


def run_hashes(bodies: list[bytes], counts: list[int], run: int = RUN, min_words: int = MIN_WORDS) -> np.ndarray:
    """Hash of each run, by its first sentence: a polynomial over the sentences' hashes."""
    import xxhash

    end = run_ends(counts, run, min_words)
    if not len(end):
        return np.empty(0, np.int64)
    base, mask, prefix, power = 0x9E3779B97F4A7C15, 0xFFFFFFFFFFFFFFFF, [0], [1]
    for h in map(xxhash.xxh3_64_intdigest, bodies):
        prefix.append((prefix[-1] * base + h) & mask)
        power.append(power[-1] * base & mask)
    p, w = np.array(prefix, np.uint64), np.array(power, np.uint64)
    start = np.arange(len(end))
    with np.errstate(over="ignore"):
        out = (p[end] - p[start] * w[end - start]) ^ (end - start).astype(np.uint64)
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return out.view(np.int64)


def occurrences(docs: DataFrame, id_col: str, text_col: str, run: int, min_words: int) -> DataFrame:
    """(h, id, key, at) of each run; key: hash of the whole text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                rows, hs, ats = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for i, text in enumerate(batch.column("text").to_pylist()):
                    _, bodies, counts = sentences(text)
                    h = run_hashes(bodies, counts, run, min_words)
                    rows.append(np.full(len(h), i))
                    hs.append(h)
                    ats.append(np.arange(len(h)))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), batch.column("id").take(take), batch.column("key").take(take), pa.array(np.concatenate(ats).astype(np.int32))], ["h", "id", "key", "at"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return materialize(rows.mapInArrow(hashed, f"h long, id {rows.schema['id'].dataType.simpleString()}, key long, at int"), "runs")


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, run: int, min_words: int) -> DataFrame:
    """(id, key, starts): the first sentences of the runs of a document that aren't the first of
    their kind, sorted."""
    runs = occurrences(docs, id_col, text_col, run, min_words)
    twice = materialize(runs.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "repeated")
    n = twice.agg(F.sum("c")).first()[0] or 0
    hot = F.broadcast(twice.where(F.col("c") > max(LEAST_HOT, n // MAX_HOT)).select("h"))  # at most MAX_HOT rows
    cold = twice.join(hot, "h", "left_anti").select("h").hint("merge")
    place = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("key"), F.col("at"))

    def later(found: DataFrame, of_hash) -> DataFrame:
        first = found.groupBy("h").agg(F.min(place).alias("first"))
        return found.join(of_hash(first), "h").where(~F.col("first").eqNullSafe(place)).select("id", "key", "at")

    often, seldom = runs.join(hot, "h", "left_semi"), materialize(runs.join(cold, "h", "left_semi"), "found")
    every = later(often, F.broadcast).unionByName(later(seldom, lambda first: first))
    return every.groupBy("id", "key").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, text without what is removed, n_sentences, n_removed,
    removed (spans of the old text, in code points, in order, apart from each other)."""
    starts = repeated_runs(docs, id_col, text_col, run, min_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                texts, n, gone, spans = [], [], [], []
                for text, marks in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                    ends, _, counts = sentences(text)
                    last = run_ends(counts, run, min_words) if marks else ()
                    drop = sorted({k for i in marks or () for k in range(i, last[i])})
                    cuts: list[list[int]] = []
                    for i in drop:
                        a, b = ends[i - 1] if i else 0, ends[i]
                        if cuts and cuts[-1][1] == a:
                            cuts[-1][1] = b
                        else:
                            cuts.append([a, b])
                    at, kept = 0, []
                    for a, b in cuts:
                        kept.append(text[at:a])
                        at = b
                    texts.append("".join([*kept, text[at:]]))
                    n.append(len(ends))
                    gone.append(len(drop))
                    spans.append([{"start": a, "end": b} for a, b in cuts])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind)], ["doc_id", "text", "n_sentences", "n_removed", "removed"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias(f"{TMP}key"), text.alias("text"))
    joined = rows.join(starts, (F.col(f"{TMP}key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "starts")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, text string, n_sentences long, n_removed long, removed array<struct<start: long, end: long>>")
