"""Resampling towards a target distribution by importance weights of hashed n-grams.

A document's features are its runs of 1 to MAX_N consecutive words, joined by a space and hashed
to BUCKETS buckets by their CRC-32. No run is ever written out: the CRC of each word is computed
once, and CRCs are linear over GF(2), so that the CRC of a run and one more word is the run's CRC
moved on by the word's bytes, plus that of a space and the word. Moving on by 2^k bytes is a
32 x 32 matrix over GF(2), kept as four tables of 256 values; any length is a product of those.

All documents and all target texts are counted by bucket; a bucket's gain is the floored
thousandfold logarithm of its smoothed share in the target over that in the documents. A
document's weight is the floored mean of its features' gains. With Gumbel noise from a hash of the
doc_id the highest scores are a weighted sample without replacement; among documents of MIN_WORDS
words the best DRAW_PERCENT of a hundred are drawn.

Ranks come from a range partitioning by score, whose partitions each number their own rows, so
that no task sees all of them. Only counts by bucket reach the driver.

A null or empty text has no words, no features, weight 0 and a score, and is never drawn. A null
doc_id is hashed as an empty string and loses ties. Rows that repeat are scored each, and rows that
tie wholly are ranked in any order. A very long text is read whole. Other columns of the input,
whatever their names, play no part. Without target texts the gains still are what the formula says.
An empty table of documents gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

MAX_N = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
DRAW_PERCENT = 10
#: CRC-32's polynomial, bits reversed.
POLYNOMIAL = 0xEDB88320
#: Distinct words whose CRCs a task remembers.
MAX_MEMO = 200_000

#: Bytes of words: digits, letters (capitals of ASCII lowered) and all beyond ASCII; else spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def _tables(columns: list[int]) -> np.ndarray:
    """A matrix over GF(2), given by what it makes of each bit, as tables of its action on bytes."""
    out = np.zeros((4, 256), np.uint32)
    for bit, column in enumerate(columns):
        byte, at = divmod(bit, 8)
        out[byte, np.arange(256) >> at & 1 == 1] ^= np.uint32(column)
    return out


def _act(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tables[0][v & 255] ^ tables[1][v >> 8 & 255] ^ tables[2][v >> 16 & 255] ^ tables[3][v >> 24]


class Moves:
    """CRCs moved on by any number of bytes; matrices are squared as lengths ask for them."""

    def __init__(self) -> None:
        columns = []
        for bit in range(32):
            v = 1 << bit
            for _ in range(8):
                v = v >> 1 ^ (POLYNOMIAL if v & 1 else 0)
            columns.append(v)
        self.powers = [_tables(columns)]

    def __call__(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = crc.copy()
        for k in range(int(by.max(initial=0)).bit_length()):
            if k == len(self.powers):
                one = self.powers[-1]
                self.powers.append(_tables([int(x) for x in _act(one, _act(one, np.uint32(1) << np.arange(32, dtype=np.uint32)))]))
            some = by >> k & 1 == 1
            out[some] = _act(self.powers[k], out[some])
        return out


class _Crcs(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MAX_MEMO:
            self.clear()
        got = self[word] = zlib.crc32(word)
        return got


class Features:
    """CRCs of all runs of up to max_n words of texts."""

    def __init__(self, max_n: int) -> None:
        self.max_n, self.crcs, self.move = max_n, _Crcs(), Moves()

    def __call__(self, texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(crcs of features, the text that each is of, words of each text)."""
        held = [t.translate(_WORD_BYTES).split() for t in texts]
        n_words = np.array([len(ws) for ws in held], np.int64)
        total, owner = int(n_words.sum()), np.repeat(np.arange(len(held)), n_words)
        crc = np.fromiter((self.crcs[w] for ws in held for w in ws), np.uint32, total)
        found, owners = [crc], [owner]
        if self.max_n > 1:
            length = np.fromiter((len(w) for ws in held for w in ws), np.int64, total)
            after = self.move(np.full(total, zlib.crc32(b" "), np.uint32), length) ^ crc  # of a space and the word
            run = crc
            for n in range(2, self.max_n + 1):
                run = self.move(run[: max(0, total - n + 1)], length[n - 1 :] + 1) ^ after[n - 1 :]
                whole = owner[n - 1 :] == owner[: len(run)]  # not from one text into the next
                found.append(run[whole])
                owners.append(owner[n - 1 :][whole])
        return np.concatenate(found), np.concatenate(owners), n_words


def _binary(batch: pa.RecordBatch, at: int, n: int) -> list[bytes]:
    return batch.column("text").slice(at, n).cast(pa.binary()).to_pylist()


#: Texts whose features are made together.
TEXTS = 256


def bucket_counts(texts: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket, over all texts; as many numbers as there are buckets reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(max_n), np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                crc, _, _ = features(_binary(batch, at, TEXTS))
                sums += np.bincount(crc % buckets, minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some], pa.int64())], ["bucket", "n"])

    got = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, floor(1000 ln) of the target's smoothed share over the source's."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, max_n: int = MAX_N) -> DataFrame:
    """doc_id, text to doc_id, n_words, n_features, weight."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, gain = Features(max_n), held.value.astype(np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                texts = _binary(batch, at, TEXTS)
                crc, owner, n_words = features(texts)
                n = np.bincount(owner, minlength=len(texts))
                sums = np.bincount(owner, gain[crc % buckets], len(texts)).astype(np.int64)  # whole numbers, so exact
                mean = np.where(n > 0, sums // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, TEXTS), *(pa.array(x, pa.int64()) for x in (n_words, n, mean))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(weigh, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """rows with their place from 1 in the order. Ranges of the order are partitions, which number
    their rows; what is before each is a sum over partitions. Stored, as the ranges are sampled."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(sorted_rows.withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranked")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").withColumn(name, F.col("start") + F.col("nth") + 1).drop("part", "nth", "start")


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = DRAW_PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs; rank is null where it isn't
    drawn. target: texts in a column text."""
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    gain = gains(bucket_counts(texts.select("text"), max_n, buckets), bucket_counts(target.select(text_or_empty("text").alias("text")), max_n, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights(texts, gain, max_n).withColumns({"score": F.col("weight") + noise, "row": F.monotonically_increasing_id()})
    rows = materialize(scored, "scored")
    may = ranked(rows.where(F.col("n_words") >= min_words), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    draw = rows.where(F.col("n_words") >= min_words).count() * percent // 100
    may = may.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return may.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that are drawn, all columns kept; rows that share a doc_id count as one
    choice, made if one of them is drawn."""
    ids = resample(docs, target, id_col=id_col, text_col=text_col, **how).where("rank is not null").select("doc_id").distinct()
    key = "__mf_drawn"
    return docs.join(ids.withColumnRenamed("doc_id", key), F.col(f"`{id_col}`").eqNullSafe(F.col(key)), "left_semi")
