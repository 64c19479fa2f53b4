"""Best-fit packing by exact-complement hashing.

Documents are tokenized, closed by an end token and, only where longer than a sequence, cut into
pieces: very long texts give many. The plan is made on counts by length, at most CAPACITY of them, whatever the number of
pieces: from the longest length down, the gap that a piece leaves is looked up among the lengths
that are still available, as one length, as a pair and as a triple; a combination that fills the
gap exactly is used as many times at once as the counts allow. Only where none does, the longest
length that fits goes in, and the rest of the gap is looked up again.

The plan is a list of (lengths of a sequence, times). Pieces are numbered within their length by
two-level counts, so that no task holds all pieces of a frequent length, and each number has its
place in the plan.

A null text is empty; an empty text is one end token; a null doc_id is a value like others, and
comes last of its length; rows that repeat or tie are packed each, in any order among themselves.
Other columns of the input, whatever their names, play no part. Empty tables give empty results.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TMP, materialize, text_or_empty

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers, twice: a full memory is kept as the older one, in which
#: words that come up again are found.
MAX_MEMO = 400_000
#: Pieces that are numbered together in one task.
PIECES_A_TASK = 50_000

#: Signs that the tokenizer parts from letters before them.
_SIGNS = b".,;:!?|*&%$#-()"
#: The tokenizer's letters for bytes: printable ones as they are, others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


class Memo:
    """Two generations of a bounded memory; young is the one to read and write."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.older: dict = {}

    def turn(self) -> None:
        if len(self.young) > MAX_MEMO:
            self.young, self.older = {}, self.young

    def missing(self, keys: set) -> list:
        """Those of keys that neither generation has; what the older has becomes young again."""
        out, young, old = [], self.young, self.older
        for k in keys.difference(young):
            if (found := old.get(k)) is None:
                out.append(k)
            else:
                young[k] = found
        return out


_tokenizer = None
#: The settings of a tokenizer that encoded() may take word by word.
_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def _path(tokenizer: str) -> str:
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def _parted(word: bytes) -> tuple[bytes, bytes] | None:
    """The lower-cased letters of a word, and the signs after them; None if it isn't letters of
    Latin-1 with such signs, for which nothing is assumed."""
    letters = word.rstrip(_SIGNS)
    if letters.isalpha():  # of ASCII
        return letters.lower(), word[len(letters) :]
    s = letters.decode()
    return (s.lower().encode(), word[len(letters) :]) if s.isalpha() and max(s) <= "\xff" else None


def encoded(texts: list[str], tokenizer: str = TOKENIZER) -> list[bytes]:
    """Ids of each text, without special tokens, as little-endian 32-bit numbers.

    The tokenizer drops white space and no token reaches across it, so that a text's ids are those
    of its words, one after the other. It also lower-cases, and parts letters from signs: letters
    go to its model directly, in its letters for bytes; other words go through all of it. Each
    word is put together from such parts once, each part encoded once. A tokenizer whose settings
    are others than _BY_WORDS encodes whole texts."""
    global _tokenizer
    if _tokenizer is None or _tokenizer[0] != tokenizer:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(_path(tokenizer))
        settings = json.loads(made.to_str())
        _tokenizer = (tokenizer, made, made.model, Memo(), Memo(), all(settings[k] == v for k, v in _BY_WORDS.items()))
    _, made, model, words, parts, by_words = _tokenizer
    if not by_words:
        return [np.array(e.ids, "<u4").tobytes() for e in made.encode_batch_fast(texts, add_special_tokens=False)]
    words.turn()
    parts.turn()
    split = [t.encode().split() for t in texts]
    new = {w: _parted(w) for w in words.missing(set().union(*split))}
    letters = parts.missing({pair[0] for pair in new.values() if pair})
    for p in letters:
        parts.young[p] = np.array([t.id for t in model.tokenize(p.decode("latin-1").translate(_LETTERS))], "<u4").tobytes()
    rest = parts.missing({pair[1] if pair else w for w, pair in new.items()})
    for p, e in zip(rest, made.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False), strict=True):
        parts.young[p] = np.array(e.ids, "<u4").tobytes()
    for w, pair in new.items():
        words.young[w] = parts.young[pair[0]] + parts.young[pair[1]] if pair else parts.young[w]
    ids = words.young.__getitem__
    return [b"".join(map(ids, ws)) for ws in split]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, and ids on request) of each piece."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, body in enumerate(encoded(batch.column("text").to_pylist(), tokenizer)):
                    body += end
                    for p in range(0, len(body), 4 * capacity):
                        part = body[p : p + 4 * capacity]
                        rows.append(i)
                        piece.append(p // (4 * capacity))
                        start.append(p // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        ids.append(part if with_ids else b"")
                made = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*made, pa.array(ids, pa.binary())] if with_ids else made, [*names, "ids"] if with_ids else names)

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """counts[n]: pieces of length n. Sequences as (lengths, times). Pieces that the sequence in
    hand holds are taken off the counts at once, so that every look-up sees all that is left."""
    left = np.array(counts, np.int64)
    left = np.r_[left, np.zeros(max(0, capacity + 1 - len(left)), np.int64)]
    out: list[tuple[tuple[int, ...], int]] = []

    def lengths(upto: int) -> np.ndarray:
        """Available lengths, longest first."""
        return np.flatnonzero(left[1 : upto + 1])[::-1] + 1

    def pair(gap: int, most: int) -> tuple[int, int] | None:
        a = lengths(min(gap - 1, most))
        a = a[2 * a >= gap]
        a = a[left[gap - a] > (2 * a == gap)]  # two of the same must both be there
        return (int(a[0]), gap - int(a[0])) if len(a) else None

    def complement(gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that add up to gap."""
        if left[gap]:
            return (gap,)
        if two := pair(gap, gap):
            return two
        for c in map(int, lengths(gap - 2)):
            if 3 * c < gap:
                break
            left[c] -= 1
            two = pair(gap - c, c)
            left[c] += 1
            if two:
                return (c, *two)
        return None

    for longest in range(capacity, 0, -1):
        while left[longest] > 0:
            held: list[int] = []
            more: tuple[int, ...] | None = (longest,)
            gap = capacity
            while more:
                for n in more:
                    left[n] -= 1
                    gap -= n
                held += more
                more = complement(gap) if gap else None
                if more is None and gap and len(fits := lengths(gap)):
                    more = (int(fits[0]),)
            times = 1 + min(int(left[n]) // held.count(n) for n in set(held))
            out.append((tuple(held), times))
            for n in held:
                left[n] -= times - 1
    return out


def places(sequences: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Sorted runs of numbers: pieces first to first + times - 1 of a length lie at offset in the
    sequences base, base + 1 and so on."""
    nth: dict[int, int] = {}
    rows, base = [], 0
    for combo, times in sequences:
        offset = 0
        for n in combo:
            rows.append((n, nth.get(n, 0), base, offset))
            nth[n] = nth.get(n, 0) + times
            offset += n
        base += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "base", "offset"), cols, strict=True))


def numbered(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """rows (doc_id, piece, start, length, ...) with number, gapless from 0 in each length."""
    spark = rows.sparkSession
    cuts = spark.createDataFrame([(n, -(-c // PIECES_A_TASK)) for n, c in counts.items()], f"length long, {TMP}cuts long")
    part = rows.join(F.broadcast(cuts), "length").withColumn(f"{TMP}cut", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col(f"{TMP}cuts")))
    before = Window.partitionBy("length").orderBy(f"{TMP}cut").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy("length", f"{TMP}cut").agg(F.count("*").alias("n"))
    starts = sums.select("length", f"{TMP}cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{TMP}start"))
    nth = F.row_number().over(Window.partitionBy("length", f"{TMP}cut").orderBy(F.asc_nulls_last("doc_id"), "piece", "start", "ids_crc32"))
    return part.withColumn(f"{TMP}nth", nth - 1).join(starts, ["length", f"{TMP}cut"]).withColumn("number", F.col(f"{TMP}start") + F.col(f"{TMP}nth")).drop(f"{TMP}cuts", f"{TMP}cut", f"{TMP}nth", f"{TMP}start")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of each piece."""
    rows = materialize(pieces(docs, id_col, text_col, capacity, tokenizer, with_ids), "pieces")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    by_length = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        by_length[n] = c
    at = places(plan(by_length, capacity))
    high = at["length"] * (1 << 44) + at["first"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            i = np.searchsorted(high, n * (1 << 44) + k, side="right") - 1
            new = [pa.array(at["base"][i] + k - at["first"][i]), pa.array(at["offset"][i])]
            names = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], [*names, "sequence_id", "offset"])

    got = numbered(rows, counts)
    names = [c for c in rows.columns if c != "number"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return got.select(*names, "number").mapInArrow(place, f"{kinds}, sequence_id long, offset long")
