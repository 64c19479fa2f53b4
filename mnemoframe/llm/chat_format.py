"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one string, each turn as

    <|turn|>ROLE<|text|>TEXT<|end|>

and encoded once, with offsets, by a byte-level tokenizer that knows the three controls as tokens
of their own, so that no token reaches across a turn's border. Turn spans and token spans are both
sorted: binary search gives the tokens of each assistant text, which form the loss mask. Inside
roles and texts, a run of backslashes between < and | gets one backslash more, so that no control
can occur there; taking one away restores the text.

Turns are ordered by turn (null first), then role and text; a null role or text is empty; rows
with a null conv_id form one conversation. Rows that repeat or tie are turns each. A very long
text is one turn like any other. A conversation is rendered by one task, and must fit in its
memory, as its tokens are one training example; the turns of a conversation reach it sorted, in
batches. Other columns of the input, whatever their names, play no part. Empty tables give empty
results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
TOKENIZER = "byte_bpe_50k.tiktoken"

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")

_encoder = None


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's string, and the span of each loss text in it, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn begins at {at}")
        mid = formatted.index(TEXT, at)
        end = formatted.index(END, mid)
        out.append((unescape(formatted[at + len(TURN) : mid]), unescape(formatted[mid + len(TEXT) : end])))
        at = end + len(END)
    return out


def encoder(name: str = TOKENIZER) -> tuple:
    """A byte-level encoder whose vocabulary is a file of ranks, with the controls as tokens after
    all others; and how many bytes each of its tokens stands for."""
    global _encoder
    if _encoder is None or _encoder[0] != name:
        import public_tokenizers
        import tiktoken

        from .packing import _path

        with open(_path(name), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        first = max(ranks.values()) + 2  # the id after the ranks is kept for an end of text
        controls = {t: first + k for k, t in enumerate((TURN, TEXT, END))}
        sizes = np.zeros(first + len(controls), np.int64)
        for token, i in (ranks | {t.encode(): i for t, i in controls.items()}).items():
            sizes[i] = len(token)
        _encoder = (name, tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=controls), sizes, frozenset(controls))
    return _encoder[1:]


def encoded(texts: list[str], name: str = TOKENIZER) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text, encoded once, the ids and the offsets of each token in characters (tokens by
    2). Tokens stand for bytes one after the other, so that their offsets follow from their lengths;
    a token that is a part of a character has all of it."""
    made, sizes, controls = encoder(name)
    out = []
    for text in texts:
        ids = made.encode_to_numpy(text, allowed_special=controls, disallowed_special=()).astype(np.int32)
        end = np.cumsum(sizes[ids])
        start = end - sizes[ids]
        if not text.isascii():
            raw = np.frombuffer(text.encode(), np.uint8)
            char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
            start, end = char[start], char[end - 1] + 1
        out.append((ids, np.stack([start, end], 1)))
    return out


def loss_mask(offsets: np.ndarray | list[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token, whether it lies in a span. Both lists are sorted; a character that is
    several tokens gives each of them its own span."""
    mask = np.zeros(len(offsets), bool)
    if not len(offsets) or not spans:
        return mask
    at = np.asarray(offsets, np.int64)
    s = np.array(spans, np.int64)
    first = np.searchsorted(at[:, 0], s[:, 0], side="left")
    last = np.searchsorted(at[:, 1], s[:, 1], side="right")
    edge = np.zeros(len(at) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.maximum(first, last), -1)
    return np.cumsum(edge[:-1]) > 0


def masked_text(formatted: str, offsets: np.ndarray | list[tuple[int, int]], mask: np.ndarray) -> list[str]:
    """What the masked tokens cover, unescaped, one string for each stretch of them."""
    at = np.asarray(offsets, np.int64).reshape(-1, 2)[np.asarray(mask, bool)]
    if not len(at):
        return []
    new = np.r_[True, at[1:, 0] > at[:-1, 1]]
    starts = at[new, 0]
    ends = at[np.r_[new[1:], True], 1]
    return [unescape(formatted[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


#: Characters of conversations that are encoded together.
BATCH_CHARS = 1 << 20


def format_conversations(rows: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """rows: conv_id, turn, role, text. One row for each conversation: conv_id, formatted,
    input_ids, loss_mask, offsets (start and end in turn)."""

    def told(convs: list, texts: list[str], spans: list, kind: pa.DataType) -> pa.RecordBatch:
        got = encoded(texts, name)
        masks = [loss_mask(at, s) for (_, at), s in zip(got, spans, strict=True)]
        bounds = np.r_[0, np.cumsum([len(m) for m in masks])].astype(np.int32)

        def lists(parts: list[np.ndarray], scale: int, kind: type) -> pa.Array:
            flat = np.concatenate(parts) if parts else np.empty(0)
            return pa.ListArray.from_arrays(pa.array(bounds * scale), pa.array(flat.astype(kind)))

        cols = [pa.array(convs, kind), pa.array(texts, pa.string()), lists([i for i, _ in got], 1, np.int32), lists(masks, 1, bool), lists([at.ravel() for _, at in got], 2, np.int32)]
        return pa.RecordBatch.from_arrays(cols, ["conv_id", "formatted", "input_ids", "loss_mask", "offsets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turns, n, kind = None, None, 0, None
        convs: list = []
        texts: list[str] = []
        spans: list = []

        def close() -> None:
            text, at = render(turns)
            convs.append(conv)
            texts.append(text)
            spans.append(at)

        for batch in batches:
            kind = batch.column("conv_id").type
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if turns is None or c != conv:
                    if turns is not None:
                        close()
                        n += len(texts[-1])
                        if n > BATCH_CHARS:
                            yield told(convs, texts, spans, kind)
                            convs, texts, spans, n = [], [], [], 0
                    conv, turns = c, []
                turns.append((role, text))
        if turns is not None:
            close()
            yield told(convs, texts, spans, kind)

    clean = rows.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    lined = clean.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "role", "text")
    id_kind = clean.schema["conv_id"].dataType.simpleString()
    return lined.mapInArrow(run, f"conv_id {id_kind}, formatted string, input_ids array<int>, loss_mask array<boolean>, offsets array<int>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_tokens, loss_tokens."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            masks, flat = batch.column("loss_mask"), batch.column("offsets")
            values, at = masks.flatten().to_numpy(zero_copy_only=False), flat.flatten().to_numpy()
            m = np.r_[0, np.cumsum(masks.value_lengths().to_numpy())]
            for i, text in enumerate(batch.column("formatted").to_pylist()):
                turns = parse(text)
                digest = hashlib.sha256()
                for role, body in turns:
                    digest.update(f"{role}\n{body}\n".encode())
                mask = values[m[i] : m[i + 1]]
                loss = "".join(masked_text(text, at[2 * m[i] : 2 * m[i + 1]].reshape(-1, 2), mask))
                out.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), len(mask), int(mask.sum())))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            i, s = pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, (i, s, i, s, i, i, i), strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"])

    id_kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(read, f"conv_id {id_kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose turns look like another template's controls."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
