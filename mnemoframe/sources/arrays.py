"""One JSON array of objects in one file, read by many tasks.

Where a byte stands in an array (inside a string or not, and how deep) depends on all bytes before
it. Each block of the file tells what it makes of either start, inside a string or outside: how it
ends, and by how much it goes deeper. Those few numbers, combined in order on the driver, give each
block's own start; then each block reads the records that begin in it, and the last one to its end,
wherever that is.

As readers of such files do, a missing last bracket is passed over, and so is what follows it. A
record that isn't closed, or isn't an object, is an error."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 32 << 20
#: What is read at once beyond a block, at first; it doubles as long as a record goes on.
MORE = 1 << 20
_STRING = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_REST = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_MARK = re.compile(rb'"[^"\\]*(?:\\.[^"\\]*)*"|["{}\[\]]', re.S)
#: What may stand between records.
_BETWEEN = b" \t\r\n,"
COMPRESSED = (".gz", ".bz2", ".lz4", ".snappy", ".zst", ".deflate")


class Bytes:
    """Ranges of a file in any store that Arrow reaches."""

    def __init__(self, uri: str) -> None:
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, end: int) -> bytes:
        return self.file.read_at(max(0, min(end, self.size) - start), start)

    def escaped(self, at: int) -> bool:
        """Whether an odd number of backslashes stands before a place."""
        n, step = 0, 64
        while n < at:
            step = min(step * 2, at)
            run = self.read(at - step, at)
            n = len(run) - len(run.rstrip(b"\\"))
            if n < len(run):
                break
        return n % 2 == 1


def _outside(body: bytes) -> tuple[bool, int]:
    """(whether it ends inside a string, how much deeper it ends), of bytes from outside of one."""
    bare = _STRING.sub(b"", body)
    opened = bare.find(b'"')
    if opened >= 0:
        bare = bare[:opened]
    return opened >= 0, bare.count(b"{") + bare.count(b"[") - bare.count(b"}") - bare.count(b"]")


def summary(body: bytes, escaped: bool) -> tuple[bool, int, bool, int]:
    """What a block makes of a start outside of strings, and of one inside."""
    rest = _REST.match(body, int(escaped))
    inside = _outside(body[rest.end() :]) if rest else (True, 0)
    return (*_outside(body), *inside)


def starts(blocks: list[tuple[bool, int, bool, int]]) -> list[tuple[bool, int]]:
    """(inside a string, depth) where each block starts; depth is -1 once the array has ended in a
    block before. A block that closes the array and opens another goes by its own reading."""
    out, inside, depth = [], False, 0
    for k, (end_out, more_out, end_in, more_in) in enumerate(blocks):
        out.append((inside, depth))
        inside, depth = (end_in, depth + more_in) if inside else (end_out, depth + more_out)
        if depth <= 0 and k + 1 < len(blocks):
            return out + [(False, -1)] * (len(blocks) - k - 1)
    return out


def records(data: Bytes, start: int, end: int, inside: bool, depth: int) -> Iterator[bytes]:
    """The records that begin in a block."""
    if depth < 0:
        return
    body, more = data.read(start, end), MORE
    at = int(start > 0 and inside and data.escaped(start))
    if inside:
        rest = _REST.match(body, at)
        if not rest:
            return  # all of it is part of one string
        at = rest.end()
    if start == 0:
        at = len(body) - len(body.removeprefix(b"\xef\xbb\xbf").lstrip())
        if body[at : at + 1] != b"[":
            raise ValueError("no JSON array")
        at, depth = at + 1, 1
    opened, free = None, at  # where the open record begins, and what is behind the last one
    while True:
        for m in _MARK.finditer(body, at):
            mark, place = m[0][:1], m.start()
            if mark == b'"':
                if len(m[0]) == 1:
                    break  # a string that goes on behind what is read
                continue
            if mark in b"{[":
                if depth == 1:
                    _nothing(body[free : min(place, end - start)])
                    if start + place >= end:
                        return
                    if mark == b"[":
                        raise ValueError("an array must contain objects")
                    opened = place
                depth += 1
                continue
            depth -= 1
            if depth == 1:
                if opened is not None:
                    yield body[opened : m.end()]
                opened, free = None, m.end()
            if depth == 0:
                _nothing(body[free:place])
                return
        if opened is None:
            if depth == 1:
                _nothing(body[free : end - start])
            return
        if start + len(body) >= data.size:
            raise ValueError("a record isn't closed")
        body += data.read(start + len(body), start + len(body) + more)
        more, at, depth = more * 2, opened, 1
        opened, free = None, at


def _nothing(between: bytes) -> None:
    if between.strip(_BETWEEN):
        raise ValueError("an array must contain objects")


def readable(spark: SparkSession, path: str) -> str | None:
    """The path as Arrow takes it, if it is one plain file that Arrow reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.getFileStatus(at).isFile() or path.endswith(COMPRESSED):
        return None
    uri = re.sub(r"^file:/(?!/)", "file:///", store.makeQualified(at).toString())
    try:
        Bytes(uri)
    except (OSError, ValueError, NotImplementedError):
        return None
    return uri


def read_array(spark: SparkSession, uri: str, schema: str | T.StructType, block: int = BLOCK) -> DataFrame:
    """The records, with their place (ord): the block in the upper bits, as of a partition."""
    n = max(1, -(-Bytes(uri).size // block))

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = Bytes(uri)
        for b in batches:
            yield pd.DataFrame([(k, *summary(data.read(k * block, (k + 1) * block), data.escaped(k * block))) for k in b["id"]], columns=["k", "a", "b", "c", "d"])

    told = spark.range(0, n, 1, n).mapInPandas(tell, "k long, a boolean, b long, c boolean, d long").collect()  # a row for each block
    begin = starts([tuple(r)[1:] for r in sorted(told)])

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data = Bytes(uri)
        for b in batches:
            for k in b["id"]:
                held: list[str] = []
                first = int(k) << 33
                for r in records(data, int(k) * block, min((int(k) + 1) * block, data.size), *begin[k]):
                    held.append(r.decode())
                    if len(held) == 256:
                        yield pd.DataFrame({"ord": range(first, first + 256), "record": held})
                        held, first = [], first + 256
                yield pd.DataFrame({"ord": range(first, first + len(held)), "record": pd.Series(held, dtype=object)})

    rows = spark.range(0, n, 1, n).mapInPandas(take, "ord long, record string")
    return rows.select(F.from_json("record", schema, {"mode": "FAILFAST"}).alias("r"), "ord").select("r.*", "ord")
