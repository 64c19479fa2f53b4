"""Records that can be read while the job that makes them still runs.

A data source for writing, whose tasks make the records themselves (a function of a few rows at a
time: calls to a model, say), as rows from another Python operator would wait in its buffers. Each
closes a small file after every few rows. Files are named by run, partition and number, and moved
into place whole, so that a task that is tried again replaces what its first attempt wrote, and no
row is there twice. Rows are stored first, so that they come in the same order again. What an
aborted job wrote stays, as it may have cost calls; only a job that ends well leaves its mark."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import scratch

Each = Callable[[list[dict[str, Any]]], list[dict[str, Any]]]
#: Rows of a file.
EVERY = 16
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: int
    rows: int


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, body: str) -> None:
    store, at = _store(folder)
    store.create_dir(at, recursive=True)
    hidden = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(body.encode())
    store.move(hidden, f"{at}/{name}")


class LiveWriter(DataSourceWriter):
    def __init__(self, folder: str, run: str, every: int, each: Each = list) -> None:
        self.folder, self.run, self.every, self.each = folder, run, every, each

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        partition = context.partitionId() if context else 0
        files = rows = 0
        held: list[dict[str, Any]] = []

        def close() -> None:
            nonlocal files, held
            _put(self.folder, f"{self.run}-{partition:05}-{files:05}.jsonl", "".join(f"{json.dumps(x, ensure_ascii=False)}\n" for x in self.each(held)))
            files, held = files + 1, []

        for row in iterator:
            held.append(json.loads(row[0]))
            rows += 1
            if len(held) == self.every:
                close()
        if held:
            close()
        return Written(partition, files, rows)

    def commit(self, messages: list[Any]) -> None:
        told = [m for m in messages if m is not None]
        _put(self.folder, f"_{self.run}", f"{sum(m.rows for m in told)} rows in {sum(m.files for m in told)} files\n")

    def abort(self, messages: list[Any]) -> None:
        """Nothing is undone."""


def _source(own: Each, format_name: str) -> type[DataSource]:
    """The source whose tasks make records by own. Options: path, run, every; a column of JSON."""

    class LiveRecords(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def writer(self, schema: StructType, overwrite: bool) -> LiveWriter:
            return LiveWriter(self.options["path"], self.options["run"], int(self.options["every"]), own)

    return LiveRecords


def live_records(rows: DataFrame, folder: str, each: Each = list, more: str = "", every: int = EVERY) -> DataFrame:
    """The records that each() makes of rows, with more columns (as a schema), written to the folder
    as they come, and read from there when all are written. Earlier runs' records stay beside them."""
    spark, run = rows.sparkSession, uuid.uuid4().hex
    at = scratch(spark, "live")
    rows.write.parquet(at)
    stored = spark.read.schema(rows.schema).parquet(at)
    spark.dataSource.register(_source(each, "live_records"))
    was = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(every))  # or rows would wait for one another on their way to the writer
    try:
        lines = stored.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        lines.write.format("live_records").options(path=folder, run=run, every=str(every)).mode("append").save()
    finally:
        spark.conf.set(BATCH, was)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *([more] if more else [])])
    return read_live(spark, folder, kinds, run)


def read_live(spark: SparkSession, folder: str, kinds: str, run: str = "") -> DataFrame:
    """The records that are there by now, of one run or of all."""
    return spark.read.schema(kinds).option("mode", "FAILFAST").option("pathGlobFilter", f"{run}*.jsonl").json(folder)
