"""Units from a stream of messages.

For any time t, the units built from the stream and seen at t are those that a batch build gives
from what was available then. Each conversation's messages are keyed state: a micro-batch reads its
own messages and the state of the conversations that they belong to, and nothing else of what came
before. Conversations that it changes are built again, as a whole, and replace their units, so that
late messages and repeated batches change nothing but what they should."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources import files

CONVERSATION = ["scope_id", "conv_ix"]
#: Rows that leave a conversation's state at once.
ROWS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Talks(StatefulProcessor):
    """State of a conversation: its messages by msg_ix. What comes for a place replaces what is
    there; of several for one place in one batch, the greatest counts, so that a batch that is run
    again says the same. A conversation that changed leaves as a whole; one to which nothing new was
    said doesn't.

    idle: milliseconds after the last change when a timer closes the conversation: its messages are
    dropped, and from then on only the mark that it is closed is kept. Messages for it come out with
    late = true, and change no unit."""

    def __init__(self, schema: T.StructType, idle: int | None) -> None:
        self.columns = [f.name for f in schema]
        self.value = T.StructType([f for f in schema if f.name not in (*CONVERSATION, "msg_ix")])
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getMapState("messages", T.StructType([T.StructField("msg_ix", T.LongType())]), self.value)
        self.closed = handle.getValueState("closed", T.StructType([T.StructField("closed", T.BooleanType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names, came = self.value.names, {}
        for part in rows:
            for ix, *said in part[["msg_ix", *names]].itertuples(index=False, name=None):
                said = tuple(None if pd.api.types.is_scalar(x) and pd.isna(x) else x for x in said)
                if ix not in came or repr(said) > repr(came[ix]):
                    came[ix] = said
        if self.closed.exists():
            yield self.frame(key, sorted(came.items()), late=True)
            return
        changed = False
        for ix, said in came.items():
            at = (int(ix),)
            held = self.messages.getValue(at)
            if held is None or tuple(held) != said:
                self.messages.updateValue(at, said)
                changed = True
        if self.idle is not None and changed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        told: list[tuple[Any, Any]] = []
        for at, said in self.messages.iterator() if changed else ():
            told.append((at[0], tuple(said)))
            if len(told) == ROWS:
                yield self.frame(key, told)
                told = []
        if told:
            yield self.frame(key, told)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.messages.clear()
        self.closed.update((True,))
        yield from ()

    def frame(self, key: Any, held: list[tuple[Any, Any]], late: bool = False) -> pd.DataFrame:
        own = dict(zip(CONVERSATION, key, strict=True))
        rows = [own | {"msg_ix": ix} | dict(zip(self.value.names, said, strict=True)) for ix, said in held]
        return pd.DataFrame(rows, columns=self.columns, dtype=object).assign(late=late)

    def close(self) -> None:
        pass


class IncrementalBuild:
    """folder: units, and which conversations each batch built, by batch; late: messages of closed
    conversations. build's unit_ids end in the conversation's place and their own, whatever the
    scope is called. idle: as in Talks; None keeps every conversation open for good."""

    def __init__(self, folder: str, build: Callable[[DataFrame], DataFrame], idle: int | None = None) -> None:
        self.folder, self.build, self.idle = folder.rstrip("/"), build, idle

    def _read(self, like: DataFrame, name: str) -> DataFrame | None:
        spark = like.sparkSession
        return spark.read.parquet(f"{self.folder}/{name}") if files.exists(spark, f"{self.folder}/{name}") else None

    def talks(self, stream: DataFrame) -> DataFrame:
        """The conversations that each batch changes, whole, with late."""
        typed = T.StructType([*stream.schema, T.StructField("late", T.BooleanType())])
        mode = "None" if self.idle is None else "ProcessingTime"
        return stream.groupBy(*CONVERSATION).transformWithStateInPandas(Talks(stream.schema, self.idle), typed, "Append", mode)

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch, of talks(). A batch that is run again overwrites its own files. What
        it changed is stored first, as state must be read once."""
        spark, at = batch.sparkSession, f"{self.folder}/changed/batch={batch_id}"
        batch.write.mode("overwrite").parquet(at)
        changed = spark.read.schema(batch.schema).parquet(at)
        if changed.isEmpty():
            return
        late, talks = changed.where("late").drop("late"), changed.where("not late").drop("late")
        if not late.isEmpty():
            late.write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")
        place = F.regexp_extract("unit_id", r"^.*:c(\d+):", 1).cast("int")  # the last one, as scopes may hold such marks
        self.build(talks).withColumn("conv_ix", place).write.mode("overwrite").parquet(f"{self.folder}/units/batch={batch_id}")
        talks.select(*CONVERSATION).distinct().write.mode("overwrite").parquet(f"{self.folder}/touched/batch={batch_id}")
        files.delete(spark, at)

    def units(self, like: DataFrame) -> DataFrame:
        """Each conversation's units of the last batch that changed it."""
        last = self._read(like, "touched").groupBy(*CONVERSATION).agg(F.max("batch").alias("batch"))
        return self._read(like, "units").join(last, [*CONVERSATION, "batch"]).drop("batch", "conv_ix")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Keyed state needs the RocksDB provider, which is set for this query alone. Without a
        trigger, it takes what is there and ends; with timers, which never let availableNow end, in
        one batch."""
        conf = stream.sparkSession.conf
        was = conf.get(PROVIDER, None)
        conf.set(PROVIDER, ROCKSDB)
        try:
            return self.talks(stream).writeStream.foreachBatch(self.absorb).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or ({"availableNow": True} if self.idle is None else {"once": True}))).start()
        finally:
            conf.unset(PROVIDER) if was is None else conf.set(PROVIDER, was)


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums in tumbling windows; on a stream, rows later than `late` are left out."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
