"""Replay: what a stream has built at any time is what a batch builds from what was available then."""

import random

from pyspark.sql import functions as F

from mnemoframe.operators import retrieve, units
from mnemoframe.streaming import incremental

from .test_engine import MESSAGES, asks

COLS = ["scope_id", "unit_id", "text", "ts_raw", "available_at_raw"]


def said(scope, conv, ix, text=None):
    return (scope, conv, ix, None, "user", "Ann", text or f"Fact {scope} {conv} {ix}. More of it.", f"2024-0{conv}-{ix:02}")


def rows_of(df):
    return sorted(map(tuple, df.select(*COLS).collect()))


class Feed:
    """A folder that a stream reads, batch by batch, and the build on it."""

    def __init__(self, spark, tmp_path, **how):
        self.spark, self.src, self.ck = spark, f"file://{tmp_path}/in", f"file://{tmp_path}/ck"
        self.build, self.progress = incremental.IncrementalBuild(f"file://{tmp_path}/state", units.fact_units, **how), []
        self.like = spark.createDataFrame([], MESSAGES)

    def send(self, rows):
        self.spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").json(self.src)
        query = self.build.start(self.spark.readStream.schema(MESSAGES).json(self.src), self.ck)
        assert query.awaitTermination(180)
        self.progress += [p for p in query.recentProgress if p["numInputRows"]]


def test_any_time_equals_batch(spark, tmp_path):
    """In order of time, with late, repeated and corrected messages; at each time the stream's
    units, as a question at that time sees them, are the batch build's."""
    feed, known = Feed(spark, tmp_path), {}
    batches = [
        [said("a", 1, 1), said("a", 1, 2), said("x:c5:y", 1, 1)],
        [said("a", 2, 1), said("a", 2, 3), said("a", 1, 2)],  # one again
        [said("a", 2, 2), said("x:c5:y", 3, 1)],  # one late
        [said("a", 2, 3, "Corrected. Really."), said("b", 3, 2)],
    ]
    for k, batch in enumerate(batches):
        feed.send(batch)
        known |= {r[:3]: r for r in batch}
        want = units.fact_units(spark.createDataFrame(list(known.values()), MESSAGES))
        got = feed.build.units(feed.like)
        assert rows_of(got) == rows_of(want), k
        for when in ("2024-01-15", "2024-02-02", "2024-12-01", ""):
            q = asks(spark, *((f"q{s}", s, "", when) for s in ("a", "x:c5:y", "b")))
            seen = [sorted((r.question_id, r.unit_id) for r in retrieve.snapshot(q, u).collect()) for u in (got, want)]
            assert seen[0] == seen[1]
    # Only what a batch changes is built again: the repeated message changed nothing.
    touched = spark.read.parquet(f"{feed.build.folder}/touched")
    by_batch = {k: {(r.scope_id, r.conv_ix) for r in touched.where(F.col("batch") == k).collect()} for k in range(4)}
    assert by_batch == {0: {("a", 1), ("x:c5:y", 1)}, 1: {("a", 2)}, 2: {("a", 2), ("x:c5:y", 3)}, 3: {("a", 2), ("b", 3)}}


def test_a_batch_reads_its_own_rows_and_state(spark, tmp_path):
    """As history grows, a batch of one conversation reads as many rows and writes as much state."""
    feed = Feed(spark, tmp_path)
    for k in range(1, 5):
        feed.send([said(f"s{k}", 1, m) for m in range(1, 21)])
    assert [p["numInputRows"] for p in feed.progress] == [20] * 4
    state = [p["stateOperators"][0] for p in feed.progress]
    assert [s["numRowsUpdated"] for s in state] == [20] * 4 and state[-1]["numRowsTotal"] == 80
    # Nothing of older batches is kept to be read: no messages, and what changed is gone.
    assert {p.name for p in (tmp_path / "state").iterdir()} <= {"units", "touched", "changed"} and not list((tmp_path / "state" / "changed").glob("batch=*"))
    made = spark.read.parquet(f"{feed.build.folder}/units")
    assert {(r.batch, r["count"]) for r in made.groupBy("batch").count().collect()} == {(k, 40) for k in range(4)}


def test_random_orders(spark, tmp_path):
    rng = random.Random(2)
    rows = [said(s, c, m) for s in ("p", "q") for c in (1, 2) for m in range(1, 6)]
    order = rng.sample(rows, len(rows)) + rng.choices(rows, k=5)
    feed = Feed(spark, tmp_path)
    for at in range(0, len(order), 9):
        feed.send(order[at : at + 9])
    assert rows_of(feed.build.units(feed.like)) == rows_of(units.fact_units(spark.createDataFrame(rows, MESSAGES)))


def test_closed_conversations(spark, tmp_path):
    """A timer closes what was silent for long: later messages are told apart and change nothing."""
    import time

    feed = Feed(spark, tmp_path, idle=1)
    feed.send([said("a", 1, 1), said("a", 1, 2)])
    time.sleep(1)
    feed.send([said("b", 1, 1)])  # another's batch lets the timer go off
    before = rows_of(feed.build.units(feed.like))
    feed.send([said("a", 1, 3)])
    assert rows_of(feed.build.units(feed.like)) == before
    late = spark.read.parquet(f"{feed.build.folder}/late").collect()
    assert [(r.scope_id, r.conv_ix, r.msg_ix) for r in late] == [("a", 1, 3)]
