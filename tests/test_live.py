"""Records that can be read before their job ends, none of them twice."""

import functools
import json
from pathlib import Path

import pytest
from pyspark.sql import Row

from mnemoframe.operators.calls import Calls
from mnemoframe.plans import experiment, systems
from mnemoframe.sources import live, tables

from .test_engine import unified


def lines(folder):
    return [json.loads(x) for f in sorted(Path(folder).glob("*.jsonl")) for x in f.read_text().splitlines()]


def test_rows_are_there_before_the_job_ends(spark, tmp_path):
    """The last rows wait until the first ones can be read from the folder."""
    folder = tmp_path / "out"

    def slow(some):
        import time

        if some[0]["n"] >= 8:
            for _ in range(600):
                if len(lines(folder)) >= 4:
                    break
                time.sleep(0.1)
            else:
                raise AssertionError("nothing could be read")
        return [r | {"twice": 2 * r["n"]} for r in some]

    rows = spark.range(0, 10, 1, 1).withColumnRenamed("id", "n")
    got = live.live_records(rows, f"file://{folder}", slow, "twice long", every=2)
    assert sorted(map(tuple, got.collect())) == [(n, 2 * n) for n in range(10)]
    assert sorted(r["n"] for r in lines(folder)) == list(range(10)) and len(list(folder.glob("_*"))) == 1
    assert not [p for p in folder.iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_a_task_tried_again_replaces_its_rows(tmp_path):
    writer = live.LiveWriter(f"file://{tmp_path}", "run", 3)

    def failing(n):
        yield from (Row(value=json.dumps({"n": k})) for k in range(n))
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(failing(7))
    assert [r["n"] for r in lines(tmp_path)] == list(range(6))
    told = writer.write(iter([Row(value=json.dumps({"n": k})) for k in range(8)]))
    assert [r["n"] for r in lines(tmp_path)] == list(range(8)) and (told.files, told.rows) == (3, 8)
    writer.commit([told])
    assert (tmp_path / "_run").read_text() == "8 rows in 3 files\n"
    other = live.LiveWriter(f"file://{tmp_path}", "later", 3)
    other.write(iter([Row(value='{"n": 9}')]))
    assert sorted(r["n"] for r in lines(tmp_path)) == list(range(8)) + [9]


def dying(prompts):
    if any("move to" in p for p in prompts):
        raise RuntimeError("power cut")
    return ["Final answer: Lyon" for _ in prompts]


def test_answers_of_a_run(spark, tmp_path):
    data = tables.read_unified(spark, f"file://{unified(tmp_path)}")
    agent = functools.partial(systems.model_answers, complete=lambda ps: ["Final answer: Lyon" for _ in ps])
    got = experiment.Experiment(systems.RawMemory(), agent=agent, live=f"file://{tmp_path}/live").run(data)
    assert sorted((r["question_id"], r["reply"], r["error"]) for r in lines(tmp_path / "live/answers")) == [(q, "Final answer: Lyon", None) for q in ("q1", "q2")]
    assert got.report["question_count"] == 2 and got.report["accuracy"] == 0.5


def test_replies_of_a_run_that_fails_stay(spark, tmp_path):
    rows = spark.createDataFrame([(k, "move to" if k == 5 else "x") for k in range(6)], "n long, prompt string").coalesce(1).sortWithinPartitions("n")
    reads = rows.withColumns({"query_text": rows.prompt, "context": rows.prompt, "query_time_raw": rows.prompt})
    with pytest.raises(Exception, match="power cut"):
        systems.model_answers(reads, dying, live=f"file://{tmp_path}/live").collect()
    with_errors = systems.model_answers(reads, dying, calls=Calls(2, False), live=f"file://{tmp_path}/kept")
    assert {r.n: r.error for r in with_errors.collect()} == {k: "RuntimeError: power cut" if k == 5 else None for k in range(6)}
