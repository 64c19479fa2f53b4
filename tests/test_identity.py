"""What components are cached by, and calls that fail."""

import functools
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import keys
from mnemoframe.operators import cache, embedding, evaluate
from mnemoframe.operators.calls import Calls
from mnemoframe.plans import backends, experiment, systems
from mnemoframe.sources import tables

from .test_engine import unified

URL = "http://127.0.0.1:9/v1"


def named_judge(prompts):
    return ['{"label": "CORRECT"}' for _ in prompts]


def specs():
    """Components as runs have them."""
    chat = backends.ChatModel("m", URL)
    return [
        chat, chat.many, named_judge, functools.partial(systems.model_answers, complete=chat.many, with_time=False), systems.FactMemory(embed=backends.EmbeddingModel("e", URL), identity="e", vectors="/v"),
        keys.Declared(lambda p: p, "mine", "2", {"heat": 0.5, "api_key": "x"}),
    ]


def test_identities_differ_where_results_may():
    many = lambda **how: keys.config_key(backends.ChatModel(**({"model": "m", "base_url": URL} | how)).many)
    said = [many(), many(model="n"), many(system="s"), many(max_tokens=5)]
    assert len(set(said)) == 4 and many(key_env="OTHER", base_url="http://else") != said[1]
    agents = [keys.config_key(functools.partial(systems.model_answers, complete=backends.ChatModel(m, URL).many, with_time=w)) for m in "ab" for w in (True, False)]
    assert len(set(agents)) == 4
    assert keys.config_key(systems.FactMemory(calls=Calls(8, False))) == keys.config_key(systems.FactMemory()) != keys.config_key(systems.FactMemory(top_k=3))
    a, b = (keys.Declared(named_judge, "j", v) for v in "12")
    assert keys.config_key(a) != keys.config_key(b)


def test_what_has_no_identity_is_refused():
    def closure(prompts):
        return prompts

    for thing in (closure, lambda ps: ps, functools.partial(closure), object(), systems.FactMemory(extract=lambda p: p)):
        with pytest.raises(keys.Undeclared):
            keys.identity(thing)
        assert "undeclared" in json.dumps(keys.identity(thing, strict=False))

    class Odd:
        def cache_spec(self):
            return "name"

    with pytest.raises(TypeError, match="dict"):
        keys.identity(Odd())


def test_identities_are_equal_in_another_process():
    code = "import json; from tests.test_identity import specs; from mnemoframe.functions import keys; print(json.dumps([keys.config_key(s) for s in specs()]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True, timeout=120)
    assert json.loads(out.stdout) == [keys.config_key(s) for s in specs()]


class Judge(backends.ChatModel):
    """A judge behind the interface of all others, which says what its model's name is."""

    def many(self, prompts):
        return [json.dumps({"label": self.model}) for _ in prompts]


def test_another_judge_or_wording_is_asked(spark, tmp_path):
    data = tables.read_unified(spark, f"file://{unified(tmp_path, 'locomo')}")
    c = cache.StageCache(f"file://{tmp_path}/c")

    def run(model, **how):
        ex = experiment.Experiment(systems.RawMemory(), judge=Judge(model, URL).many, cache=c, **how)
        got = ex.run(data)
        return {r.judge_label for r in got.tables["evaluations"].collect()}, got.report["evaluation_cache_hit_count"]

    assert run("CORRECT") == ({"CORRECT"}, 0)
    assert run("WRONG") == ({"WRONG"}, 0)
    assert run("CORRECT") == ({"CORRECT"}, 2)
    assert run("CORRECT", templates={"turns": "{question}"}) == ({"CORRECT"}, 0)
    with pytest.raises(keys.Undeclared):
        experiment.Experiment(systems.RawMemory(), judge=lambda ps: ps, cache=c).run(data)


def test_cached_builds_keep_all_units(spark, tmp_path):
    data = tables.read_unified(spark, f"file://{unified(tmp_path)}")
    c = cache.StageCache(f"file://{tmp_path}/c")
    for _ in range(2):
        built, _ = experiment.Experiment(systems.RawMemory(), cache=c).build(data)
        assert sorted(r.text for r in built.collect()) == ["I moved to Lyon", "I moved to Oslo"]


def test_calls():
    def call(x):
        if x == 3:
            raise OSError("no")
        return 10 * x

    for workers in (1, 4):
        got = Calls(workers, fail_fast=False).each(call, [1, 2, 3, 4])
        assert got == [(10, None), (20, None), (None, "OSError: no"), (40, None)]
        with pytest.raises(OSError):
            Calls(workers).each(call, [1, 2, 3, 4])
    with pytest.raises(ValueError, match="2 texts gave 1"):
        Calls().replies(lambda ps: ps[:1], ["a", "b"])
    assert Calls(2, False).replies(lambda ps: [], ["a"]) == [(None, "ValueError: 1 texts gave 0 replies")]


def test_calls_run_at_once():
    import threading

    gate = threading.Barrier(4)
    assert [r for r, _ in Calls(4).each(lambda x: (gate.wait(20), x)[1], [1, 2, 3, 4])] == [1, 2, 3, 4]


def picky(prompts):
    """Fails on one question, whoever asks with it."""
    if any("move to" in p for p in prompts):
        raise RuntimeError("overloaded")
    return ["Final answer: Lyon" for _ in prompts]


def recovered(prompts):
    return ["Final answer: Lyon" for _ in prompts]


def two_questions(tmp_path):
    path = Path(unified(tmp_path))
    path.write_text(path.read_text().replace('"q2", "query": "Where did I move?"', '"q2", "query": "Where did I move to?"'))
    return f"file://{path}"


def test_a_failed_answer_costs_one_row(spark, tmp_path):
    data = tables.read_unified(spark, two_questions(tmp_path))
    agent = functools.partial(systems.model_answers, complete=picky)
    for workers in (1, 3):
        got = experiment.Experiment(systems.RawMemory(), agent=agent, fail_fast=False, workers=workers).run(data)
        assert [r.question_id for r in got.tables["answers"].collect()] == ["q1"] and got.report["question_count"] == 1
        assert [tuple(r) for r in got.tables["failures"].collect()] == [("i1", "q2", "answer", "RuntimeError: overloaded")]
        assert got.summaries["answer"]["failed_count"] == 1 and got.summaries["evaluate"]["failed_count"] == 0
    with pytest.raises(Exception, match="overloaded"):
        experiment.Experiment(systems.RawMemory(), agent=agent).run(data)


def test_failures_are_not_found_in_the_cache(spark, tmp_path):
    data = tables.read_unified(spark, two_questions(tmp_path))
    c = cache.StageCache(f"file://{tmp_path}/c")
    asked = []

    def run(complete):
        agent = functools.partial(systems.model_answers, complete=keys.Declared(complete, "model", "1"))
        got = experiment.Experiment(systems.RawMemory(), agent=agent, fail_fast=False, cache=c).run(data)
        asked.append(got.report["answer_cache_hit_count"])
        return sorted(r.question_id for r in got.tables["answers"].collect()), got.summaries["answer"]["failed_count"]

    assert [run(picky), run(picky), run(recovered), run(picky)] == [(["q1"], 1), (["q1"], 1), (["q1", "q2"], 0), (["q1", "q2"], 0)] and asked == [0, 1, 1, 2]


def test_a_failed_verdict_stays_open(spark, tmp_path):
    data = tables.read_unified(spark, f"file://{unified(tmp_path, 'locomo')}")

    def judge(prompts):
        if any("Oslo" in p.split("memories")[0] for p in prompts) or any("- Oslo" in p for p in prompts):
            raise TimeoutError("slow")
        return ['{"label": "CORRECT"}' for _ in prompts]

    got = experiment.Experiment(systems.RawMemory(), judge=judge, fail_fast=False).run(data)
    rows = {r.question_id: r for r in got.tables["evaluations"].collect()}
    assert rows["q1"].passed and rows["q2"].passed is None and rows["q2"].judge_label is None and rows["q2"].judge_source is None
    assert got.summaries["evaluate"]["failed_count"] == 1 and got.report["evaluated_count"] == 1 and got.report["accuracy"] == 1.0
    assert [(r.question_id, r.stage, r.error) for r in got.tables["failures"].collect()] == [("q2", "evaluate", "TimeoutError: slow")]


def test_a_text_that_cannot_be_embedded(spark, tmp_path):
    def embed(texts):
        if "bad" in texts:
            raise ValueError("too long")
        return [[1 / 3, 0.1] for _ in texts]

    store = embedding.VectorStore(f"file://{tmp_path}/v")
    texts = spark.createDataFrame([("a",), ("bad",), ("c",), ("a",)], "text string")
    counts = store.warm(texts, embed, "m", Calls(2, fail_fast=False))
    assert counts == {"cache_hits": 0, "cache_misses": 3, "failed_count": 1}
    got = {r.text: list(r.vector) for r in store.vectors(texts, embed, "m", Calls(1, False)).collect()}
    assert got == {"a": [1 / 3, 0.1], "c": [1 / 3, 0.1]}  # all 64 bits
    with pytest.raises(Exception, match="too long"):
        store.warm(texts, embed, "m")


def test_failed_units_of_judge_rows(spark):
    rows = spark.createDataFrame([("i", str(k), "locomo", f"q{k}", "a", ["r"], [], None) for k in range(5)], "item_id string, question_id string, dataset string, question string, answer string, references array<string>, incorrect_answers array<string>, question_type string")

    def judge(prompts):
        if "q3" in prompts[0]:
            raise RuntimeError("x")
        return ['{"label": "WRONG"}']

    got = evaluate.judge(rows, judge, calls=Calls(fail_fast=False))
    assert {(r.question_id, r.score, r.error) for r in got.select("question_id", "score", "error").collect()} == {(str(k), None if k == 3 else 0.0, "RuntimeError: x" if k == 3 else None) for k in range(5)}
    assert evaluate.accuracy(got).select(F.col("evaluated_count")).first()[0] == 4
