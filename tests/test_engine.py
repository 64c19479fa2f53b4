import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import cache, context, embedding, evaluate, prompts, retrieve, units
from mnemoframe.plans import backends, experiment, systems
from mnemoframe.sources import codecs, files, sinks, tables
from mnemoframe.streaming import incremental

MESSAGES = "scope_id string, conv_ix int, msg_ix int, message_id string, role string, speaker string, content string, ts_raw string"


def talk(spark, *rows):
    return spark.createDataFrame([(s, c, m, None, r, sp, t, ts) for s, c, m, r, sp, t, ts in rows], MESSAGES)


TWO = [
    ("p", 1, 1, "user", "Ann", "I moved to Lyon. I like tea; green tea.", "2024-01-01"), ("p", 1, 2, "assistant", None, "Noted.", "2024-01-01T00:01:00"),
    ("p", 2, 1, "user", "Ann", "I now live in Oslo.", "2024-03-01"), ("p", 2, 2, "assistant", None, "  ", None),
]


def asks(spark, *rows):
    return spark.createDataFrame(list(rows), "question_id string, scope_id string, query_text string, query_time_raw string")


def test_raw_units(spark):
    got = units.raw_units(talk(spark, *TWO), ["USER"]).orderBy("unit_id").collect()
    assert [(r.unit_id, r.memory_type, r.source_ids) for r in got] == [("p:c1:m1", "raw_message", ["c1:m1"]), ("p:c2:m1", "raw_message", ["c2:m1"])]
    assert units.raw_units(talk(spark, *TWO)).count() == 3


def test_roles_padding_and_names(spark):
    rows = talk(spark, ("p", 1, 1, "assistant", "user", "a", None), ("p", 1, 2, " USER ", None, "  padded  ", " 2024-01-01 "), ("p", 1, 3, "", "User", "c", ""), ("p", 1, 4, None, "Ann", "d", None))
    got = {r.unit_id: (r.text, r.role, r.ts_raw) for r in units.raw_units(rows, ["user"]).collect()}
    assert got == {"p:c1:m2": ("padded", "user", "2024-01-01"), "p:c1:m3": ("c", "user", None)}
    assert {r.role for r in units.raw_units(rows).collect()} == {"assistant", "user", "ann"}
    named = talk(spark, ("p", 1, 1, "user", 'An"n\\', "Hi there.", None), ("p", 1, 2, "user", "Alice", "Alice said, it rains. She left", None))
    want = {hashlib.sha1(json.dumps(n).encode()).hexdigest()[:8] for n in ('An"n\\', "Alice")}
    made = units.fact_units(named).collect()
    assert {r.unit_id[-8:] for r in made} == want
    assert {r.text for r in made} == {'An"n\\ said Hi there.', "Alice said, it rains.", "Alice said She left"}


def test_fact_units(spark):
    got = {r.unit_id.rsplit(":", 1)[0]: r for r in units.fact_units(talk(spark, *TWO)).collect()}
    assert [got[f"p:c1:fact_1_{i}"].text for i in (2, 3)] == ["Ann said I like tea", "Ann said green tea."] and "p:c2:fact_1_1" in got
    assert {r.available_at_raw for k, r in got.items() if ":c1:" in k} == {"2024-01-01T00:01:00"}
    assert got["p:c1:fact_1_3"].ts_raw == "2024-01-01" and got["p:c1:fact_1_3"].source_ids == ["c1:m1", "c1:m2"]


def test_chunking_against_a_loop(spark):
    rng = random.Random(1)
    rows = [("s", c, m, "user", None, " ".join(["w"] * rng.randint(0, 30)), None) for c in range(4) for m in range(1, 30)]
    want = {}
    for c in range(4):
        tok, chunk, n = 0, 1, 0
        for r in (r for r in rows if r[1] == c and r[5].strip()):
            size = len(r[5].split()) + 5  # speaker : user content :
            if n and tok + size > 40:
                chunk, tok = chunk + 1, 0
            tok, n = tok + size, n + 1
            want[c, r[2]] = chunk
    assert {(r.conv_ix, r.msg_ix): r.chunk for r in units.chunked(talk(spark, *rows), 40).collect()} == want


def test_snapshot_hides_the_future(spark):
    built = units.raw_units(talk(spark, *TWO))
    q = asks(spark, ("q1", "p", "where is Ann", "2024-02-01"), ("q2", "p", "where", None), ("q3", "none", "x", "2024-02-01"))
    counts = {r.question_id: tuple(r)[1:] for r in retrieve.snapshot_counts(q, built).collect()}
    assert counts == {"q1": (3, 2, 1), "q2": (3, 3, 0), "q3": (0, 0, 0)}
    reads = {r.question_id: r for r in systems.RawMemory().read(q, built).collect()}
    assert "Oslo" not in reads["q1"].context and "Oslo" in reads["q2"].context and reads["q3"].context == "" and reads["q3"].context_blocks == 0


def test_rank_order_and_limits(spark):
    scored = spark.createDataFrame([("q", "u:c10", 0.5), ("q", "u:c2", 0.5), ("q", "a", 0.0), ("q", "z", 0.9)], "question_id string, unit_id string, score double")
    assert [r.unit_id for r in retrieve.ranked(scored, 3).orderBy("rank").collect()] == ["z", "u:c10", "u:c2"]
    assert retrieve.effective(0, 7) == 7 and retrieve.effective(None, 7) == 7
    with pytest.raises(ValueError):
        retrieve.effective(-1, 7)
    plan = retrieve.ranked(scored, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_budget_prefix(spark):
    rows = [("q", "a", "one two three", "2024-01-01", 1.0, 1), ("q", "b", "four five six seven", None, 0.5, 2), ("q", "c", "x", None, 0.1, 3)]
    ranked = spark.createDataFrame(rows, "question_id string, unit_id string, text string, ts_raw string, score double, rank int")
    q = asks(spark, ("q", "s", "", None), ("r", "s", "", None))
    got = {r.question_id: r for r in context.pack_lines(q, ranked, 5, timestamps=False).collect()}
    assert got["q"].context == "one two three" and got["q"].context_tokens == 3 and got["r"].context == ""
    assert context.pack_lines(q.where("question_id = 'q'"), ranked, 2, timestamps=False).first().context == ""


def lines(spec):
    from datetime import datetime

    return [context.Line(f"u{i}", t, raw, datetime.fromisoformat(raw) if raw else None, i, s) for i, (t, raw, s) in enumerate(spec, 1)]


def test_renderings():
    ls = lines([("first fact here", "2024-05-02", 0.9), ("second fact here", "2024-05-02", 0.8), ("third fact here", "2024-05-20", 0.7)])
    assert context.render_grouped(ls, 3, False, 2) == "# 2024\n## 05\n### 02\n- first fact here\n- second fact here\n- 20: third fact here"
    assert context.render_grouped(ls, 1, False, 2).splitlines()[1] == "- 05-02: first fact here"
    assert context.render_flat(ls[:1], True, False) == "- 2024-05-02: first fact here"
    s, n, blocks, points = context.adaptive(ls, 1000)
    assert blocks == 3 and points == 2 and n == context.count_tokens(s)
    s, n, blocks, _ = context.adaptive(ls, 14)
    assert n <= 14 and 0 < blocks < 3 and "first fact here" in s
    assert context.adaptive(ls, 2) == ("", 0, 0, 0)
    assert "# Unknown" in context.render_grouped([*ls, *lines([("odd", None, 0.1)])], 2, False, 2)
    assert context.merged(ls, 1000, by_time=True)[0].startswith("[2024-05-02] first fact here | second fact here")


def test_contains(spark):
    rows = [("The  Answer is Lyon", ["lyon", "oslo"]), ("none", ["lyon"]), ("x", []), ("x", None), ("x", ["  "]), (None, ["a"])]
    df = spark.createDataFrame(rows, "answer string, references array<string>")
    some, every = evaluate.contains(), evaluate.contains(need_all=True)
    got = df.select(some["score"].alias("a"), some["passed"].alias("b"), every["score"].alias("c"), every["passed"].alias("d")).collect()
    assert [tuple(r) for r in got] == [(1.0, True, 0.5, False), (0.0, False, 0.0, False), (None,) * 4, (None,) * 4, (None,) * 4, (0.0, False, 0.0, False)]


def test_accuracy_ignores_nulls(spark):
    df = spark.createDataFrame([("a", True, 1.0), ("a", None, None), ("b", False, 0.0)], "category string, passed boolean, score double")
    assert tuple(evaluate.accuracy(df).first()) == (3, 2, 1, 0.5, 0.5)
    assert {r.category: r.accuracy for r in evaluate.accuracy(df, "category").collect()} == {"a": 1.0, "b": 0.0}
    assert evaluate.accuracy(df.limit(0)).first().accuracy is None


@pytest.mark.parametrize("raw,turn,persona", [('{"label": "CORRECT"}', "CORRECT", "CORRECT"), ("INCORRECT", "CORRECT", "WRONG"), ("", "WRONG", "WRONG"), (None, "WRONG", "WRONG"), ('so: {"label": "wrong", "reason": "r"} ok', "WRONG", "WRONG"), ('```json\n{"label": "CORRECT"}\n```', "CORRECT", "CORRECT"), ("it is correct", "CORRECT", "CORRECT")])
def test_labels(spark, raw, turn, persona):
    df = spark.createDataFrame([(raw,)], "x string")
    assert tuple(df.select(evaluate.parse_turn_label("x"), evaluate.parse_persona_label("x")).first()) == (turn, persona)
    assert df.select(evaluate.parse_turn_label("x", strict=True)).first()[0] == ("WRONG" if raw == "INCORRECT" else turn)


def test_judge_routes(spark):
    cols = "item_id string, question_id string, dataset string, question string, answer string, references array<string>, incorrect_answers array<string>, question_type string"
    rows = [
        ("i", "1", "LoCoMo x", "q", "a", ["a"], [], "5"), ("i", "2", "locomo", "q", "a", [" "], [], "1"), ("i", "3", "locomo", "q", "a", ["b"], [], "1"), ("i", "4_abs", "longmemeval_s", "q", "a", ["b"], [], "any"),
        ("i", "5", "mbench", "q", " A ", ["a"], ["b"], None), ("i", "6", "mbench", "q", "b", ["a"], ["B"], None), ("i", "7", "mbench", "q", "c", ["a"], ["b"], None),
    ]
    asked = spark.sparkContext.accumulator(0)

    def reply(ps):
        asked.add(len(ps))
        return ["yes" if "yes or no" in p else '{"label": "INCORRECT"}' for p in ps]

    got = {r.question_id: r for r in evaluate.judge(spark.createDataFrame(rows, cols), reply).collect()}
    assert got["1"].skip_reason == "category_5" and got["1"].passed is None and got["2"].skip_reason == "empty_gold_answer"
    assert got["3"].passed and got["4_abs"].passed and got["5"].passed and got["5"].judge_source == "exact_reference"
    assert got["6"].passed is False and got["7"].judge_label == "WRONG" and asked.value == 3


def test_replies(spark):
    t = "<think>x\ny</think>noise <|message|>It is so.\n**Final Answer:** tea\n"
    df = spark.createDataFrame([(t,), ("plain",), (None,)], "x string").select(prompts.clean_reply("x").alias("c"), prompts.final_answer("x").alias("f"))
    assert [tuple(r) for r in df.collect()] == [("It is so.\n**Final Answer:** tea", "tea"), ("plain", "plain"), ("", "")]


def test_extraction(spark):
    said = {"Ann": '{"facts": [{"text": " moved  to Lyon ", "tags": ["a","b","c","d","e","f","g"]}, "likes tea", ""]}', "assistant": "no json"}

    def extract(prompt):
        return next(v for k, v in said.items() if f"Speaker: {k}" in prompt)

    retry = systems.Retry(2, 0.0)
    made, calls = systems.extracted_units(talk(spark, *TWO[:2]), extract, 100, retry)
    got = sorted((r.text, len(r.tags)) for r in made.collect())
    assert got == [("likes tea", 0), ("moved  to Lyon", 6)]
    assert sorted((r.outcome, r.generation.call_count) for r in calls.collect()) == [("Malformed: no JSON in the reply", 2), ("ok", 1)]


def test_calls_are_tried_again():
    retry, said = systems.Retry(3, 0.0), []

    def model(*answers):
        said.clear()

        def f(prompt):
            said.append(prompt)
            a = answers[len(said) - 1]
            if isinstance(a, Exception):
                raise a
            return a

        return f

    good = systems.Reply('{"facts": ["x"]}', 3, 4)
    assert retry.call(model(TimeoutError("timed out"), "no json", good), "p", prompts.check_facts) == systems.Outcome(good, "ok", 3)
    assert retry.call(model(*[TimeoutError("timed out")] * 3), "p") == systems.Outcome(None, "TimeoutError: timed out", 3) and len(said) == 3
    assert retry.call(model(ZeroDivisionError("x")), "p") == systems.Outcome(None, "ZeroDivisionError: x", 1)
    assert systems.Retry(3, 0.0, retryable=()).call(model(ZeroDivisionError("x"), "y"), "p").said == "ok"
    for bad in ("", "no", "[1]", '{"tags": []}', '{"facts": "x"}'):
        with pytest.raises(systems.Malformed):
            prompts.check_facts(bad)
    for fine in ('{"facts": null}', 'so: {"facts": []} ok', '{"facts": ["a", {"text": "b"}]}'):
        prompts.check_facts(fine)


def test_calls_are_counted_once(spark):
    """Two facts of one call, and a call of each speaker."""

    def extract(prompt):
        return systems.Reply('{"facts": ["one", "two"]}', 10, 5)

    made = systems.FactMemory(extract=extract, retry=systems.Retry(1, 0.0)).build(talk(spark, *TWO[:2]))
    r = units.token_stats(talk(spark, *TWO[:2]), made).first()
    assert (r.unit_count, r.generation_prompt_tokens, r.generation_completion_tokens, r.generation_total_tokens, r.generation_call_count) == (4, 20, 10, 30, 2)
    assert r.generation_to_unit == 30 / 4
    assert {u.generation.call_id.rsplit("_", 1)[0] for u in made.collect()} == {"p:c1:chunk_1:speaker"}


def by_length(texts):
    return [[float(len(t)), 1.0, float("tea" in t)] for t in texts]


def test_vectors_are_stored_once(spark, tmp_path):
    store = embedding.VectorStore(f"file://{tmp_path}/v")
    texts = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "text string")
    assert store.warm(texts, by_length, "m1") == {"cache_hits": 0, "cache_misses": 2}
    assert store.warm(texts, lambda ts: 1 / 0, "m1") == {"cache_hits": 2, "cache_misses": 0}
    assert store.warm(texts, by_length, "m2")["cache_misses"] == 2
    assert {r.text: r.vector for r in store.vectors(texts, by_length, "m1").collect()} == {"a": [1.0, 1.0, 0.0], "bb": [2.0, 1.0, 0.0]}
    rows = store.table(texts).collect()
    assert all(r.text_hash not in ("a", "bb") and r.dim == 3 and len(r.vector) == 24 for r in rows)
    with pytest.raises(Exception, match="gave 1 vectors"):
        store.warm(spark.createDataFrame([("c",), ("d",)], "text string").coalesce(1), lambda ts: [[1.0]], "m3")


def test_embedded_memory(spark, tmp_path):
    memory = systems.FactMemory(embed=by_length, identity="m", vectors=f"file://{tmp_path}/v", top_k=2)
    built = memory.build(talk(spark, *TWO))
    assert memory.index(built)["cache_misses"] == built.select("text").distinct().count() and memory.index(built)["cache_misses"] == 0
    q = asks(spark, ("q", "p", "tea?", None))
    got = [r.text for r in memory.rank(q, built).orderBy("rank").collect()]
    v = {r.text: by_length([r.text])[0] for r in built.collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = sorted(built.collect(), key=lambda r: (-round(cos(v[r.text], by_length(["tea?"])[0]), 6), r.unit_id))[:2]
    assert got == [r.text for r in want]
    with pytest.raises(ValueError):
        systems.FactMemory(embed=by_length)


def test_tokens_counted_by_a_tokenizer(spark):
    """Chunks and budgets by a count that doesn't add up over joined texts."""
    calls = lambda s: len(s) // 4 + 1
    memory = systems.FactMemory(count=calls, budget=12, render="ranked_list", chunk_tokens=12)
    assert {r.unit_id.split(":fact_")[1].split("_")[0] for r in memory.build(talk(spark, *TWO)).collect()} == {"1", "2"}
    built = units.fact_units(talk(spark, *TWO))
    q = asks(spark, ("q", "p", "tea", None))
    r = memory.read(q, built).first()
    lines = [f"[{x.ts_raw}] {x.text}" for x in memory.rank(q, built).orderBy("rank").collect()]
    k = max((k for k in range(len(lines) + 1) if all(calls("\n\n".join(lines[:j])) <= 12 for j in range(1, k + 1))), default=0)
    assert r.context == "\n\n".join(lines[:k]) and r.context_blocks == k > 0 and r.context_tokens == calls(r.context)


def test_codecs_keep_everything(spark):
    built = units.fact_units(talk(spark, *TWO)).withColumn("tags", F.when(F.col("text").contains("tea"), F.array()).otherwise(F.col("tags")))
    back = codecs.decode(codecs.encode(built, "unit"), "unit")
    cols = back.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, built.select(*cols).collect()))
    with pytest.raises(Exception):  # noqa: B017
        codecs.decode(spark.createDataFrame([("unit", "{nope")], "shape string, payload string"), "unit").collect()


def test_nearest_is_exact(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 2)
    monkeypatch.setattr(retrieve, "VECTOR_BLOCK", 7)
    rng = random.Random(5)
    vs = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)] + [[0.0] * 4]
    df = spark.createDataFrame(list(enumerate(vs)), "unit_id long, vector array<double>")
    q = df.where("unit_id % 8 = 0").withColumnRenamed("unit_id", "question_id")
    got = retrieve.ranked(retrieve.nearest(q, df, 3).withColumn("score", F.round("score", 6) + 0.0), 3)
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / max(1e-300, (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5), 6)
    for i in range(0, 41, 8):
        want = sorted(range(41), key=lambda j: (-cos(vs[i], vs[j]), j))[:3]
        assert [r.unit_id for r in got.where(F.col("question_id") == i).orderBy("rank").collect()] == want


def test_stage_cache(spark, tmp_path):
    c = cache.StageCache(f"file://{tmp_path}/cache")
    want = spark.createDataFrame([("k1", 1), ("k2", 2)], "cache_key string, v int")
    double = lambda miss: miss.select("cache_key", (F.col("v") * 2).alias("w"))
    got, counts = c.through("s", want, double)
    assert {r.w for r in got.collect()} == {2, 4} and counts == {"cache_hits": 0, "cache_misses": 2}
    more = spark.createDataFrame([("k2", 2), ("k3", 3)], "cache_key string, v int")
    got, counts = c.through("s", more, double)
    assert {r.w for r in got.collect()} == {4, 6} and counts == {"cache_hits": 1, "cache_misses": 1}


def unified(tmp_path, name="toy"):
    m = lambda i, t, ts: {"message_id": i, "role": "user", "content": t, "timestamp": ts, "metadata": {"session_id": "s"}}
    q = lambda i, t, when, ref, kind: {"question_id": i, "query": t, "query_time": when, "metadata": {"question_type": kind}, "label": {"reference_answer": ref, "evidence_ids": ["m1"], "metadata": {}}}
    body = {
        "schema_version": tables.SCHEMA_VERSION, "dataset_name": name, "split": "test", "metadata": {},
        "items": [{"item_id": " i1 ", "metadata": {}, "conversations": [[m("m1", "I moved to Lyon", "2024-01-01")], [m("m2", "I moved to Oslo", "2024-03-01")]],
                   "questions": [q("q1", "Where did I move?", "2024-02-01", "Lyon", "place"), q("q2", "Where did I move?", "2024-02-01", ["Oslo"], "late")]}],
    }
    path = tmp_path / "toy.json"
    path.write_text(json.dumps(body))
    return str(path)


def test_experiment_end_to_end(spark, tmp_path):
    data = tables.read_unified(spark, f"file://{unified(tmp_path)}")
    assert set(data.requests().columns).isdisjoint({"reference", "references", "evidence_ids"})
    log = sinks.EventTable()
    c = cache.StageCache(f"file://{tmp_path}/c")
    result = experiment.Experiment(systems.RawMemory(), events=log, cache=c).run(data)
    got = {r.question_id: r for r in result.tables["evaluations"].collect()}
    assert got["q1"].passed and got["q2"].passed is False and result.report["accuracy"] == 0.5 and result.summaries["build"]["cache_misses"] == 1
    assert {r.category: r.accuracy for r in result.tables["categories"].collect()} == {"place": 1.0, "late": 0.0}
    assert log.phases("done") == ["build", "index", "read", "answer", "evaluate", "run"] and [r.supported for r in result.tables["index"].collect()] == [False]
    assert {r.question_id: (r.reference, r.evidence_ids) for r in result.tables["answers"].collect()} == {"q1": ("Lyon", ["m1"]), "q2": ('["Oslo"]', ["m1"])}
    again = experiment.Experiment(systems.RawMemory(), cache=c).run(data)
    assert [again.report[f"{x}_cache_hit_count"] for x in ("build", "answer", "evaluation")] == [1, 2, 2] and again.report["accuracy"] == 0.5
    other = experiment.Experiment(systems.RawMemory(top_k=3), cache=c).run(data)
    assert other.summaries["build"]["cache_misses"] == 1 and other.report["answer_cache_hit_count"] == 0
    null = experiment.Experiment(systems.NullMemory()).run(data)
    assert null.report["accuracy"] == 0.0 and null.report["total_context_tokens"] == 0
    assert null.tables["artifacts"].first().unit_count == 0
    facts = experiment.Experiment(systems.FactMemory()).run(data)
    assert facts.report["accuracy"] == 0.5 and facts.report["storage_generation_tokens"] == 0
    # Another agent reads the cached contexts; only its answers are new.
    loud = experiment.Experiment(systems.RawMemory(), agent=shout, cache=c).run(data)
    assert loud.summaries["read"] == {"cache_hits": 2, "cache_misses": 0} and loud.report["answer_cache_hit_count"] == 0
    built, _ = experiment.Experiment(systems.RawMemory()).build(data)
    with pytest.raises(Exception, match="artifact missing"):
        ex = experiment.Experiment(systems.RawMemory())
        ex.read(data, built, ex.artifacts(data, built).limit(0))[0].collect()


def shout(reads):
    return reads.withColumns({"answer": F.upper("context"), "agent_name": F.lit("shout")})


def stub_model(prompts):
    return ["Final answer: Lyon" for _ in prompts]


def stub_judge(prompts):
    return ['{"label": "CORRECT"}' if "- Lyon" in p else '{"label": "WRONG"}' for p in prompts]


def test_spec_chooses_agent_and_evaluator(spark, tmp_path):
    here = "tests.test_engine"
    spec = experiment.Spec("r", f"file://{unified(tmp_path, 'locomo')}", f"file://{tmp_path}/out", system="null", agent="model", agent_options={"model": f"{here}:stub_model"}, evaluator="judge", evaluator_options={"model": f"{here}:stub_judge"})
    report = experiment.run_spec(spark, spec)["report"]
    assert report["agent"] == "model" and report["evaluator"] == "judge" and report["accuracy"] == 0.5
    with pytest.raises(ValueError, match="unknown agent"):
        experiment.Spec("r", "x", "y", agent="nobody").answering()
    assert experiment.Spec("r", "x", "y", evaluator="judge", evaluator_options={"model": {"model": "m", "base_url": "http://h"}}).judging().__self__ == backends.ChatModel("m", "http://h")


def test_chat_and_embedding_backends():
    """Against a server of our own."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "messages" in body:
                out = {"choices": [{"message": {"content": body["messages"][-1]["content"].upper()}}], "usage": {"prompt_tokens": 2, "completion_tokens": 1, "total_tokens": 3}}
            else:
                out = {"data": [{"index": i, "embedding": [len(t)]} for i, t in reversed(list(enumerate(body["input"])))]}
            said = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(said)))
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1/"
    assert backends.ChatModel("m", url)("hi") == systems.Reply("HI", 2, 1, 3)
    assert backends.EmbeddingModel("m", url, batch=2)(["a", "bbb", "cc"]) == [[1], [3], [2]]
    server.shutdown()


def test_judge_is_told_of_the_case(spark):
    cols = "item_id string, question_id string, question string, answer string, references array<string>, incorrect_answers array<string>, question_type string, family string, facts array<string>, `case` string, relation_type string, relation_subtype string, topic string, source string"
    rows = [("i", "1", "q", "a", ["r"], ["w"], None, "persona", [" f1 ", ""], "moved twice", "nuanced", "a_user_vs_user", "food", "user-related"), ("i", "2", "q", "a", ["r"], ["w"], None, "persona", None, None, "other", None, None, None)]
    df = spark.createDataFrame(rows, cols)
    one, two = [r.p for r in df.select(prompts.judge_prompt(df.columns).alias("p"), "question_id").orderBy("question_id").collect()]
    for said in ("- f1", "moved twice", "nuanced", "food", prompts.RELATIONS["nuanced"], prompts.KINDS["non_persona_contradiction"], prompts.SOURCES["user-related"], "- w"):
        assert said in one and (said == "- w" or said not in two)
    assert "(none)" in two
    said = df.select(prompts.judge_prompt(df.columns, {"persona": "{question}|{answer}|{references}|{other}"}).alias("p")).first().p
    assert said == "q|a|- r|{other}"
    bare = df.select("question", "answer", "references", "incorrect_answers", "question_type", "question_id", "family")
    assert bare.select(prompts.judge_prompt(bare.columns)).count() == 2


def test_spec_run(spark, tmp_path):
    spec = {"run_id": "r", "data": f"file://{unified(tmp_path)}", "output": str(tmp_path / "out"), "system": "raw", "system_options": {"target_roles": ["user"]}, "max_questions": 1}
    (tmp_path / "spec.json").write_text(json.dumps(spec))
    manifest = experiment.run_spec(spark, experiment.Spec.load(str(tmp_path / "spec.json")))
    assert manifest["report"]["accuracy"] == 1.0 and (tmp_path / "out/report.md").read_text().startswith("| run_id")
    assert spark.read.json(str(tmp_path / "out/events")).where("state = 'done'").count() == 6
    assert json.loads((tmp_path / "out/categories.json").read_text())["place"]["accuracy"] == 1.0 and (tmp_path / "out/categories.csv").read_text().startswith("category,")
    assert [json.loads(r.value)["question_id"] for r in spark.read.text(str(tmp_path / "out/answers.jsonl")).collect()] == ["q1"] and spark.read.json(str(tmp_path / "out/index.jsonl")).count() == 1
    assert manifest["artifacts"]["report_md"] == "report.md" and json.loads((tmp_path / "out/manifest.json").read_text()) == manifest
    assert spark.read.parquet(str(tmp_path / "out/evaluations")).count() == 1
    (tmp_path / "bad.json").write_text(json.dumps(spec | {"nope": 1}))
    with pytest.raises(ValueError):
        experiment.Spec.load(str(tmp_path / "bad.json"))
    with pytest.raises(ValueError):
        systems.FactMemory(render="other")


def test_readers(spark, tmp_path):
    turn = lambda i, s, t: {"record_id": i, "session_id": s, "turn_index": 1, "speaker": "Ann", "text": t, "timestamp": "1:56 pm on 8 May, 2023", "metadata": {"dia_id": "D1", "other": 1}}
    turns = [{"example_id": f"e{k}", "source_sample_id": "s1", "question_id": f"q{k}", "question_type": "1", "question": "?", "answer": 2020 if k else "x", "turn_records": [turn("t1", "a", "hi"), turn("t2", "b", "yo"), turn("t3", "a", "so")], "gold_turn_ids": ["t1", None] if k else [], "gold_session_ids": ["a"]} for k in (0, 1)]
    (tmp_path / "t.json").write_text(json.dumps(turns))
    d = tables.from_turn_records(tables.json_array(spark, f"file://{tmp_path}/t.json", tables.TURNS), "locomo")
    assert [(r.conv_ix, r.msg_ix, r.message_id, r.role) for r in d.messages.orderBy("conv_ix", "msg_ix").collect()] == [(1, 1, "t1", "participant"), (1, 2, "t3", "participant"), (2, 1, "t2", "participant")]
    assert d.items.count() == 1 and {r.question_id: (r.evidence_level, r.evidence_ids) for r in d.labels.collect()} == {"q0": ("conversation", ["a"]), "q1": ("message", ["t1"])}
    assert "other" not in d.messages.first().metadata
    hay = [{"question_id": "h", "question_type": "multi-session", "question": "?", "question_date": "2023/05/30 (Tue) 23:40", "answer": 3, "answer_session_ids": ["s2"], "haystack_dates": ["2023/05/20 (Sat) 02:21", None], "haystack_session_ids": ["s1"], "haystack_sessions": [[{"role": "user", "content": "a"}], [{"role": "assistant", "content": "b"}]]}]
    (tmp_path / "h.json").write_text(json.dumps(hay))
    d = tables.from_haystack(tables.json_array(spark, f"file://{tmp_path}/h.json", tables.HAYSTACK), "longmemeval")
    assert [(r.conv_ix, r.message_id, r.ts_raw) for r in d.messages.orderBy("conv_ix").collect()] == [(1, "s1:m1", "2023/05/20 (Sat) 02:21"), (2, "session_2:m1", None)]
    assert d.labels.first().references == ["3"]
    sess = [{"session_id": "s1", "persona_id": "p0", "timestamp": "2024-01-01T00:00:00+00:00", "order": 1, "history": [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "hi"}]}]
    inst = [{"instance_id": "n1", "persona_id": "p0", "persona_str": json.dumps({"name": "Bo", "pin": "1234"}), "relation_type": "family", "facts": ["f"], "session_ids": ["s1"], "qas": [{"query": "who", "correct_answers": ["x"], "incorrect_answers": ["y"]}]}]
    (tmp_path / "s.json").write_text(json.dumps(sess))
    (tmp_path / "n.json").write_text(json.dumps(inst))
    d = tables.from_persona(tables.json_array(spark, f"file://{tmp_path}/s.json", tables.PERSONA_SESSIONS), tables.json_array(spark, f"file://{tmp_path}/n.json", tables.PERSONA_INSTANCES), "mbench")
    assert [(r.item_id, r.speaker, r.message_id) for r in d.messages.orderBy("msg_ix").collect()] == [("p0", "Bo", "s1:m1"), ("p0", "assistant", "s1:m2")]
    q = d.questions.first()
    assert q.question_id == "n1:q1" and q.question_type == "family" and "1234" not in q.metadata and d.labels.first().incorrect_answers == ["y"]
    (tmp_path / "x.json").write_text('"no"')
    with pytest.raises(ValueError):
        tables.json_array(spark, f"file://{tmp_path}/x.json", tables.TURNS)


def test_unified_round_trip(spark, tmp_path):
    """Written as lines or as one object, and read again, a dataset is the same."""
    data = tables.read_unified(spark, f"file://{unified(tmp_path)}")
    sinks.write_unified(data, f"file://{tmp_path}/lines")
    sinks.write_unified_object(data, f"file://{tmp_path}/whole.json")
    whole = json.loads((tmp_path / "whole.json").read_text())
    assert whole["items"][0]["questions"][1]["label"]["reference_answer"] == ["Oslo"] and whole["items"][0]["conversations"][0][0]["metadata"] == {"session_id": "s"}
    for path in (f"file://{tmp_path}/lines", f"file://{tmp_path}/whole.json"):
        back = tables.read_unified(spark, path)
        for t in ("items", "messages", "questions", "labels"):
            got, want = (sorted(map(str, getattr(x, t).collect())) for x in (back, data))
            assert got == want, (path, t)
        assert back.name == "toy"
    assert sinks.export_summary(data) == {"item_count": 1, "message_count": 2, "question_count": 2}
    assert sinks.report_text([{"run_id": "a|b\nc"}], "md").splitlines()[2].startswith("| a\\|b c |")


def test_numbers_over_partitions(spark):
    rows = spark.range(1000).repartition(7).withColumn("ord", F.monotonically_increasing_id())
    got = tables.numbered(rows, "n").orderBy("ord").collect()
    assert [r.n for r in got] == list(range(1000))


def test_heads_of_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n  [1]")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "_SUCCESS").write_text("x")
    (tmp_path / "d" / "part-0").write_text("")
    (tmp_path / "d" / "part-1").write_text('{"a": 1}')
    assert [files.first_character(spark, f"file://{tmp_path}/{n}") for n in ("a.json", "d")] == ["[", "{"]
    files.write_text(spark, f"file://{tmp_path}/n/x.txt", "é")
    assert files.read_text(spark, f"file://{tmp_path}/n/x.txt") == "é" and not files.exists(spark, f"file://{tmp_path}/none")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, c, m, None, "user", "Ann", f"Fact {s} {c} {m}. More.", f"2024-0{c}-01") for s in ("a", "x:c5:y") for c in (1, 2, 3) for m in (1, 2)]
    src = tmp_path / "in"
    b = incremental.IncrementalBuild(f"file://{tmp_path}/state", units.fact_units)
    order = [rows[:3], rows[4:9], rows[3:4] + rows[8:9], rows[9:]]
    for k, part in enumerate(order):
        spark.createDataFrame(part, MESSAGES).coalesce(1).write.mode("append").json(f"file://{src}")
        stream = spark.readStream.schema(MESSAGES).json(f"file://{src}")
        b.start(stream, f"file://{tmp_path}/ck").awaitTermination(120)
    like = spark.createDataFrame(rows, MESSAGES)
    batch = units.fact_units(like)
    cols = ["scope_id", "unit_id", "text", "ts_raw", "available_at_raw"]
    got, want = (sorted(map(tuple, x.select(*cols).collect())) for x in (b.units(like), batch))
    assert got == want
    q = asks(spark, ("q", "a", "", "2024-02-15"))
    assert retrieve.snapshot(q, b.units(like)).count() == retrieve.snapshot(q, batch).count() > 0


def test_strict_join(spark):
    left = spark.createDataFrame([("i", "q1"), ("i", "q2")], "item_id string, question_id string")
    with pytest.raises(Exception, match="answer missing"):
        evaluate.strict_join(left, left.limit(1).withColumn("answer", F.lit("x")), evaluate.KEYS, "answer").collect()
    twice = spark.createDataFrame([("i", "q", "old", 1), ("i", "q", "new", 2)], "item_id string, question_id string, answer string, n int")
    assert [r.answer for r in evaluate.last_answers(twice, "n").collect()] == ["new"]
