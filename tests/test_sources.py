"""Arrays read in parts, metadata as fields, shapes of records."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import text
from mnemoframe.operators import units
from mnemoframe.plans import backends
from mnemoframe.sources import arrays, codecs, tables

SCHEMA = "a string, b array<struct<c: string>>, n long"


def odd_records(n, seed=3):
    rng = random.Random(seed)
    chars = ['"', "\\", "{", "}", "[", "]", ",", "x", "é", "\n", "\U0001f600", " "]
    return [{"a": "".join(rng.choice(chars) for _ in range(rng.randint(0, 40))), "b": [{"c": "".join(rng.choice(chars) for _ in range(rng.randint(0, 9)))} for _ in range(rng.randint(0, 3))], "n": i} for i in range(n)]


def write(tmp_path, body, name="a.json"):
    (tmp_path / name).write_text(body)
    return f"file://{tmp_path}/{name}"


@pytest.mark.parametrize("ensure_ascii", [True, False])
@pytest.mark.parametrize("tail", ["]", "", "] trailing {", ",\n"])
def test_blocks_of_any_size(tmp_path, ensure_ascii, tail):
    rows = odd_records(60)
    body = " [" + " ,\n".join(json.dumps(r, ensure_ascii=ensure_ascii) for r in rows) + tail
    data = arrays.Bytes(write(tmp_path, body))
    for block in (1, 2, 7, 64, 1000, 1 << 20):
        cuts = [(k, min(k + block, data.size)) for k in range(0, data.size, block)]
        begin = arrays.starts([arrays.summary(data.read(*c), data.escaped(c[0])) for c in cuts])
        if block == 1:
            cuts, begin = cuts[:1500], begin[:1500]
        got = [json.loads(r) for c, b in zip(cuts, begin, strict=True) if c[0] or block > 1 for r in arrays.records(data, *c, *b)]
        assert got == rows if block > 1 else all(g in rows for g in got), block


def test_many_tasks(spark, tmp_path):
    rows = odd_records(300)
    uri = write(tmp_path, "[" + ",".join(map(json.dumps, rows)) + "]")
    df = arrays.read_array(spark, uri, SCHEMA, block=4096)
    got = df.orderBy("ord").collect()
    assert [(r.a, [x.c for x in r.b], r.n) for r in got] == [(r["a"], [x["c"] for x in r["b"]], r["n"]) for r in rows]
    assert df.rdd.getNumPartitions() > 5 and len({r.ord >> 33 for r in got}) > 5
    assert [r.i for r in tables.numbered(df.select("ord", "n"), "i").orderBy("n").collect()] == list(range(300))


def test_array_edges(spark, tmp_path):
    read = lambda body: [r.n for r in tables.json_array(spark, write(tmp_path, body, f"{abs(hash(body))}.json"), "n long").orderBy("ord").collect()]
    assert read("[]") == [] and read("[ ") == [] and read('[{"n": 1}') == [1] and read('[{"n": 1},{"n": 2}] rest') == [1, 2] and read('\ufeff[{"n": 3}]') == [3]
    for bad in ('[{"n": 1}, 5]', '[1, {"n": 1}]', '[{"n": 1}, {"n"', '[[{"n": 1}]]'):
        with pytest.raises(Exception, match="objects|closed"):
            read(bad)
    with pytest.raises(ValueError):
        read("5")


def test_metadata_fields(spark):
    rows = [("u", "said", '{"place": {"name": "Oslo"}, "topics": ["tea", null, " ", 3], "empty": [], "none": null, "deep": {}, "structured": {"facts": [{"text": "f1", "tags": ["t1", "t2"]}, {"text": "f2"}]}}'), ("v", "other", None), ("w", "bad", "{")]
    df = spark.createDataFrame(rows, "unit_id string, text string, metadata string").withColumns({"tags": F.array(F.lit("x")), "ts_raw": F.lit("2024"), "source_ids": F.array(F.lit("s"))})
    fields = ["text", "metadata.place.name", "metadata.topics", "metadata.none", "metadata.empty", "structured.facts", "tags", "timestamp"]
    got = {r.unit_id: r.t for r in df.select("unit_id", units.retrieval_text(fields).alias("t")).collect()}
    assert got == {"u": "said Oslo tea 3 f1 t1 t2 f2 x 2024", "v": "other x 2024", "w": "bad x 2024"}
    cleaned = [r.m for r in df.select(text.clean_metadata("metadata").alias("m")).collect()]
    assert json.loads(cleaned[0]) == {k: v for k, v in json.loads(rows[0][2]).items() if v not in (None, [], {})} and cleaned[1] is None


def test_shapes(spark):
    for shape, row in {
        "scope": '{"scope_id": "s", "dataset": null, "subject_id": "p", "timeline_id": null, "metadata": "{}"}',
        "request": '{"query": "q", "query_id": null, "query_time": "2024", "top_k": 3, "context_budget_tokens": null, "metadata": null}',
        "index": '{"item_id": "i", "memory_artifact_id": "m", "system_name": "x", "stats": "{}"}',
        "build": '{"item_id": "i", "artifact": {"artifact_id": "a", "system_name": "x", "scope": {"scope_id": "s"}, "units": [{"unit_id": "u", "text": "t", "source_ids": [], "tags": null}], "metadata": null}, "stats": null}',
        "read_result": '{"request": {"query": "q"}, "ranked_units": [{"unit": {"unit_id": "u"}, "rank": 1, "score": 0.5, "retrieval_text": "t"}], "context": {"text": "c", "token_count": 1}, "stats": null, "trace_ref": null}',
    }.items():
        rows = codecs.decode(spark.createDataFrame([(shape, row)], "shape string, payload string"), shape)
        again = codecs.decode(codecs.encode(rows, shape), shape)
        assert again.schema == rows.schema and again.collect() == rows.collect(), shape


def test_json_mode(monkeypatch):
    sent = []
    monkeypatch.setattr(backends, "_post", lambda url, key, body, timeout: (sent.append(body), {"choices": [{"message": {"content": "{}"}}]})[1])
    backends.ChatModel("m", "http://h", json_mode=True)("x"), backends.ChatModel("m", "http://h")("x")
    assert sent[0]["response_format"] == {"type": "json_object"} and "response_format" not in sent[1]
