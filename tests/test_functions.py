import datetime as dt
import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemoframe.functions import keys, text, times, vectors

TOKEN = re.compile(text.TOKEN_PATTERN)


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    "raw,want",
    [
        ("2024-01-02", dt.datetime(2024, 1, 2)), ("2024-01-02T03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)), ("2024-01-02 03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)), ("2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02T03:04:05+02:00", dt.datetime(2024, 1, 2, 1, 4, 5)), ("20240103", dt.datetime(2024, 1, 3)), ("1:56 pm on 8 May, 2023", dt.datetime(2023, 5, 8, 13, 56)), ("9:05 AM on 12 December, 2022", dt.datetime(2022, 12, 12, 9, 5)),
        ("2023/02/15 (Wed) 23:50", dt.datetime(2023, 2, 15, 23, 50)), ("2024", None), ("2024-01", None), ("", None), (" unknown ", None), (None, None), ("soon", None),
    ],
)
def test_parse(spark, raw, want):
    assert one(spark, raw, times.parse("x")) == want


def test_strict_dates(spark):
    assert one(spark, "2023/02/15 (Wed) 23:50", times.parse("x", lenient=False)) is None


def test_visible(spark):
    rows = [("2024-01-01", None, "2024-02-01"), ("2024-03-01", None, "2024-02-01"), (None, "2024-01-01", "2024-02-01"), ("?", None, "2024-02-01"), ("?", None, None), ("2024-01-01", None, "?"), ("", "", "")]
    df = spark.createDataFrame(rows, "a string, t string, q string")
    assert [r.v for r in df.select(times.visible(F.col("a"), F.col("t"), F.col("q")).alias("v")).collect()] == [True, False, True, False, True, False, True]


def test_extremes(spark):
    def ends(values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
        return tuple(df.agg(times.earliest("x", "i").alias("a"), times.latest("x", "i").alias("b")).first())

    assert ends(["2024-02-01", "2024-01-01", "2024-01-01T00:00:00", "2024-02-01T00:00:00"]) == ("2024-01-01", "2024-02-01")
    assert ends(["x", " ", "y", None]) == ("x", "y") and ends([None, ""]) == (None, None) and ends(["x", "2024-01-01"]) == ("2024-01-01", "2024-01-01")


def segments(t, most):
    whole = " ".join(t.split()).strip(" ,;")
    n = lambda s: len(TOKEN.findall(s))
    if not whole:
        return []
    if n(whole) <= most:
        return [whole]
    out, cur = [], []
    for w in whole.split(" "):
        if cur and n(" ".join([*cur, w])) > most:
            out.append(" ".join(cur))
            cur = []
        cur.append(w)
    return [s for s in (x.strip(" ,;") for x in [*out, " ".join(cur)]) if s]


def test_segments_end_clean(spark):
    t = " ".join(f"w{i}," for i in range(30))
    got = one(spark, t, text.segments("x", 24), "string")
    assert got[0].endswith("w11") and got[1].startswith("w12") and not any(s[-1] in " ,;" for s in got)
    assert one(spark, "; " * 3 + ", , ,", text.segments("x", 2)) == []


def test_segments_and_sentences(spark):
    rng = random.Random(4)
    rows = [" ".join(rng.choice(["a", "bc,", "d-e-f", "gg.", "h;", "!", "x-y-z-w-v-u"]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    df = spark.createDataFrame([(r,) for r in rows], "x string").select("x", text.segments("x", 5).alias("s"), text.sentences("x").alias("t"), text.token_count("x").alias("n"))
    for r in df.collect():
        assert r.s == segments(r.x, 5) and r.n == len(TOKEN.findall(r.x))
        parts = re.split(r"(?<=[.!?])\s+|(?<=[;:])\s+", " ".join(r.x.split()))
        assert r.t == [p for p in (q.strip(" ,;") for q in parts) if p]


@given(st.text(max_size=60))
@settings(max_examples=15, deadline=None)
def test_hashed_vector(spark, t):
    want = [0] * 256
    for w in re.findall(text.LEXICAL_PATTERN, t.lower()):
        d = hashlib.sha1(w.encode()).digest()
        want[int.from_bytes(d[:4], "big") % 256] += 1 if d[4] % 2 == 0 else -1
    assert one(spark, t, vectors.hashed_dense(F.col("x"))) == want


def test_keys(spark):
    a = spark.createDataFrame([(None, ""), ("", None)], "a string, b string").select(keys.content_key("a", "b").alias("k")).collect()
    assert a[0].k != a[1].k
    spec = {"api_key": "s", "chunk_tokens": 5, "inner": [{"password": "p", "x": 1}]}
    assert keys.redacted(spec) == {"chunk_tokens": 5, "inner": [{"x": 1}]}
    assert keys.config_key(spec) == keys.config_key(spec | {"api_key": "t"}) != keys.config_key(spec | {"chunk_tokens": 6})
