"""Plans for large inputs: the same results as the plain ones, by less work."""

import random

import pytest
from pyspark.sql import functions as F

from mnemoframe import queries
from mnemoframe.operators import retrieve, units
from mnemoframe.plans import systems

from .test_engine import asks, talk


def corpus(spark, n=400, seed=1):
    """Units of words, a few of which nearly all share; of any length, at several times."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [w for w in ("the", "of", "and") if rng.random() < 0.8] + [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.choice([0, 1, 3, 10, 30]))]
        rows.append((rng.choice(["a", "b"]), 1, i + 1, "user", "Ann", " ".join(words) or "!", f"2024-0{rng.randint(1, 9)}-01"))
    return units.raw_units(talk(spark, *rows))


@pytest.mark.parametrize("k", [3, 40])
def test_lexical_top_is_exact(spark, k):
    rng = random.Random(k)
    built = corpus(spark)
    said = [" ".join(rng.sample(["the", "of", "and"], rng.randint(0, 3)) + [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(0, 8))]) for _ in range(30)]
    q = asks(spark, *((f"q{i}", rng.choice(["a", "b", "none"]), t, rng.choice([None, "2024-05-15", "2023-01-01", "?"])) for i, t in enumerate(said)))
    cols = ["question_id", "unit_id", "score", "rank", "text", "scope_id"]
    want = sorted(map(tuple, retrieve.ranked(retrieve.lexical_scores(q, built), k).select(*cols).collect()))
    got = sorted(map(tuple, retrieve.lexical_top(q, built, k, direct_pairs=0).select(*cols).collect()))
    assert got == want and want


@pytest.mark.parametrize("digits", [9, 2, 1])
def test_lexical_top_ranks_rounded_scores(spark, digits):
    """1 of 3 words and 3 of 27 score alike but for the last bit of the quotient; with few digits
    many tie, at the k-th place and at 0 as well."""
    n = {"x": (3, 27), "y": (5, 75), "z": (1, 3)}
    rows = [("a", 1, 10 * i + j, "user", "Ann", " ".join([*(f"s{w}" for w in range(shared)), *(f"{name}{i}u{w}" for w in range(size - shared))]), "2024-01-01") for i in range(9) for j, (name, (shared, size)) in enumerate(n.items(), 1)]
    rng = random.Random(digits)
    built = units.raw_units(talk(spark, *rows)).unionByName(corpus(spark))
    said = [f"s0 s1 s2 s3 s4 q{i}" for i in range(1, 4)] + [" ".join(["the", "of", *(f"w{rng.randint(0, 299)}" for _ in range(rng.randint(0, 8)))]) for _ in range(12)]
    q = asks(spark, *((f"q{i}", "a" if i < 3 else rng.choice(["a", "b"]), t, None) for i, t in enumerate(said)))
    built = built.dropDuplicates(["scope_id", "unit_id"]).localCheckpoint()
    cols = ["question_id", "unit_id", "score", "rank"]
    plain = retrieve.lexical_scores(q, built).withColumn("score", F.round("score", digits))
    for k in (5, 20):
        want = sorted(map(tuple, retrieve.ranked(plain, k).select(*cols).collect()))
        for most in (0, retrieve.DIRECT_PAIRS):
            assert sorted(map(tuple, retrieve.lexical_top(q, built, k, most, digits).select(*cols).collect())) == want


def test_lexical_pairs_follow_shared_words(spark, monkeypatch):
    """Where a question has rare words, pairs that are met are those that share them, and not the
    scope's; words that all units hold don't bring them back."""
    n = 3000
    rows = [("a", 1, i + 1, "user", "Ann", f"the of and x{i % 300} y{i % 500} z{i} long tail of many words {i}", "2024-01-01") for i in range(n)]
    built, q = units.raw_units(talk(spark, *rows)), asks(spark, *((f"q{i}", "a", f"the of x{i} y{i} z{i}", None) for i in range(20)))
    met = {}
    plain = retrieve.ranked
    monkeypatch.setattr(retrieve, "ranked", lambda df, *a, **k: (met.setdefault("pairs", df.count()), plain(df, *a, **k))[1])
    best, short = retrieve.lexical_postings(q, built, 5)
    assert met["pairs"] < 20 * 40 < 20 * n / 50 and short.count() == 0
    want = plain(retrieve.lexical_scores(q, built), 5)
    assert {tuple(r) for r in best.select("question_id", "unit_id").collect()} == {tuple(r) for r in want.select("question_id", "unit_id").collect()}


def loop(rows, most, count):
    """The chunk of each message of one conversation, by the tokens of what is joined."""
    held, chunk, out = [], 1, {}
    for ix, line in rows:
        if held and count("\n".join([*held, line])) > most:
            held, chunk = [], chunk + 1
        held.append(line)
        out[ix] = chunk
    return out


def test_chunks_by_a_tokenizer(spark):
    """Tokens of joined texts, as a real tokenizer counts them; sums by message chunk otherwise."""
    pytest.importorskip("public_tokenizers")
    count = queries.token_counter()
    rng = random.Random(7)
    rows = [(s, c, m, "user", None, " ".join(rng.choice(["tea", "  green", "Oslo!", "1234567", "über", "\n\n"]) for _ in range(rng.randint(0, 12))) + "  x" * (m % 2), None) for s in "ab" for c in (1, 2) for m in range(1, 40)]
    many = lambda ts: [count(t) for t in ts]
    got = {(r.scope_id, r.conv_ix, r.msg_ix): r.chunk for r in units.chunked(talk(spark, *rows), 40, many).collect()}
    want, summed = {}, 0
    for s in "ab":
        for c in (1, 2):
            mine = [(r[2], f"speaker: user\ncontent: {r[5].strip()}") for r in rows if r[:2] == (s, c) and r[5].strip()]
            one = loop(mine, 40, count)
            want |= {(s, c, ix): k for ix, k in one.items()}
            at, k, by_sum = 0, 1, {}
            for ix, line in mine:
                if at and at + count(line) > 40:
                    at, k = 0, k + 1
                at += count(line)
                by_sum[ix] = k
            summed += by_sum != one
    assert got == want and summed
    facts = systems.FactMemory(count=count, chunk_tokens=40).build(talk(spark, *rows))
    assert facts.select(F.col("unit_id")).distinct().count() == facts.count() > 0


@pytest.mark.parametrize("name", ["snapshot_counts", "lexical_topk", "context_pack", "fact_units", "min_max_ts_raw"])
def test_plans_compile(spark, name):
    """Without a fallback, generated code that is too large is an error."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_times_are_read_before_the_join(spark):
    """The as-of join compares two timestamps; no expression that reads times is in its condition."""
    q = asks(spark, ("q", "p", "tea", "2024-01-01"))
    plan = retrieve.snapshot(q, corpus(spark, 20))._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.split("\n") if "Join Inner" in line)
    assert "_at" in join and "_asked" in join and "regexp" not in join.lower() and "timestamp(" not in join.lower()


def test_question_ids_may_repeat_across_scopes(spark):
    built = units.raw_units(talk(spark, ("a", 1, 1, "user", "Ann", "x", "2024-01-01"), ("b", 1, 1, "user", "Ann", "y", "2024-03-01"), ("b", 1, 2, "user", "Ann", "z", "2024-01-01")))
    q = asks(spark, ("q", "a", "", "2024-02-01"), ("q", "b", "", "2024-02-01"))
    got = retrieve.snapshot_counts(q, built).collect()
    assert sorted((r.unit_count, r.snapshot_unit_count, r.hidden_unit_count) for r in got) == [(1, 1, 0), (2, 1, 1)]
