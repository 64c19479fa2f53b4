"""The registered queries against their SQL."""

import importlib
import re

import duckdb
import pandas as pd
import pytest

from mnemoframe import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark", "events", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols, key=lambda s: s.astype(str)).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")


def ranked(con):
    """Each question's ranked units, from SQL: (text, raw time, score, rank, unit_id)."""
    rows = con.sql(f"WITH {queries.BASE} SELECT q.question_id, text, ts_raw, score, rank, unit_id FROM q LEFT JOIN ranked USING (question_id)").fetchall()
    out = {}
    for i, *r in rows:
        out.setdefault(i, [])
        if r[4]:
            out[i].append(tuple(r))
    return {i: sorted(rs, key=lambda r: r[3]) for i, rs in out.items()}


def tokens(s):
    return len(TOKEN.findall(s))


def layouts(lines):
    """The flat layout and, by years, months and days, the headed ones, of lines with times."""
    when = lambda r: r[1][:10].split("-")
    yield 0, "\n".join(f"- {r[1][:10]}: {r[0]}" for r in lines)
    if len(lines) < 2:
        return
    for depth in (1, 2, 3):
        out, left = [], list(lines)
        for y in dict.fromkeys(when(r)[0] for r in left):
            out.append(f"# {y}")
            of_y = [r for r in left if when(r)[0] == y]
            if depth == 1:
                out += [f"- {'-'.join(when(r)[1:])}: {r[0]}" for r in of_y]
                continue
            for m in dict.fromkeys(when(r)[1] for r in of_y):
                out.append(f"## {m}")
                of_m = [r for r in of_y if when(r)[1] == m]
                if depth == 2:
                    out += [f"- {when(r)[2]}: {r[0]}" for r in of_m]
                    continue
                for d in dict.fromkeys(when(r)[2] for r in of_m):
                    of_d = [r for r in of_m if when(r)[2] == d]
                    out += [f"### {d}", *(f"- {r[0]}" for r in of_d)] if len(of_d) > 1 else [f"- {d}: {of_d[0][0]}"]
        yield depth, "\n".join(out)


def test_adaptive_prune(spark, con):
    got = {r.question_id: (r.context, r.context_tokens, r.context_blocks) for r in queries.QUERIES["adaptive_prune"](spark, SF).collect()}
    want = {}
    for i, lines in ranked(con).items():
        left = list(lines)
        while left:
            n, depth, s = min((tokens(s), -d, s) for d, s in layouts(left))
            if n <= 300:
                break
            left.remove(min(left, key=lambda r: ((1 / r[3] + max(0.0, r[2])) / max(1, tokens(r[0])), -r[3])))
        want[i] = (s, n, len(left)) if left else ("", 0, 0)
    assert got == want and any(n for _, n, _ in got.values())


def test_merged_timeline(spark, con):
    got = {r.question_id: (r.context, r.context_tokens) for r in queries.QUERIES["merged_timeline"](spark, SF).collect()}
    for i, lines in ranked(con).items():
        best = ""
        for k in range(1, len(lines) + 1):
            held = {}
            for r in sorted(lines[:k], key=lambda r: (r[1], r[3])):
                held.setdefault(r[1], []).append(r[0])
            s = "\n\n".join(f"[{t}] {' | '.join(x)}" for t, x in held.items())
            if tokens(s) > 300:
                break
            best = s
        assert got[i] == (best, tokens(best)), i


def test_tokenizer_context(spark, con):
    count = queries.token_counter()
    got = {r.question_id: (r.context, r.context_tokens, r.context_blocks) for r in queries.QUERIES["tokenizer_context"](spark, SF).collect()}
    for i, lines in ranked(con).items():
        best = ("", 0, 0)
        for k in range(1, len(lines) + 1):
            s = "\n".join(f"- {r[1]}: {r[0]}" for r in lines[:k])
            if count(s) > 400:
                break
            best = (s, count(s), k)
        assert got[i] == best, i
    assert any(k for _, _, k in got.values())


def test_judged_answers(spark, con):
    """The stubs' verdicts, from the prompts' lengths: each row is judged as its own prompt says."""
    got = {r.question_id: r for r in queries.QUERIES["judged_answers"](spark, SF).collect()}
    assert len(got) == con.sql("SELECT count(*) FROM benchmark").fetchall()[0][0]
    for i, r in got.items():
        if int(i) % 6 == 5:
            assert r.skip_reason == "category_5" and r.passed is None and r.judge_label is None
        else:
            assert r.skip_reason is None and r.judge_label in ("CORRECT", "WRONG") and r.passed == (r.judge_label == "CORRECT") and r.score == float(r.passed)
    assert {r.judge_label for r in got.values()} == {"CORRECT", "WRONG", None}


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
