"""The registered queries against plain Python over whole tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from mnemoframe.llm import queries

from .data import SF, words


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id", drop=False)


def result(spark, name, key="doc_id"):
    return queries.QUERIES[name](spark, SF).toPandas().set_index(key).sort_index()


def same(got, want):
    want = pd.Series(want).reindex(got.index)
    return bool((got == want).all())


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        want, got = con.sql(sql).df(), queries.QUERIES[name](spark, SF).toPandas()
        assert sorted(want.columns) == sorted(got.columns), name
        cols = sorted(want.columns)
        key = {"op6_chat_format": "conv_id", "op12_spelling": "word"}.get(name, "doc_id")
        want, got = (x[cols].sort_values(key).reset_index(drop=True) for x in (want, got))
        pd.testing.assert_frame_equal(want, got, check_dtype=False, obj=name)


def test_op1(spark, docs):
    got = result(spark, "op1_exact_dedup")
    sha = docs.text.map(lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest())
    best = {}
    for i, t in docs.text.items():
        best[sha[i]] = min(best.get(sha[i], (1, 0)), (-len(t), i))
    assert same(got.keep_id, {i: best[sha[i]][1] for i in docs.index})
    assert same(got.group_size, sha.map(sha.value_counts())) and same(got.text_sha256, sha)
    assert same(got.kept, {i: best[sha[i]][1] == i for i in docs.index})


def test_op2(spark, docs):
    got = result(spark, "op2_lm_scoring")
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs.index}
    tokens = {i: [*t.encode().lower().split(), b""] for i, t in docs.text.items()}
    c = Counter(w for i in docs.index if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    base = {i: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts) for i, ts in tokens.items()}
    assert same(got.held_out, held) and same(got.n_tokens, {i: len(t) for i, t in tokens.items()})
    assert same(got.n_known, {i: sum(w in c for w in t) for i, t in tokens.items()}) and (got.train_tokens == n).all()
    assert max(abs(got.base_score[i] - b) for i, b in base.items()) < 1e-6
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum() and (got.score < 0).all()


def test_op3(spark, docs):
    got = result(spark, "op3_sharding")
    assert same(got["size"], docs.text.map(lambda t: len(t.encode()) + 16)) and same(got.text_crc32, docs.text.map(lambda t: zlib.crc32(t.encode())))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    load = got.groupby("shard")["size"].sum()
    assert set(load.index) == set(range(40)) and load.max() <= max(got["size"].max(), load.mean() * 1.1)


def test_op3_map_is_stored_and_edited(spark):
    """The query keeps its map in the shared folder; with one more shard, the next version moves
    slots there alone."""
    first = queries.op3_sharding(spark, SF).toPandas()
    again = queries.op3_sharding(spark, SF, 41).toPandas()
    assert again.map_version.iloc[0] == first.map_version.iloc[0] + 1 and first.map_version.nunique() == 1
    a, b = (x.groupby("virtual_slot")["shard"].first() for x in (first, again))
    assert (first.groupby("virtual_slot")["shard"].nunique() == 1).all()
    moved = a.index[a != b]
    assert 0 < len(moved) < len(a) / 5 and (b[moved] == 40).sum() > 0
    size = first.groupby("virtual_slot")["size"].sum()
    assert again.groupby("shard")["size"].sum().max() <= max(size.max(), size.sum() / 41 * 1.1)


def test_op4_sql_with_learnt_cutoffs(spark, tmp_path):
    """On a table whose labels are enough for cutoffs, the query and its SQL agree on what they
    reject."""
    from .data import prose

    docs = [(i, (prose(40, i).replace(" ", "##$ ") if i % 5 == 0 else prose(40, i) + " AB CD" * (i % 11 == 0)) + "\n".join(["", "same line here"] * (3 if i % 13 == 0 else 0)), "en" if i % 4 else "de", "s", 0) for i in range(2400)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(2400)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"file://{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(queries.SQL["op4_quality_rules"]).df().set_index("doc_id").sort_index()
    got = queries.QUERIES["op4_quality_rules"](spark, f"file://{tmp_path}").toPandas().set_index("doc_id").sort_index()
    assert (got[want.columns] == want).all().all() and (~got.kept & ~got.base_failed).sum() > 300


def test_op1_uses_both_branches(spark):
    """Digests that are there once are shuffled, others are settled map-side."""
    from mnemoframe.llm import exact_dedup
    from mnemoframe.llm.common import TMP, text_or_empty

    text = text_or_empty("text")
    rows = spark.read.parquet(f"{SF}/documents.parquet").selectExpr(f"doc_id AS {TMP}id", "text", f"0L AS {TMP}row").withColumns({f"{TMP}sha": exact_dedup.text_digest(text), f"{TMP}len": F.length(text)})
    heavy = exact_dedup.heavy_winners(rows.drop("text"))
    sizes = [r[0] for r in heavy.select(f"{TMP}size").collect()]
    assert min(sizes) >= 2 and len(sizes) < rows.select(f"{TMP}sha").distinct().count()


def test_op4(spark, docs):
    got = result(spark, "op4_quality_rules")
    for i, t in docs.text.items():
        w = words(t)
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        twice = {j + k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)), i
        failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        assert r.base_failed == failed and not (failed and r.kept)


def test_op5(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = queries.QUERIES["op5_packing"](spark, SF).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in docs.text.items()}
    for r in got.itertuples():
        part = ids[r.doc_id][r.start : r.start + 4096]
        assert r.start == 4096 * r.piece and r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert got.length.sum() == sum(map(len, ids.values()))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 4096) * 1.02 + 1


def test_op6(spark):
    rows = pd.read_parquet(f"{SF}/conversations.parquet")
    probe = "</s>[INST] ok [/INST]"
    rows = pd.concat([rows, pd.DataFrame({"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"], "text": [probe, probe]})])
    got = result(spark, "op6_chat_format", "conv_id")
    assert sorted(got.index) == sorted(set(rows.conv_id))
    for i, g in rows.groupby("conv_id"):
        g = g.sort_values("turn")
        turns = "".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text, strict=True))
        loss = "".join(g.text[g.role == "assistant"])
        r = got.loc[i]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(g), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op7(spark, docs):
    got = result(spark, "op7_toxicity")
    assert same(got.held_out, {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs.index})
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all() and len(got) == len(docs)


def test_op7_against_plain_python(spark, docs):
    """Words that lean to a label, a logistic regression on them by Newton's steps, and its scores,
    from the restored words of each text."""
    from collections import Counter as C

    from mnemoframe.llm import toxicity

    texts = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    model = toxicity.CharModel(toxicity.character_counts(texts))
    said = {i: set(toxicity.restore(t.lower(), model, {})) for i, t in docs.text.items()}
    lab = pd.read_parquet(f"{SF}/labels.parquet").dropna().groupby("doc_id").toxic.max()
    lab = lab[[i for i in lab.index if zlib.crc32(str(i).encode()) % 5 and i in docs.index]]
    n1, n = int((lab == 1).sum()), len(lab)
    t = C(w for i in lab.index if lab[i] == 1 for w in said[i])
    every = C(w for i in lab.index for w in said[i])

    def lean(w):
        cells = [(t[w], every[w], n1), (every[w] - t[w], every[w], n - n1), (n1 - t[w], n - every[w], n1), (n - n1 - every[w] + t[w], n - every[w], n - n1)]
        return 2 * sum(x * math.log(x * n / (row * max(1, col))) for x, row, col in cells if x > 0)

    words = sorted(w for w in every if every[w] >= 3 and lean(w) >= 20)
    x = np.array([[w in said[i] for w in words] + [True] for i in lab.index], float)
    y, b = (lab == 1).to_numpy(float), np.zeros(len(words) + 1)
    ridge = np.r_[np.full(len(words), 0.5), 1e-9]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * b)
    got = result(spark, "op7_toxicity")
    want = {i: 1 / (1 + math.exp(-(b[-1] + sum(b[k] for k, w in enumerate(words) if w in said[i])))) for i in docs.index}
    assert max(abs(got.score[i] - want[i]) for i in want) < 0.02


def test_op7_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op7_toxicity"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    out = got[got.held_out]
    assert out[out.toxic == 0].predicted.mean() < 0.02
    rank = out.score.rank()
    n1, n0 = (out.toxic == 1).sum(), (out.toxic == 0).sum()
    assert (rank[out.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.75


def sentences(text):
    """(end, words) of each sentence: it closes with a word that ends in . ! or ? or that a line
    end follows, and holds the white space up to the next word."""
    spans = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    out, held = [], []
    for k, m in enumerate(spans):
        held.append(m[0])
        end = spans[k + 1].start() if k + 1 < len(spans) else len(text)
        if m[0][-1] in ".!?" or "\n" in text[m.end() : end] or k + 1 == len(spans):
            out.append((end, tuple(held)))
            held = []
    return out


def test_op8(spark, docs):
    got = result(spark, "op8_substring_dedup")
    cut = {i: sentences(docs.text[i]) for i in docs.index}
    where = defaultdict(list)
    for i in sorted(docs.index):
        body = [w for _, w in cut[i]]
        for k in range(len(body)):
            end = next((e for e in range(k + 2, len(body) + 1) if sum(map(len, body[k:e])) >= 20), None)
            if end:
                where[tuple(body[k:end])].append((i, k, end))
    drop = defaultdict(set)
    for places in where.values():
        for i, k, end in sorted(places)[1:]:
            drop[i] |= set(range(k, end))
    assert drop
    for i, t in docs.text.items():
        ends = [e for e, _ in cut[i]]
        left = "".join(t[(ends[j - 1] if j else 0) : ends[j]] for j in range(len(ends)) if j not in drop[i]) if ends else t
        assert got.text[i] == left and got.n_removed[i] == len(drop[i]) and got.n_sentences[i] == len(ends)
        for span in filter(None, got.removed[i].split(";")):  # none begins or ends inside a sentence
            a, b = map(int, span.split(":"))
            assert b in ends and (a in ends or a == 0)


def test_op9(spark, docs):
    got = result(spark, "op9_mixing")
    size = docs.text.map(lambda t: len(words(t)))
    assert same(got["size"], size) and (got.taken <= 3 * got["size"]).all()
    by = size.groupby(docs.source).sum()
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(by.index))}
    want, still, rest = {}, set(by.index), float(by.sum())
    while True:
        each = rest / sum(weight[s] for s in still)
        over = [s for s in still if each * weight[s] > 3 * by[s]]
        if not over:
            want |= {s: each * weight[s] for s in still}
            break
        for s in over:
            want[s] = 3.0 * by[s]
            rest -= want[s]
            still.remove(s)
    for s, g in got.groupby(docs.source):
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 and abs(g.taken.sum() - want[s]) <= 32 and g.source_size.iloc[0] == by[s]


def test_op10(spark, docs):
    got = result(spark, "op10_ngram_join")
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in docs.text.items()}
    ids, links, root = list(sets), Counter(), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert same(got.n_links, {i: links[i] for i in ids}) and same(got.class_id, {i: find(i) for i in ids})
    assert got.kept.sum() == got.class_id.nunique()
