"""The pipeline, stage by stage, against plain Python on a small corpus with planted copies."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from . import data  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    texts = [f"{data.prose(rng.randint(12, 90), i)}\n" for i in range(50)]
    texts += [t.replace(" ", "  ", 3) for t in texts[:6]] + [texts[7]] * 3  # exact copies
    for i in range(10, 16):  # near copies: one word of a long text
        w = data.prose(120, 500 + i).split()
        texts += [" ".join(w), " ".join([*w[:60], "other", *w[61:]])]
    texts += ["too short", "", None, " ".join(["again and again it goes"] * 8)]  # go by the base rule
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k], "en", f"s{i % 7 % 3}" if i % 9 else None, len(texts[k] or "")) for i, k in enumerate(order)]


def failed(text):
    w = data.words(text)
    grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    twice = {j + k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(5)}
    return len(w) < 10 or 100 * len(twice) > 20 * len(w)


def once(rows):
    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        best[key] = min(best.get(key, r), r, key=lambda r: (-len(r[1] or ""), r[0]))
    return sorted(best.values())


def unlike(rows):
    sets = {r[0]: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := data.words(r[1])) else set() for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [r for r in rows if find(r[0]) == r[0]]


def mixed(rows):
    """Rows as often as taken, the last one cut, by targets, Sainte-Lague quotas and seeded order."""
    size = {r[0]: len(data.words(r[1])) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    total = {s: sum(size[r[0]] for r in by[s]) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, still, left = {}, set(names), float(sum(total.values()))
    while still:
        each = left / sum(weight[s] for s in still)
        over = [s for s in still if each * weight[s] > 3 * total[s]]
        for s in over or list(still):
            target[s] = 3.0 * total[s] if over else each * weight[s]
            still.remove(s)
            left -= target[s] if over else 0
    blocks, won = round(sum(total.values()) / 32), Counter()
    for _ in range(blocks):
        won[max(names, key=lambda s: (target[s] / (2 * won[s] + 1), -names.index(s)))] += 1
    out = []
    for s in names:
        take = min(won[s] * 32, 3 * total[s])
        whole, start = take // total[s], 0
        part = take - whole * total[s]
        for r in sorted(by[s], key=lambda r: hashlib.md5(f"17|{r[0]}".encode()).hexdigest()):
            out += [r] * whole
            again = max(0, min(size[r[0]], part - start))
            start += size[r[0]]
            if again == size[r[0]]:
                out.append(r)
            elif again:
                cut = r[1][: [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", r[1])][again - 1]]
                out.append((*r[:1], cut, *r[2:4], len(cut)))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{at}/documents.parquet")
    data.labels(spark).write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    rows = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {"quality rules": lambda rs: [r for r in rs if not failed(r[1])], "exact dedup": once, "near duplicates": unlike, "mixing": mixed}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = len(rows), want[name](rows)
        got = stage(spark, docs, folder)
        assert got.dtypes == docs.dtypes
        docs = corpus_pipeline.materialize(got, "test")
        assert sorted(map(repr, map(tuple, docs.collect()))) == sorted(map(repr, rows)), name
        assert name == "mixing" or len(rows) < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, packed)) == sorted(map(key, whole)) == sorted(pieces(rows))
    for got in (packed, whole):
        held = defaultdict(list)
        for r in got:
            held[r.sequence_id].append((r.offset, r.length))
        for places in held.values():
            places.sort()
            assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 4096
        assert len(held) == math.ceil(sum(r.length for r in got) / 4096)


def pieces(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows:
        ids = [*t.encode(r[1], add_special_tokens=False).ids, 1]
        yield r[0], 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("make", [data.empty, data.odd])
def test_stages_on_odd_rows(spark, folder, make):
    """Nulls, ties, repeated rows, extra columns; and a stage that leaves nothing for the next."""
    docs = make(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        docs = corpus_pipeline.materialize(got, "odd")
    n = docs.count()
    got = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert (n == 0) == (make is data.empty) and sum(r.piece == 0 for r in got) == n
    short = docs.where("length(text) < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, short, folder).count() == 0
