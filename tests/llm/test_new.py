"""Personal data, spelling variants and resampling against plain Python, by parts and as queries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from mnemoframe.llm import importance, pii, queries, spelling

from . import data
from .data import SF

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def texts():
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    return {i: t or "" for i, t in zip(docs.doc_id, docs.text, strict=True)}


# Resampling.


def test_crc_algebra():
    rng = random.Random(1)
    move = importance.Moves()
    for _ in range(200):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.randint(0, 300))) for _ in range(2))
        moved = move(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_features_of_longer_runs():
    said = ["One two, THREE four", "", "x", "Ünder \U0001f600 9lives a", "w" * 5000 + " end"]
    crc, owner, n_words = importance.Features(3)([t.encode() for t in said])
    for k, t in enumerate(said):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        want = Counter(zlib.crc32(" ".join(ws[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(ws) - n + 1))
        assert Counter(crc[owner == k].tolist()) == want and n_words[k] == len(ws)


def resampled(texts, target):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    buckets = {i: [zlib.crc32(w.encode()) % 10_000 for w in word.findall(t.translate(LOWER))] for i, t in texts.items()}
    s = Counter(b for bs in buckets.values() for b in bs)
    t = Counter(zlib.crc32(w.encode()) % 10_000 for x in target for w in word.findall((x or "").translate(LOWER)))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = {}
    for i, bs in buckets.items():
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * (n_s + 10_000) / ((s[b] + 1.0) * (n_t + 10_000)))) for b in bs]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    may = sorted((i for i in out if out[i][0] >= 20), key=lambda i: (-out[i][2], i))
    rank = {i: k + 1 for k, i in enumerate(may[: 10 * len(may) // 100])}
    return {i: (*v, rank.get(i)) for i, v in out.items()}


def test_op13(spark, texts):
    target = pd.read_parquet(f"{SF}/benchmark.parquet").text
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in queries.op13_importance(spark, SF).collect()}
    assert got == resampled(texts, target) and any(r[3] for r in got.values())


def test_drawn(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 7}{k}" for k in range(25)), "x") for i in range(100)], "doc_id long, text string, rank string")
    got = importance.drawn(docs, docs.select("text").limit(3), max_n=2)
    assert got.columns == docs.columns and got.count() == 10


# Spelling variants.


def edited(a, b):
    """Whether one edit makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_near_words_share_a_key():
    rng = random.Random(5)
    some = {"".join(rng.choice("abc") for _ in range(rng.randint(7, 9))) for _ in range(700)} | {"ananananan", "anananananan", "nananananan", "aaaaaaaa", "aaaaaaa", "aaaabaaa"}
    counts = Counter(w[i : i + 2] for w in some for i in range(len(w) - 1))
    ranks = {g: k for k, (g, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0])))}
    own, longer = ({w: {k for k, o in spelling.keys(w, ranks) if o == mine} for w in some} for mine in (True, False))
    found = 0
    for a in some:
        for b in some:
            if edited(a, b) and len(a) <= len(b):
                found += 1
                assert own[a] & (own[b] if len(a) == len(b) else longer[b]), (a, b)
    assert found > 500


def test_op12(spark, texts):
    n = Counter()
    for i, t in texts.items():
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    cuts = {}
    for w in n:
        for i in range(len(w)):
            cuts.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    near = {w: {o for i in range(len(w)) for o in cuts[w[:i] + w[i + 1 :]] if o != w and edited(w, o)} | {c for i in range(len(w)) if (c := w[:i] + w[i + 1 :]) in n} | cuts.get(w, set()) for w in n}
    best = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: o for w, o in best.items() if n[o] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    want = {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op12_spelling(spark, SF).collect()}
    assert got == want and form


def test_roots(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "word string, form string")
    assert {r.root for r in spelling.roots(chain).collect()} == {"w9"}


# Personal data.

BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
)


def by_patterns(text):
    return [(k, *m.span()) for k, (_, pattern, fits) in enumerate(BASE) for m in pattern.finditer(text) if fits(m[0])]


def test_base_spans():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1234.@+- (5)x%") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == by_patterns(text), text
    for text in ("4111 1111 1111 1111 4111-1111-1111-1111", "a@b.c@d.e", "@x.y@z.w", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1", "+1 (415) 555-0199 +44 20 7946 0958", "\U0001f600x@y.zé", "0000001.2.3.4"):
        assert pii.base_spans(text) == by_patterns(text), text


def test_op11(spark, texts):
    got = {r.doc_id: r for r in queries.op11_pii(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        want = by_patterns(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(got[i].spans.split(","))


@pytest.fixture(scope="module")
def private(spark):
    """Texts with personal data of the strict forms, and numbers that are none."""
    rng, rows = random.Random(9), []

    def card():
        body = "".join(str(rng.randrange(10)) for _ in range(15))
        return next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))

    for i in range(900):
        words = data.prose(30, i).split()
        some = [f"{words[0]}.{i}@mail{i % 9}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), card(), f"+1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"]
        none = [str(rng.randrange(10**15, 10**16)), f"{rng.randrange(1990, 2030)}-05-{rng.randrange(10, 28)}", str(rng.randrange(10**6))]
        for x in rng.sample(some + none, 3):
            words.insert(rng.randrange(len(words)), x)
        rows.append((i, " ".join(words)))
    return data.frame(spark, rows)


def test_learnt_spans(spark, private):
    rng = random.Random(4)
    plain = [f"order {rng.randrange(10**5)} of 2021-03-{rng.randrange(10, 28)}, {data.prose(20, k)} v1.2.{k}" for k in range(60)]
    said = {
        5000: "write to jane.roe [at] example [dot] org please", 5001: "ring (415) 555-0199 at noon", 5002: "paid 7536784127813050 4845168114407329 twice", 5003: "host 192[.]168[.]7[.]23 is down", 5004: "call +1 (826) 555-4081 190.137.223.204 now",
    }
    docs = private.unionByName(data.frame(spark, [*said.items(), *((6000 + k, t) for k, t in enumerate(plain))]))
    got = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
    found = {i: pii.redact(t, got[i]) for i, t in said.items()}
    assert found == {
        5000: "write to <email> please", 5001: "ring <phone> at noon", 5002: "paid <card> <card> twice", 5003: "host <ip> is down", 5004: "call <phone> <ip> now",
    }
    assert sum(bool(got[6000 + k]) for k in range(len(plain))) <= 1
    again = {r.doc_id: r.spans for r in pii.detect(docs.repartition(3)).collect()}
    assert again == got


def test_all_texts_are_learnt_from(spark, private, monkeypatch):
    """Every span of every text of the trees' folds, of which repeated texts count once, weighs in the
    fit, and all rows are looked through for thresholds."""

    class Seen(Exception):
        pass

    class Trees(pii.GBTClassifier):
        def fit(self, df):
            raise Seen(df.agg({"weight": "sum"}).first()[0], df.count(), self.getMaxBins())

    monkeypatch.setattr(pii, "GBTClassifier", Trees)
    for name, most in (("MAX_TEXTS", 300), ("MAX_ROWS", 2000)):
        monkeypatch.setattr(pii, name, most, raising=False)
    with pytest.raises(Seen) as seen:
        pii.fit(private.unionByName(private.limit(50)).select("text"))
    weight, n, bins = seen.value.args
    mine = private.where("pmod(xxhash64(text), 8) > 2").collect()
    assert weight == pytest.approx(sum(row[-1] for r in mine for row in pii.labelled(r.text))) and 0 < n <= bins * bins


def test_cutoff():
    m, y = np.array([3.0] * 40 + [2.0] * 5 + [1.0] * 40), np.array([1] * 40 + [0] * 5 + [1] * 40)
    w = np.ones(85)
    assert pii.cutoff(m, y, w, 0.85) == 0.0 and pii.cutoff(m[:45], y[:45], w[:45], 0.95) == np.inf and pii.cutoff(m[:45], y[:45], w[:45], 0.93) == 2.5
    assert pii.cutoff(m[:3], y[:3], w[:3], 0.9) == np.inf and pii.cutoff(m[:0], y[:0], w[:0]) == np.inf


def test_taken():
    taken = pii.Taken([(0, 5, 10), (1, 8, 12)])
    assert [taken.take(*s) for s in ((0, 5), (12, 14), (9, 11), (4, 6), (13, 20), (14, 15))] == [True, True, False, False, False, True]


def test_long_numbers():
    text = "1 " * 20_000 + "x" + "2." * 20_000 + "9" * 30_000
    assert pii.base_spans(text)[:1] == by_patterns(text[:60_000])[:1] and sum(1 for _ in pii.proposals(text)) < 20 * len(text)


ODD = {
    "pii": (pii.detect, lambda d: pii.detect(d)),
    "draw": (importance.resample, lambda d: importance.resample(d, d.limit(0))),
}


@pytest.mark.parametrize("name", ODD)
def test_odd_rows(spark, name):
    run = ODD[name][1]
    assert run(data.empty(spark)).count() == 0
    got = run(data.odd(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in data.odd(spark).collect())
    if name == "pii":
        assert all(r.spans == "" and r.n_card == 0 for r in got)
    else:
        assert all(r["rank"] is None for r in got)  # a tenth of the long ones is less than one
        assert {r.n_features for r in got if r.doc_id in (4, 5, 10)} == {0}


def test_odd_words(spark):
    assert spelling.variants(data.empty(spark)).count() == 0
    got = {r.word: r for r in spelling.variants(data.odd(spark)).collect()}
    assert all(len(w) >= 7 and r.n >= 2 and r.root == r.word for w, r in got.items())


# Gaps in the tests of earlier operators.


def test_slot_map_by_plain_python(spark):
    """Slots by XXH64, the map by handing out slots, the places by counting."""
    import struct

    import xxhash

    from mnemoframe.llm import sharding

    got = pd.DataFrame([r.asDict() for r in sharding.shard(spark.read.parquet(f"{SF}/documents.parquet")).collect()])

    def slot(doc_id, crc):
        h = 42
        for v in (doc_id, crc):
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        return h % sharding.N_SLOTS

    assert [slot(*x) for x in zip(got.doc_id, got.text_crc32, strict=True)] == got.virtual_slot.tolist()
    size = got.groupby("virtual_slot")["size"].sum().to_dict()
    load, where = dict.fromkeys(range(40), 0), {}
    for s in sorted(size, key=lambda s: (-size[s], s)):
        where[s] = min(load, key=lambda k: (load[k], k))
        load[where[s]] += size[s]
    assert got.virtual_slot.map(where).tolist() == got.shard.tolist()
    for _, rows in got.groupby("shard"):
        order = rows.sort_values("slot")
        assert order.slot.tolist() == list(range(len(rows))) and order.virtual_slot.is_monotonic_increasing


def test_lattices_by_enumeration():
    """Of all paths of a lattice, the search finds one of the highest probability."""
    from itertools import product

    from mnemoframe.llm import toxicity

    rng = random.Random(6)
    model = toxicity.CharModel(toxicity.count_words(Counter({"".join(rng.choice("abeilost") for _ in range(rng.randint(2, 7))): rng.randint(1, 50) for _ in range(200)})))

    def total(letters, channel):
        p, at = channel, " " * (toxicity.ORDER - 1)
        for c in letters + " ":
            p, at = p + model.logp(at, c), (at + c)[1:]
        return p

    forms = ["1d10t", "b@ss", "l o s t", "s.t.0.l.e", "aab", "b!llll", "t-0-0-l", "5ee", "|o$t", "looost!", "a b 1 e", "+e5+s"]
    forms += ["".join(rng.choice("abeilost01$@!+") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    for form in forms:
        for silent in (True, False):
            columns = toxicity.lattice(form, silent)
            best = {}
            for path in product(*columns):
                said = "".join(x for x, _ in path)
                best[said] = max(best.get(said, -np.inf), total(said, sum(q for _, q in path)))
            top = max(best.values())
            found = toxicity.viterbi(columns, model)
            assert max(p for s, p in best.items() if s.strip() == found) >= top - 1e-9, form


def test_words_that_cannot_matter_are_passed_over():
    """With known words, tokens that are not searched would have given none of them."""
    from mnemoframe.llm import toxicity

    rng = random.Random(8)
    words = ["".join(rng.choice("abeilost") for _ in range(rng.randint(2, 6))) for _ in range(150)]
    counts = toxicity.count_words(Counter({w: rng.randint(1, 40) for w in words}))
    known = dict.fromkeys(words[:40])
    some, every = toxicity.Reader(counts, known), toxicity.Reader(counts)
    for _ in range(3000):
        w = rng.choice(words) if rng.random() < 0.5 else "".join(rng.choice("abeilost") for _ in range(5))
        w = "".join(rng.choice([c, c, c * 2, c * 3, {"a": "4@", "e": "3", "i": "1!|", "l": "1|", "o": "0", "s": "5$", "t": "7+", "b": "8"}[c][0]]) for c in w) + rng.choice(["", "", "!", "$$", ".", "###", "1"])
        assert some.words(w) == every.words(w) & set(known), w


def test_counts_of_grams():
    from mnemoframe.llm import toxicity

    words = Counter({"a": 2, "über": 1, "lost": 5, "x" * 50: 3})
    want = np.zeros((toxicity.ORDER, 1 << toxicity.TABLE_BITS))
    for w, n in words.items():
        text = "   " + w + " "
        for order in range(1, toxicity.ORDER + 1):
            for at in range(3, len(text)):
                want[order - 1, toxicity._slot(text[at - order + 1 : at + 1])] += n
    assert (toxicity.count_words(words) == want).all()
