"""Parts of the operators, on their own."""

import functools
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemoframe.llm import chat_format, components, exact_dedup, lm_scoring, mixing, ngram_join, packing, quality_rules, sharding, substring_dedup, toxicity

from . import data


def test_heavy_digests_are_split(spark):
    rows = [(i, "same text") for i in range(40)] + [(100 + i, f"text {i % 30}") for i in range(60)]
    got = exact_dedup.decisions(data.frame(spark, rows), support=0.05)
    plain = exact_dedup.decisions(data.frame(spark, rows), support=1.0)
    assert sorted(got.collect()) == sorted(plain.collect())
    assert sum(r.kept for r in got.collect()) == 31


def test_slot_map(spark, tmp_path):
    sizes = [random.Random(i).randint(1, 100) for i in range(500)]
    first = sharding.SlotMap.balanced(sizes, 7)
    assert max(first.loads(sizes)) - min(first.loads(sizes)) <= 100
    grown = first.rebalanced(sizes, 8)
    moved = [i for i in range(500) if grown.shards[i] != first.shards[i]]
    assert grown.version == 2 and all(grown.shards[i] == 7 for i in moved) and max(grown.loads(sizes)) <= 1.03 * sum(sizes) / 8
    for m in (first, grown):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == grown and sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == first
    with pytest.raises(ValueError):
        grown.rebalanced(sizes, 3)


def test_stored_map_is_edited(spark, tmp_path):
    docs = data.frame(spark, [(i, data.prose(20, i)) for i in range(60)])
    a = {r.doc_id: r.shard for r in sharding.shard(docs, 3, 64, store=str(tmp_path / "m")).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard(docs, 4, 64, store=str(tmp_path / "m")).collect()}
    assert sum(a[i] != b[i] for i in a) < 30 and set(b.values()) == {0, 1, 2, 3}


@pytest.mark.parametrize("n,k", [(50, 0), (200, 3), (1000, 15), (1000, 40), (3, 0)])
def test_binomial_tail(spark, n, k):
    from pyspark.sql import functions as F

    p = 0.03
    got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k <= p * n else 1.0
    assert got == pytest.approx(want, rel=1e-9)


def test_learnt_cutoffs(spark):
    docs = [(i, data.prose(40, i).replace(" ", "##$ " if i % 5 == 0 else " "), "en", "s") for i in range(1500)]
    labels = data.labels(spark, [(i, int(i % 5 != 0), 0) for i in range(1500)])
    got = {r.doc_id: r for r in quality_rules.decisions(data.frame(spark, docs), labels).collect()}
    assert all(r.kept == (i % 5 != 0) for i, r in got.items()) and got[0].cut_symbols == 0.03 and not any(r.base_failed for r in got.values())
    few = quality_rules.decisions(data.frame(spark, docs[:100]), labels).collect()
    assert all(r.kept != r.base_failed for r in few)  # too few labels to promise anything


@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(0, 40))
@settings(max_examples=8, deadline=None)
def test_sainte_lague(spark, weights, seats):
    rows = [(i, float(w), seats) for i, w in enumerate(weights)]
    got = mixing.sainte_lague(spark.createDataFrame(rows, "k int, w double, s long"), [], ["k"], "w", "s", "won").collect()
    want = Counter()
    if sum(weights):
        for _ in range(seats):
            want[max(range(len(weights)), key=lambda i: (weights[i] / (2 * want[i] + 1), -i))] += 1
    assert {r.k: r.won for r in got} == {i: want[i] for i in range(len(weights))}


def test_mix_rows(spark):
    docs = data.frame(spark, [(i, f" {data.prose(50, i)}\n", "en", f"s{i % 4 % 3}") for i in range(80)])
    taken = {r.doc_id: r.taken for r in mixing.decisions(docs).collect()}
    got = Counter()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in mixing.mix(docs).collect():
        got[r.doc_id] += len(data.words(r.text))
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert got == Counter({k: v for k, v in taken.items() if v})


@given(st.lists(st.integers(1, 24), max_size=60))
@settings(max_examples=60, deadline=None)
def test_plan(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=25)
    got = packing.plan(counts, 24)
    used = Counter(n for combo, times in got for n in combo for _ in range(times))
    assert used == Counter(lengths) and all(sum(c) <= 24 and t > 0 for c, t in got)
    n = sum(t for _, t in got)
    assert n <= math.ceil(sum(lengths) / 24) * 1.5 + 1


@pytest.mark.parametrize("n", [65, 70, 80, 85, 90])
def test_plan_of_distinct_lengths(n):
    counts = np.r_[0, np.ones(n, int)]
    assert len(packing.plan(counts)) == math.ceil(n * (n + 1) / 2 / 4096)


def fewest(lengths, capacity):
    """Sequences that an exact search needs."""
    best = len(lengths)

    def place(k, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if k == len(lengths):
            best = len(loads)
            return
        for i in range(len(loads)):
            if loads[i] + lengths[k] <= capacity and loads[i] not in loads[:i]:
                place(k + 1, [*loads[:i], loads[i] + lengths[k], *loads[i + 1 :]])
        place(k + 1, [*loads, lengths[k]])

    place(0, [])
    return best


@given(st.lists(st.integers(1, 24), min_size=1, max_size=9))
@settings(max_examples=100, deadline=None)
def test_plan_against_an_exact_search(lengths):
    got = sum(t for _, t in packing.plan(np.bincount(lengths, minlength=25), 24))
    want = fewest(sorted(lengths, reverse=True), 24)
    assert want <= got <= want + (want > 1)  # best fit may need one more, but never of one


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    for t in ("Hello World, again", "  it's\n\n", ""):
        assert np.frombuffer(packing.encoded([t], name)[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\tÉ'sΣ́ <|endoftext|>1!"), max_size=40), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_encoding_by_words(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for t, got in zip(texts, packing.encoded(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


@functools.cache
def whole_tokenizer():
    """The same vocabulary in another library, which tells offsets itself."""
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer, processors

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.post_processor = processors.ByteLevel(trim_offsets=False)  # spans hold their spaces
    made.encode_special_tokens = True  # the strings of its own specials are text here
    made.add_tokens([AddedToken(t, normalized=False, special=False) for t in (chat_format.TURN, chat_format.TEXT, chat_format.END)])
    return made


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|end|>"]), st.text(alphabet=st.sampled_from("a <|>\\é\U0001f600\n"), max_size=30) | st.sampled_from(["<|end|>", "<\\|text|>", "<|endoftext|>", "</s>[INST]", "<"])), max_size=6))
@settings(max_examples=150, deadline=None)
def test_chat_round_trip(turns):
    text, spans = chat_format.render(turns)
    assert chat_format.parse(text) == turns
    e = whole_tokenizer().encode(text, add_special_tokens=False)
    ids, at = chat_format.encoded([text])[0]
    assert ids.tolist() == e.ids and [tuple(x) for x in at.tolist()] == e.offsets
    mask = chat_format.loss_mask(at, spans)
    want = [t for r, t in turns if r == "assistant" and t]
    assert chat_format.masked_text(text, e.offsets, mask) == want
    inside = {i for i, (a, b) in enumerate(e.offsets) for s, t in spans if s <= a and b <= t}
    assert set(np.flatnonzero(mask)) == inside


def brown(docs, core_words, classes):
    """A class bigram model in plain Python, by its definition: log10 probability of each text.
    docs: id to text; every likelihood is summed anew."""
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    tokens = {i: [*t.lower().split(), ""] for i, t in docs.items()}
    train = [t for i, t in tokens.items() if not held[i]]
    count = Counter(w for t in train for w in t)
    ends = count.pop("")
    core = sorted(count, key=lambda w: (-count[w], w))[:core_words]
    item = {w: w for w in core} | {"": ""}
    pairs = Counter((item.get(a, "*"), item.get(b, "*")) for t in train for a, b in zip(["", *t], t))
    n_of = Counter()
    for (a, b), n in pairs.items():
        n_of[a] += n
        n_of[b] += n
    order = sorted(core, key=lambda w: (-n_of[w], core.index(w)))
    of = {"": 0, "*": 1} | {w: k % (classes - 2) + 2 for k, w in enumerate(order)}

    def likelihood():
        t = Counter()
        for (a, b), n in pairs.items():
            t[of[a], of[b]] += n
        rows, cols = Counter(), Counter()
        for (a, b), n in t.items():
            rows[a] += n
            cols[b] += n
        f = lambda c: sum(n * math.log(n) for n in c.values())
        return f(t) - f(rows) - f(cols)

    moved = True
    while moved:
        moved = False
        for w in order:
            was, fits = of[w], []
            for c in range(2, classes):
                of[w] = c
                fits.append((likelihood(), -c))
            best, c = max(fits)
            of[w] = was
            if best > fits[was - 2][0] + lm_scoring.MIN_GAIN * sum(pairs.values()):
                of[w], moved = -c, True
    t = np.full((classes, classes), 0.5)
    for (a, b), n in pairs.items():
        t[of[a], of[b]] += n
    p, size = np.log(t / t.sum(1, keepdims=True)), np.log(t.sum(0))
    cls = dict(of)
    near = {w: [] for w in count if w not in of}
    for seq in train:
        for k, w in enumerate(seq):
            if w in near:
                near[w].append((of.get(seq[k - 1] if k else "", 1), of.get(seq[k + 1], 1)))
    for w, around in near.items():
        cls[w] = max(range(2, classes), key=lambda c: (sum(p[a, c] + p[c, b] - size[c] for a, b in around), -c))
    t = np.zeros((classes, classes))
    for seq in train:
        for a, b in zip(["", *seq], seq):
            t[cls[a], cls[b]] += 1
    total, rare = Counter({0: ends}), Counter()
    for w, n in count.items():
        total[cls[w]] += n
        rare[cls[w]] += w in near
    prior = [(t[:, c].sum() + 0.1 * (c != 1)) / (t.sum() + 0.1 * (classes - 1)) for c in range(classes)]

    def step(a, b):
        n = t[a].sum()
        return max(t[a, b] - 0.5, 0) / n + 0.5 * (t[a] > 0).sum() / n * prior[b] if n else prior[b]

    def emission(w):
        c = cls[w]
        return ends / total[0] if w == "" else (count[w] - 0.75 * (w in near)) / (total[c] + 0.1)

    def unknown(a):
        return [step(a, c) * (0.75 * rare[c] + 0.1) / (total[c] + 0.1) for c in range(2, classes)]

    for a in range(classes):
        if a != 1:  # a distribution over all words, the unknown one and the end
            known = sum(step(a, cls[w]) * emission(w) for w in [*count, ""])
            assert abs(known + sum(unknown(a)) - 1) < 1e-9
    out = {}
    for i, seq in tokens.items():
        before, s = 0, 0.0
        for w in seq:
            if w in cls and w != "*":
                s += math.log10(step(before, cls[w]) * emission(w))
                before = cls[w]
            else:
                u = unknown(before)
                s += math.log10(sum(u))
                before = 2 + u.index(max(u))
        out[i] = s
    return out


@pytest.mark.parametrize("lookup", [0, 7, 1000])
def test_class_model_against_plain_python(spark, lookup):
    """Every step of the model, whichever words travel to the tasks."""
    rng = random.Random(6)
    kinds = [[f"{k}{i}" for i in range(7)] for k in "abc"]
    docs = {}
    for i in range(60):
        ws = []
        for k in range(rng.randint(0, 25)):
            r = rng.random()
            ws.append(f"r{rng.randrange(60)}" if r < 0.25 else f"u{i}x{k}" if r < 0.3 else min(rng.choices(kinds[(k + i) % 3], k=2)))
        docs[i] = " ".join(w.upper() if rng.random() < 0.2 else w for w in ws)
    want = brown(docs, 15, 6)
    rows = lm_scoring.score(data.frame(spark, list(docs.items())), core_words=15, classes=6, lookup=lookup).collect()
    got = {r.doc_id: r.score for r in rows}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6
    assert any(r.n_known < r.n_tokens for r in rows)


def test_exchange_finds_classes():
    rng = np.random.default_rng(3)
    items, kinds = 60, 4
    kind = np.arange(items) % kinds
    n = rng.poisson(0.3, (items, items)) + rng.poisson(6, (items, items)) * ((kind[:, None] + 1) % kinds == kind[None, :])
    n[-1] = n[:, -1] = 1
    end = lm_scoring.exchange(n, 6, fixed=1)
    assert (end == 0).sum() == 1 and end[-1] == 0
    pure = sum(Counter(kind[end == c]).most_common(1)[0][1] for c in range(1, 6) if (end == c).any())
    assert pure >= 50


def test_texts_with_spaced_out_words_search_no_more_than_may_matter(monkeypatch):
    counts = toxicity.count_words(Counter({"idiot": 50, "letter": 50, "balloon": 50, "tree": 50}))
    text = "i d i o t l3tt3r b4lloon !d1ot tr3e balloon"
    met, plain = [], toxicity.lattice
    monkeypatch.setattr(toxicity, "lattice", lambda s, *a, **k: (met.append(s), plain(s, *a, **k))[1])
    want = toxicity.Reader(counts).words(text) & {"idiot"}
    met.clear()
    assert toxicity.Reader(counts, {"idiot"}).words(text) == want == {"idiot"}
    assert set(met) == {"i d i o t", "!d1ot"}


def test_pieces_with_signs_are_searched_by_segments(monkeypatch):
    counts = toxicity.count_words(Counter({"idiot": 50, "trash": 50, "loan": 50, "a": 90}))
    text = "trash!! a loan$, assail!! and !d1ot!!"
    met, plain = [], toxicity.lattice
    monkeypatch.setattr(toxicity, "lattice", lambda s, *a, **k: (met.append(s), plain(s, *a, **k))[1])
    want = toxicity.Reader(counts).words(text) & {"a", "idiot"}
    met.clear()
    assert toxicity.Reader(counts, {"a", "idiot"}).words(text) == want == {"a", "idiot"}
    assert set(met) == {"!d1ot!!"}  # no other may become one of the two, though all hold an a


def test_readers_agree_with_whole_texts():
    """Pieces, lines that are spaced out and batches: the words are those of the whole text."""
    rng = random.Random(12)
    words = [data.prose(1, i) for i in range(40)] + ["straße", "élan", "жук", "a", "il"]
    counts = toxicity.count_words(Counter({w: rng.randint(1, 30) for w in words}))

    def token():
        w = "".join(rng.choice([c, c, c, c * 2, rng.choice("!$@013+")]) for c in rng.choice(words))
        return rng.choice([w, w, w.upper(), " ".join(w), ".".join(w), f"({w})", f"“{w}”", f"{w}!!", f"{w}-{w}", f"{w}_²", f"{w}…{w}\u0301"])

    texts = ["".join(token() + rng.choice([" ", " ", ", ", "\n", ". ", "\u00a0", "\n\n"]) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    want = [set(toxicity.restore(t, toxicity.CharModel(counts), {})) for t in texts]
    assert toxicity.Reader(counts).sets(texts) == want
    some = set(rng.sample(words, 12)) | {"a"}
    assert toxicity.Reader(counts, some).sets(texts) == [w & some for w in want]
    assert [toxicity.Reader(counts, some).words(t) for t in texts[:30]] == [w & some for w in want[:30]]


def test_steps_hold_the_tokens_of_few_texts_at_once():
    """Each step of the class model over one large batch, in this process: the memory of its tokens."""
    import tracemalloc
    import types

    import pyarrow as pa

    class Steps(Exception):
        pass

    class Frame:
        sparkSession = types.SimpleNamespace(sparkContext=types.SimpleNamespace(broadcast=lambda x: types.SimpleNamespace(value=x)))

        def select(self, *_):
            return self

        def mapInArrow(self, step, _):
            raise Steps(step)

    core = [f"w{i}".encode() for i in range(50)]
    text = " ".join(f"w{i % 60}" for i in range(400))
    texts = pa.record_batch({"text": [text] * 4000})
    affinity = lm_scoring.Affinity.of(np.ones((8, 8)))
    steps = {
        "items": (lambda: lm_scoring.item_bigrams(Frame(), core), texts, 4000 * 401),
        "contexts": (lambda: lm_scoring.rare_classes(Frame(), core, np.r_[np.arange(50) % 6 + 2, 0, 1], affinity), texts, 4000 * 60),
        "bigrams": (lambda: lm_scoring.class_bigrams(Frame(), 8), pa.record_batch({"classes": [bytes([2] * 400 + [0])] * 4000}), 4000 * 401),
    }
    for name, (make, batch, tokens) in steps.items():
        with pytest.raises(Steps) as got:
            make()
        tracemalloc.start()
        n = sum(sum(out.column("n").to_pylist()) for out in got.value.args[0](iter([batch])))
        held = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert n == tokens and held < 32, (name, n, held)


def test_exchange_ends_at_a_maximum():
    """It ends, and then no move of one item raises the likelihood, counted anew, by MIN_GAIN."""

    def likelihood(n, of):
        member = np.eye(of.max() + 1)[of]
        table = member.T @ n @ member
        x = lambda v: (v * np.log(np.maximum(v, 1))).sum()
        return x(table) - x(table.sum(1)) - x(table.sum(0))

    for seed in range(8):
        rng = np.random.default_rng(seed)
        n = rng.poisson(rng.pareto(1.0, (40, 1)) * rng.pareto(1.0, 40)).astype(float)
        n[-2:] += 1
        n[:, -2:] += 1
        of = lm_scoring.exchange(n, 8, sweeps=200)
        assert (of == lm_scoring.exchange(n, 8, sweeps=400)).all()
        here = likelihood(n, of)
        for w in range(38):
            for c in range(2, 8):
                other = of.copy()
                other[w] = c
                assert likelihood(n, other) <= here + lm_scoring.MIN_GAIN * n.sum() * 1.001


def test_minhash_recall():
    bands, rows = ngram_join.band_shape()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


def test_large_group_of_near_copies(spark):
    """More texts than one block holds, each like each other."""
    base = data.prose(120, 9).split()
    texts = [" ".join(base[:60] + [f"x{i}"] + base[61:]) for i in range(300)]
    got = ngram_join.decisions(data.frame(spark, [(i, t) for i, t in enumerate([*texts, *texts[:10], data.prose(100, 4)])])).collect()
    by = {r.doc_id: r for r in got}
    assert by[0].class_size == 310 and by[0].n_links == 309 and by[0].n_text_links == 299 and by[50].n_links == 309
    assert by[310].class_size == 1 and by[310].n_links == 0 and sum(r.kept for r in got) == 2


def test_a_chain_is_work_in_proportion_to_its_links(spark):
    """5,000 texts, each like its neighbours alone: one class, and few pairs are compared."""
    from collections import defaultdict

    from pyspark.sql import functions as F

    ws = data.prose(5 * 5000 + 60, 3).split()
    docs = data.frame(spark, [(i, " ".join(ws[5 * i : 5 * i + 60])) for i in range(5000)])
    got = ngram_join.decisions(docs).collect()
    assert {r.class_id for r in got} == {0} and sum(r.n_links for r in got) == 2 * 4999
    signed = ngram_join.signatures(docs, "doc_id", "text", ngram_join.SHINGLE, *ngram_join.band_shape())
    sides = defaultdict(lambda: [0, 0])
    for r in ngram_join.work_units(signed.select("row", F.explode("bands").alias("band"))).collect():
        sides[r.h0, r.h1][r.side] += 1
    assert sum(a * b if h0 != h1 else a * (a - 1) // 2 for (h0, h1), (a, b) in sides.items()) < 12 * 4999


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_sentences_cover_the_text():
    for t in ["", "  ", "One. Two!  Three?\n\nFour", " lead. x", "a.b c.d. \n e", " ".join(["w"] * 50), "x\n" * 5]:
        ends, body, n = substring_dedup.sentences(t)
        assert len(ends) == len(body) == len(n) and sum(n) == len(data.words(t))
        assert not ends or (ends[-1] == len(t) and ends == sorted(set(ends)))


def test_shared_passage_goes(spark):
    passage = ". ".join(data.prose(9, 50 + i) for i in range(7)) + "."
    docs = [(i, f"{data.prose(8, i)}. {passage} {data.prose(8, 99 - i)}.") for i in range(5)] + [(9, f"{data.prose(30, 7)}.")]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(data.frame(spark, docs)).collect()}
    assert got[0].text == docs[0][1] and got[9].n_removed == 0
    assert all(got[i].text == docs[i][1].replace(passage + " ", "") and got[i].n_removed == 7 for i in range(1, 5))


@pytest.mark.parametrize("first", [3, 10, 18])
def test_passage_from_inside_a_sentence_goes_but_for_that_sentence(spark, first):
    """Passages of 55 words, whose first sentence has other words before it in each document, and
    whose last one has other words after it."""
    docs = []
    for i in range(6):
        p = data.prose(55, 300 + i).split()
        inner = " ".join(p[first:34]) + ". " + " ".join(p[34:45]) + ". "
        for k in range(3):
            docs.append((10 * i + k, f"{data.prose(5 + 3 * k, 40 * i + k)} {' '.join(p[:first])}. {inner}{' '.join(p[45:])} {data.prose(9, 900 + 40 * i + k)}.", inner))
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(data.frame(spark, [d[:2] for d in docs])).collect()}
    for i, text, inner in docs:
        assert got[i].text == (text if i % 10 == 0 else text.replace(inner, "")), i


def test_short_lines_that_texts_share_stay(spark):
    docs = [(i, f"All rights reserved by us. See the licence.\n{data.prose(40, i)}.") for i in range(30)]
    assert all(r.n_removed == 0 for r in substring_dedup.remove_repeats(data.frame(spark, docs)).collect())


def test_hot_passages_are_settled_apart(spark, monkeypatch):
    """The same result whether hashes count as hot or not."""
    passage = f"{data.prose(15, 1)}. {data.prose(15, 2)}."
    docs = data.frame(spark, [(i, f"{data.prose(9, i)}. {passage if i % 3 else data.prose(20, i % 7)} {data.prose(6, i)}.") for i in range(60)])
    plain = sorted(substring_dedup.remove_repeats(docs).collect())
    monkeypatch.setattr(substring_dedup, "LEAST_HOT", 8)
    assert sorted(substring_dedup.remove_repeats(docs).collect()) == plain and sum(r.n_removed > 0 for r in plain) == 39


def test_deobfuscation():
    plain = "you are an idiot and a stupid clown they say the moron is a loser and worthless trash".split()
    model = toxicity.CharModel(toxicity.count_words(Counter(plain * 20)))
    for text, word in [("1d10t", "idiot"), ("so s t u p i d", "stupid"), ("m.o.r.o.n", "moron"), ("looooser", "loser"), ("cl0wn", "clown"), ("tr@5h!!", "trash"), ("w0rthless", "worthless"), ("ID10T", "idiot")]:
        assert word in toxicity.restore(text, model, {}), text
    assert toxicity.restore("a plain text, 2023-01-02", model, {}) == ["a", "plain", "text"]


def test_deobfuscation_at_ends_and_of_doubled_letters():
    plain = "you are an idiot and a stupid clown they say the moron is a loser and worthless disgusting trash ass".split()
    counts = toxicity.count_words(Counter(plain * 20))
    model, reader = toxicity.CharModel(counts), toxicity.Reader(counts)
    forms = [("idio7", "idiot"), ("idio+", "idiot"), ("worthle55", "worthless"), ("worthles$", "worthless"), ("disgustin9", "disgusting"), ("a$$", "ass"), ("stuupid", "stupid"), ("iidiiot", "idiot"), ("clown!", "clown"), ("a $ s", "ass")]
    for text, word in forms:
        assert word in toxicity.restore(text, model, {}), text
        assert word in reader.words(f"they say {text}, the end"), text
    assert reader.words("a plain text, 2023-01-02") == {"a", "plain", "text"}


def test_spellings_are_those_of_the_search():
    rng = random.Random(8)
    model = toxicity.CharModel(toxicity.count_words(Counter({data.prose(1, i): rng.randint(1, 9) for i in range(300)})))
    for _ in range(500):
        w = "".join(rng.choice("abcde") * rng.choice([1, 1, 2, 3]) for _ in range(rng.randint(1, 7)))
        assert toxicity.respelled(w, model) == toxicity.viterbi(toxicity.lattice(w), model), w


def test_slots_agree():
    text = "   aß\U0001f600c "
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    for order, at in itertools.product(range(1, 5), range(3, len(text))):
        assert toxicity._slots(codes, order)[at - 3] == toxicity._slot(text[at - order + 1 : at + 1])
