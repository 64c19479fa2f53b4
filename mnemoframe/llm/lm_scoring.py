"""Language-model scoring with Brown class-based bigrams.

Tokens are the words of the text with A-Z lower-cased, then one end. Every training word is in one
class; the end has class 0 to itself.

1. The CORE most frequent training words (ties by code point) are clustered by exchange: items
   start in turn by frequency, and are moved, one by one, to the class of the highest likelihood
   of the training bigrams, until no move gains MIN_GAIN. All other words are one item there.
2. Every other training word, however rare, then goes to the class under which the neighbours of
   all its occurrences, by their classes, are most probable. This is the same step with the
   classes held fixed, taken for all words at once, from counts that grow with the corpus.
3. Class transitions are counted over all training texts, every word with its class. Then

       P(word | before) = P(class | class before) * P(word | class)

   with transitions by absolute discounting, interpolated with class frequencies, and emissions by
   relative frequency, from which each word outside the core gives DISCOUNT counts to the unknown
   words of its class. An unknown word sums over all classes, and what follows it sees the most
   probable one. All probabilities after a class add up to 1, all unknown words counting as one.

All counts cover all training texts. Words are summed in one shuffle; the neighbours of rare words
in another, by 64-bit hash; a document's words meet their counts and classes in a third, and are
put together again by document, as one byte a token. The LOOKUP most frequent words travel to the
tasks instead, which changes nothing but speed. What is collected or broadcast is bounded: counts
of core bigrams, class tables, and the LOOKUP words.

A null text is empty: it is one end. A null doc_id counts as held out. Rows that repeat or tie are
scored each. A very long text is one row of one byte a token. Other columns of the input, whatever
their names, play no part. Empty tables give empty results; without training texts all words are
unknown.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

CORE = 2048
#: Classes, at most 255: that of the end, that of all rare words while the core is clustered, and
#: those of words.
CLASSES = 64
LOOKUP = 200_000
#: What the move of a word must gain, in nats for each training bigram: the same at every size.
MIN_GAIN = 1e-6
DISCOUNT = 0.75
#: Pseudo-count of each token in the base, and of each class's unknown words in the model.
PSEUDO = 0.1
#: Distinct words that a task holds before it passes its counts on.
MAX_HELD = 300_000
#: Neighbours of rare words that a task holds before it passes them on.
MAX_CONTEXTS = 2_000_000
#: Bytes of texts, or of classes, whose tokens a task holds at once, unless one row has more.
PART = 1 << 20
#: Class code of a word that isn't known yet, or not at all.
NONE = 255
#: Classes 0 and 1.
END, REST = 0, 1


def held_out(id_col: str, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % folds == 0


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _raised(table: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What adding `more` to each row raises its sum of x log x by, and the diagonal's part of it."""
    at = np.flatnonzero(more)
    part = table[:, at]
    raised = _xlogx(part + more[at]) - _xlogx(part)
    diag = np.zeros(len(table))
    diag[at] = raised[at, np.arange(len(at))]
    return raised.sum(1), diag


def exchange(bigrams: np.ndarray, classes: int = CLASSES, fixed: int = 2, sweeps: int | None = None) -> np.ndarray:
    """Class of each item. bigrams: counts, items by items. The last `fixed` items stay alone in
    the first classes. The others start in turn by frequency; each sweep moves every item, most
    frequent first, to the class of the highest likelihood, if that gains MIN_GAIN nats a bigram;
    ties go to the lowest class. Sweeps go on until nothing moves, or as often as said."""
    items = len(bigrams)
    n = bigrams.astype(np.float64)
    words = items - fixed
    order = np.argsort(-(n.sum(0) + n.sum(1))[:words], kind="stable")
    of = np.zeros(items, np.int64)
    of[words:] = np.arange(fixed)
    of[order] = np.arange(words) % (classes - fixed) + fixed
    member = np.zeros((items, classes))
    member[np.arange(items), of] = 1
    right, left = n @ member, n.T @ member  # what follows and what precedes each item, by class
    table = member.T @ right
    least = MIN_GAIN * table.sum()
    active = [int(i) for i in order if n[i].any() or n[:, i].any()]
    while sweeps is None or sweeps > 0:
        moved = 0
        for w in active:
            a, s = of[w], n[w, w]
            r, m = right[w].copy(), left[w].copy()
            r[a] -= s
            m[a] -= s
            table[a] -= r
            table[:, a] -= m
            table[a, a] -= s
            # Rows and columns change only where the word has neighbours; the diagonal comes last.
            by_row, row_diag = _raised(table, r)
            by_col, col_diag = _raised(table.T, m)
            d = np.diag(table)
            tr, tc = table.sum(1) + m, table.sum(0) + r  # a class's own totals keep its bigrams with the word
            gain = by_row - row_diag + by_col - col_diag + _xlogx(d + r + m + s) - _xlogx(d)
            gain += _xlogx(tr) - _xlogx(tr + r.sum() + s) + _xlogx(tc) - _xlogx(tc + m.sum() + s)
            gain[:fixed] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + least:
                b = a
            table[b] += r
            table[:, b] += m
            table[b, b] += s
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= n[:, w]
                right[:, b] += n[:, w]
                left[:, a] -= n[w]
                left[:, b] += n[w]
        if not moved:
            break
        sweeps = None if sweeps is None else sweeps - 1
    return of


@dataclass(frozen=True)
class Affinity:
    """Logarithms by which a word's neighbours tell its class: after[l, k] of class k after l,
    before[k, r] of r after k, and size[k] of the class's tokens."""

    after: np.ndarray
    before: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, table: np.ndarray) -> Affinity:
        """table: class bigrams of the clustered core."""
        t = table + 0.5
        p = np.log(t / t.sum(1, keepdims=True))
        return cls(p, p, np.log(t.sum(0)))

    def best(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Class of each word; left, right: how often each class is before and after it."""
        score = left @ self.after + right @ self.before.T - left.sum(1, keepdims=True) * self.size
        score[:, : REST + 1] = -np.inf
        return np.argmax(score, axis=1)


@dataclass(frozen=True)
class Classes:
    """Logarithms to base 10: trans of transitions, emit of 1 / class total, unknown of an unknown
    word after each class; and then: the class that an unknown word has after each class."""

    trans: np.ndarray
    emit: np.ndarray
    unknown: np.ndarray
    then: np.ndarray


def class_model(table: np.ndarray, totals: np.ndarray, rare_types: np.ndarray) -> Classes:
    """table: class bigrams of all training tokens; totals: tokens of each class; rare_types:
    its distinct words outside the core."""
    d, n = 0.5, len(table)
    words = np.arange(n) > REST
    prior = (table.sum(0) + PSEUDO * (np.arange(n) != REST)) / (table.sum() + PSEUDO * (n - 1))
    total = table.sum(1, keepdims=True)
    rest = np.where(total > 0, d * (table > 0).sum(1, keepdims=True) / np.maximum(total, 1), 1.0)
    trans = np.maximum(table - d, 0) / np.maximum(total, 1) + rest * prior
    sums = totals + PSEUDO * words
    share = np.where(words, (DISCOUNT * rare_types + PSEUDO) / np.maximum(sums, PSEUDO), 0.0)
    with np.errstate(divide="ignore"):
        return Classes(np.log10(trans), -np.log10(np.maximum(sums, PSEUDO)), np.log10(trans @ share), np.argmax(trans * share, axis=1))


def _flat(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """All tokens, the end being empty; where each text's tokens begin."""
    flat: list[bytes] = []
    starts = []
    for t in texts:
        starts.append(len(flat))
        flat += t.encode().lower().split()
        flat.append(b"")
    return flat, np.array(starts, np.int64)


def _parts(whole: Iterator[pa.RecordBatch], col: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in order, in slices of at most PART bytes of the column, or of one row. A token costs
    many times its bytes, so that what is in hand is bounded by these and not by rows."""
    for batch in whole:
        ends = np.cumsum(pc.binary_length(batch.column(col)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
            yield batch.slice(at, to - at)
            at = to


def vocabulary(train: DataFrame) -> DataFrame:
    """(token, c) of each word of the column text; ends aside."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "n"])

        held: Counter[bytes] = Counter()
        for batch in _parts(batches):
            for t in batch.column("text").to_pylist():
                held.update(t.encode().lower().split())
            if len(held) > MAX_HELD:
                yield told()
                held = Counter()
        yield told()

    return train.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


def frequent(lexicon: DataFrame, most: int) -> DataFrame:
    """Rows above a count that at most `most` words reach; the count is found on a histogram of
    logarithms, so that no task sorts the vocabulary."""
    bin_of = F.floor(F.log2("c") * 64).cast("int")
    bins = sorted(lexicon.groupBy(bin_of.alias("b")).count().collect(), reverse=True)  # 64 a doubling
    low, n = None, 0
    for b, count in bins:
        if n + count > most:
            break
        low, n = b, n + count
    return lexicon.where(F.lit(False) if low is None else bin_of >= low)


def item_bigrams(train: DataFrame, core: list[bytes]) -> np.ndarray:
    """Counts of neighbouring items: core words, then the end, then all other words as one; their
    square is all that reaches the driver."""
    k = len(core)
    items = k + 2
    held = train.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(core)} | {b"": k})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = held.value, np.zeros(items * items, np.int64)
        for batch in _parts(batches):
            flat, _ = _flat(batch.column("text").to_pylist())
            at = np.fromiter(map(known.get, flat, repeat(k + 1)), np.int64, len(flat))
            np.add.at(sums, np.r_[k, at[:-1]] * items + at, 1)
        code = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(sums[code])], ["code", "n"])

    got = train.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(items * items, np.float64)
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(items, items)


def rare_classes(train: DataFrame, core: list[bytes], of: np.ndarray, affinity: Affinity) -> DataFrame:
    """(h, cls) of each training word outside the core, h being its hash (xxhash64); words of one
    hash share a class."""
    k, classes = len(core), len(affinity.size)
    held = train.sparkSession.sparkContext.broadcast({w: int(of[i]) for i, w in enumerate(core)} | {b"": END})

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def told() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True)
            h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in names), np.uint64, len(names)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h[code // classes**2]), pa.array((code % classes**2).astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "ctx", "n"])

        known = held.value
        names: dict[bytes, int] = {}
        codes: list[np.ndarray] = []
        for batch in _parts(batches):
            flat, _ = _flat(batch.column("text").to_pylist())
            cls = np.fromiter(map(known.get, flat, repeat(REST)), np.int64, len(flat))
            rare = np.flatnonzero(cls == REST)
            which = np.fromiter((names.setdefault(flat[i], len(names)) for i in rare.tolist()), np.int64, len(rare))
            left, right = np.r_[END, cls[:-1]][rare], cls[np.minimum(rare + 1, len(cls) - 1)]  # an end follows
            codes.append((which * classes + left) * classes + right)
            if len(names) > MAX_HELD or sum(map(len, codes)) > MAX_CONTEXTS:
                yield told()
                names, codes = {}, []
        yield told()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None, None)  # the word in hand, whose rows may go on in the next batch

        def told(h: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(affinity.best(left, right).astype(np.int32))], ["h", "cls"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h, ctx, n = (batch.column(c).to_numpy() for c in ("h", "ctx", "n"))
            new = np.r_[True, h[1:] != h[:-1]]
            word, each = np.cumsum(new) - 1, h[new]
            left, right = (np.bincount(word * classes + c, n, len(each) * classes).reshape(-1, classes) for c in (ctx // classes, ctx % classes))
            if last[0] is not None:
                if last[0] == each[0]:
                    left[0] += last[1]
                    right[0] += last[2]
                else:
                    yield told(np.array([last[0]]), last[1][None], last[2][None])
            if len(each) > 1:
                yield told(each[:-1], left[:-1], right[:-1])
            last = (each[-1], left[-1], right[-1])
        if last[0] is not None:
            yield told(np.array([last[0]]), last[1][None], last[2][None])

    rows = train.mapInArrow(contexts, "h long, ctx int, n int")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(assign, "h long, cls int")


def resolved(texts: DataFrame, lexicon: DataFrame, known: pa.Table, ends: int) -> DataFrame:
    """texts: doc_id, held_out, text. A row for each: doc_id, held_out, n_tokens, n_known, base and
    own (logarithms of the base's and the emissions' counts), and classes, one byte a token, NONE
    for unknown words. known: rows of the lexicon that travel to the tasks."""
    sent = texts.sparkSession.sparkContext.broadcast((known["token"].to_pylist(), known["c"].to_numpy(), known["cls"].to_numpy(), known["core"].to_numpy()))
    cache: dict = {}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, cls, core = sent.value
        if not cache:
            cache["at"] = {w.encode(): i for i, w in enumerate(words)} | {b"": len(words)}
            count = np.r_[c, ends, 0].astype(np.float64)  # then an end, then a word to look up
            cache["base"] = np.log10(count + PSEUDO)
            cache["own"] = np.log10(np.maximum(count - DISCOUNT * ~np.r_[core, True, True].astype(bool), PSEUDO))
            cache["base"][-1] = cache["own"][-1] = 0
            cache["seen"] = (count > 0).astype(np.int64)
            cache["cls"] = np.r_[cls, END, NONE].astype(np.uint8)
        get, absent = cache["at"].get, len(words) + 1
        for batch in _parts(batches):
            flat, starts = _flat(batch.column("text").to_pylist())
            at = np.fromiter(map(get, flat, repeat(absent)), np.int64, len(flat))
            codes = cache["cls"][at]
            n = np.diff(np.r_[starts, len(flat)])
            missing = np.flatnonzero(at == absent)
            owner = np.repeat(np.arange(len(starts)), n)[missing].tolist()
            tokens: list[str] = []
            token_of: list[int] = []
            nth: list[int] = []
            refs: list[list[int]] = [[] for _ in starts]
            doc, names = -1, {}
            for i, d in zip(missing.tolist(), owner, strict=True):
                if d != doc:
                    doc, names = d, {}
                w = flat[i]
                if (r := names.get(w)) is None:
                    r = names[w] = len(names)
                    tokens.append(w.decode())
                    token_of.append(d)
                    nth.append(r)
                refs[d].append(r)
            sums = (np.add.reduceat(cache[x][at], starts) for x in ("seen", "base", "own"))
            uid, k, m = batch.column("uid").to_numpy(), len(tokens), len(starts)
            bounds = [*starts.tolist(), len(flat)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[uid, uid[token_of]] if k else uid),
                    pa.array([*[-1] * m, *nth], pa.int32()),
                    pa.array([*(f" {u}" for u in uid), *tokens]),  # no word holds a space
                    *(pa.concat_arrays([batch.column(c), pa.nulls(k, batch.column(c).type)]) for c in ("doc_id", "held_out")),
                    *(pa.concat_arrays([pa.array(x), pa.nulls(k, pa.array(x).type)]) for x in (n, *sums)),
                    pa.array([*(codes[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)), *[None] * k], pa.binary()),
                    pa.array([*(np.array(r, np.uint32).tobytes() for r in refs), *[None] * k], pa.binary()),
                ],
                ["uid", "nth", "token", "doc_id", "held_out", "n_tokens", "n_known", "base", "own", "codes", "refs"],
            )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: pa.RecordBatch, heads: np.ndarray) -> pa.RecordBatch:
            """rows: those of whole documents, each beginning at one of heads."""
            c, cls = (rows.column(x).fill_null(v).to_numpy(zero_copy_only=False) for x, v in (("c", 0), ("cls", NONE)))
            docs = rows.take(pa.array(heads))
            base = np.where(c > 0, np.log10(c + PSEUDO), np.log10(PSEUDO))
            own = np.where(c > 0, np.log10(np.maximum(c - DISCOUNT * ~rows.column("core").fill_null(False).to_numpy(zero_copy_only=False), PSEUDO)), 0.0)
            sums = [docs.column(x).to_numpy().copy() for x in ("n_known", "base", "own")]
            out = []
            for i, (at, codes, refs) in enumerate(zip(heads.tolist(), docs.column("codes").to_pylist(), docs.column("refs").to_pylist(), strict=True)):
                if refs:
                    place = np.frombuffer(refs, np.uint32).astype(np.int64) + at + 1
                    full = np.frombuffer(codes, np.uint8).copy()
                    full[full == NONE] = cls[place]
                    codes = full.tobytes()
                    for s, v in zip(sums, (c > 0, base, own), strict=True):
                        s[i] += v[place].sum()
                out.append(codes)
            names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "own", "classes"]
            return pa.RecordBatch.from_arrays([*(docs.column(x) for x in names[:3]), *map(pa.array, sums), pa.array(out, pa.binary())], names)

        left = None
        for batch in batches:
            whole = batch if left is None else pa.concat_batches([left, batch])
            heads = np.flatnonzero(whole.column("nth").to_numpy() < 0)
            left = whole.slice(int(heads[-1])) if len(heads) else whole  # may go on in the next batch
            if len(heads) > 1:
                yield told(whole.slice(0, int(heads[-1])), heads[:-1])
        if left is not None and left.num_rows:
            yield told(left, np.array([0]))

    kind = texts.schema["doc_id"].dataType.simpleString()
    rated = texts.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(
        read, f"uid long, nth int, token string, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, own double, codes binary, refs binary"
    )
    found = rated.join(lexicon.select("token", "c", "cls", "core"), "token", "left").drop("token")
    lined = found.repartition("uid").sortWithinPartitions("uid", "nth")
    return lined.mapInArrow(join, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, own double, classes binary")


def class_bigrams(rows: DataFrame, classes: int) -> np.ndarray:
    """rows: the classes of training texts. Counts of neighbouring classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(classes * classes, np.int64)
        for batch in _parts(batches, "classes"):
            cls = np.frombuffer(b"".join(batch.column("classes").to_pylist()), np.uint8).astype(np.int64)
            sums += np.bincount(np.r_[END, cls[:-1]] * classes + cls, minlength=classes * classes)
        code = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(sums[code])], ["code", "n"])

    got = rows.select("classes").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes * classes)
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(classes, classes)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", core_words: int = CORE, classes: int = CLASSES, lookup: int = LOOKUP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
    train = texts.where(~F.col("held_out")).select("text")
    vocab = materialize(vocabulary(train), "vocabulary")
    words, types = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    tokens, types = words + ends, types + (ends > 0)
    core = [r.token.encode() for r in vocab.orderBy(F.desc("c"), "token").limit(core_words).collect()]  # core_words rows at most
    bigrams = item_bigrams(train, core)
    of = exchange(bigrams, classes)
    member = np.zeros((len(of), classes))
    member[np.arange(len(of)), of] = 1
    rare = rare_classes(train, core, of, Affinity.of(member.T @ bigrams @ member))
    named = F.broadcast(spark.createDataFrame([(w.decode(), int(of[i])) for i, w in enumerate(core)], "token string, core_cls int"))
    lexicon = vocab.join(named, "token", "left").withColumn("h", F.xxhash64("token")).join(rare, "h", "left")
    lexicon = materialize(lexicon.select("token", "c", F.coalesce("core_cls", "cls").alias("cls"), F.col("core_cls").isNotNull().alias("core")), "lexicon")
    totals, rare_types = np.zeros(classes), np.zeros(classes)
    for r in lexicon.groupBy("cls").agg(F.sum("c").alias("c"), F.count_if(~F.col("core")).alias("n")).collect():  # a row a class
        totals[r.cls], rare_types[r.cls] = r.c, r.n
    totals[END] = ends
    rows = materialize(resolved(texts, lexicon, frequent(lexicon, lookup).toArrow(), ends), "classes")
    model = class_model(class_bigrams(rows.where(~F.col("held_out")), classes), totals, rare_types)
    base_all = float(np.log10(tokens + PSEUDO * (types + 1)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        then = model.then.tolist()
        for batch in _parts(batches, "classes"):
            n = batch.column("n_tokens").to_numpy()
            cls = np.frombuffer(b"".join(batch.column("classes").to_pylist()), np.uint8).astype(np.int64)
            unknown = np.flatnonzero(cls == NONE)
            for i in unknown.tolist():
                cls[i] = then[cls[i - 1] if i else END]
            before = np.r_[END, cls[:-1]]
            step = model.trans[before, cls] + model.emit[cls]
            step[unknown] = model.unknown[before[unknown]]
            sums = np.add.reduceat(step, np.r_[0, np.cumsum(n)[:-1]])
            base = batch.column("base").to_numpy() - n * base_all
            names = ["doc_id", "held_out", "n_tokens", "n_known"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(base), pa.array(batch.column("own").to_numpy() + sums)], [*names, "base_score", "score"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rated = rows.mapInArrow(rate, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return rated.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
