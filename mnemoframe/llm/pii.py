"""Personal data: spans that generators propose, boosted trees rate and calibrated cutoffs select.

1. Base spans are what strict patterns match: e-mail addresses, IP addresses, card numbers that pass
   Luhn's check, phone numbers with a plus. They always stay.
2. Generators with high recall propose spans that may overlap: addresses with spelt-out or bracketed
   signs, and all runs of consecutive groups of digits that could be a card, a phone or an IP
   address, within longer runs of digits too.
3. Gradient boosted trees rate each by features of its format (digits, groups, separators, checks)
   and its context (characters around it, digits near by, how the word before leans). They are
   fitted on all texts, each distinct one once, and all spans that are proposed in them. What is
   right is known there: base spans as they stand, and renditions of them, planted in their own
   places (spelt out, regrouped, beside another number), as against decoys planted likewise (a
   broken check digit, a part above 255, dates, versions) and all else that the generators propose.
   By a hash of the texts, words are weighed on one eighth, and the trees are fitted on five more.
4. On the other two eighths, each kind gets the lowest cutoff
   above which the share of right spans is TARGET at least, by the lower end of its Wilson interval.
   A kind without such a cutoff gets none, and adds nothing.
5. Of the spans above their kind's cutoff, the best rated are added first; none overlaps a base span
   or another added one.

A null or empty text has no spans. Rows that repeat or tie are read each; a text's spans depend on
nothing but the text and the set of all texts. A very long text is read
whole, in time that grows with its length. doc_id and other columns of the input, whatever their
names, play no part. Empty tables give empty results; without base spans nothing is learnt or added.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Copies of each text with planted renditions.
PLANTED = 6
TARGET = 0.9
#: Weight of proposals that are no base spans, where nothing was planted: they may be right.
UNSURE = 0.1
#: Different spans in a leaf, at least.
LEAST = 10
#: Texts that a word must stand before a span in, to count.
MIN_CUES = 10
#: Of one-sided 95 % intervals.
Z = 1.645
TREES, DEPTH, BINS, STEP = 30, 4, 64, 0.3
#: Margins are told apart to one part in so many, and rows of a part of the training set, at most.
GRID = 1024
PART = 50_000
#: Proposals that are rated together.
BATCH = 4096
ROWS = pa.schema([("h", pa.int64()), ("nth", pa.int64()), ("kind", pa.int32()), ("x", pa.list_(pa.float64())), ("cue", pa.string()), ("label", pa.int32()), ("weight", pa.float64())])

# The strict patterns. An address is found from its @, as its first part is whatever
# stands before it; digits can't begin within a run, which would match no other way.
_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGITS = re.compile(r"[0-9]+")
#: Digits with up to three signs between them.
_REGION = re.compile(r"[0-9]+(?:[ ().\-/\[\]]{1,3}[0-9]+)*")
_AT = re.compile(r"@|\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s", re.I)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\sdot\s|\[\.\])[A-Za-z0-9-]+)+", re.I)
_LAST_WORD = re.compile(r"[^\W\d_]+(?=[\W\d_]*$)")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    own = sum(map(int, digits[-1::-2]))
    return (own + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def only_digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[Span]:
    """(kind, start, end), by kind and start."""
    out: list[Span] = []
    last = 0
    for m in _AFTER_AT.finditer(text) if "@" in text else ():
        start = _local_start(text, m.start(), last)
        if start < m.start():
            last = m.end()
            out.append((EMAIL, start, last))
    for m in _IP.finditer(text):
        if all(map(octet, m[0].split("."))):
            out.append((IP, *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append((CARD, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(only_digits(m[0])) <= 15:
            out.append((PHONE, *m.span()))
    return out


def proposals(text: str) -> Iterator[Span]:
    """All that may be personal data, overlapping; a few for each character of the text at most."""
    for m in _AT.finditer(text):
        start = _local_start(text, m.start(), 0)
        if start < m.start() and (d := _DOMAIN.match(text, m.end())):
            yield EMAIL, start, d.end()
    for m in _REGION.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [g.span() for g in _DIGITS.finditer(text, *m.span())]
        for i, (start, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):
                n += groups[j][1] - groups[j][0]
                if n > 19:
                    break
                end = groups[j][1]
                if j == i + 3 and all(e - s <= 3 for s, e in groups[i : j + 1]):
                    yield IP, start, end
                if 13 <= n:
                    yield CARD, start, end
                if 7 <= n <= 15:
                    first = start
                    while first and text[first - 1] in "+(" and start - first < 2:
                        first -= 1
                    yield PHONE, first, end


def _class(c: str) -> int:
    """0 none or white space, 1 digit, 2 letter, 3 plus, 4 sign inside numbers, 5 other."""
    if not c or c.isspace():
        return 0
    if c.isdigit():
        return 1
    return 2 if c.isalpha() else 3 if c == "+" else 4 if c in ".-/()[]@:" else 5


FEATURES = 30


def features(text: str, span: Span) -> list[float]:
    """Of format and context, all numbers."""
    kind, start, end = span
    s = text[start:end]
    groups = _DIGITS.findall(s)
    digits, sizes = "".join(groups), [len(g) for g in groups] or [0]
    seps = [x for x in _DIGITS.split(s)[1:-1]]
    before, after = text[max(0, start - 16) : start], text[end : end + 16]
    inside = [c for c in s if not c.isdigit()]
    tail = re.split(r"[^A-Za-z0-9]+", s)[-1]
    return [
        kind, len(s), len(digits), luhn(digits) if digits else 0, len(groups), min(sizes), max(sizes), sizes[0], sizes[-1], len(set(seps)),
        max(map(len, seps), default=0), sum(not octet(g) for g in groups), sum(len(g) > 1 and g[0] == "0" for g in groups), s[:1] == "+", s[:1] == "(" or s[:2] == "+(", s.count("(") == s.count(")"),
        sum(c.isalpha() for c in inside), s.count("@"), s.count("."), len(tail) * tail.isalpha(), s.count("-"), s.count(" "),
        _class(before[-1:]), _class(before[-2:-1]), _class(after[:1]), _class(after[1:2]), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), int(digits[0]) if digits else -1, len(set(digits)),
    ]


def cue(text: str, start: int) -> str:
    """The word before a span, within a few characters."""
    m = _LAST_WORD.search(text[max(0, start - 24) : start])
    return m[0].lower() if m else ""


Pieces = list[tuple[str, int | None]]


def rendition(kind: int, s: str, other: tuple[str, int | None], pick: random.Random) -> Pieces:
    """A base span written another way, beside another number, or a decoy like it: pieces of text,
    with their kind where they are personal data."""
    d, own, no = only_digits(s), (s, kind), None
    space, beside = (" ", no), [[other, (" ", no), (s, kind)], [(s, kind), (" ", no), other]]
    if kind == EMAIL:
        local, domain = s.split("@", 1)
        at, dot = pick.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", ".")])
        return pick.choice([[(local + at + domain.replace(".", dot), kind)], [(f"{local}@{pick.randint(0, 9)}.{pick.randint(0, 20)}.{pick.randint(0, 9)}", no)], [other, space, own]])
    if kind == IP:
        a = s.split(".")
        wild = [*a[:3], str(pick.randint(256, 999))]
        pick.shuffle(wild)
        return pick.choice([[("[.]".join(a), kind)], [(".".join(wild), no)], [(f"{s}.{pick.randint(1, 99)}", no)], *beside])
    if kind == CARD:
        broken = d[:-1] + str((int(d[-1]) + pick.randint(1, 9)) % 10)
        fours = lambda x: pick.choice([".", " - ", "  ", "/", " ", "-"]).join(x[i : i + 4] for i in range(0, len(x), 4))
        return pick.choice([[(fours(d), kind)], [(fours(broken), no)], [(broken, no)], [(broken, no), space, own], [own, space, (broken, no)], *beside])
    last, sep = d[-10:], pick.choice(["-", ".", " "])
    body = [f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}{sep}{last[3:6]}{sep}{last[6:]}"]
    day = f"{pick.randint(1990, 2030)}-{pick.randint(1, 12):02}-{pick.randint(1, 28):02}"
    right = [[(x, kind)] for x in (*body, f"00{d[:-10] or '1'} {body[1]}", f"+{d[:-10] or '1'}/{last[:3]}/{last[3:]}")]
    decoys = (f"{day} {pick.randint(0, 23):02}.{pick.randint(0, 59):02}", f"{day}/{day}", f"{pick.randint(1000, 9999)}.{pick.randint(100000, 999999)}", " ".join(str(pick.randint(100, 9999)) for _ in range(3)))
    return pick.choice([*right, *([(x, no)] for x in decoys), *beside])


def planted(text: str, spans: list[Span], pick: random.Random) -> tuple[str, set[Span], list[Span]]:
    """The text with renditions and decoys in the places of its base spans; the spans that are right;
    the places."""
    numbers = [(text[s:e], k) for k, s, e in spans if k != EMAIL]
    out, right, places, at, n = [], set(), [], 0, 0
    for kind, start, end in sorted(spans, key=lambda x: x[1:]):
        if start < at:
            continue
        other = pick.choice([*numbers, (str(pick.randint(100, 999_999)), None), (str(pick.randint(10**15, 10**16 - 1)), None)])
        out.append(text[at:start])
        n += start - at
        first = n
        for piece, of in rendition(kind, text[start:end], other, pick):
            if of is not None:
                right.add((of, n, n + len(piece)))
            out.append(piece)
            n += len(piece)
        places.append((kind, first, n))
        at = end
    return "".join([*out, text[at:]]), right, places


def labelled(text: str) -> Iterator[tuple[Span, list[float], str, int, float]]:
    """Proposals in a text and in its planted copies, with what they are and how sure that is."""
    spans = base_spans(text)
    yield from rated(text, set(spans), spans)
    if spans:
        pick = random.Random(zlib.crc32(text.encode()))
        for _ in range(PLANTED):
            made, right, places = planted(text, spans, pick)
            yield from rated(made, right | {s for s in base_spans(made) if not Taken(places).meets(*s[1:])}, places)


def rated(text: str, right: set[Span], places: list[Span]) -> Iterator[tuple[Span, list[float], str, int, float]]:
    known = Taken(places)
    for span in proposals(text):
        yield span, features(text, span), cue(text, span[1]), int(span in right), 1.0 if span in right or known.meets(*span[1:]) else UNSURE


class Trees:
    """The fitted trees as arrays, read from their printed form, so that tasks need no JVM."""

    def __init__(self, trees: list[str], weights: list[float]) -> None:
        self.nodes, self.weights = [self._read(t) for t in trees], weights

    @staticmethod
    def _read(text: str) -> tuple[np.ndarray, ...]:
        feature, threshold, left, right, value = [], [], [], [], []
        lines = iter(re.findall(r"If \(feature (\d+) <= (\S+)\)|(Else)|Predict: (\S+)", text))

        def node() -> int:
            f, t, _, v = next(lines)
            at = len(feature)
            for column, x in ((feature, int(f or 0)), (threshold, float(t or 0)), (left, at), (right, at), (value, float(v or 0))):
                column.append(x)
            if f:
                left[at] = node()
                next(lines)  # Else
                right[at] = node()
            return at

        node()
        return tuple(map(np.array, (feature, threshold, left, right, value)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.nodes, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            out += weight * value[at]
        return np.round(out * GRID) / GRID


class Model:
    """Trees, how words before spans lean, and each kind's cutoff."""

    def __init__(self, trees: Trees, cues: dict[tuple[int, str], float], cutoffs: list[float]) -> None:
        self.trees, self.cues, self.cutoffs = trees, cues, cutoffs

    def added(self, text: str, base: list[Span]) -> list[Span]:
        known, good, rest = set(base), [], proposals(text)
        while some := list(islice(rest, BATCH)):
            x = np.array([[*features(text, s), self.cues.get((s[0], cue(text, s[1])), 0.0)] for s in some], float)
            margin = self.trees.margin(x)
            good += [(-m, s) for m, s in zip(margin.tolist(), some, strict=True) if m >= self.cutoffs[s[0]] and s not in known]
        taken, out = Taken(base), []
        for _, span in sorted(good):
            if taken.take(*span[1:]):
                out.append(span)
        return out


class Taken:
    """Places that are taken, as separate stretches in order."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts, self.ends = [], []
        for _, start, end in sorted(spans, key=lambda s: s[1:]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)  # the first that begins behind it
        return k > 0 and self.ends[k - 1] > start

    def take(self, start: int, end: int) -> bool:
        """Whether the stretch was free; it isn't any more."""
        if self.meets(start, end):
            return False
        k = bisect_left(self.starts, end)
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


def wilson(right: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = right / n
    return (p + Z * Z / (2 * n) - Z * np.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def cutoff(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, target: float = TARGET) -> float:
    """The lowest margin from which on the share of right spans is sure to be the target: half way to
    the next one below, or even odds where all of them are right enough."""
    order = np.argsort(-margin, kind="stable")
    m, right, n = margin[order], np.cumsum((label * weight)[order]), np.cumsum(weight[order])
    last = np.r_[m[1:] != m[:-1], True] if len(m) else np.zeros(0, bool)  # ties count as one
    good = np.flatnonzero(last & (wilson(right, n) >= target)) if len(m) else []
    if not len(good):
        return np.inf
    k = good[-1]
    return float((m[k] + m[k + 1]) / 2) if k + 1 < len(m) else min(0.0, float(m[k]))


def fit(texts: DataFrame) -> Model | None:
    """The model of all texts (text); None where there is nothing to learn."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if h in seen:
                    continue
                seen.add(h)
                told = enumerate(labelled(text))
                while some := list(islice(told, BATCH)):
                    yield pa.RecordBatch.from_pylist([{"h": h, "nth": k, "kind": span[0], "x": [float(v) for v in x], "cue": word, "label": label, "weight": weight} for k, (span, x, word, label, weight) in some], ROWS)

    found = texts.select(F.xxhash64("text").alias("h"), "text").mapInArrow(rows, "h long, nth long, kind int, x array<double>, cue string, label int, weight double")
    found = materialize(found.dropDuplicates(["h", "nth"]), "spans")  # a text may be in many tasks
    fold = F.pmod("h", F.lit(8))  # 0 and 1 for cutoffs, 2 for words, the rest for trees
    lean = found.where(fold == 2)
    leans = lean.where("cue != ''").groupBy("kind", "cue").agg(F.avg("label").alias("m"), F.count_distinct("h").alias("n")).where(F.col("n") >= MIN_CUES)
    means = {r.kind: r.m for r in lean.groupBy("kind").agg(F.avg("label").alias("m")).collect()}
    cues = {(r.kind, r.cue): r.m * r.n / (r.n + MIN_CUES) - means[r.kind] * r.n / (r.n + MIN_CUES) for r in leans.collect()}  # words before numbers in MIN_CUES texts

    def with_cue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [[*f, cues.get((k, w), 0.0)] for f, k, w in zip(batch.column("x").to_pylist(), batch.column("kind").to_pylist(), batch.column("cue").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("kind"), pa.array(x, pa.list_(pa.float64())), batch.column("label").cast(pa.float64()), batch.column("weight")], ["h", "kind", "x", "label", "weight"])

    # Spans that look alike weigh as one row with a count, in a fixed order, so that a fit can be repeated.
    ready = found.mapInArrow(with_cue, "h long, kind int, x array<double>, label double, weight double")
    weight = F.round(F.sum("weight"), 6).alias("weight")  # whatever the order they are added in
    known = ready.where(fold > 2).groupBy("x", "label").agg(weight)
    known = materialize(known.repartition(4 + found.count() // PART, "x").sortWithinPartitions("x", "label"), "train")
    if known.select("label").distinct().count() < 2:
        return None
    # Spark looks for thresholds among bins * bins rows; more bins than it needs make that all rows.
    bins = max(BINS, math.isqrt(known.count()) + 1)
    gbt = GBTClassifier(featuresCol="v", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=bins, stepSize=STEP, minInstancesPerNode=LEAST, seed=11)
    got = gbt.fit(known.withColumn("v", array_to_vector("x")))
    trees = Trees([t.toDebugString for t in got.trees], list(got.treeWeights))

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, FEATURES + 1)
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(trees.margin(x)), batch.column("label"), batch.column("weight")], ["kind", "margin", "label", "weight"])

    # A row for each margin of the grid at most, whatever the spans are.
    right = F.round(F.sum(F.col("label") * F.col("weight")), 6).alias("right")
    held = ready.where(fold < 2).mapInArrow(margins, "kind int, margin double, label double, weight double").groupBy("kind", "margin").agg(right, weight).toPandas()
    cuts = []
    for k in range(len(KINDS)):
        m, good, w = held[held["kind"] == k].sort_values("margin")[["margin", "right", "weight"]].to_numpy().T
        cuts.append(cutoff(m, good / w, w))
    return Model(trees, cues, cuts)


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


COLUMNS = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans of each row of docs."""
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(fit(texts.select("text")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            counts, base, every = [], [], []
            for text in batch.column("text").to_pylist():
                found = base_spans(text)
                counts.append([sum(k == kind for k, _, _ in found) for kind in range(len(KINDS))])
                base.append(as_text(found))
                every.append(as_text(found + model.added(text, found)) if model else base[-1])
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(n[:, k]) for k in range(len(KINDS))), pa.array(base, pa.string()), pa.array(every, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    got = texts.mapInArrow(read, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def redact(text: str, spans: str) -> str:
    """The text with each span's kind in its place; of spans that overlap, the first holds."""
    out, at = [], 0
    for start, end, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join([*out, text[at:]])
