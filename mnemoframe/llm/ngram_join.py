"""Near-duplicate join: word n-gram sets, MinHash banding, exact checks on full sets.

Words are runs of characters other than white space, as they stand. A text's set holds its n-grams
of SHINGLE words (all its words, if there are fewer); two texts are linked if the Jaccard
similarity of their sets is at least THRESHOLD. A text without words has no links. N-grams are
compared by 64-bit hashes.

1. Each text gives a digest of its set and MinHash band keys. Texts of equal sets form one copy
   class, whose first row (smallest doc_id, null last) stands for it from there on.
2. Band keys of the representatives are shuffled into buckets. A row's home is the largest bucket
   that it is in. Two rows that share a bucket are compared in the unit of their two homes, and
   only there, however many buckets they share; rows meet in a unit only if both lie in a bucket
   that the two homes share. So work follows the buckets, not what they are connected to: a chain
   of texts, each like its neighbours alone, has one small unit a link.
3. Units are cut into blocks of BLOCK sets; every pair of blocks is one piece of work, in which all
   its pairs are verified on their full sets at once. It yields counts and a spanning forest, never
   the pairs, so that large groups of near copies run on many tasks.
4. Connected components of the verified forests are the classes.

Copies are never compared with each other. No bucket, unit or partner count is capped. The number
of links needs every pair within a bucket once, which is the one cost that grows with the square
of a bucket's distinct texts. Banding finds a pair at the threshold with probability RECALL at
least, a more similar one with more.

Empty tables give empty results; rows that repeat are copies; null texts are empty; ties of doc_id
go by row. A very long text is one set like any other, in the task that reads it. Other columns of
the input, whatever their names, play no part, and pass through ``deduplicate`` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TMP, broadcast_if_small, materialize, text_or_empty
from .components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Most MinHash values a text; of the band shapes that reach RECALL within it, the one with the
#: longest bands is taken, as it has the fewest false candidates.
MAX_HASHES = 128
BLOCK = 256
#: Rows of keys up to which a side is broadcast.
MAX_BROADCAST = 200_000
#: Words whose hashes a worker remembers.
MAX_MEMO = 400_000
SEED = 20240101


def band_shape(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows a band) with 1 - (1 - threshold^rows)^bands >= recall."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("no band shape reaches that recall with so few hashes")


_memo: dict[bytes, int] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-grams."""
    import xxhash

    global _memo
    tokens = text.encode().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(_memo) > MAX_MEMO:
        _memo = {}
    got = _memo
    for w in tokens:
        if w not in got:
            got[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(got.__getitem__, tokens), np.uint64, len(tokens))
    n = min(size, len(tokens))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        return np.unique(_mixed(out))


def minhash_bands(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 1024):
            np.minimum(low, (shingles[i : i + 1024, None] * a + b).min(axis=0), out=low)
        rows = low.reshape(bands, -1)
        key = np.arange(1, bands + 1, dtype=np.uint64)
        for i in range(rows.shape[1]):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(row, id, key, digest, n, bands) as a stored table. key: MD5 of the text; digest: of the
    set, unique to the row if the set is empty."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                digest, n, keys = [], [], []
                for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    s = shingle_set(text, shingle)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else f"none-{row}")
                    keys.append(minhash_bands(s, a, b, bands) if len(s) else np.empty(0, np.int64))
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("key"), pa.array(digest), pa.array(n, pa.int32()), lists], ["row", "id", "key", "digest", "n", "bands"])

    text = text_or_empty(text_col)
    rows_in = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("key"), text.alias("text"))
    kind = rows_in.schema["id"].dataType.simpleString()
    return materialize(rows_in.mapInArrow(sign, f"row long, id {kind}, key string, digest string, n int, bands array<long>"), "signatures")


def verify_block(x: list[tuple], y: list[tuple] | None, threshold: float) -> tuple[dict[int, list[int]], list[tuple[int, int]]]:
    """x, y: (row, copies, set). Links within x, or from x to y: for each row with links, the
    linked documents and linked texts; and a forest that spans them."""
    every = x if y is None else [*x, *y]
    sizes = np.array([len(m[2]) for m in every])
    flat = np.concatenate([m[2] for m in every])
    owner = np.repeat(np.arange(len(every)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    shared = ~(new & np.r_[new[1:], True])
    term, owner = (np.cumsum(new) - 1)[shared], owner[shared]
    term = np.cumsum(np.r_[True, term[1:] != term[:-1]]) - 1 if len(term) else term
    nx = len(x)
    across = np.zeros((nx, nx if y is None else len(y)), np.float32)
    for at in range(0, int(term[-1]) + 1 if len(term) else 0, 4096):
        lo, hi = np.searchsorted(term, (at, at + 4096))
        m = np.zeros((len(every), 4096), np.float32)
        m[owner[lo:hi], term[lo:hi] - at] = 1
        across += m[:nx] @ (m[:nx] if y is None else m[nx:]).T
    sx, sy = sizes[:nx], sizes[:nx] if y is None else sizes[nx:]
    # Comparing whole numbers keeps pairs that lie exactly at the threshold.
    union = sx[:, None] + sy[None, :] - across
    linked = across >= union * threshold - 1e-6
    linked &= across > 0
    right = x if y is None else y
    if y is None:
        np.fill_diagonal(linked, False)
    counts: dict[int, list[int]] = {}
    for members, others, hits in ((x, right, linked),) if y is None else ((x, right, linked), (right, x, linked.T)):
        copies = np.array([o[1] for o in others])
        for i in np.flatnonzero(hits.any(axis=1)):
            counts[members[i][0]] = [int(copies[hits[i]].sum()), int(hits[i].sum())]
    parent = {r: r for r in counts}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    for i in np.flatnonzero(linked.any(axis=1)):
        u = find(x[i][0])
        for j in np.flatnonzero(linked[i]):
            v = find(right[j][0])
            if u != v:
                u, v = min(u, v), max(u, v)
                parent[v] = u
    return counts, [(r, find(r)) for r in parent if find(r) != r]


def work_units(keyed: DataFrame) -> DataFrame:
    """keyed: (row, band), a row for each band key. (row, h0, h1, side) for each unit of two homes
    that the row takes part in, being of the home h0 (side 0) or h1 (side 1)."""
    sizes = materialize(keyed.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
    shared = materialize(keyed.join(sizes, "band"), "buckets")
    homes = shared.groupBy("row").agg(F.max(F.struct("c", "band")).alias("m")).select("row", F.col("m.band").alias("home"))
    member = materialize(shared.join(homes, "row").select("row", "band", "home"), "members")
    others = member.groupBy("band", "home").agg(F.lit(1).alias("_")).select("band", F.col("home").alias("other"))
    met = member.join(others, "band").select("row", F.least("home", "other").alias("h0"), F.greatest("home", "other").alias("h1"), (F.col("home") > F.col("other")).cast("int").alias("side"))
    return met.distinct()


def blocked(units: DataFrame) -> DataFrame:
    """work_units() with n0 and n1, the blocks of either side of the unit."""
    count = lambda side: F.greatest(F.lit(1), F.ceil(F.count_if(F.col("side") == side) / BLOCK)).cast("int")
    unit = units.groupBy("h0", "h1").agg(count(0).alias("n0"), count(1).alias("n1"), F.count("*").alias("n")).where("n > 1").drop("n")
    return units.join(broadcast_if_small(unit, "blocks", MAX_BROADCAST), ["h0", "h1"])


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of docs: row, id, key, class_row (shared by the class), kept (the
    smallest id of its class, then the smallest row), n_links (linked documents, copies counted)
    and n_text_links (linked texts other than its own)."""
    bands, rows = band_shape(threshold, recall)
    signed = signatures(docs, id_col, text_col, shingle, bands, rows)
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row"))["row"]
    classes = materialize(signed.groupBy("digest").agg(first.alias("rep"), F.count("*").alias("copies")), "classes")
    reps = signed.join(classes.withColumnRenamed("digest", f"{TMP}d"), (F.col("row") == F.col("rep")) & (F.col("digest") == F.col(f"{TMP}d")))
    units = blocked(materialize(work_units(reps.select("row", F.explode("bands").alias("band"))), "units"))
    dealt = units.groupBy("row").agg(F.collect_list(F.struct("h0", "h1", "side", "n0", "n1")).alias("units"))
    wanted = dealt.join(reps.select("row", "id", "key", "copies"), "row")
    verified = _verified(docs, broadcast_if_small(wanted, "candidates", MAX_BROADCAST), id_col, text_col, shingle, threshold)
    counts = verified.where("other is null").groupBy("row").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    edges = verified.where("other is not null").select(F.col("row").alias("u"), F.col("other").alias("v"))
    roots = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("root"))
    of_rep = classes.join(roots, "rep", "left").join(counts.withColumnRenamed("row", "rep"), "rep", "left")
    of_rep = of_rep.select("digest", F.coalesce("root", "rep").alias("class_row"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    placed = materialize(signed.select("row", "id", "key", "digest").join(of_rep, "digest").drop("digest"), "placed")
    heads = materialize(placed.groupBy("class_row").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row")).alias("head"), F.count("*").alias("class_size")), "heads")
    return placed.join(heads, "class_row").select("row", "id", "key", "class_row", F.col("head.id").alias("class_id"), "class_size", "n_links", "n_text_links", (F.col("row") == F.col("head.row")).alias("kept"))


def _verified(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float) -> DataFrame:
    """wanted: row, id, key, copies, units. (row, other, links, texts): counts of links, or edges
    where other isn't null."""
    unit = "array<struct<h0: long, h1: long, side: int, n0: int, n1: int>>"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                made = [shingle_set(t, shingle).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("units", "row", "copies")), pa.array(made, pa.binary())], ["units", "row", "copies", "set"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, x, y, seen = None, [], [], set()

        def done() -> pa.RecordBatch:
            one = key[0] == key[1] and key[2] == key[3]
            counts, edges = verify_block(x, None if one else y, threshold) if x and (one or y) else ({}, [])
            rows = [*counts, *(e[0] for e in edges)]
            other = [*([None] * len(counts)), *(e[1] for e in edges)]
            links = [*(c[0] for c in counts.values()), *([0] * len(edges))]
            texts = [*(c[1] for c in counts.values()), *([0] * len(edges))]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (rows, other, links, texts)], ["row", "other", "links", "texts"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("h0", "h1", "b0", "b1", "left", "row", "copies", "set")]
            for h0, h1, b0, b1, left, row, copies, made in zip(*cols, strict=True):
                if (h0, h1, b0, b1) != key:
                    if key is not None:
                        yield done()
                    key, x, y, seen = (h0, h1, b0, b1), [], [], set()
                if row not in seen:  # rows that repeat come once for each
                    seen.add(row)
                    (x if left else y).append((row, copies, np.frombuffer(made, np.uint64)))
        if key is not None:
            yield done()

    text = text_or_empty(text_col)
    read = docs.select(F.col(id_col).alias(f"{TMP}id"), F.md5(text.cast("binary")).alias(f"{TMP}key"), text.alias("text"))
    found = read.join(wanted, (F.col(f"{TMP}key") == F.col("key")) & F.col(f"{TMP}id").eqNullSafe(F.col("id")))
    whole = found.select("units", "row", "copies", "text").mapInArrow(sets, f"units {unit}, row long, copies long, set binary")
    each = whole.select("row", "copies", "set", F.explode("units").alias("u")).select("row", "copies", "set", "u.*")
    own = F.pmod(F.xxhash64("row"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int")
    facing = F.when((F.col("side") == 1) | (F.col("h0") == F.col("h1")), F.col("n0")).otherwise(F.col("n1"))
    pairs = each.withColumn("own", own).withColumn("to", F.explode(F.sequence(F.lit(0), facing - 1)))
    alike = F.col("h0") == F.col("h1")
    b0 = F.when(alike, F.least("own", "to")).otherwise(F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("to")))
    b1 = F.when(alike, F.greatest("own", "to")).otherwise(F.when(F.col("side") == 0, F.col("to")).otherwise(F.col("own")))
    dealt = pairs.select("h0", "h1", b0.alias("b0"), b1.alias("b1"), F.when(alike, F.col("own") == b0).otherwise(F.col("side") == 0).alias("left"), "row", "copies", "set")
    lined = dealt.repartition("h0", "h1", "b0", "b1").sortWithinPartitions("h0", "h1", "b0", "b1")
    return materialize(lined.mapInArrow(work, "row long, other long, links long, texts long"), "verified")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (smallest doc_id of its class), class_size,
    n_links, n_text_links, kept."""
    got = near_classes(docs, id_col, text_col, **options)
    return got.select(F.col("id").alias("doc_id"), "class_id", "class_size", "n_links", "n_text_links", "kept")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row of each class, the first by doc_id (null last), with all its columns."""
    placed = near_classes(docs, id_col, text_col, **options)
    one = placed.groupBy("id", "key").agg(F.max("kept").alias("stays"), F.count("*").alias("same"))
    marks = materialize(one.where("not stays or same > 1"), "marks")
    gone = broadcast_if_small(marks.where("not stays").select(F.col("id").alias(f"{TMP}i"), F.col("key").alias(f"{TMP}k")), "gone", MAX_BROADCAST)
    key = F.md5(text_or_empty(text_col).cast("binary"))
    keyed = docs.withColumn(f"{TMP}key", key)
    left = keyed.join(gone, (F.col(f"{TMP}k") == F.col(f"{TMP}key")) & F.col(f"{TMP}i").eqNullSafe(F.col(id_col)), "left_anti")
    if not marks.where("stays").isEmpty():  # whole rows that repeat, of which one stays
        nth = F.row_number().over(Window.partitionBy(id_col, f"{TMP}key").orderBy(F.lit(0)))
        left = left.withColumn(f"{TMP}nth", nth).where(F.col(f"{TMP}nth") == 1)
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
