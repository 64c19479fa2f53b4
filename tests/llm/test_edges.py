"""Every operator on empty tables and on odd rows: defined results, no failure."""

import pytest

from mnemoframe.llm import chat_format, exact_dedup, lm_scoring, mixing, ngram_join, packing, quality_rules, sharding, substring_dedup, toxicity

from . import data

LABELS = [(1, 1, 0), (7, 0, 1), (None, 1, 1), (9, None, None), (9, 1, 0), (11, 1, 1)]
PER_ROW = {
    "exact": lambda s, d, some: exact_dedup.decisions(d),
    "lm": lambda s, d, some: lm_scoring.score(d),
    "shard": lambda s, d, some: sharding.shard(d, n_shards=3, n_slots=16),
    "quality": lambda s, d, some: quality_rules.decisions(d, data.labels(s, LABELS if some else ())),
    "toxic": lambda s, d, some: toxicity.score(d, data.labels(s, LABELS if some else ())),
    "substring": lambda s, d, some: substring_dedup.remove_repeats(d),
    "mix": lambda s, d, some: mixing.decisions(d),
    "near": lambda s, d, some: ngram_join.decisions(d),
}
WHOLE = {
    "exact": lambda s, d, some: exact_dedup.deduplicate(d),
    "quality": lambda s, d, some: quality_rules.keep_good(d, data.labels(s, LABELS if some else ())),
    "near": lambda s, d, some: ngram_join.deduplicate(d),
    "mix": lambda s, d, some: mixing.mix(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_per_row(spark, name):
    assert PER_ROW[name](spark, data.empty(spark), False).count() == 0
    rows = data.odd(spark)
    got = PER_ROW[name](spark, rows, True).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in rows.collect())
    assert len(PER_ROW[name](spark, rows, False).collect()) == 15


def test_values_of_odd_rows(spark):
    rows = data.odd(spark)
    exact = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in PER_ROW["exact"](spark, rows, True).collect()}
    assert {(1, 3, 6, False), (3, 3, 6, True), (11, 11, 2, True), (12, 11, 2, False), (10, 10, 4, True), (4, 10, 4, False), (None, 3, 6, False), (None, 10, 4, False)} <= exact
    lm = {r.doc_id: (r.n_tokens, r.held_out) for r in PER_ROW["lm"](spark, rows, True).collect() if r.doc_id is not None}
    assert lm[5][0] == lm[4][0] == lm[10][0] == 1 and lm[7][0] == 20_001 and lm[11][0] == 3
    assert all(r.held_out for r in PER_ROW["lm"](spark, rows, True).collect() if r.doc_id is None)
    sizes = {r.doc_id: r["size"] for r in PER_ROW["shard"](spark, rows, True).collect() if r.doc_id is not None}
    assert sizes[4] == sizes[5] == 16 and sizes[11] == 23
    near = {r.doc_id: (r.class_id, r.n_links) for r in PER_ROW["near"](spark, rows, True).collect() if r.doc_id is not None}
    assert near[1] == near[9] == (1, 5) and near[7] == (7, 1) and near[8] == (7, 1) and near[11] == (11, 1) and near[4] == (4, 0)
    spans = {r.doc_id: (r.n_removed, r.n_sentences) for r in PER_ROW["substring"](spark, rows, True).collect() if r.doc_id is not None}
    assert spans[4] == spans[10] == (0, 0) and spans[9] == (0, 1)  # one sentence is no run
    taken = [r for r in PER_ROW["mix"](spark, rows, True).collect() if r["size"] == 0]
    assert len(taken) == 4 and all(r.taken == 0 for r in taken)


@pytest.mark.parametrize("name", WHOLE)
def test_whole_rows(spark, name):
    none = WHOLE[name](spark, data.empty(spark), False)
    assert none.columns == data.empty(spark).columns and none.count() == 0
    rows = data.odd(spark)
    got = WHOLE[name](spark, rows, True)
    assert got.dtypes == rows.dtypes
    ids = [r.doc_id for r in got.collect()]
    if name == "exact":
        # Null and blank texts are equal; 3 has the most code points of its group.
        assert sorted(map(str, ids)) == sorted(map(str, [3, 10, 7, 8, 11, 13]))
    if name == "near":
        # A text without words is like no other.
        assert sorted(map(str, ids)) == sorted(map(str, [1, 4, 5, None, 10, 7, 11, 13]))
    if name == "quality":
        assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, None, 7, 8, 9, 9]))


def test_packing(spark):
    assert packing.pack(data.empty(spark)).count() == 0
    got = packing.pack(data.odd(spark)).collect()
    assert {(str(r.doc_id), r.piece) for r in got if r.doc_id in (None, 4, 5)} == {("None", 0), ("4", 0), ("5", 0)}
    assert sum(r.length for r in got if r.doc_id == 4) == 1


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat_format.read_back(chat_format.format_conversations(spark.createDataFrame([], schema))).count() == 0
    clash = spark.createDataFrame([(1, 0, "user", "x", "c", True)], f"{schema}, formatted string, loss_mask boolean")
    assert chat_format.read_back(chat_format.format_conversations(clash)).first().n_turns == 1
    rows = [(1, 0, "user", None), (1, None, None, "first"), (None, 0, "assistant", "x"), (2, 0, "assistant", ""), (2, 0, "assistant", "long " * 30_000), (3, 1, "user", "same"), (3, 1, "user", "same")]
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(rows, schema))).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, None: 1, 2: 2, 3: 2}
    assert got[2].loss_chars == 150_000 and got[None].loss_chars == 1 and got[3].loss_chars == 0
