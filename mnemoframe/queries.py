"""The registered queries of the memory engine, on whole tables, and their SQL.

conversations are messages: a scope is conv_id modulo 10, a turn a minute, a conversation a day.
benchmark are questions, asked every three days. documents with labels are graded records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import session
from .functions import keys, text, times, vectors
from .operators import cache, context, embedding, evaluate, prompts, retrieve, summaries, units
from .plans import experiment, systems
from .sources import codecs, sinks, tables
from .streaming import incremental

TOP_K = 20
#: Tokens of a chunk.
CHUNK = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            out = sql
            for name, part in (("facts", FACTS), ("chunks", CHUNKS), ("pack", PACK), ("base", BASE), ("placed", PLACED), ("most", str(CHUNK))):
                out = out.replace(f"{{{name}}}", part)
            SQL[f.__name__] = out
        return f

    return add


BASE = r"""
    msgs AS (SELECT CAST(conv_id % 10 AS VARCHAR) AS scope_id, conv_id AS conv_ix, turn + 1 AS msg_ix, role, text AS content,
        TIMESTAMP '2024-01-01' + to_days(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS BIGINT)) AS ts FROM conversations),
    units AS (SELECT scope_id, conv_ix, msg_ix, scope_id || ':c' || conv_ix || ':m' || msg_ix AS unit_id, trim(content, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_raw, ts, role
        FROM msgs WHERE trim(content) <> ''),
    q AS (SELECT item_id AS question_id, CAST(item_id % 10 AS VARCHAR) AS scope_id, text AS query_text, TIMESTAMP '2024-01-01' + to_days(CAST(item_id * 3 AS INTEGER)) AS qt FROM benchmark),
    toks AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_+\-'']*')) AS w FROM units),
    qtoks AS (SELECT *, list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9][a-z0-9_+\-'']*')) AS w FROM q),
    scored AS (SELECT question_id, unit_id, u.text, u.ts_raw, u.ts, round(len(list_intersect(qtoks.w, u.w)) / sqrt(greatest(1, len(qtoks.w))::DOUBLE * greatest(1, len(u.w))), 9) AS score
        FROM qtoks JOIN toks u ON qtoks.scope_id = u.scope_id AND u.ts <= qtoks.qt),
    ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, unit_id) AS rank FROM scored) WHERE rank <= 20),
    lines AS (SELECT *, '- ' || ts_raw || ': ' || text AS block, len(regexp_extract_all('- ' || ts_raw || ': ' || text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]')) AS tok FROM ranked),
    packed AS (SELECT * FROM (SELECT *, sum(tok) OVER (PARTITION BY question_id ORDER BY rank) AS so_far FROM lines) WHERE so_far <= 400),
    contexts AS (SELECT q.question_id, coalesce(string_agg(block, chr(10) ORDER BY rank), '') AS context, CAST(coalesce(sum(tok), 0) AS BIGINT) AS context_tokens, count(block) AS context_blocks,
        count(DISTINCT ts_raw) AS context_timepoints FROM q LEFT JOIN packed USING (question_id) GROUP BY q.question_id)"""


# A greedy packing in SQL: of the words i to n, a segment that begins at i ends before the first
# word whose running sum passes the limit; the chain of beginnings is followed by recursion.
PACK = r"""
    ws AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM src),
    cum AS (SELECT k, i, word, sum(len(regexp_extract_all(word, '[A-Za-z0-9]+|[^A-Za-z0-9\s]'))) OVER (PARTITION BY k ORDER BY i) AS c, len(regexp_extract_all(word, '[A-Za-z0-9]+|[^A-Za-z0-9\s]')) AS t FROM ws),
    nxt AS (SELECT a.k, a.i, coalesce(min(b.i), max(a.n) + 1) AS j FROM (SELECT *, max(i) OVER (PARTITION BY k) AS n FROM cum) a LEFT JOIN cum b ON a.k = b.k AND b.i > a.i AND b.c - (a.c - a.t) > 24 GROUP BY ALL),
    chain(k, i, j) AS (SELECT k, i, j FROM nxt WHERE i = 1 UNION ALL SELECT n.k, n.i, n.j FROM chain c JOIN nxt n ON n.k = c.k AND n.i = c.j),
    cut AS (SELECT chain.k, chain.i, trim(array_to_string(w[chain.i:chain.j - 1], ' '), ' ,;') AS segment FROM chain JOIN src USING (k)),
    segs AS (SELECT k, segment, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS "at" FROM cut WHERE segment <> '')"""
# A conversation's chunks, by the same recursion over messages.
CHUNKS = r"""
    said AS (SELECT scope_id, conv_ix, msg_ix, role, trim(content, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_raw FROM msgs WHERE trim(content, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
    mt AS (SELECT *, row_number() OVER (PARTITION BY scope_id, conv_ix ORDER BY msg_ix) AS i, len(regexp_extract_all('speaker: ' || role || ' content: ' || content, '[A-Za-z0-9]+|[^A-Za-z0-9\s]')) AS t FROM said),
    mc AS (SELECT *, sum(t) OVER (PARTITION BY scope_id, conv_ix ORDER BY i) AS c, max(i) OVER (PARTITION BY scope_id, conv_ix) AS n FROM mt),
    mn AS (SELECT a.scope_id, a.conv_ix, a.i, coalesce(min(b.i), max(a.n) + 1) AS j FROM mc a LEFT JOIN mc b ON a.scope_id = b.scope_id AND a.conv_ix = b.conv_ix AND b.i > a.i AND b.c - (a.c - a.t) > {most} GROUP BY ALL),
    walk(scope_id, conv_ix, i, j, chunk) AS (SELECT scope_id, conv_ix, i, j, 1 FROM mn WHERE i = 1 UNION ALL SELECT n.scope_id, n.conv_ix, n.i, n.j, walk.chunk + 1 FROM walk JOIN mn n ON n.scope_id = walk.scope_id AND n.conv_ix = walk.conv_ix AND n.i = walk.j),
    chunks AS (SELECT mc.scope_id, mc.conv_ix, mc.msg_ix, mc.role, mc.content, mc.ts_raw, walk.chunk FROM mc JOIN walk ON mc.scope_id = walk.scope_id AND mc.conv_ix = walk.conv_ix AND mc.i >= walk.i AND mc.i < walk.j)"""
FACTS = r"""
    sents AS (SELECT scope_id, conv_ix, chunk, msg_ix, role, unnest(parts) AS s, generate_subscripts(parts, 1) AS si FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(content, '\s+', ' ', 'g')), '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ,;')), lambda x: x <> '') AS parts FROM chunks)),
    src AS (SELECT scope_id || '|' || conv_ix || '|' || chunk || '|' || role || '|' || msg_ix || '|' || si AS k, scope_id, conv_ix, chunk, role, msg_ix, si, string_split(s, ' ') AS w FROM sents),
    {pack},
    spans AS (SELECT scope_id, conv_ix, chunk, max(ts_raw) AS last_raw, list('c' || conv_ix || ':m' || msg_ix ORDER BY msg_ix) AS source_ids FROM chunks GROUP BY ALL),
    own AS (SELECT scope_id, conv_ix, chunk, role, arg_max(ts_raw, msg_ix) AS ts_raw FROM chunks GROUP BY ALL),
    facts AS (SELECT src.scope_id, src.conv_ix, src.chunk, src.role, segment, row_number() OVER (PARTITION BY src.scope_id, src.conv_ix, src.chunk, src.role ORDER BY src.msg_ix, src.si, "at") AS n FROM segs JOIN src USING (k)),
    made AS (SELECT f.scope_id, f.scope_id || ':c' || f.conv_ix || ':fact_' || f.chunk || '_' || n || ':speaker_' || substr(sha1('"' || role || '"'), 1, 8) AS unit_id,
        CASE WHEN starts_with(lower(segment), lower(role || ' said')) THEN segment ELSE role || ' said ' || segment END AS text, own.ts_raw, spans.last_raw AS available_at_raw, array_to_string(spans.source_ids, ',') AS source_ids
        FROM facts f JOIN spans USING (scope_id, conv_ix, chunk) JOIN own USING (scope_id, conv_ix, chunk, role))"""


# As BASE, with conversations numbered from 1 in each scope, as files give them.
PLACED = BASE.replace("conv_id AS conv_ix, turn + 1 AS msg_ix", "dense_rank() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id) AS conv_ix, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS msg_ix, conv_id, turn")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    ts = F.expr("make_timestamp(2024, 1, 1, 0, 0, 0) + make_dt_interval(cast(conv_id as int), 0, cast(turn as int))")
    return c.select(
        (F.col("conv_id") % 10).cast("string").alias("scope_id"), F.col("conv_id").alias("conv_ix"), (F.col("turn") + 1).alias("msg_ix"), F.concat_ws(":", "conv_id", "turn").alias("message_id"), "role",
        F.lit(None).cast("string").alias("speaker"), F.col("text").alias("content"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("ts_raw"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    at = F.expr("make_timestamp(2024, 1, 1, 0, 0, 0) + make_dt_interval(cast(item_id * 3 as int))")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), (F.col("item_id") % 10).cast("string").alias("scope_id"), F.col("text").alias("query_text"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("query_time_raw"))


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return units.raw_units(messages(spark, sf))


def lexical(spark: SparkSession, sf: str) -> DataFrame:
    scored = retrieve.lexical_scores(questions(spark, sf), raw(spark, sf))
    return retrieve.ranked(scored.withColumn("score", F.round("score", 9)), TOP_K)


def graded(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", "source", evaluate.category("lang").alias("category"), (F.col("quality") == 1).alias("passed"), F.col("quality").cast("double").alias("score"))


@query("WITH {base} SELECT scope_id, unit_id, text, ts_raw, lower(role) AS role FROM units")
def raw_units(spark, sf):
    return raw(spark, sf).select("scope_id", "unit_id", "text", "ts_raw", "role")


@query(r"""WITH {base}, m AS (SELECT unit_id, conv_ix, msg_ix, text, CASE WHEN msg_ix % 5 = 0 THEN '' ELSE ' ' || role END AS role, CASE msg_ix % 3 WHEN 0 THEN 'User' WHEN 1 THEN 'Ann' END AS speaker FROM units)
    SELECT unit_id, text, lower(trim(coalesce(nullif(role, ''), speaker, ''))) AS role FROM m WHERE lower(trim(coalesce(nullif(role, ''), speaker, ''))) = 'user'""")
def role_filter(spark, sf):
    """Messages with padding, some without a role, some with a speaker of another name."""
    role = F.when(F.col("msg_ix") % 5 == 0, "").otherwise(F.concat(F.lit(" "), "role"))
    speaker = F.when(F.col("msg_ix") % 3 == 0, "User").when(F.col("msg_ix") % 3 == 1, "Ann")
    padded = messages(spark, sf).withColumns({"role": role, "speaker": speaker, "content": F.concat(F.lit(" \n"), "content", F.lit("  "))})
    return units.raw_units(padded, ["User"]).select("unit_id", "text", "role")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_+\-'']*'))) AS n_lexical FROM documents""")
def token_sets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.token_count("text").alias("n_tokens"), F.size(text.lexical_set("text")).cast("long").alias("n_lexical"))


@query("""WITH {base} SELECT q.question_id, count(u.unit_id) AS unit_count, count(u.unit_id) FILTER (u.ts <= q.qt) AS snapshot_unit_count, count(u.unit_id) FILTER (u.ts > q.qt) AS hidden_unit_count
    FROM q LEFT JOIN units u USING (scope_id) GROUP BY q.question_id""")
def snapshot_counts(spark, sf):
    return retrieve.snapshot_counts(questions(spark, sf), raw(spark, sf))


@query("WITH {base} SELECT question_id, unit_id, score, rank FROM ranked")
def lexical_topk(spark, sf):
    return lexical(spark, sf).select("question_id", "unit_id", "score", "rank")


@query("WITH {base} SELECT question_id, unit_id, score, rank FROM ranked")
def lexical_postings(spark, sf):
    """The same through the inverted index, however few the pairs are."""
    got = retrieve.lexical_top(questions(spark, sf), raw(spark, sf), TOP_K, direct_pairs=0, digits=9)
    return got.select("question_id", "unit_id", "score", "rank")


@query("WITH {base} SELECT * FROM contexts")
def context_pack(spark, sf):
    return context.pack_lines(questions(spark, sf), lexical(spark, sf), 400, joiner="\n", style="list")


@query("WITH {base} SELECT question_id, string_agg('- ' || strftime(ts, '%Y-%m-%d') || ': ' || text, chr(10) ORDER BY rank) AS context FROM ranked GROUP BY question_id")
def render_flat(spark, sf):
    line = F.concat(F.lit("- "), context.full_date(), F.lit(": "), "text")
    rows = lexical(spark, sf).withColumn("line", line)
    return rows.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("context"))


@query()
def adaptive_prune(spark, sf):
    return context.pack_each(questions(spark, sf), lexical(spark, sf), context.adaptive, 300)


@query()
def merged_timeline(spark, sf):
    return context.pack_each(questions(spark, sf), lexical(spark, sf), context.merged, 300, by_time=True)


@query("SELECT item_id AS question_id, '' AS context, CAST(0 AS BIGINT) AS context_tokens, CAST(0 AS BIGINT) AS context_blocks, CAST(0 AS BIGINT) AS context_timepoints FROM benchmark")
def null_system(spark, sf):
    return systems.NullMemory().read(questions(spark, sf), raw(spark, sf))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    refs = F.slice(text.lexical_tokens("query_text"), 1, 3)
    asked = questions(spark, sf).select("question_id", refs.alias("references"))
    return systems.fixed_query_answers(context_pack(spark, sf)).join(asked, "question_id")


@query(r"""WITH {base}, r AS (SELECT question_id, lower(context) AS c, list_slice(regexp_extract_all(lower(query_text), '[a-z0-9][a-z0-9_+\-'']*'), 1, 3) AS refs FROM contexts JOIN q USING (question_id)),
    h AS (SELECT question_id, len(refs) AS n, len(list_filter(refs, lambda x: contains(c, x))) AS k FROM r)
    SELECT question_id, CASE WHEN n > 0 THEN CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END END AS any_score, CASE WHEN n > 0 THEN k / n END AS all_score, CASE WHEN n > 0 THEN k = n END AS all_passed FROM h""")
def contains_eval(spark, sf):
    rows = _answers(spark, sf)
    some, every = evaluate.contains(), evaluate.contains(need_all=True)
    return rows.select("question_id", some["score"].cast("double").alias("any_score"), every["score"].alias("all_score"), every["passed"].alias("all_passed"))


@query(r"""SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\s+', ' ', 'g')))""")
def contains_docs(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id"), F.col("text").alias("reference"))
    return evaluate.containing(table(spark, sf, "documents").select("doc_id", "text"), b)


@query("""SELECT lang AS category, count(*) AS question_count, count(quality) AS evaluated_count, count(*) FILTER (quality = 1) AS passed_count, round(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 9) AS accuracy, round(avg(quality), 9) AS avg_score
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def category_accuracy(spark, sf):
    got = evaluate.accuracy(graded(spark, sf), "category")
    return got.withColumns({c: F.round(c, 9) for c in ("accuracy", "avg_score")})


@query("""SELECT count(*) AS question_count, count(quality) AS evaluated_count, count(*) FILTER (quality = 1) AS passed_count, round(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 9) AS accuracy, round(avg(quality), 9) AS avg_score
    FROM documents LEFT JOIN labels USING (doc_id)""")
def overall_accuracy(spark, sf):
    return evaluate.accuracy(graded(spark, sf)).withColumns({c: F.round(c, 9) for c in ("accuracy", "avg_score")})


@query("""SELECT lang AS category, count(*) AS question_count, count(quality) AS evaluated_count, count(*) FILTER (quality = 1) AS passed_count, round(count(*) FILTER (quality = 1) / nullif(count(quality), 0), 9) AS accuracy, round(avg(quality), 9) AS avg_score
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def accuracy_rollup(spark, sf):
    return evaluate.accuracy_all(graded(spark, sf)).withColumns({c: F.round(c, 9) for c in ("accuracy", "avg_score")})


@query(r"""WITH {base}, t AS (SELECT unit_id, sha1(unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_+\-'']*'))) AS h FROM units)
    SELECT unit_id, CAST(('0x' || substr(h, 7, 2)) AS INTEGER) AS bucket, CAST(sum(1 - 2 * (CAST(('0x' || substr(h, 9, 2)) AS INTEGER) % 2)) AS BIGINT) AS weight FROM t GROUP BY ALL""")
def hash_embed_buckets(spark, sf):
    rows = raw(spark, sf).select("unit_id", F.explode(vectors.hashed(F.col("text"))).alias("x"))
    return rows.groupBy("unit_id", F.col("x.b").alias("bucket")).agg(F.sum("x.s").cast("long").alias("weight"))


@query(r"""WITH {base}, uh AS (SELECT unit_id, sha1(unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_+\-'']*'))) AS h FROM units),
    qh AS (SELECT question_id, sha1(unnest(regexp_extract_all(lower(query_text), '[a-z0-9][a-z0-9_+\-'']*'))) AS h FROM q),
    uv AS (SELECT unit_id, substr(h, 7, 2) AS b, sum(1 - 2 * (CAST(('0x' || substr(h, 9, 2)) AS INTEGER) % 2))::DOUBLE AS w FROM uh GROUP BY ALL),
    qv AS (SELECT question_id, substr(h, 7, 2) AS b, sum(1 - 2 * (CAST(('0x' || substr(h, 9, 2)) AS INTEGER) % 2))::DOUBLE AS w FROM qh GROUP BY ALL),
    un AS (SELECT unit_id, sqrt(sum(w * w)) AS n FROM uv GROUP BY unit_id), qn AS (SELECT question_id, sqrt(sum(w * w)) AS n FROM qv GROUP BY question_id),
    pairs AS (SELECT question_id, unit_id FROM q JOIN units u ON q.scope_id = u.scope_id AND u.ts <= q.qt),
    dots AS (SELECT question_id, unit_id, sum(qv.w * uv.w) AS d FROM pairs JOIN qv USING (question_id) JOIN uv USING (unit_id) WHERE qv.b = uv.b GROUP BY ALL),
    s AS (SELECT p.question_id, p.unit_id, round(CASE WHEN coalesce(un.n, 0) = 0 OR coalesce(qn.n, 0) = 0 THEN 0.0 ELSE coalesce(d, 0) / (un.n * qn.n) END, 9) + 0.0 AS score
        FROM pairs p LEFT JOIN dots USING (question_id, unit_id) LEFT JOIN un USING (unit_id) LEFT JOIN qn USING (question_id))
    SELECT question_id, unit_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, unit_id) AS rank FROM s) WHERE rank <= 20""")
def hash_dense_topk(spark, sf):
    scored = retrieve.hashed_scores(questions(spark, sf), raw(spark, sf)).withColumn("score", F.round("score", 9) + 0.0)
    return retrieve.ranked(scored, TOP_K).select("question_id", "unit_id", "score", "rank")


@query(r"""WITH RECURSIVE {base}, {chunks}, {facts}, uh AS (SELECT unit_id, sha1(unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_+\-'']*'))) AS h FROM made),
    qh AS (SELECT question_id, sha1(unnest(regexp_extract_all(lower(query_text), '[a-z0-9][a-z0-9_+\-'']*'))) AS h FROM q),
    uv AS (SELECT unit_id, substr(h, 7, 2) AS b, sum(1 - 2 * (CAST(('0x' || substr(h, 9, 2)) AS INTEGER) % 2))::DOUBLE AS w FROM uh GROUP BY ALL),
    qv AS (SELECT question_id, substr(h, 7, 2) AS b, sum(1 - 2 * (CAST(('0x' || substr(h, 9, 2)) AS INTEGER) % 2))::DOUBLE AS w FROM qh GROUP BY ALL),
    un AS (SELECT unit_id, sqrt(sum(w * w)) AS n FROM uv GROUP BY unit_id), qn AS (SELECT question_id, sqrt(sum(w * w)) AS n FROM qv GROUP BY question_id),
    pairs AS (SELECT question_id, unit_id FROM q JOIN made u ON q.scope_id = u.scope_id AND CAST(u.available_at_raw AS TIMESTAMP) <= q.qt),
    dots AS (SELECT question_id, unit_id, sum(qv.w * uv.w) AS d FROM pairs JOIN qv USING (question_id) JOIN uv USING (unit_id) WHERE qv.b = uv.b GROUP BY ALL),
    s AS (SELECT p.question_id, p.unit_id, CASE WHEN coalesce(un.n, 0) = 0 OR coalesce(qn.n, 0) = 0 THEN 0.0 ELSE coalesce(d, 0) / (un.n * qn.n) END AS score
        FROM pairs p LEFT JOIN dots USING (question_id, unit_id) LEFT JOIN un USING (unit_id) LEFT JOIN qn USING (question_id))
    SELECT question_id, unit_id, round(score, 9) + 0.0 AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, unit_id) AS rank FROM s) WHERE rank <= 20""")
def fact_memory_topk(spark, sf):
    """FactMemory from messages to ranks: chunks, sentences, visible facts, hashed vectors."""
    memory = systems.FactMemory(chunk_tokens=CHUNK, top_k=TOP_K)
    ranked = memory.rank(questions(spark, sf), memory.build(messages(spark, sf)))
    return ranked.select("question_id", "unit_id", (F.round("score", 9) + 0.0).alias("score"), "rank")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS question_id, b.vec_id AS unit_id, round(list_cosine_similarity(a.e, b.e), 6) + 0.0 AS score FROM v a, v b WHERE a.vec_id % 20 = 0)
    SELECT question_id, unit_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, unit_id) AS rank FROM s) WHERE rank <= 20""")
def vector_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    asks = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    scored = retrieve.nearest(asks, e.select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector")), TOP_K)
    return retrieve.ranked(scored.withColumn("score", F.round("score", 6) + 0.0), TOP_K).select("question_id", "unit_id", "score", "rank")


@query(r"""WITH {base}, s AS (SELECT unit_id, string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM units),
    e AS (SELECT unit_id, unnest(list_filter(list_transform(parts, lambda x: trim(x, ' ,;')), lambda x: x <> '')) AS sentence FROM s)
    SELECT unit_id, sentence, count(*) AS n FROM e GROUP BY ALL""")
def sentence_split(spark, sf):
    return raw(spark, sf).select("unit_id", F.explode(text.sentences("text")).alias("sentence")).groupBy("unit_id", "sentence").agg(F.count("*").alias("n"))


@query(r"""WITH RECURSIVE {base}, src AS (SELECT unit_id AS k, string_split(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ,;'), ' ') AS w FROM units), {pack} SELECT k AS unit_id, "at", segment FROM segs""")
def word_pack(spark, sf):
    return raw(spark, sf).select("unit_id", F.posexplode(text.segments("text")).alias("at", "segment"))


@query("WITH RECURSIVE {base}, {chunks} SELECT scope_id, conv_ix, msg_ix, chunk FROM chunks")
def chunking(spark, sf):
    return units.chunked(messages(spark, sf), CHUNK).select("scope_id", "conv_ix", "msg_ix", "chunk")


@query("WITH RECURSIVE {base}, {chunks}, {facts} SELECT scope_id, unit_id, text, ts_raw, available_at_raw, source_ids FROM made")
def fact_units(spark, sf):
    made = units.fact_units(messages(spark, sf), CHUNK)
    return made.select("scope_id", "unit_id", "text", "ts_raw", "available_at_raw", F.array_join("source_ids", ",").alias("source_ids"))


@query(r"""WITH RECURSIVE {base}, {chunks}, {facts},
    s AS (SELECT scope_id, CAST(sum(len(regexp_extract_all(content, '[A-Za-z0-9]+|[^A-Za-z0-9\s]'))) AS BIGINT) AS source_tokens FROM msgs GROUP BY scope_id),
    u AS (SELECT scope_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\s]')) AS n FROM made)
    SELECT scope_id, any_value(source_tokens) AS source_tokens, count(*) AS unit_count, CAST(sum(n) AS BIGINT) AS unit_tokens, round(avg(n), 9) AS avg_unit_tokens, max(n) AS max_unit_tokens, round(sum(n) / any_value(source_tokens), 9) AS compression,
        0 AS generation_prompt_tokens, 0 AS generation_completion_tokens, 0 AS generation_total_tokens, 0 AS generation_call_count, 0.0 AS generation_to_unit
    FROM u JOIN s USING (scope_id) GROUP BY scope_id""")
def fact_token_stats(spark, sf):
    m = messages(spark, sf)
    return units.token_stats(m, units.fact_units(m, CHUNK)).withColumns({c: F.round(c, 9) for c in ("avg_unit_tokens", "compression")})


@query("WITH {base} SELECT scope_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_raw, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_raw FROM msgs GROUP BY scope_id")
def min_max_ts_raw(spark, sf):
    rows = messages(spark, sf).withColumn("ord", F.struct("conv_ix", "msg_ix"))
    return rows.groupBy("scope_id").agg(times.earliest("ts_raw", "ord").alias("first_raw"), times.latest("ts_raw", "ord").alias("last_raw"))


@query("""WITH {base}, f AS (SELECT scope_id, conv_ix, role, min(msg_ix) AS pos FROM msgs GROUP BY ALL) SELECT scope_id, conv_ix, string_agg(role || ' said', '; ' ORDER BY pos) AS phrases FROM f GROUP BY ALL""")
def speaker_phrases(spark, sf):
    return units.speaker_phrases(messages(spark, sf).withColumn("speaker", F.col("role")))


@query("""WITH {base}, k AS (SELECT unit_id, sha256(unit_id || '|' || text) AS cache_key, msg_ix FROM units), c AS (SELECT DISTINCT cache_key FROM k WHERE msg_ix % 2 = 1)
    SELECT k.cache_key, c.cache_key IS NOT NULL AS hit, count(*) AS n FROM k LEFT JOIN c USING (cache_key) GROUP BY ALL""")
def stage_cache_split(spark, sf):
    k = raw(spark, sf).select("unit_id", F.sha2(F.concat_ws("|", "unit_id", "text"), 256).alias("cache_key"), F.regexp_extract("unit_id", r"m(\d+)$", 1).cast("int").alias("m"))
    held = k.where("m % 2 = 1").select("cache_key", F.current_timestamp().alias("written_at"))
    hits, misses = cache.split(k, held)
    both = hits.select("cache_key", F.lit(True).alias("hit")).unionByName(misses.select("cache_key", F.lit(False).alias("hit")))
    return both.groupBy("cache_key", "hit").agg(F.count("*").alias("n"))


@query("""WITH {base}, i AS (SELECT DISTINCT scope_id FROM msgs), a AS (SELECT scope_id, count(*) AS n FROM units GROUP BY scope_id)
    SELECT count(*) AS item_count, count(n) AS artifact_count, count(*) - count(n) AS failed_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS unit_count, round(coalesce(sum(n) / nullif(count(n), 0), 0.0), 9) AS avg_units_per_item, 0 AS cache_hits, 0 AS cache_misses FROM i LEFT JOIN a USING (scope_id)""")
def build_summary(spark, sf):
    items = messages(spark, sf).select(F.col("scope_id").alias("item_id")).distinct()
    made = keys.artifact_ids(raw(spark, sf), "raw", systems.RawMemory())
    return summaries.build_summary(items, made).withColumn("avg_units_per_item", F.round("avg_units_per_item", 9))


@query("""WITH {base} SELECT count(*) AS question_count, count(context) AS answered_count, CAST(sum(context_tokens) AS BIGINT) AS context_tokens, round(sum(context_tokens) / count(*), 9) AS avg_context_tokens, 0 AS cache_hits, 0 AS cache_misses FROM contexts""")
def answer_summary(spark, sf):
    return summaries.answer_summary(systems.fixed_query_answers(context_pack(spark, sf))).withColumn("avg_context_tokens", F.round("avg_context_tokens", 9))


def _replies() -> Column:
    n = F.col("conv_id") % 6
    forms = ['{"label": "CORRECT"}', "It is wrong", "The answer is INCORRECT.", '```json\n{"label": "WRONG", "reason": "x"}\n```', "", "correct, I think"]
    out = F.lit(forms[-1])
    for i, f in enumerate(forms[:-1]):
        out = F.when(n == i, F.lit(f)).otherwise(out)
    return out


@query("""SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'WRONG' WHEN 2 THEN 'CORRECT' WHEN 3 THEN 'WRONG' WHEN 4 THEN 'WRONG' ELSE 'CORRECT' END AS turn_label,
    CASE conv_id % 6 WHEN 0 THEN 'CORRECT' WHEN 5 THEN 'CORRECT' ELSE 'WRONG' END AS persona_label FROM conversations""")
def judge_labels(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", _replies().alias("reply"))
    return rows.select("conv_id", "turn", evaluate.parse_turn_label("reply").alias("turn_label"), evaluate.parse_persona_label("reply").alias("persona_label"))


@query("""SELECT conv_id, turn, text AS cleaned FROM conversations""")
def clean_replies(spark, sf):
    reply = F.concat(F.lit("<think>a\nb</think> noise <|message|>"), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", prompts.clean_reply(reply).alias("cleaned"))


@query("""WITH r AS (SELECT conv_id, turn, dense_rank() OVER (ORDER BY conv_id) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS m FROM conversations) SELECT conv_id, turn FROM r WHERE i <= 30 AND m <= 2""")
def head_limits(spark, sf):
    """Conversations numbered over the whole table; the limit is Dataset.head's."""
    c = table(spark, sf, "conversations")
    ids = c.select(F.col("conv_id").alias("item_id")).distinct()
    at = session.scratch(spark, "items")  # ranges are sampled, and numbered() reads its input twice
    ids.repartitionByRange("item_id").sortWithinPartitions("item_id").withColumn("ord", F.monotonically_increasing_id()).write.parquet(at)
    items = tables.numbered(spark.read.parquet(at), "item_ord").drop("ord")
    q = c.select(F.col("conv_id").alias("item_id"), F.concat_ws(":", "conv_id", "turn").alias("question_id"), F.col("turn").alias("q_ord"))
    got = tables.Dataset("d", items, q, q, q).head(30, 2)
    return got.questions.select(F.col("item_id").alias("conv_id"), F.col("q_ord").alias("turn"))


@query("""WITH {base}, e AS (SELECT q.question_id, u.unit_id FROM q JOIN units u ON q.scope_id = u.scope_id WHERE u.conv_ix = q.question_id AND u.msg_ix <= 3), j AS (SELECT e.question_id, r.rank FROM e LEFT JOIN ranked r USING (question_id, unit_id))
    SELECT question_id, round(count(rank) / count(*), 9) AS recall, count(rank) > 0 AS hit, round(coalesce(1 / min(rank), 0.0), 9) AS reciprocal_rank FROM j GROUP BY question_id""")
def evidence_recall(spark, sf):
    u = raw(spark, sf).select("scope_id", "unit_id", F.regexp_extract("unit_id", r"c(\d+):m", 1).cast("long").alias("conv"), F.regexp_extract("unit_id", r"m(\d+)$", 1).cast("long").alias("m"))
    gold = questions(spark, sf).join(u, ["scope_id"]).where("conv = question_id and m <= 3").groupBy("question_id").agg(F.collect_set("unit_id").alias("evidence_ids"))
    found = lexical(spark, sf).select("question_id", "rank", F.array("unit_id").alias("source_ids"))
    return evaluate.evidence_recall(found, gold, TOP_K).withColumns({c: F.round(c, 9) for c in ("recall", "reciprocal_rank")})


@query("""WITH {base}, w AS (SELECT question_id, unit_id, rank <= 5 AS l, rank % 2 = 0 AS r FROM ranked) SELECT count(*) AS question_count, count(*) FILTER (l AND r) AS both, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (r AND NOT l) AS right_only, count(*) FILTER (NOT l AND NOT r) AS neither FROM w""")
def paired_runs(spark, sf):
    rows = lexical(spark, sf).select(F.col("question_id").alias("item_id"), F.col("unit_id").alias("question_id"), "rank")
    return summaries.paired(rows.withColumn("passed", F.col("rank") <= 5), rows.withColumn("passed", F.col("rank") % 2 == 0))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def windowed_events(spark, sf):
    return incremental.windowed_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 6))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
    n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM n GROUP BY user_id, k""")
def event_sessions(spark, sf):
    return incremental.sessions(table(spark, sf, "events"))


@query()
def judged_answers(spark, sf):
    """The whole path with stub models: prompts, replies, cleaning, judging."""
    q = questions(spark, sf)
    reads = systems.RawMemory(top_k=5, budget=200).read(q, raw(spark, sf)).join(q, "question_id")
    answered = systems.model_answers(reads, lambda ps: [f"<think>{len(p)}</think>Final answer: {p.split('Question: ')[-1][:20]}" for p in ps])
    rows = answered.select(
        F.lit("all").alias("item_id"), F.col("question_id").cast("string").alias("question_id"), F.lit("locomo").alias("dataset"), F.col("query_text").alias("question"), F.col("final_answer").alias("answer"),
        F.array("query_text").alias("references"), F.array().cast("array<string>").alias("incorrect_answers"), (F.col("question_id") % 6).cast("string").alias("question_type"),
    )
    return evaluate.judge(rows, lambda ps: ['{"label": "CORRECT"}' if len(p) % 2 else '{"label": "WRONG"}' for p in ps]).select("question_id", "skip_reason", "judge_label", "score", "passed")


def dataset(spark: SparkSession, sf: str) -> tables.Dataset:
    """The tables as a dataset: an item for each scope, its conversations numbered from 1. What a
    question's first three words are is its reference."""
    rank = F.dense_rank().over(Window.partitionBy("scope_id").orderBy("conv_ix"))
    nth = F.row_number().over(Window.partitionBy("scope_id", "conv_ix").orderBy("msg_ix"))
    m = messages(spark, sf).withColumns({"at": rank, "nth": nth}).drop("conv_ix", "msg_ix").withColumnsRenamed({"at": "conv_ix", "nth": "msg_ix"})
    m = m.withColumns({"item_id": F.col("scope_id"), "session_id": F.lit(None).cast("string"), "metadata": F.to_json(F.struct("message_id"))}).select(*tables.MESSAGES)
    q = questions(spark, sf).select(
        F.col("scope_id").alias("item_id"), F.col("question_id").cast("string").alias("question_id"), (F.row_number().over(Window.partitionBy("scope_id").orderBy("question_id")) - 1).alias("q_ord"), F.col("query_text").alias("query"),
        "query_time_raw", F.lit(None).cast("string").alias("question_type"), F.to_json(F.struct((F.col("question_id") % 3).cast("string").alias("category"))).alias("metadata"),
    )
    refs = F.slice(text.lexical_tokens("query"), 1, 3)
    labels = q.select("item_id", "question_id", F.to_json(refs).alias("reference"), refs.alias("references"), F.array(F.lit("e1")).alias("evidence_ids"), F.lit(None).cast("string").alias("evidence_level"), F.array().cast("array<string>").alias("incorrect_answers"), F.lit("{}").alias("metadata"))
    scopes = m.select("item_id").distinct()
    items = scopes.select(F.col("item_id").cast("long").alias("item_ord"), "item_id", F.col("item_id").alias("subject_id"), F.lit("{}").alias("metadata"))
    return tables.Dataset("tables", items, m, q.join(scopes, "item_id", "left_semi"), labels.join(scopes, "item_id", "left_semi"))


def from_file(spark: SparkSession, sf: str) -> tables.Dataset:
    """dataset() written as a unified file and read again."""
    at = session.scratch(spark, "unified")
    sinks.write_unified(dataset(spark, sf), at)
    return tables.read_unified(spark, at)


@query("""WITH {placed} SELECT scope_id AS item_id, conv_ix, msg_ix, conv_id || ':' || turn AS message_id, role, trim(content, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_raw FROM msgs""")
def unified_messages(spark, sf):
    """A unified file, written and read: messages."""
    return from_file(spark, sf).messages.select("item_id", "conv_ix", "msg_ix", "message_id", "role", "content", "ts_raw")


@query(r"""WITH {placed}, s AS (SELECT DISTINCT scope_id FROM msgs) SELECT scope_id AS item_id, CAST(question_id AS VARCHAR) AS question_id, row_number() OVER (PARTITION BY scope_id ORDER BY question_id) - 1 AS q_ord, query_text AS query, strftime(qt, '%Y-%m-%dT%H:%M:%S') AS query_time_raw,
    CAST(question_id % 3 AS VARCHAR) AS question_type, array_to_string(list_slice(regexp_extract_all(lower(query_text), '[a-z0-9][a-z0-9_+\-'']*'), 1, 3), '|') AS refs, 'e1' AS evidence FROM q JOIN s USING (scope_id)""")
def unified_questions(spark, sf):
    """A unified file, written and read: questions with their labels."""
    d = from_file(spark, sf)
    rows = d.questions.join(d.labels.select("item_id", "question_id", F.array_join("references", "|").alias("refs"), F.array_join("evidence_ids", "|").alias("evidence")), evaluate.KEYS)
    return rows.select("item_id", "question_id", "q_ord", "query", "query_time_raw", "question_type", "refs", "evidence")


@query("""WITH {base} SELECT scope_id, unit_id, text, ts_raw, role, 'c' || conv_ix || ':m' || msg_ix AS source FROM units""")
def unit_codec(spark, sf):
    """Units as JSON and back."""
    rows = units.raw_units(messages(spark, sf).withColumn("message_id", F.lit(None).cast("string")))
    return codecs.decode(codecs.encode(rows, "unit"), "unit").select("scope_id", "unit_id", "text", "ts_raw", "role", F.array_join("source_ids", "|").alias("source"))


def json_lines(rows: DataFrame, name: str, schema: str) -> DataFrame:
    """rows written as JSON lines and read as a source's records, in order."""
    at = session.scratch(rows.sparkSession, name)
    rows.write.json(at)
    return tables.json_array(rows.sparkSession, at, schema)


@query("""SELECT 'c' || conv_id AS item_id, 1 AS conv_ix, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS msg_ix, 't' || turn AS message_id, 'participant' AS role, role AS speaker, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content FROM conversations""")
def turn_records(spark, sf):
    """One record a question, two for each conversation, with all its turns in one session."""
    t = F.struct("turn", F.struct(F.concat(F.lit("t"), "turn").alias("record_id"), F.lit("s").alias("session_id"), F.col("turn").cast("int").alias("turn_index"), F.col("role").alias("speaker"), "text").alias("t"))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(t)), lambda x: x["t"]).alias("turn_records"))
    rows = c.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), "*").select(F.concat(F.lit("c"), "conv_id").alias("source_sample_id"), F.concat_ws(":", "conv_id", "k").alias("question_id"), F.lit("?").alias("question"), F.lit("x").alias("answer"), "turn_records")
    d = tables.from_turn_records(json_lines(rows, "turns", tables.TURNS), "turns")
    return d.messages.select("item_id", "conv_ix", "msg_ix", "message_id", "role", "speaker", "content")


@query("""WITH p AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id) AS conv_ix, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS msg_ix FROM conversations)
    SELECT CAST(conv_id % 10 AS VARCHAR) AS item_id, conv_ix, msg_ix, CASE WHEN conv_id % 2 = 0 THEN 's' || conv_id ELSE 'session_' || conv_ix END || ':m' || msg_ix AS message_id, role, role AS speaker, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content FROM p""")
def haystack_sessions(spark, sf):
    """One question for each scope, over all its conversations as sessions, every other one without
    an id."""
    t = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("t"))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(t)), lambda x: x["t"]).alias("turns"))
    s = F.array_sort(F.collect_list(F.struct("conv_id", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("s"), "conv_id")).otherwise("").alias("sid"), "turns")))
    rows = c.groupBy((F.col("conv_id") % 10).cast("string").alias("question_id")).agg(s.alias("s")).select("question_id", F.lit("?").alias("question"), F.lit("7").alias("answer"), F.transform("s", lambda x: x["sid"]).alias("haystack_session_ids"), F.transform("s", lambda x: x["turns"]).alias("haystack_sessions"))
    d = tables.from_haystack(json_lines(rows, "haystack", tables.HAYSTACK), "haystack")
    return d.messages.select("item_id", "conv_ix", "msg_ix", "message_id", "role", "speaker", "content")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS msg_ix FROM conversations) SELECT 'p0' AS item_id, msg_ix, 's' || conv_id || ':m' || msg_ix AS message_id, role, CASE WHEN role = 'user' THEN 'Bo' ELSE lower(role) END AS speaker, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content FROM p""")
def persona_sessions(spark, sf):
    """Every conversation as a session of one persona."""
    t = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("t"))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(t)), lambda x: x["t"]).alias("history"))
    sess = json_lines(c.select(F.concat(F.lit("s"), "conv_id").alias("session_id"), F.lit("p0").alias("persona_id"), F.col("conv_id").cast("int").alias("order"), "history"), "sessions", tables.PERSONA_SESSIONS)
    inst = spark.createDataFrame([("n1", "p0", '{"name": "Bo"}')], "instance_id string, persona_id string, persona_str string")
    d = tables.from_persona(sess, json_lines(inst, "instances", tables.PERSONA_INSTANCES), "persona")
    return d.messages.select("item_id", "msg_ix", "message_id", "role", "speaker", "content")


@query(r"""WITH {placed}, s AS (SELECT DISTINCT scope_id FROM msgs), r AS (SELECT q.question_id, lower(context) AS c, list_slice(regexp_extract_all(lower(query_text), '[a-z0-9][a-z0-9_+\-'']*'), 1, 3) AS refs FROM contexts JOIN q USING (question_id) JOIN s ON q.scope_id = s.scope_id),
    h AS (SELECT question_id, len(list_filter(refs, lambda x: contains(c, x))) > 0 AS passed FROM r WHERE len(refs) > 0)
    SELECT CAST(question_id % 3 AS VARCHAR) AS category, count(*) AS evaluated_count, count(*) FILTER (passed) AS passed_count, round(count(*) FILTER (passed) / count(*), 9) AS accuracy FROM h GROUP BY ALL""")
def experiment_categories(spark, sf):
    """A whole run over a unified file: built, indexed, read, answered, evaluated, written, and its
    accuracies by category read from the run's folder."""
    ex = experiment.Experiment(systems.RawMemory(top_k=TOP_K, budget=400))
    got = ex.run(from_file(spark, sf))
    at = session.scratch(spark, "run")
    sinks.write_run(spark, at, "r", {"system": "raw"}, got.tables, got.report)
    return spark.read.parquet(f"{at}/categories").select("category", "evaluated_count", "passed_count", F.round("accuracy", 9).alias("accuracy"))


@query("WITH {base} SELECT scope_id, unit_id, text, ts_raw, role FROM units")
def replayed_units(spark, sf):
    """Units of a stream: every other turn of all conversations first, then the others, late, with
    the first ones once more."""
    at, rows = session.scratch(spark, "replay"), messages(spark, sf)
    replay = incremental.IncrementalBuild(f"{at}/state", units.raw_units)
    for part in (rows.where("msg_ix % 2 = 1"), rows):
        part.write.mode("append").parquet(f"{at}/in")
        replay.start(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), f"{at}/checkpoint").awaitTermination()
    return replay.units(rows).select("scope_id", "unit_id", "text", "ts_raw", "role")


def stub_vectors(texts: list[str]) -> list[list[float]]:
    """A model that any SQL can follow: length, letters e, and words, as fractions."""
    return [[len(t) / 7, t.count("e") / 3, (t.count(" ") + 1) / 9] for t in texts]


@query("""WITH {base}, f AS (SELECT unit_id, scope_id, ts, [length(text) / 7.0::DOUBLE, (length(text) - length(replace(text, 'e', ''))) / 3.0::DOUBLE, (length(text) - length(replace(text, ' ', '')) + 1) / 9.0::DOUBLE] AS v FROM units),
    g AS (SELECT question_id, scope_id, qt, [length(query_text) / 7.0::DOUBLE, (length(query_text) - length(replace(query_text, 'e', ''))) / 3.0::DOUBLE, (length(query_text) - length(replace(query_text, ' ', '')) + 1) / 9.0::DOUBLE] AS v FROM q),
    s AS (SELECT question_id, unit_id, round(list_cosine_similarity(g.v, f.v), 9) AS score FROM g JOIN f ON g.scope_id = f.scope_id AND f.ts <= g.qt)
    SELECT question_id, unit_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, unit_id) AS rank FROM s) WHERE rank <= 20""")
def embedded_topk(spark, sf):
    """Units and questions embedded by a model, each text once, and ranked by its vectors."""
    store, q, u = embedding.VectorStore(session.scratch(spark, "vectors")), questions(spark, sf), raw(spark, sf)
    of_u = store.vectors(u.select("text"), stub_vectors, "stub")
    of_q = store.vectors(q.select(F.col("query_text").alias("text")), stub_vectors, "stub")
    scored = retrieve.embedded_scores(q, u, of_q, of_u, F.col("text"))
    return retrieve.ranked(scored.withColumn("score", F.round("score", 9)), TOP_K).select("question_id", "unit_id", "score", "rank")


def token_counter(name: str = "byte_bpe_50k.tiktoken") -> Callable[[str], int]:
    """Counts tokens by a public vocabulary of ranks, loaded once in a worker."""
    held: list = []

    def count(s: str) -> int:
        if not held:
            import base64

            import public_tokenizers
            import tiktoken

            with open(public_tokenizers.path(name), "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
            held.append(tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
        return len(held[0].encode_ordinary(s))

    return count


@query()
def tokenizer_chunks(spark, sf):
    """Chunks by a real tokenizer's tokens of their joined messages."""
    count = token_counter()
    return units.chunked(messages(spark, sf), CHUNK, lambda ts: [count(t) for t in ts]).select("scope_id", "conv_ix", "msg_ix", "chunk")


@query()
def tokenizer_context(spark, sf):
    """Contexts within a budget of a real tokenizer's tokens, which don't add up over lines."""
    return context.pack_each(questions(spark, sf), lexical(spark, sf), context.prefix, 400, joiner="\n", style="list", count=token_counter())
