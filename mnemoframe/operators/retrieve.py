"""Reads: which units a question can see, and in what order.

questions: question_id, scope_id, query_text, query_time_raw. Units and questions meet on the
scope; time is a residual predicate of that join, so that it needs no strategy of its own. A hot
scope is split by adaptive execution. Ranks are cut by row_number, which Spark turns into a limit
for each group before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, times, vectors

TOP_K = 50


def query_text(query: str = "query", fallback: bool = False) -> Column:
    """Of a plain query, itself; of a JSON object, its question, query or text; else the object
    as it stands on request, or nothing."""
    q = F.col(query)
    is_object = text.strip(q).startswith("{")
    found = text.first_text(*(F.get_json_object(q, f"$.{k}") for k in ("question", "query", "text")))
    return F.when(is_object, F.coalesce(found, q if fallback else F.lit(""))).otherwise(F.coalesce(q, F.lit("")))


def effective(value: int | None, default: int) -> int:
    """0 and None mean the default; less is refused."""
    if value is not None and value < 0:
        raise ValueError("limits can't be negative")
    return value or default


def snapshot(questions: DataFrame, units: DataFrame) -> DataFrame:
    """Each question with each unit of its scope that it can see. Times are read once a row, on
    either side of the join, which compares timestamps."""
    q, u = timed_questions(questions), timed_units(units).withColumnRenamed("scope_id", "_scope")
    return q.join(u, (F.col("scope_id") == F.col("_scope")) & seen()).drop("_scope", *TIMES)


#: Columns that questions and units have while they are compared.
TIMES = ("_free", "_asked", "_at")


def seen() -> Column:
    return F.col("_free") | F.coalesce(F.col("_at") <= F.col("_asked"), F.lit(False))


def timed_questions(questions: DataFrame) -> DataFrame:
    return questions.withColumns({"_free": times.no_cutoff("query_time_raw"), "_asked": times.parse("query_time_raw")})


def timed_units(units: DataFrame) -> DataFrame:
    return units.withColumn("_at", times.available_at(F.col("available_at_raw"), F.col("ts_raw")))


def snapshot_counts(questions: DataFrame, units: DataFrame) -> DataFrame:
    """question_id, unit_count, snapshot_unit_count, hidden_unit_count. Units are counted by scope
    and time; questions lie among those times, and what is before each is a running sum: within a
    day, plus the days before it. So no pair of a question and a unit or time is made, and a scope
    with many times is many tasks."""
    when = times.available_at(F.col("available_at_raw"), F.col("ts_raw"))
    per_time = units.groupBy("scope_id", when.alias("at")).agg(F.count("*").alias("n"))
    all_units = per_time.groupBy("scope_id").agg(F.sum("n").alias("unit_count"))
    free = times.no_cutoff("query_time_raw")
    asks = questions.select("question_id", "scope_id", times.parse("query_time_raw").alias("at"), free.alias("free"))
    # Times that can't be read stay in line, as a day of their own that counts nothing: a filter on
    # them would have every time parsed twice.
    known = F.when(F.col("at").isNotNull(), F.col("n")).otherwise(0)
    line = per_time.select(F.lit(None).cast(asks.schema["question_id"].dataType).alias("question_id"), "scope_id", "at", known.alias("n"), F.lit(False).alias("asked"))
    line = line.unionByName(asks.select("question_id", "scope_id", "at", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))).withColumn("day", F.to_date("at"))
    within = Window.partitionBy("scope_id", "day").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    days = line.groupBy("scope_id", "day").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("scope_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("scope_id", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    seen = line.withColumn("n", F.sum("n").over(within)).where("asked").join(days, ["scope_id", "day"]).select("question_id", "scope_id", (F.col("n") + F.col("before")).alias("seen"))  # days that are null meet none
    out = asks.join(all_units, "scope_id", "left").join(seen, ["question_id", "scope_id"], "left")
    n = F.coalesce("unit_count", F.lit(0))
    s = F.when(F.col("free"), n).otherwise(F.coalesce("seen", F.lit(0)))
    return out.select("question_id", n.alias("unit_count"), s.alias("snapshot_unit_count"), (n - s).alias("hidden_unit_count"))


def ranked(scored: DataFrame, top_k: int | None = None, by: str = "question_id") -> DataFrame:
    """The first top_k by score, then unit_id; units without a score in common fill the list."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc("unit_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= effective(top_k, TOP_K))


def lexical_scores(questions: DataFrame, units: DataFrame) -> DataFrame:
    """Shared words over the root of the product of distinct words."""
    q = questions.withColumn("q_words", text.lexical_set("query_text"))
    u = units.withColumn("u_words", text.lexical_set("text"))
    both = F.size(F.array_intersect("q_words", "u_words"))
    size = F.greatest(F.lit(1), F.size("q_words")) * F.greatest(F.lit(1), F.size("u_words"))
    return snapshot(q, u).withColumn("score", both / F.sqrt(size.cast("double"))).drop("q_words", "u_words")


#: Pairs of a question and a unit of its scope up to which all are compared at once.
DIRECT_PAIRS = 20_000_000
#: A word is common in a scope if more than this share of its units hold it.
COMMON = 1 / 16
PAIR = ["scope_id", "question_id", "unit_id"]


def lexical_top(questions: DataFrame, units: DataFrame, top_k: int | None = None, direct_pairs: int = DIRECT_PAIRS, digits: int | None = None) -> DataFrame:
    """ranked(lexical_scores(...)), by pairs that share words where all pairs would be many. unit_ids
    are unique in a scope, question_ids in all. digits: those that scores are rounded to before they
    are ranked, so that scores tie that differ by the rounding of their quotients alone."""
    of_q, of_u = (df.groupBy("scope_id").agg(F.count("*").alias(n)) for df, n in ((questions, "q"), (units, "u")))
    pairs = of_q.join(of_u, "scope_id").agg(F.sum(F.col("q") * F.col("u"))).first()[0] or 0
    if pairs <= direct_pairs:
        scored = lexical_scores(questions, units)
        return ranked(scored if digits is None else scored.withColumn("score", F.round("score", digits)), top_k)
    k = effective(top_k, TOP_K)
    best, short = lexical_postings(questions, units, k, digits)
    q, u = timed_questions(questions), timed_units(units).withColumnRenamed("scope_id", "_scope")
    # Questions with too few units of a score above 0: the first of the others, by unit_id, fill up.
    lack = q.join(short, "question_id")
    rest = lack.join(u, (F.col("scope_id") == F.col("_scope")) & seen()).select(*PAIR).join(best.select(*PAIR), PAIR, "left_anti")
    fill = ranked(rest.withColumn("score", F.lit(0.0)), k).drop("rank")
    top = ranked(best.unionByName(fill), k)
    return questions.join(top.drop("scope_id"), "question_id").join(units.withColumnRenamed("scope_id", "_scope"), "unit_id").where("scope_id = _scope").drop("_scope")


def lexical_postings(questions: DataFrame, units: DataFrame, k: int, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The best k pairs (scope_id, question_id, unit_id, score) of each question that share a word,
    exact, and the questions that have fewer above 0. digits: as in lexical_top; bounds are rounded
    like scores, which keeps their order.

    Words lead from questions to units by an inverted index of the scope. Rare words come first; the
    score of a pair that shares one is bounded from both sides, as a question's common words are
    known by number, and what can't reach the k-th lower bound isn't scored. A unit that shares
    only common words can reach the k-th score only if it has few words, so that the index of common
    words, cut by the binary size of units, is read as far as that."""
    from ..session import scratch

    spark = questions.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        at = scratch(spark, name)
        df.write.parquet(at)
        return spark.read.parquet(at)

    def score(shared: Column) -> Column:
        exact = shared / F.sqrt((F.greatest(F.lit(1), F.col("n_q")) * F.greatest(F.lit(1), F.col("n_u"))).cast("double"))
        return exact if digits is None else F.round(exact, digits)

    u = timed_units(units).withColumn("u_words", text.lexical_set("text")).select("scope_id", "unit_id", "_at", "u_words", F.size("u_words").alias("n_u"))
    postings = kept(u.select("scope_id", "unit_id", "_at", "n_u", F.explode("u_words").alias("word")), "postings")
    held = units.groupBy("scope_id").agg(F.count("*").alias("in_scope"))
    often = postings.groupBy("scope_id", "word").agg(F.count("*").alias("df")).join(held, "scope_id").select("scope_id", "word", (F.col("df") > COMMON * F.col("in_scope")).alias("common"))
    q = timed_questions(questions).withColumn("q_words", text.lexical_set("query_text")).select("scope_id", "question_id", "_free", "_asked", F.size("q_words").alias("n_q"), F.explode("q_words").alias("word"))
    asked = q.join(often, ["scope_id", "word"])
    n_common = asked.groupBy("question_id").agg(F.count_if("common").alias("n_common"), F.collect_list(F.when(F.col("common"), F.col("word"))).alias("commons"))
    asked = kept(asked.join(n_common.drop("commons"), "question_id"), "asked")

    # Pairs that share a rare word, and their bounds.
    rare = asked.where("not common").join(postings, ["scope_id", "word"]).where(seen()).groupBy(*PAIR, "n_q", "n_u", "n_common").agg(F.count("*").alias("shared"))
    rare = kept(rare.withColumns({"low": score(F.col("shared")), "high": score(F.col("shared") + F.least("n_common", F.col("n_u") - F.col("shared")))}), "rare")
    by = Window.partitionBy("question_id")
    floor = rare.withColumn("at", F.row_number().over(by.orderBy(F.desc("low")))).where(F.col("at") == k).select("question_id", F.col("low").alias("floor"))
    worth = rare.join(floor, "question_id", "left").where(F.col("floor").isNull() | (F.col("high") >= F.col("floor") * SLACK))
    worth = worth.join(n_common.select("question_id", "commons"), "question_id").join(u.select("scope_id", "unit_id", "u_words"), ["scope_id", "unit_id"])
    first = kept(worth.select(*PAIR, score(F.col("shared") + F.size(F.array_intersect("commons", "u_words"))).alias("score")), "first")

    # Pairs that share common words alone: short units only, where the k-th score is known.
    kth = first.withColumn("at", F.row_number().over(by.orderBy(F.desc("score")))).where(F.col("at") == k).select("question_id", F.col("score").alias("kth"))
    reach = F.col("kth") - (0.0 if digits is None else 10.0**-digits)  # what may be rounded up to it
    most = F.when(reach > 0, F.col("n_common") * F.col("n_common") / (F.col("n_q") * reach * reach * SLACK))
    power = lambda n: F.floor(F.log2(F.greatest(F.lit(1), n))).cast("int")
    top = postings.agg(F.max("n_u")).first()[0] or 1
    wide = asked.where("common").join(kth, "question_id", "left").withColumn("most", F.least(F.coalesce(most, F.lit(float(top))), F.lit(float(top)))).where("most >= 1")
    wide = wide.withColumn("power", F.explode(F.sequence(F.lit(0), power(F.col("most")))))
    plain = wide.join(postings.withColumn("power", power(F.col("n_u"))), ["scope_id", "word", "power"]).where(seen()).groupBy(*PAIR, "n_q", "n_u").agg(F.count("*").alias("shared"))
    second = plain.join(rare.select(*PAIR), PAIR, "left_anti").select(*PAIR, score(F.col("shared")).alias("score"))
    best = kept(ranked(first.unionByName(second), k).drop("rank"), "best")
    counts = questions.select("question_id").join(best.where("score > 0").groupBy("question_id").agg(F.count("*").alias("n")), "question_id", "left")
    return best, counts.where(F.coalesce("n", F.lit(0)) < k).select("question_id")


#: Bounds are taken a little lower than they come out, as they are rounded.
SLACK = 1 - 1e-9


def hashed_scores(questions: DataFrame, units: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Cosine of hashed vectors. Texts are hashed once each, before the join."""
    from .units import retrieval_text

    q = questions.withColumn("q_vec", vectors.sparse(F.col("query_text"))).withColumn("q_norm", vectors.sparse_norm(F.col("q_vec")))
    u = units.withColumn("u_vec", vectors.sparse(retrieval_text(fields or ["text", "tags"]))).withColumn("u_norm", vectors.sparse_norm(F.col("u_vec")))
    u = u.withColumn("u_vec", F.map_from_entries("u_vec"))
    product = vectors.sparse_dot(F.col("q_vec"), F.col("u_vec"))
    return snapshot(q, u).withColumn("score", vectors.cosine(product, F.col("q_norm"), F.col("u_norm"))).drop("q_vec", "u_vec", "q_norm", "u_norm")


#: Queries and vectors that are compared in one piece of work, at most.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 16384


def nearest(queries: DataFrame, vectors_df: DataFrame, top_k: int, digits: int = 6) -> DataFrame:
    """(question_id, unit_id, score) of the nearest stored vectors of each query by cosine, exact;
    a few more where scores tie. queries: question_id, vector; vectors_df: unit_id, vector. Every
    query meets every vector, as the search wants, in blocks: one matrix product each, of which
    only the first top_k of each query leave the task."""
    import numpy as np
    import pandas as pd

    n_q, n_v = queries.count(), vectors_df.count()
    blocks_q, blocks_v = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_v // VECTOR_BLOCK))
    dealt = lambda df, key, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q = dealt(queries.select("question_id", F.col("vector").cast("array<double>").alias("vector")), "question_id", "qb", blocks_q, "vb", blocks_v)
    v = dealt(vectors_df.select("unit_id", F.col("vector").cast("array<double>").alias("vector")), "unit_id", "vb", blocks_v, "qb", blocks_q)
    slack = 10.0**-digits

    def unit(rows: pd.Series) -> np.ndarray:
        m = np.stack(rows.to_numpy())
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"question_id": left["question_id"].iloc[:0], "unit_id": right["unit_id"].iloc[:0], "score": pd.Series(dtype=float)})
        score = unit(left["vector"]) @ unit(right["vector"]).T
        kth = np.partition(score, -top_k, axis=1)[:, -top_k] if score.shape[1] > top_k else np.full(len(left), -2.0)
        i, j = np.nonzero(score >= kth[:, None] - slack)
        return pd.DataFrame({"question_id": left["question_id"].to_numpy()[i], "unit_id": right["unit_id"].to_numpy()[j], "score": score[i, j]})

    kinds = f"question_id {queries.schema['question_id'].dataType.simpleString()}, unit_id {vectors_df.schema['unit_id'].dataType.simpleString()}, score double"
    return q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(search, kinds)


def embedded_scores(questions: DataFrame, units: DataFrame, of_questions: DataFrame, of_units: DataFrame, unit_text: Column) -> DataFrame:
    """Cosine of embedded vectors. of_questions, of_units: (text, vector) of query_text and of
    unit_text. What has no vector scores 0."""
    q = questions.join(of_questions.select(F.col("text").alias("query_text"), F.col("vector").alias("q_vec")), "query_text", "left").withColumn("q_norm", vectors.norm(F.col("q_vec")))
    u = units.withColumn("_said", unit_text).join(of_units.select(F.col("text").alias("_said"), F.col("vector").alias("u_vec")), "_said", "left").drop("_said").withColumn("u_norm", vectors.norm(F.col("u_vec")))
    score = F.coalesce(vectors.cosine(vectors.dot(F.col("q_vec"), F.col("u_vec")), F.col("q_norm"), F.col("u_norm")), F.lit(0.0))
    return snapshot(q, u).withColumn("score", score).drop("q_vec", "u_vec", "q_norm", "u_norm")
