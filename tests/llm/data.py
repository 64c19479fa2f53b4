"""Tables that the tests of the corpus operators share."""

import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators use themselves.
EXTRA = "kept boolean, size long, row long, key string, cluster long, source_size long, n_words long, stratum string, digest string, target double, shard int, word string, `a b.c` string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(text):
    return WORD.findall(text or "")


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(n))


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source); other columns are null."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, None, None)[:4] if len(r) < 4 else r
        full.append((doc_id, text, lang, source, len(text) if text is not None else None, *([None] * 13)))
    return spark.createDataFrame(full, SCHEMA)


def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = prose(20_000, 1)
    a = prose(60, 2)
    return frame(
        spark,
        [
            (1, a, "en", "s1"), (2, a, "en", "s1"), (3, a.replace(" ", "  "), "en", None), (4, None, None, None), (5, "", "de", "s2"),
            (None, None, None, None), (None, a, None, "s1"), (7, long, "en", "s2"), (8, long + " end", "en", "s2"), (9, a, "en", "s1"),
            (9, a, "en", "s1"), (10, " \t\n ", "fr", "s3"), (11, "one two", "fr", "s3"), (12, "one two", "fr", "s3"), (13, "   \U0001f600 x́", "fr", "s3"),
        ],
    )


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
