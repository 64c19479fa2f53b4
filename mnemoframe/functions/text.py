"""Text expressions: trimming, tokens, sentences, segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: what counts as a token, as a lexical token, and where
# sentences end.
TOKEN_PATTERN = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"
LEXICAL_PATTERN = r"[a-z0-9][a-z0-9_+\-']*"
SENTENCE_BREAK = r"(?<=[.!?])\s+|(?<=[;:])\s+"
SEGMENT_TOKENS = 24


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space, in Unicode's sense, at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def collapse(c: str | Column) -> Column:
    """Stripped, and each run of white space one space."""
    return strip(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(strip(_col(c).cast("string")), F.lit(""))


def text_or_null(c: str | Column) -> Column:
    return F.nullif(strip(_col(c).cast("string")), F.lit(""))


def first_text(*cols: str | Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(_col(c).cast("string"), F.lit("")) for c in cols))


def string_list(c: str | Column) -> Column:
    """The elements that aren't null; an empty list for null."""
    return F.coalesce(F.filter(_col(c), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def clean_metadata(c: str | Column) -> Column:
    """A JSON object without the members that are null, an empty list or an empty object; null for
    what isn't an object."""
    held = F.map_filter(F.from_json(_col(c), "map<string, variant>"), lambda _, v: ~F.coalesce(F.to_json(v), F.lit("null")).isin("null", "[]", "{}"))
    return F.to_json(held)


def metadata_texts(c: str | Column, path: str) -> Column:
    """What stands at a path of a JSON object, as texts: a list's elements, or the value; what is
    blank or isn't there gives none."""
    held = F.try_variant_get(F.try_parse_json(_col(c)), f"$.{path}", "variant")
    many = F.try_variant_get(held, "$", "array<variant>")
    said = F.when(many.isNotNull(), F.transform(many, variant_text)).otherwise(F.array(variant_text(held)))
    return F.filter(said, lambda x: x.isNotNull() & (strip(x) != ""))


def variant_text(v: Column) -> Column:
    """A string as it is, other values as JSON; null for null."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.nullif(F.to_json(v), F.lit("null")))


def tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(f"({TOKEN_PATTERN})"), 1)


def token_count(c: str | Column) -> Column:
    """Additive: a joined text has as many tokens as its lines, since none holds white space."""
    return F.size(tokens(c)).cast("long")


def lexical_tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(f"({LEXICAL_PATTERN})"), 1)


def lexical_set(c: str | Column) -> Column:
    return F.array_distinct(lexical_tokens(c))


def sentences(c: str | Column) -> Column:
    parts = F.split(collapse(c), SENTENCE_BREAK)
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" ,;"))), lambda x: x != "")


def segments(c: str | Column, max_tokens: int = SEGMENT_TOKENS) -> Column:
    """The sentence whole, if it has few enough tokens, else its words packed greedily; a word
    with too many tokens stands alone. Segments lose commas, semicolons and spaces at their ends,
    and go if nothing else is left."""
    whole = F.btrim(collapse(c), F.lit(" ,;"))

    def add(a: Column, w: Column) -> Column:
        n = F.size(tokens(w))
        fits = (a["n"] > 0) & (a["n"] + n <= max_tokens)
        return F.struct(
            F.when(fits | (a["cur"] == ""), a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))).alias("done"),
            F.when(fits, F.concat(a["cur"], F.lit(" "), w)).otherwise(w).alias("cur"),
            F.when(fits, a["n"] + n).otherwise(n).alias("n"),
        )

    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))
    packed = F.aggregate(F.split(whole, " "), zero, add, lambda a: F.concat(a["done"], F.array(a["cur"])))
    packed = F.filter(F.transform(packed, lambda s: F.btrim(s, F.lit(" ,;"))), lambda s: s != "")
    return F.when(whole == "", F.array().cast("array<string>")).when(F.size(tokens(whole)) <= max_tokens, F.array(whole)).otherwise(packed)


def normalized(c: str | Column) -> Column:
    """For comparing answers: white space collapsed, stripped, lower case."""
    return F.lower(collapse(c))
