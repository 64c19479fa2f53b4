"""Hashed and dense vectors. Hashed weights are whole numbers, so that sums are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lexical_tokens

# Fixed value: the length of hashed vectors.
BUCKETS = 256


def bucket_of(token: Column) -> Column:
    """The last of the first four bytes of the token's SHA-1."""
    return F.conv(F.substring(F.sha1(token), 7, 2), 16, 10).cast("int")


def sign_of(token: Column) -> Column:
    """1 if the fifth byte is even, else -1."""
    return F.lit(1) - 2 * (F.conv(F.substring(F.sha1(token), 9, 2), 16, 10).cast("int") % 2)


def hashed(text: Column) -> Column:
    """Buckets and signs of each token, as array<struct<b, s>>; their sums are the vector."""
    return F.transform(lexical_tokens(text), lambda t: F.struct(bucket_of(t).alias("b"), sign_of(t).alias("s")))


def hashed_dense(text: Column) -> Column:
    """The vector as array<int>."""
    add = lambda a, x: F.transform(a, lambda v, i: F.when(i == x["b"], v + x["s"]).otherwise(v))
    return F.aggregate(hashed(text), F.array_repeat(F.lit(0), BUCKETS), add)


def sparse(text: Column) -> Column:
    """The vector's buckets that tokens fall in and their weights, as array<struct<b, w>>."""

    def summed(h: Column) -> Column:
        weight = lambda b: F.aggregate(h, F.lit(0), lambda a, x: a + F.when(x["b"] == b, x["s"]).otherwise(0))
        return F.transform(F.array_distinct(F.transform(h, lambda x: x["b"])), lambda b: F.struct(b.alias("b"), weight(b).alias("w")))

    return F.get(F.transform(F.array(hashed(text)), summed), F.lit(0))


def sparse_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x["w"].cast("double") * x["w"].cast("double")))


def sparse_dot(v: Column, of: Column) -> Column:
    """v: as sparse(); of: the other vector as a map from bucket to weight."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x["w"].cast("double") * F.coalesce(F.try_element_at(of, x["b"]), F.lit(0)).cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products, as far as the shorter goes."""
    return F.aggregate(F.arrays_zip(a.alias("l"), b.alias("r")), F.lit(0.0), lambda s, x: s + F.coalesce(x["l"].cast("double") * x["r"].cast("double"), F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(product: Column, left_norm: Column, right_norm: Column) -> Column:
    """0 where either norm is."""
    return F.when((left_norm == 0) | (right_norm == 0), F.lit(0.0)).otherwise(product / (left_norm * right_norm))
