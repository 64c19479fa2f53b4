"""Vectors of texts from a model, kept in a store so that no text is embedded twice.

The store is a folder of Parquet rows: identity (of the model and its settings), text_hash, dim and
the vector as little-endian 64-bit floats, as models give them. No text is written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files
from .calls import Calls

Embed = Callable[[list[str]], list[list[float]]]
STORED = "identity string, text_hash string, dim int, vector binary"


@F.pandas_udf(T.BinaryType())
def to_blob(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<f8").tobytes())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def from_blob(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, "<f8").astype(float))


@dataclass(frozen=True)
class VectorStore:
    folder: str

    def table(self, like: DataFrame) -> DataFrame:
        spark = like.sparkSession
        if not files.exists(spark, self.folder):
            return spark.createDataFrame([], STORED)
        return spark.read.schema(STORED).parquet(self.folder)

    def warm(self, texts: DataFrame, embed: Embed, identity: str, calls: Calls = Calls()) -> dict[str, int]:
        """Embeds those of texts (text) that the store lacks, each once. A blob whose size doesn't
        fit its dim counts as lacking. Unless calls.fail_fast, texts whose call fails stay without a
        vector, and are counted."""
        wanted = texts.select("text").where("text is not null").distinct().withColumn("text_hash", F.sha2("text", 256))
        have = self.sound(texts, identity)
        missing = wanted.join(have, "text_hash", "left_anti")

        def run(batches):
            for b in batches:
                got = [None if v is None else [float(x) for x in v] for v, _ in calls.replies(embed, b["text"].tolist(), "vectors")]
                yield pd.DataFrame({"text_hash": b["text_hash"], "vector": pd.Series(got, index=b.index, dtype=object)})

        n, n_missing = wanted.count(), missing.count()
        if n_missing:
            new = missing.mapInPandas(run, "text_hash string, vector array<double>").where("vector is not null")
            new.select(F.lit(identity).alias("identity"), "text_hash", F.size("vector").alias("dim"), to_blob("vector").alias("vector")).write.mode("append").parquet(self.folder)
        out = {"cache_hits": n - n_missing, "cache_misses": n_missing}
        if not calls.fail_fast:
            out["failed_count"] = wanted.join(self.sound(texts, identity), "text_hash", "left_anti").count() if n_missing else 0
        return out

    def sound(self, like: DataFrame, identity: str) -> DataFrame:
        kept = self.table(like).where((F.col("identity") == identity) & (F.octet_length("vector") == 8 * F.col("dim")))
        return kept.groupBy("text_hash").agg(F.max("vector").alias("vector"))

    def vectors(self, texts: DataFrame, embed: Embed, identity: str, calls: Calls = Calls()) -> DataFrame:
        """(text, vector) of each distinct text that has one, warmed first."""
        self.warm(texts, embed, identity, calls)
        keyed = texts.select("text").where("text is not null").distinct().withColumn("text_hash", F.sha2("text", 256))
        return keyed.join(self.sound(texts, identity), "text_hash").select("text", from_blob("vector").alias("vector"))
