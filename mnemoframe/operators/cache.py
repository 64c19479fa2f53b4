"""Stage caches: Parquet tables by stage, looked up by content keys.

A lookup is a semi join and an anti join on the key; what is missing is computed and appended.
Of rows with one key, the last written counts. Rows with an error are written too, so that what
failed is known without asking again, but a later run finds nothing in them and does ask again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str = "cache_key", at: str = "written_at") -> DataFrame:
    """Each key's rows of its last writing, of which there may be many; what has no error goes
    before what has."""
    order = F.struct(F.col("error").isNull(), F.col(at)) if "error" in rows.columns else F.struct(at)
    return rows.withColumn("_w", order).withColumn("_last", F.max("_w").over(Window.partitionBy(key))).where("_w = _last").drop("_w", "_last")


def split(wanted: DataFrame, cached: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits, misses): rows of wanted that the cache has, with its columns, and those it hasn't."""
    keys = wanted.select(key).distinct()
    return keys.join(latest(cached.join(keys, key, "left_semi"), key).drop("written_at"), key), wanted.join(cached.select(key).distinct(), key, "left_anti")


def _with_error(rows: DataFrame) -> DataFrame:
    return rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))


class StageCache:
    """A folder with a table for each stage. Keys hold everything that a result depends on, so
    that a changed budget or config is a miss; secrets aren't part of them."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    #: Part of every path: tables of other layouts are never read.
    LAYOUT = 2

    def path(self, stage: str) -> str:
        return f"{self.folder}/v{self.LAYOUT}/stage={stage}"

    def table(self, like: DataFrame, stage: str) -> DataFrame | None:
        jvm = like.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path(stage))
        if not at.getFileSystem(like.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return like.sparkSession.read.parquet(self.path(stage))

    def through(self, stage: str, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict[str, int]]:
        """compute(rows of wanted that are missing) must keep cache_key, and may have error. The
        result has all of them, with a column error, computed once; the counts are hits and misses."""
        held = self.table(wanted, stage)
        held = None if held is None else held.where("error is null")
        keys = wanted.select("cache_key").distinct()
        misses = wanted if held is None else wanted.join(held.select("cache_key").distinct(), "cache_key", "left_anti")
        n_hits = 0 if held is None else keys.join(held.select("cache_key"), "cache_key", "left_semi").count()
        n_misses = misses.count()
        if n_misses:
            _with_error(compute(misses)).withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(self.path(stage))
        if not (n_hits or n_misses):
            return _with_error(compute(misses)), {"cache_hits": 0, "cache_misses": 0}
        every = wanted.sparkSession.read.parquet(self.path(stage)).join(keys, "cache_key", "left_semi")
        return latest(every).drop("written_at"), {"cache_hits": n_hits, "cache_misses": n_misses}
