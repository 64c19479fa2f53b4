"""What the corpus operators share: text rules, scratch tables, bounded broadcasts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every operator here: space and the controls 9 to 13.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
#: Prefix of working columns, so that columns of the input never clash with them.
TMP = "__mf_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, a folder of our own, if all of
    Spark is this one machine; elsewhere executors would each write to their own disk, and that is
    an error."""
    context = spark.sparkContext
    if base := context.getConf().get("spark.checkpoint.dir", ""):
        return base.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file:///tmp/checkpoints/{os.getuid()}"


def app_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, deleted with the application."""
    folder = f"{scratch_dir(spark)}/mnemoframe/{spark.sparkContext.applicationId}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts the lineage: a lost
    executor costs a read of that table, not a new run of what made it. Row numbers in it are
    stable from then on."""
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, name: str, max_rows: int) -> DataFrame:
    """df, materialised; marked for broadcasting only if its counted rows are max_rows at most.
    Above that, joins with it shuffle."""
    kept = materialize(df, name)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def text_or_empty(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The maximal runs of characters that aren't white space, as an array."""
    return let(
        F.btrim(text, F.lit(WS_CHARS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_RUN)),
    )


def n_words(text: Column) -> Column:
    return let(
        F.btrim(text, F.lit(WS_CHARS)),
        lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WS_RUN))),
    ).cast("long")
