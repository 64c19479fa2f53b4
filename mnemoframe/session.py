"""The session that the engine expects."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def build(app: str = "mnemoframe", **conf: str) -> SparkSession:
    """A session with UTC, which timestamps without a zone are read in, and adaptive execution."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for this application's own tables, in the shared folder that the cluster names
    (spark.checkpoint.dir); one of this machine only where Spark is this machine."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", "")
    if not base and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"{(base or f'file:///tmp/checkpoints/{os.getuid()}').rstrip('/')}/mnemoframe/{context.applicationId}"
    at = context._jvm.org.apache.hadoop.fs.Path(own)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex}"
