"""Small files through Hadoop's file systems, so that any store Spark reaches will do.

What goes through here is bounded: heads of files, reports, manifests, events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def write_parts(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """A file from its parts, in order."""
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    try:
        for part in parts:
            out.write(bytearray(part.encode()))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, body: str) -> None:
    write_parts(spark, path, [body])


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as a whole."""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def first_character(spark: SparkSession, path: str) -> str:
    """The first character that isn't white space, of a file or of a folder's first file that
    isn't empty; "" if there is none. No more of a file is read than that takes."""
    fs, p = _at(spark, path)
    found = [p] if fs.getFileStatus(p).isFile() else sorted((s.getPath() for s in fs.listStatus(p) if s.isFile() and not s.getPath().getName().startswith(("_", "."))), key=str)
    for f in found:
        stream = fs.open(f)
        try:
            while (c := stream.read()) >= 0:
                if not chr(c).isspace() and c not in (0xEF, 0xBB, 0xBF):
                    return chr(c)
        finally:
            stream.close()
    return ""
