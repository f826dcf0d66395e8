"""Findings of a stream of files.

A file is one row and all state of a scan is within a file, but for collisions, which need a window over its lines. So
the stateless rules run on a stream as they are, in append mode without a watermark; `foreachBatch` runs the whole scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..operators import rules
from ..operators.lexer import lexed_lines
from ..plans.scan import scan
from ..sources.policy import Policy

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder: path, length, content."""
    return spark.readStream.format("binaryFile").schema(FILES).load(folder).select("path", "length", "content")


def stream_findings(files: DataFrame, policy: Policy | None = None) -> DataFrame:
    """All findings but collisions of a stream of path and text, or path and content."""
    policy = policy or Policy()
    found = None
    if "content" in files.columns:
        found = rules.invalid_encoding(files, policy)
        files = files.where(F.is_valid_utf8(F.col("content"))).select("path", F.col("content").cast("string").alias("text"))
    lines = lexed_lines(files, suspicious=not rules._all_tokens(policy)).withColumn("is_changed", F.lit(True))
    out = rules.on_lines(lines, policy).unionByName(rules.line_endings(files, policy))
    return out if found is None else out.unionByName(found)


def each_batch(files: DataFrame, sink: Callable[[DataFrame, int], None], policy: Policy | None = None) -> DataStreamWriter:
    """A writer that hands every micro-batch's whole scan to `sink`."""
    return files.writeStream.foreachBatch(lambda batch, number: sink(scan(batch, policy), number))
