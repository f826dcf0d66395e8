"""Files, lists of files and diffs as relations."""

from __future__ import annotations

import logging
import os
import re
import subprocess
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chars as c
from ..functions import tables as t
from .policy import glob_regex


log = logging.getLogger(__name__)


def excluded(path: Column, globs: list[str] | tuple[str, ...] = ()) -> Column:
    """Paths that a scan leaves out: with an excluded directory's name and a slash anywhere, of an excluded suffix, or matched by a glob."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    directory = slashed.rlike("(" + "|".join(map(re.escape, t.EXCLUDED_DIRECTORIES)) + ")/")
    suffix = F.lower(c.basename(slashed)).rlike("(" + "|".join(map(re.escape, t.EXCLUDED_SUFFIXES)) + r")\z")
    return reduce(lambda a, b: a | b, (path.rlike(glob_regex(g)) for g in globs), directory | suffix)


def is_binary(content: Column) -> Column:
    """A NUL among the first bytes."""
    return F.instr(F.decode(F.substring(content, 1, t.PROBE_BYTES), "ISO-8859-1"), "\x00") > 0


def scannable(files: DataFrame, globs: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Files (path, length, content) that a scan reads: not excluded, not too large, not binary, in this order."""
    listed = files.where(~excluded(F.col("path"), globs)).where(F.col("length") <= t.MOST_BYTES)
    return listed.where(~is_binary(F.col("content")))


def _walk(root: str) -> Iterator[str]:
    """Paths (relative) of the files below a local directory but those in excluded directories, whatever their names begin with.

    Linked folders aren't entered, and folders from the MOST_DEPTH-th level on neither.
    """
    for folder, folders, names in os.walk(root):
        folders[:] = [d for d in folders if d not in t.EXCLUDED_DIRECTORIES]
        if folders and folder != root and os.path.relpath(folder, root).count(os.sep) + 2 >= t.MOST_DEPTH:
            log.warning("folders below %s are too deep and are left out", folder)
            folders[:] = []
        for name in names:
            full = os.path.join(folder, name)
            if os.path.isfile(full) and not any("\ud800" <= c <= "\udfff" for c in full):
                yield os.path.relpath(full, root)


def _read_local(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """path, length, content of local files (path on disk, own path), read by tasks; content is null beyond the size limit.

    Spark's own file sources leave out names that begin with `_` or `.`.
    """
    if not known:
        return spark.createDataFrame([], "path string, length long, content binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for full, own in zip(batch.column("full").to_pylist(), batch.column("own").to_pylist(), strict=True):
                try:
                    size, content = os.path.getsize(full), None
                    if size <= t.MOST_BYTES:
                        with open(full, "rb") as f:
                            content = f.read()
                        size = len(content)
                except OSError:  # gone or unreadable
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([size]), pa.array([content], pa.binary())], ["path", "length", "content"])

    names = spark.createDataFrame(known, "full string, own string").repartition(min(len(known), 4 * spark.sparkContext.defaultParallelism))
    return names.mapInArrow(read, "path string, length long, content binary")


def files_from_directory(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), length, content of all files below a directory; in a store that isn't local, without names that begin with `_` or `.`."""
    local = re.sub("^file:(//)?", "", root)
    if "://" not in local:
        local = os.path.abspath(local)
        return _read_local(spark, [(os.path.join(local, p), p) for p in _walk(local)])
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1]
    return read.select(F.regexp_replace("path", rf"^[a-z]*:?/*{re.escape(base.lstrip('/'))}/", "").alias("path"), "length", "content").where(F.size(F.split("path", "/")) <= t.MOST_DEPTH)


def files_from_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The given files; those that don't exist are left out. Local paths keep their spelling."""
    known = {os.path.abspath(p): re.sub(r"^\./", "", p) for p in paths if os.path.isfile(p)}
    return _read_local(spark, list(known.items()))


def paths_from_list(path: str) -> list[str]:
    """Paths of a list: one a line, trimmed, blank lines left out."""
    with open(path, encoding="utf-8") as f:
        return [line.strip() for line in f if line.strip()]


def files_from_table(rows: DataFrame, path: Column, text: Column) -> DataFrame:
    """path and text of any table."""
    return rows.select(path.alias("path"), text.alias("text"))


def file_lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text with its end."""
    return files.select("path", F.posexplode(c.lines(F.col("text"))).alias("i", "line_text")).select("path", (F.col("i") + 1).alias("line"), F.col("line_text").alias("text"))


def changed_from_diff(rows: DataFrame) -> DataFrame:
    """diff_id, line_no, text of unified diffs without context: path, line of added or changed lines.

    A path with a null line is known to the diff. The path of a hunk is that of the last `+++ b/` line before it. Diffs
    are parsed apart, each in its own window.
    """
    own = F.when(F.col("text").startswith("+++ b/"), F.substring(F.col("text"), F.lit(7), F.length("text")))
    before = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("diff_id", "line_no", "text", own.alias("own")).withColumn("path", F.last("own", ignorenulls=True).over(before))
    hunk = r"^@@[^+]*\+(\d+)(?:,(\d+))?"
    start = F.try_to_number(F.regexp_extract("text", hunk, 1), F.lit("9999999999")).cast("int")
    number = F.regexp_extract("text", hunk, 2)
    count = F.when(number == "", 1).otherwise(F.try_to_number(number, F.lit("9999999999")).cast("int"))
    hunks = rows.where("path is not null").where(F.col("text").rlike(hunk)).select("path", start.alias("start"), count.alias("n")).where("n > 0")
    lines = hunks.select("path", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("line"))
    return lines.unionByName(rows.where("own is not null").select("path", F.lit(None).cast("int").alias("line"))).distinct()


def changed_from_git(spark: SparkSession, base: str, folder: str = ".") -> DataFrame | None:
    """Changed lines between a commit and HEAD; None (scan everything) if the id isn't hexadecimal or git fails."""
    if not re.fullmatch(r"[0-9A-Fa-f]+", base):
        log.warning("not a commit id, all lines are scanned: %s", base)
        return None
    try:
        run = subprocess.run(["git", "diff", "-U0", "--diff-filter=AMR", base, "HEAD"], cwd=folder, capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError) as e:
        log.warning("git diff failed, all lines are scanned: %s", e)
        return None
    if len(run.stdout) > t.MOST_BYTES:
        log.warning("the diff is longer than %d bytes and is cut", t.MOST_BYTES)
    text = run.stdout[: t.MOST_BYTES].decode("utf-8", "replace")
    rows = spark.createDataFrame([(0, i, line) for i, line in enumerate(text.split("\n"))], "diff_id int, line_no int, text string")
    return changed_from_diff(rows)
