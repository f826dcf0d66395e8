"""The scan: files to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chars as c
from ..functions import tables as t
from ..operators import rules
from ..operators.lexer import lexed_lines
from ..sources.policy import Policy


def with_changes(lines: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Lines (path, line, ...) with `is_changed`.

    changed: path, line; a path with a null line is known to the diff without changed lines. All lines of a path that
    the diff doesn't know count as changed.
    """
    if changed is None:
        return lines.withColumn("is_changed", F.lit(True))
    known = changed.select(F.col("path").alias("known_path")).distinct()
    hits = changed.where("line is not null").select(F.col("path").alias("hit_path"), F.col("line").alias("hit_line")).distinct()
    joined = lines.join(known, F.col("path") == F.col("known_path"), "left").join(hits, (F.col("path") == F.col("hit_path")) & (F.col("line") == F.col("hit_line")), "left")
    return joined.withColumn("is_changed", F.col("known_path").isNull() | F.col("hit_line").isNotNull()).drop("known_path", "hit_path", "hit_line")


def scan(files: DataFrame, policy: Policy | None = None, changed: DataFrame | None = None) -> DataFrame:
    """files: path and text, or path and content (bytes). Findings in no order; sort by file and seq for a report's order.

    Files whose bytes aren't UTF-8 have one finding if the policy's encoding asks for it, and no other. A leading `./` is
    cut from paths. Changed lines count only if the policy says `diff_only`.
    """
    policy = policy or Policy()
    files = files.withColumn("path", F.regexp_replace("path", r"^\./", ""))
    parts = []
    if "content" in files.columns:
        if policy.encoding == "utf-8-only":
            parts.append(rules.invalid_encoding(files, policy))
        files = files.where(F.is_valid_utf8(F.col("content"))).select("path", F.col("content").cast("string").alias("text"))
    files = files.select("path", "text")
    parts.append(rules.line_endings(files, policy))
    lexed = lexed_lines(files, suspicious=not rules._all_tokens(policy))
    lines = with_changes(lexed, changed if policy.diff_only else None)
    parts.append(rules.on_lines(lines, policy))
    parts.append(rules.collisions(lines, policy))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def file_risk(path, policy: Policy | None = None):
    """high, medium or low: the policy's globs in this order, else the extension; unknown ones are high."""
    policy = policy or Policy()
    ext = c.extension(path)
    risk = None
    for level in ("high", "medium", "low"):
        if globs := policy.file_policies.get(level):
            test = rules.path_matches(path, globs)
            risk = F.when(test, level) if risk is None else risk.when(test, level)
    high = ext.isin(t.HIGH_EXTENSIONS) | F.lower(ext).isin(t.HIGH_EXTENSIONS)
    medium = ext.isin(t.MEDIUM_EXTENSIONS) | F.lower(ext).isin(t.MEDIUM_EXTENSIONS)
    default = F.when(high, "high").when(medium, "medium").otherwise("high")
    return default if risk is None else risk.otherwise(default)


def should_fail(severity, risk):
    """Critical findings fail anywhere, high ones in files of high risk."""
    return (severity == "critical") | ((severity == "high") & (risk == "high"))
