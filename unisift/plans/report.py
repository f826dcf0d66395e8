"""Reports of findings: rendered rows, summaries, SARIF, outputs and the verdict."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars as c
from ..functions import tables as t
from ..sources.policy import Policy
from .scan import file_risk, should_fail

# Terminal colours of severities.
COLOURS = {"critical": "\x1b[1;31m", "high": "\x1b[0;31m", "medium": "\x1b[0;33m", "low": "\x1b[0;36m"}
RESET = "\x1b[0m"
ORDER = ("file", "seq")


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def rendered(colour: bool = False) -> Column:
    """A finding for the terminal: severity, rule and place, then what was found."""
    label = F.upper("severity")
    if colour:
        label = F.concat(*(F.when(F.col("severity") == s, code).otherwise("") for s, code in COLOURS.items()), label, F.lit(RESET))
    near = F.when(F.col("snippet") != "", _text('\n    near: "', c.escape_invisible(F.col("snippet")), '"')).otherwise("")
    return _text("  ", label, " [", F.col("rule_id"), " ", F.col("rule_name"), "] ", F.col("file"), ":", F.col("line"), ":", F.col("col"), "\n    ", F.col("char_info"), "\n    ", F.col("message"), near)


def annotation() -> Column:
    """A workflow command that marks the line; columns count from 1."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").otherwise("warning")
    return _text("::", level, " file=", F.col("file"), ",line=", F.col("line"), ",col=", F.col("col") + 1, ",title=Unicode Safety [", F.col("rule_name"), "]::", F.col("char_info"), " -- ", F.col("message"))


def by_severity(findings: DataFrame) -> DataFrame:
    """severity, n."""
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def top_by_severity(findings: DataFrame, k: int = 10) -> DataFrame:
    """The first k findings of each severity, with rn. A window group limit keeps k rows a task before the shuffle."""
    first = Window.partitionBy("severity").orderBy(*ORDER)
    return findings.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k)


def counts(findings: DataFrame) -> dict[str, int]:
    row = findings.agg(F.count(F.lit(1)).alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in t.SEVERITIES)).first()
    return row.asDict()


def summary(findings: DataFrame, files_scanned: int) -> str:
    """The text summary: counts and the first ten of each severity."""
    n = counts(findings)
    out = [f"Unicode Safety Check: {files_scanned} files scanned, {n['findings']} finding(s)", ""]
    top = top_by_severity(findings).select("severity", "rn", "rule_id", "file", "line", "rule_name").orderBy("severity", "rn").collect()  # at most 40 rows
    for s in reversed(t.SEVERITIES):
        if n[s]:
            out.append(f"  {s.upper()} ({n[s]}):")
            out += [f"    {r.rule_id} {r.file}:{r.line} {r.rule_name}" for r in top if r.severity == s]
            out += [f"    ... and {n[s] - 10} more"] * (n[s] > 10)
            out.append("")
    if not n["findings"]:
        out.append("  No adversarial Unicode detected.")
    return "\n".join(out)


def table_row() -> Column:
    """A finding as a row of a Markdown table."""
    message = F.replace(F.left("message", F.lit(80)), F.lit("|"), F.lit("\\|"))
    file = F.replace(F.replace("file", F.lit("|"), F.lit("\\|")), F.lit("`"), F.lit("'"))
    return _text("| ", F.col("severity"), " | ", F.col("rule_id"), " ", F.col("rule_name"), " | `", file, "` | ", F.col("line"), " | ", message, " |")


def step_summary(findings: DataFrame, files_scanned: int) -> str:
    """The Markdown summary: counts and the first twenty findings."""
    n = counts(findings)
    out = ["### Unicode Safety Check", "", "| Metric | Count |", "|--------|-------|", f"| Files scanned | {files_scanned} |"]
    out += [f"| {s.capitalize()} | {n[s]} |" for s in reversed(t.SEVERITIES)] + [""]
    if n["findings"]:
        out += ["#### Top findings", "", "| Severity | Rule | File | Line | Description |", "|----------|------|------|------|-------------|"]
        out += [r.row for r in findings.orderBy(*ORDER).limit(20).select(table_row().alias("row")).collect()]
        out += [f"| | | | | ... and {n['findings'] - 20} more |"] * (n["findings"] > 20)
    else:
        out.append("No adversarial Unicode detected.")
    return "\n".join(out) + "\n"


def _level(severity: str) -> str:
    return {"low": "note", "medium": "warning"}.get(severity, "error")


def sarif_result() -> Column:
    """A finding as a SARIF result, in JSON."""
    level = F.when(F.col("severity") == "low", "note").when(F.col("severity") == "medium", "warning").otherwise("error")
    place = F.struct(
        F.struct(
            F.struct(F.regexp_replace("file", r"^(\./)+", "").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
            F.struct(F.col("line").alias("startLine"), (F.col("col") + 1).alias("startColumn")).alias("region"),
        ).alias("physicalLocation")
    )
    return F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(_text(F.col("char_info"), " -- ", F.col("message")).alias("text")).alias("message"), F.array(place).alias("locations")))


def sarif(findings: DataFrame, version: str = "3.0.0") -> str:
    """A SARIF 2.1.0 document. Results are streamed to the driver partition by partition; for very many, write `sarif_result` rows instead."""
    rules = [
        {"id": k, "name": r.name, "shortDescription": {"text": r.description}, "defaultConfiguration": {"level": _level(r.severity)}, "properties": {"tags": ["security", "unicode", "supply-chain"]}}
        for k, r in t.RULES.items()
    ]
    results = [json.loads(r.result) for r in findings.orderBy(*ORDER).select(sarif_result().alias("result")).toLocalIterator()]
    driver = {"name": "unisift", "version": version, "semanticVersion": version, "rules": rules}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]}, indent=2, ensure_ascii=False)


def outputs(findings: DataFrame, files_scanned: int, sarif_path: str | None = None) -> str:
    """key=value lines for a workflow."""
    n = counts(findings)
    out = [f"findings={n['findings']}", f"files_scanned={files_scanned}", f"critical={n['critical']}", f"high={n['high']}"]
    if sarif_path is not None:
        out.append("sarif_file=" + sarif_path.replace("\n", "").replace("\r", ""))
    return "\n".join(out) + "\n"


def verdict(findings: DataFrame, policy: Policy | None = None, fail_on_warn: bool = False) -> DataFrame:
    """One row: has_fail, has_warn, exit_code. Warnings are medium and low findings that don't fail."""
    fails = should_fail(F.col("severity"), file_risk(F.col("file"), policy))
    warns = ~fails & F.col("severity").isin("medium", "low")
    row = findings.agg(F.coalesce(F.bool_or(fails), F.lit(False)).alias("has_fail"), F.coalesce(F.bool_or(warns), F.lit(False)).alias("has_warn"))
    return row.withColumn("exit_code", F.when(F.col("has_fail") | (F.lit(fail_on_warn) & F.col("has_warn")), 1).otherwise(0))
