"""The command's options as one call: which files, which policy, which reports."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import report
from .plans.scan import scan
from .sources import files as f
from .sources.policy import Policy, load_policy


@dataclass
class Options:
    files: list[str] = field(default_factory=list)
    file_list: str | None = None
    scan_all: bool = False
    policy_file: str | None = None
    base_sha: str | None = None
    sarif_file: str | None = None
    exclude: list[str] = field(default_factory=list)
    fail_on_warn: bool = False
    disable_annotations: bool = False

    def with_environment(self, env: Mapping[str, str] = os.environ) -> Options:
        """Options from INPUT_* variables where none is given; flags are joined, exclusions are added."""
        yes = lambda name: env.get(name, "").lower() == "true"
        return Options(
            self.files, self.file_list, self.scan_all or env.get("INPUT_SCAN_MODE") == "all", self.policy_file or env.get("INPUT_POLICY_FILE") or None,
            self.base_sha or env.get("INPUT_BASE_SHA") or None, self.sarif_file or env.get("INPUT_SARIF_FILE") or None,
            [*self.exclude, *(x.strip() for x in env.get("INPUT_EXCLUDE_PATTERNS", "").splitlines() if x.strip())],
            self.fail_on_warn or yes("INPUT_FAIL_ON_WARN"), self.disable_annotations or yes("INPUT_DISABLE_ANNOTATIONS"),
        )


@dataclass
class Outcome:
    findings: DataFrame
    files_scanned: int
    exit_code: int
    policy: Policy
    options: Options

    def summary(self) -> str:
        return report.summary(self.findings, self.files_scanned)

    def step_summary(self) -> str:
        return report.step_summary(self.findings, self.files_scanned)

    def outputs(self) -> str:
        return report.outputs(self.findings, self.files_scanned, self.options.sarif_file)

    def append_reports(self, env: Mapping[str, str] = os.environ) -> None:
        """Append the Markdown summary and the outputs to the files that a workflow's environment names, if it does."""
        for name, text in (("GITHUB_STEP_SUMMARY", self.step_summary), ("GITHUB_OUTPUT", self.outputs)):
            if path := env.get(name):
                with open(path, "a", encoding="utf-8") as out:
                    out.write(text())

    def annotations(self) -> DataFrame:
        found = self.findings.orderBy(*report.ORDER).select(report.annotation().alias("annotation"))
        return found.limit(0) if self.options.disable_annotations else found


def run(spark: SparkSession, options: Options, root: str = ".") -> Outcome:
    """Scan files below a root, of a list, or as given; write SARIF if asked; decide the exit code."""
    policy = load_policy(options.policy_file)
    if options.scan_all or not (options.files or options.file_list):
        listed = f.files_from_directory(spark, root)
    else:
        paths = f.paths_from_list(options.file_list) if options.file_list else options.files
        listed = f.files_from_paths(spark, paths)
    listed = listed.where(~f.excluded(F.col("path"), options.exclude))
    changed = f.changed_from_git(spark, options.base_sha, root) if options.base_sha and policy.diff_only else None
    findings = scan(f.scannable(listed, options.exclude), policy, changed).persist()
    if options.sarif_file:
        with open(options.sarif_file, "w", encoding="utf-8") as out:
            out.write(report.sarif(findings))
    exit_code = report.verdict(findings, policy, options.fail_on_warn).first()["exit_code"]
    return Outcome(findings, listed.select("path").count(), exit_code, policy, options)
