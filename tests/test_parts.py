"""Lexer, tables, globs, policies, diffs, expressions and the command."""

import random
import re

import pytest
from pyspark.sql import functions as F

from unisift import engine
from unisift.functions import chars as ch
from unisift.functions import tables as t
from unisift.functions.unicode import normal_forms
from unisift.operators.lexer import lex
from unisift.plans.scan import file_risk
from unisift.sources import files as src
from unisift.sources.policy import glob_regex, load_policy, policy_from
from unisift.streaming.scan import FILES, stream_findings


def words(text, lang):
    return [(context[0], text[a:b]) for context, a, b in lex(text, lang)]


@pytest.mark.parametrize("lang, text, want", [
    ("rust", "/* /* inner */ still */ out", [("c", "inner"), ("c", "still"), ("i", "out")]),
    ("c", "/* /* inner */ outside */", [("c", "inner"), ("i", "outside")]),
    ("c", "/*/ a */ b", [("c", "a"), ("i", "b")]),
    ("python", 'x = r"hello\\nworld" # done', [("i", "x"), ("s", "r"), ("s", "hello"), ("s", "nworld"), ("c", "done")]),
    ("python", 'a = """one\ntwo""" b', [("i", "a"), ("s", "one"), ("s", "two"), ("i", "b")]),
    ("python", "'''never\nclosed", [("s", "never"), ("s", "closed")]),
    ("javascript", "x = `one\ntwo` + y // z", [("i", "x"), ("s", "one"), ("s", "two"), ("i", "y"), ("c", "z")]),
    ("go", "x = `one\ntwo", [("i", "x"), ("s", "one"), ("i", "two")]),
    ("lua", "a -- b\nc", [("i", "a"), ("c", "b"), ("i", "c")]),
    ("html", "<p> a <!-- b --> c <!-- d\ne", [("i", "p"), ("i", "a"), ("c", "b"), ("i", "c"), ("c", "d"), ("i", "e")]),
    ("unknown", "it's\nok \"a\\\"b\" c", [("i", "it"), ("s", "s"), ("i", "ok"), ("s", "a"), ("s", "b"), ("i", "c")]),
    ("json", "# a", [("i", "a")]),
])
def test_lexer(lang, text, want):
    assert words(text, lang) == want


@pytest.mark.parametrize("lang", sorted({*t.LANGUAGE_BY_EXTENSION.values(), "unknown", "dockerfile"}))
def test_lexer_is_total(lang):
    """Every word of the text is a token once, in order, whatever the text."""
    rng = random.Random(lang)
    for _ in range(60):
        text = "".join(rng.choice(['"', "'", "`", "\\", "\n", "\r\n", "/*", "*/", "//", "#", "--", "<!--", "-->", '"""', " r", "ab1", " ", chr(0xE9)]) for _ in range(40))
        found = [text[a:b] for _, a, b in lex(text, lang)]
        assert found == re.findall("[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*", text)


def test_tables():
    for ranges in (t.CLASS_RANGES, t.SCRIPT_RANGES):
        assert all(lo <= hi for lo, hi, _ in ranges) and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert len(t.RULES) == 19 and len(t.CONFUSABLES) == 206 + 52 and len(t.CHAR_NAMES) == 190 and len(t.HIGH_EXTENSIONS) == 43 and len(t.MEDIUM_EXTENSIONS) == 15 and len(t.EXCLUDED_SUFFIXES) == 37


def test_classes(spark):
    want = {0: "USC007", 9: None, 0x7F: "USC007", 0xFFFF: None, 0x10FFFF: None, 0xE0001: "USC012", 0xE007F: "USC012", 0xE0100: "VS", 0xE01EF: "VS", 0x200B: "USC002", 0x3164: "USC016", 0xFFFB: "USC014", 0x2028: None}
    found = spark.createDataFrame([(k,) for k in want], "cp int").select("cp", ch.classify(F.col("cp")), ch.char_info(F.col("cp"))).collect()
    assert {r[0]: r[1] for r in found} == want
    info = {r[0]: r[2] for r in found}
    assert info[0x200B] == "U+200B ZERO WIDTH SPACE" and info[0xE0001] == "U+E0001 <unnamed U+E0001>" and info[0] == "U+0000 <unnamed U+0000>"


def test_text_expressions(spark):
    df = spark.createDataFrame([("a\rb\n",), ("",), ("x\r\ny",), (None,)], "s string")
    assert [r[0] for r in df.select(ch.lines(F.col("s"))).collect()] == [["a\r", "b\n"], [], ["x\r\n", "y"], None]
    long = "".join(chr(97 + i % 26) for i in range(100))
    one = spark.range(1).select(ch.snippet(F.lit(long), F.lit(50)), ch.snippet(F.lit(""), F.lit(0)), ch.snippet(F.lit("short\n"), F.lit(2)), ch.escape_invisible(F.lit("hello" + chr(0x200B) + "w\t\n"))).first()
    assert tuple(one) == ("..." + long[30:70] + "...", "", "short", "hello\\u{200B}w\t\n")
    depth = spark.range(1).select(*ch.bidi_depths(F.lit(chr(0x202C) + chr(0x202A) + "x" + chr(0x202B) + chr(0x202C)), t.EMBED_OPEN, t.EMBED_CLOSE)).first()
    assert tuple(depth) == (1, 1)
    forms = spark.createDataFrame([(chr(0x212B),), (chr(0x0401),), (chr(0x2126),), (chr(0x212A),), (None,)], "s string").select(normal_forms(F.col("s")).alias("f")).select("f.skeleton").collect()
    assert [r[0] for r in forms] == ["A" + chr(0x30A), "E" + chr(0x308), chr(0x3A9), "K", None]


@pytest.mark.parametrize("glob, path, want", [("*.[ch]", "a/b.c", True), ("[!abc]x", "dx", True), ("[!abc]x", "ax", False), ("**", "a/b", True), ("a[", "a[", True), ("?.py", "a.py", True), ("*.py", "a.pyc", False), ("[]x]", "]", True), ("build", "src/builder.rs", False)])
def test_globs(spark, glob, path, want):
    assert spark.range(1).select(F.lit(path).rlike(glob_regex(glob))).first()[0] is want


def test_paths(spark):
    paths = ["img/logo.PNG", "bundle.min.js", "src/builder.rs", "mydist/x", "a\\vendor\\b.c", "x/.env", "Dockerfile", "a.tar.gz", "b.Md", "c.tf", "d.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    found = {r[0]: r[1:] for r in df.select("path", src.excluded(F.col("path"), ["*.tf"]), ch.language(F.col("path")), file_risk(F.col("path")), ch.extension(F.col("path"))).collect()}
    assert [p for p in paths if found[p][0]] == ["img/logo.PNG", "bundle.min.js", "mydist/x", "a\\vendor\\b.c", "a.tar.gz", "c.tf"]
    assert found["Dockerfile"][1] == "dockerfile" and found["b.Md"][1:3] == ("markdown", "medium") and found["x/.env"][1:] == ("unknown", "high", "") and found["d.csv"][2] == "medium"


def test_policy_files(tmp_path):
    assert load_policy(None).severity == {} and load_policy(str(tmp_path)).diff_only
    path = tmp_path / "p.json"
    path.write_text('{"version": 1, "file_policies": {"high-risk": ["*.x"], "low": {"patterns": ["*.po"]}}, "allow": [{"characters": ["ZWJ", "U+110000", "what", 65]}]}')
    policy = load_policy(str(path))
    assert policy.file_policies == {"high": ["*.x"], "low": ["*.po"]} and policy.allow == [(["**"], {0x200D, 65})]
    (tmp_path / "p.toml").write_text("a = 1")
    with pytest.raises(ValueError, match="Unsupported policy format"):
        load_policy(str(tmp_path / "p.toml"))
    assert policy_from(None).identifier_policy == "ascii-only"


def test_diff(spark):
    text = "+++ b/a.py\n@@ -1,3 +1,4 @@ f\n+x\n@@ -5 +9 @@\n@@ -7,2 +7,0 @@\n+++ b/b.py\n+++ \"b/c.py\"\n@@ -1 +2 @@".split("\n")
    rows = spark.createDataFrame([(0, i, line) for i, line in enumerate(text)], "diff_id int, line_no int, text string")
    found = {(r.path, r.line) for r in src.changed_from_diff(rows).collect()}
    assert found == {("a.py", None), ("a.py", 1), ("a.py", 2), ("a.py", 3), ("a.py", 4), ("a.py", 9), ("b.py", None), ("b.py", 2)}
    assert src.changed_from_git(spark, "not hex") is None


def test_command(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x" + chr(0x200B) + " = 1\n")
    (tmp_path / "src/b.md").write_text("plain\n")
    (tmp_path / "src/c.dat").write_bytes(b"a\0b" + chr(0x200B).encode())
    (tmp_path / "node_modules/d.py").write_text(chr(0x200B))
    out = engine.run(spark, engine.Options(sarif_file=str(tmp_path / "out.sarif")), str(tmp_path))
    assert out.exit_code == 1 and out.files_scanned == 3 and {r.file for r in out.findings.collect()} == {"src/a.py"}
    assert (tmp_path / "out.sarif").read_text().count("USC002") >= 2 and "findings=2" in out.outputs()
    assert out.annotations().count() == 2
    (tmp_path / "list.txt").write_text(f"\n {tmp_path}/src/b.md \n{tmp_path}/none\n")
    assert engine.run(spark, engine.Options(file_list=str(tmp_path / "list.txt"))).exit_code == 0
    options = engine.Options(exclude=["a"]).with_environment({"INPUT_EXCLUDE_PATTERNS": " b \n\nc", "INPUT_FAIL_ON_WARN": "true", "INPUT_SCAN_MODE": "all"})
    assert options.exclude == ["a", "b", "c"] and options.fail_on_warn and options.scan_all


def test_hidden_files(spark, tmp_path):
    names = ["pkg/__init__.py", "pkg/mod.py", "_config.yml", ".github/x.yml", ".env", "_drafts/.hidden/a.md"]
    for name in [*names, ".git/b.py", "pkg/__pycache__/c.py"]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" + chr(0x200B) + " = 1\n")
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere")
    out = engine.run(spark, engine.Options(scan_all=True), str(tmp_path))
    assert {r.file for r in out.findings.collect()} == set(names) and out.files_scanned == len(names) and out.exit_code == 1
    out = engine.run(spark, engine.Options(files=[f"{tmp_path}/pkg/__init__.py", f"{tmp_path}/.env", f"{tmp_path}/none"]))
    assert {r.file for r in out.findings.collect()} == {f"{tmp_path}/pkg/__init__.py", f"{tmp_path}/.env"} and out.files_scanned == 2


def test_command(spark, tmp_path, monkeypatch, capsys):
    from unisift.__main__ import main, options

    (tmp_path / "app/[id]").mkdir(parents=True)
    (tmp_path / "app/[id]/page.tsx").write_text("let a" + chr(0x202E) + " = 1\n")
    (tmp_path / "clean.py").write_text("a = 1\n")
    deep = tmp_path / "/".join("d" * 64)
    deep.mkdir(parents=True)
    (deep / "far.py").write_text("x" + chr(0x200B))
    (deep.parent / "near.py").write_text("x" + chr(0x200B))
    monkeypatch.chdir(tmp_path)
    for name in ("GITHUB_STEP_SUMMARY", "GITHUB_OUTPUT"):
        monkeypatch.setenv(name, str(tmp_path / f"{name}.log"))
    assert main(["--all", "--exclude", "d/*", "--sarif-file", str(tmp_path / "out.sarif")]) == 1
    said = capsys.readouterr().out
    assert "app/[id]/page.tsx:1:5" in said and "::error file=app/[id]/page.tsx,line=1,col=6" in said and "SARIF report written to" in said
    assert "| Critical | 2 |" in (tmp_path / "GITHUB_STEP_SUMMARY.log").read_text() and "findings=3" in (tmp_path / "GITHUB_OUTPUT.log").read_text()
    assert main(["--no-annotations", "clean.py"]) == 0 and "::" not in capsys.readouterr().out
    assert (tmp_path / "GITHUB_OUTPUT.log").read_text().count("files_scanned=") == 2
    # a walk stops at the depth limit, a named file is read anyway
    assert {r.file for r in engine.run(spark, engine.Options(scan_all=True), str(tmp_path / "d")).findings.collect()} >= {str((deep.parent / "near.py").relative_to(tmp_path / "d"))}
    assert not any(r.file.endswith("far.py") for r in engine.run(spark, engine.Options(scan_all=True)).findings.collect())
    assert any(r.file.endswith("far.py") for r in engine.run(spark, engine.Options(files=[str(deep / "far.py")])).findings.collect())
    monkeypatch.setenv("INPUT_FAIL_ON_WARN", "TRUE")
    chosen, colour = options(["a.py", "--no-color"])
    assert chosen.files == ["a.py"] and chosen.fail_on_warn and not colour
    with pytest.raises(SystemExit):
        options(["--all", "--file-list", "x"])


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("x" + chr(0x200B) + " = 1\n")
    (tmp_path / "in/b.py").write_bytes(b"\xff")
    files = spark.readStream.format("binaryFile").schema(FILES).load(str(tmp_path / "in")).select("path", "content")
    run = stream_findings(files).select("rule_id").writeStream.format("memory").queryName("found").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.rule_id for r in spark.table("found").collect()) == ["USC002", "USC008", "USC019"]
