"""Whole findings of small files, reports, gates and policies."""

import json

import pytest

from unisift.plans import report
from unisift.plans.scan import scan
from unisift.sources.policy import policy_from


def c(*points: int) -> str:
    return "".join(map(chr, points))


#: name: (content, rows as "rule line:col")
CASES = {
    "clean.py": ("def hello():\n    return 1\n", []),
    "bidi.py": ("a = 1\nb = 2\n\naccess" + c(0x202E) + '_check = "user"\n', ["USC001 4:6", "USC015 4:0", "USC019 4:6"]),
    "bidi_pair.py": ('a = 1\nx = "' + c(0x202A) + 'unbalanced"\n', ["USC001 2:5", "USC015 2:0"]),
    "invisible.py": ("def hel" + c(0x200B) + "lo():\n", ["USC002 1:7", "USC019 1:7"]),
    "confusable.py": ("price = 100\n" + c(0x440) + "rice = 0\n", ["USC003 2:0", "USC019 2:0", "USC017 2:0", "USC004 2:0"]),
    "mixed_script.py": ("myV" + c(0x430) + "r = 42\n", ["USC003 1:0", "USC019 1:3", "USC017 1:3"]),
    "nbsp.js": ("function f() {\n" + c(0xA0, 0xA0) + "return true;\n}\n", ["USC005 2:0", "USC005 2:1", "USC019 2:0"]),
    "control.txt": ("one\nLine with BEL" + c(7) + " character\n", ["USC007 2:13"]),
    "normalization.py": ("x = 1\ncafe" + c(0x301) + ' = "coffee"\n', ["USC019 2:4", "USC006 2:0"]),
    "misplaced_bom.py": ('a = 1\nx = "' + c(0xFEFF) + 'hello"\n', ["USC009 2:5"]),
    "first_bom.txt": (c(0xFEFF) + "1\n", ["USC019 1:0"]),
    "variation_sel.txt": ("a" + c(0xFE00) + "b" + c(0xFE01) + "c" + c(0xFE02) + "d\n", ["USC010 1:0", "USC019 1:1"]),
    "private_use.txt": ("text with private use char " + c(0xE000) + " here\n", ["USC011 1:27", "USC019 1:27"]),
    "tag_char.txt": ("text with tag char " + c(0xE0001) + " here\n", ["USC012 1:19", "USC019 1:19"]),
    "deprecated_fmt.txt": ("text with deprecated " + c(0x206A) + " here\n", ["USC013 1:21", "USC019 1:21"]),
    "annotation.txt": ("text with annotation " + c(0xFFF9) + "anchor" + c(0xFFFA) + "body" + c(0xFFFB) + " here\n", ["USC014 1:21", "USC014 1:28", "USC014 1:33", "USC019 1:21"]),
    "ignorable.txt": ("text with hangul filler " + c(0x3164) + " here\n", ["USC016 1:24", "USC019 1:24"]),
    "mixed_endings.txt": ("line one\r\nline two\nline three\n", ["USC018 1:0"]),
    "bad.bin": (b"ab\n\xff", ["USC008 2:0"]),
    "cut.bin": (b"ok \xe2\x82", ["USC008 1:3"]),
    "balanced.txt": ("1 " + c(0x202A, 0x202C) + " 2\n", ["USC001 1:2", "USC001 1:3", "USC019 1:2"]),
    "empty.py": ("", []),
}


def rows(findings):
    out = {}
    for r in findings.orderBy("file", "seq").collect():
        out.setdefault(r.file, []).append(f"{r.rule_id} {r.line}:{r.col}")
    return out


@pytest.fixture(scope="module")
def files(spark):
    data = [(k, v if isinstance(v, bytes) else v.encode()) for k, (v, _) in CASES.items()]
    return spark.createDataFrame([*data, (None, b"x"), ("null.py", None)], "path string, content binary").repartition(3)


def test_findings(files):
    found = rows(scan(files))
    assert {k: found.get(k, []) for k in CASES} == {k: want for k, (_, want) in CASES.items()}
    assert set(found) <= set(CASES)


def test_messages_and_reports(files):
    found = scan(files).cache()
    at = {(r.file, r.rule_id): r for r in found.collect()}
    assert at["confusable.py", "USC004"].message == f"'{c(0x440)}rice' has same skeleton as 'price' (line 1:0)"
    assert at["bad.bin", "USC008"].message == "Not valid UTF-8: byte 3: invalid utf-8 sequence of 1 bytes from index 3"
    assert at["cut.bin", "USC008"].char_info == "byte 3: incomplete utf-8 byte sequence from index 3"
    assert at["mixed_endings.txt", "USC018"].message == "Mixed line endings: CRLF, LF"
    assert at["bidi.py", "USC015"].message == "Unbalanced bidi embedding/override controls (unclosed: 1, orphan closers: 0)"
    assert at["invisible.py", "USC002"].message == "Invisible formatting character U+200B ZERO WIDTH SPACE in identifier"
    n = report.counts(found)
    assert n["findings"] == sum(len(want) for _, want in CASES.values())
    text = report.summary(found, len(CASES))
    assert f"CRITICAL ({n['critical']}):" in text and f"... and {n['critical'] - 10} more" in text
    assert "| Files scanned | 22 |" in report.step_summary(found, 22)
    sarif = json.loads(report.sarif(found))
    assert len(sarif["runs"][0]["results"]) == n["findings"] and len(sarif["runs"][0]["tool"]["driver"]["rules"]) == 19
    shown = found.where("file = 'invisible.py' and rule_id = 'USC002'").select(report.rendered(), report.annotation()).first()
    assert shown[0].endswith('near: "def hel\\u{200B}lo():"') and shown[1].startswith("::error file=invisible.py,line=1,col=8,")
    assert report.outputs(found, 3, "a\nb").endswith("sarif_file=ab\n")
    found.unpersist()


@pytest.mark.parametrize("name, fails, warns", [("nbsp.js", 0, 1), ("bidi.py", 1, 1), ("ignorable.txt", 0, 1), ("clean.py", 0, 0), ("mixed_endings.txt", 0, 1)])
def test_verdict(files, name, fails, warns):
    found = scan(files.where(f"path = '{name}'"))
    assert report.verdict(found).first().exit_code == fails
    assert report.verdict(found, fail_on_warn=True).first().exit_code == (fails or warns)


def test_changed_lines(spark, files):
    changed = spark.createDataFrame([("bidi.py", None), ("confusable.py", 1), ("invisible.py", 1), ("nbsp.js", 1)], "path string, line int")
    found = rows(scan(files, changed=changed))
    assert found["bidi.py"] == ["USC001 4:6", "USC015 4:0"]
    assert "confusable.py" not in found and "nbsp.js" not in found
    assert found["invisible.py"] == ["USC002 1:7", "USC019 1:7"] and found["mixed_script.py"]


def test_policy(files):
    policy = policy_from({
        "allow": [{"paths": ["*.py"], "characters": ["U+200B", 0x202E]}], "severity": {"homoglyph": "LOW", "bidi-pairing": "nonsense"},
        "contexts": {"identifier": {"mixed-script": "ignore", "suspicious-spacing": "ignore"}}, "identifier_policy": "permitted-scripts", "permitted_scripts": ["Latin"], "encoding": "any",
    })
    found = scan(files, policy).cache()
    by = rows(found)
    assert by["invisible.py"] == ["USC019 1:4"] and by["bidi.py"] == ["USC015 4:0", "USC019 4:0"]
    assert "nbsp.js" not in by and "bad.bin" not in by
    assert by["mixed_script.py"] == ["USC019 1:0", "USC017 1:3"]
    assert {r.severity for r in found.where("rule_id = 'USC017'").collect()} == {"low"}
    assert {r.severity for r in found.where("rule_id = 'USC015'").collect()} == {"critical"}
    found.unpersist()
