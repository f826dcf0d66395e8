"""The detection rules as expressions on lines and files.

Lines come from `lexed_lines` and carry `is_changed`. Every rule on characters, lines and tokens adds to one array per
line, which is exploded once, so a line is read once; only the collision rule needs rows of a file together.
A finding has rule_id, rule_name, severity, file, line, col, message, char_info, context, snippet and seq, its place in
the order of a report.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chars as c
from ..functions import tables as t
from ..sources.policy import Policy, glob_regex

FINDING = ("rule_id", "rule_name", "severity", "file", "line", "col", "message", "char_info", "context", "snippet", "seq")


def lookup(column: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), column)


def path_matches(path: Column, globs: list[str]) -> Column:
    """Any glob matches the path or its file name."""
    return reduce(lambda a, b: a | b, (x.rlike(glob_regex(g)) for g in globs for x in (path, c.basename(path))), F.lit(False))


def allowed(path: Column, cp: Column, policy: Policy) -> Column:
    return reduce(lambda a, b: a | b, (cp.isin(*sorted(points)) & path_matches(path, globs) for globs, points in policy.allow if points), F.lit(False))


def ignored(rule_name: Column, context: Column, policy: Policy) -> Column:
    pairs = [(ctx, name) for ctx, actions in policy.contexts.items() for name, action in actions.items() if action == "ignore"]
    return reduce(lambda a, b: a | b, ((context == ctx) & (rule_name == name) for ctx, name in pairs), F.lit(False))


def _finding(rule: str | Column, col: Column, message: Column, info: Column, context: Column, snippet: Column, *order: Column) -> Column:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    seq = F.array(*(x.cast("int") for x in (*order, *[F.lit(0)] * (4 - len(order)))))
    return F.struct(rule.alias("rule_id"), col.cast("int").alias("col"), message.alias("message"), info.alias("char_info"), context.alias("context"), snippet.alias("snippet"), seq.alias("seq"))


def _placed(rows: DataFrame, policy: Policy) -> DataFrame:
    """Rows with file, line, seq's head and a finding f, as findings."""
    names = {k: r.name for k, r in t.RULES.items()}
    severities = {k: policy.severity_of(k) for k in t.RULES}
    return rows.select(
        "f.rule_id", lookup(F.col("f.rule_id"), names).alias("rule_name"), lookup(F.col("f.rule_id"), severities).alias("severity"), F.col("path").alias("file"), "line",
        "f.col", "f.message", "f.char_info", "f.context", "f.snippet", F.concat(F.array("head"), "f.seq").alias("seq"),
    )


def _quoted(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def char_findings(policy: Policy) -> Column:
    """Array of findings on a line's characters (columns path, line, text, context, is_changed)."""
    text, context = F.col("text"), F.col("context")
    nouns = {k: r.noun for k, r in t.RULES.items() if r.noun}
    kept = F.filter(
        F.transform(c.hits(text, c.CLASSIFIED), lambda x: F.struct(x["i"].alias("i"), x["cp"].alias("cp"), F.when(x["cp"] == 0xFEFF, "USC009").otherwise(c.classify(x["cp"])).alias("rule"))),
        lambda x: x["rule"].isNotNull() & (x["rule"] != "VS")
        & F.when(x["rule"] == "USC009", ~((F.col("line") == 1) & (x["i"] == 0))).otherwise(
            (F.col("is_changed") | x["rule"].isin(*t.ALWAYS)) & ~allowed(F.col("path"), x["cp"], policy) & ~ignored(lookup(x["rule"], {k: t.RULES[k].name for k in nouns}), context, policy)
        ),
    )

    def finding(x: Column) -> Column:
        info = c.char_info(x["cp"])
        bom = x["rule"] == "USC009"
        message = F.when(bom, "Misplaced byte-order mark").otherwise(_quoted(lookup(x["rule"], nouns), " ", info, " in ", context))
        return _finding(x["rule"], x["i"], message, info, F.when(bom, "other").otherwise(context), c.snippet(text, x["i"]), F.lit(1), x["i"])

    return F.transform(kept, finding)


def line_findings() -> Column:
    """Array of findings on a line as a whole: variation selectors and unpaired bidirectional controls."""
    text, head = F.col("text"), F.substring("text", 1, 80)
    n = F.regexp_count(text, F.lit(c.VARIATION))
    found = [F.when(F.col("is_changed") & (n >= 3), _finding("USC010", F.lit(0), _quoted(n.cast("string"), " variation selectors on one line"), _quoted(n.cast("string"), " variation selectors"), F.col("context"), head, F.lit(2)))]
    for place, (kind, word, openers, closer) in enumerate((("embedding/override", "embed", t.EMBED_OPEN, t.EMBED_CLOSE), ("isolate", "isolate", t.ISOLATE_OPEN, t.ISOLATE_CLOSE))):
        opened, orphans = c.bidi_depths(text, openers, closer)
        message = _quoted(f"Unbalanced bidi {kind} controls (unclosed: ", opened.cast("string"), ", orphan closers: ", orphans.cast("string"), ")")
        unpaired = text.rlike("[" + "".join(map(chr, (*openers, closer))) + "]") & (opened + orphans > 0)
        found.append(F.when(unpaired, _finding("USC015", F.lit(0), message, _quoted(f"{word} imbalance: ", (opened + orphans).cast("string")), F.lit("other"), head, F.lit(3 + place))))
    return F.filter(F.array(*found), lambda f: f.isNotNull())


def token_findings(policy: Policy) -> Column:
    """Array of findings on a changed line's tokens: scripts, identifier policy, homoglyphs, normalization."""
    own = F.filter("tokens", lambda w: F.col("is_changed") & (F.lit(_all_tokens(policy)) | w["text"].rlike(c.NON_ASCII)))

    def of(w: Column) -> Column:
        word, context, col, i = w["text"], w["context"], w["col"], w["i"]
        letters = c.characters(word)
        scripts = F.transform(letters, lambda x: c.script(x["ch"]))
        distinct = F.array_sort(F.array_distinct(F.filter(scripts, lambda s: ~s.isin("Common", "Inherited", "Unknown"))))
        listed = F.array_join(distinct, ", ")
        is_name = context == "identifier"
        mixed = is_name & word.rlike(c.FOREIGN) & (F.size(distinct) > 1) & ~F.lit("mixed-script" in policy.contexts.get("identifier", {}) and policy.contexts["identifier"]["mixed-script"] == "ignore")
        out = [F.when(mixed, F.array(_finding("USC003", col, _quoted("Mixed-script identifier '", word, "' (", listed, ")"), _quoted("scripts: ", listed), context, word, F.lit(5), i, F.lit(0))))]
        if policy.identifier_policy == "ascii-only":
            wide = F.get(F.filter(letters, lambda x: x["cp"] > 0x7F), F.lit(0))
            info = c.char_info(wide["cp"])
            out.append(F.when(is_name & wide.isNotNull(), F.array(_finding("USC019", col + wide["i"], _quoted("Non-ASCII ", info, " in identifier '", word, "' (policy: ascii-only)"), info, context, word, F.lit(5), i, F.lit(1)))))
        elif policy.identifier_policy == "permitted-scripts":
            bad = F.get(F.filter(scripts, lambda s: ~s.isin("Common", "Inherited", *sorted(policy.permitted_scripts))), F.lit(0))
            out.append(F.when(is_name & bad.isNotNull(), F.array(_finding("USC019", col, _quoted("Identifier '", word, "' uses script '", bad, "' not in permitted set"), _quoted("script ", bad), context, word, F.lit(5), i, F.lit(1)))))
        alike = F.filter(c.hits(word, c.ALIKE), lambda x: context != "string")
        out.append(F.transform(alike, lambda x: _finding("USC017", col + x["i"], _quoted("Homoglyph ", c.char_info(x["cp"]), " looks like '", c.confusable(x["cp"]), "' in ", context), c.char_info(x["cp"]), context, word, F.lit(5), i, F.lit(2))))
        forms = F.concat(F.lit("NFC: '"), w["nfc"], F.when(w["nfkc"] != w["nfc"], F.concat(F.lit("', NFKC: '"), w["nfkc"])).otherwise(""), F.lit("'"))
        out.append(F.when(w["nfc"] != word, F.array(_finding("USC006", col, _quoted("'", word, "' changes under NFC (", forms, ")"), forms, context, word, F.lit(5), i, F.lit(3)))))
        return F.flatten(F.filter(F.array(*out), lambda a: a.isNotNull()))

    return F.flatten(F.transform(own, of))


def _all_tokens(policy: Policy) -> bool:
    """ASCII identifiers can break the policy too."""
    return policy.identifier_policy == "permitted-scripts" and "Latin" not in policy.permitted_scripts


def exploded(lines: DataFrame, found: Column, policy: Policy) -> DataFrame:
    """Findings of an array per line. The generator is an outer one, since Spark would compute the array of an inner one
    once more for an inferred filter on its size."""
    return _placed(lines.select("path", "line", F.col("line").alias("head"), F.explode_outer(found).alias("f")).where("f is not null"), policy)


def on_lines(lines: DataFrame, policy: Policy) -> DataFrame:
    """All findings on characters, lines and tokens but collisions: one pass, no shuffle."""
    found = F.concat(char_findings(policy), line_findings(), token_findings(policy))
    return exploded(lines, found, policy)


def collisions(lines: DataFrame, policy: Policy) -> DataFrame:
    """Identifiers whose skeleton the file's changed lines first had with another text.

    Only files with an identifier beyond ASCII reach this; one shuffle by file and skeleton.
    """
    names = lines.where("is_changed").select("path", "line", F.explode("tokens").alias("w")).where("w.context = 'identifier'")
    names = names.withColumn("skeleton", F.coalesce("w.skeleton", "w.text"))
    seen = Window.partitionBy("path", "skeleton").orderBy("line", "w.col")
    names = names.withColumn("first", F.first(F.struct(F.col("w.text").alias("text"), "line", F.col("w.col").alias("col"))).over(seen)).where("w.text != first.text")
    word = F.col("w.text")
    message = _quoted("'", word, "' has same skeleton as '", F.col("first.text"), "' (line ", F.col("first.line").cast("string"), ":", F.col("first.col").cast("string"), ")")
    f = _finding("USC004", F.col("w.col"), message, _quoted("confusable with '", F.col("first.text"), "'"), F.lit("identifier"), word, F.lit(5), F.col("w.i"), F.lit(4))
    return _placed(names.select("path", "line", F.col("line").alias("head"), f.alias("f")), policy)


def line_endings(files: DataFrame, policy: Policy) -> DataFrame:
    """Files (path, text) with more than one kind of line end."""
    text = F.col("text")
    kinds = F.concat_ws(", ", F.when(text.contains("\r\n"), "CRLF"), F.when(text.rlike("(?<!\r)\n"), "LF"), F.when(text.rlike("\r(?!\n)"), "CR"))
    f = _finding("USC018", F.lit(0), _quoted("Mixed line endings: ", kinds), _quoted("mixed: ", kinds), F.lit("other"), F.lit(""), F.lit(0))
    found = files.where(text.contains("\r")).where(kinds.contains(","))
    return _placed(found.select("path", F.lit(1).alias("line"), F.lit(0).alias("head"), f.alias("f")), policy)


def _first_error(contents: pa.Array) -> pa.Array:
    out = []
    for raw in contents.to_pylist():
        try:
            raw.decode()
            out.append(None)
        except UnicodeDecodeError as e:
            before = raw[: e.start]
            what = "incomplete utf-8 byte sequence" if e.reason == "unexpected end of data" else f"invalid utf-8 sequence of {e.end - e.start} bytes"
            out.append({"line": before.count(b"\n") + 1, "col": len(before.rpartition(b"\n")[2].decode()), "info": f"byte {e.start}: {what} from index {e.start}"})
    return pa.array(out, pa.struct([("line", pa.int32()), ("col", pa.int32()), ("info", pa.string())]))


def invalid_encoding(files: DataFrame, policy: Policy) -> DataFrame:
    """One finding for each file (path, content) that isn't UTF-8. Only these files' bytes reach Python."""
    bad = files.where(~F.is_valid_utf8(F.col("content"))).select("path", F.arrow_udf(_first_error, "struct<line: int, col: int, info: string>")("content").alias("e"))
    f = _finding("USC008", F.col("e.col"), _quoted("Not valid UTF-8: ", F.col("e.info")), F.col("e.info"), F.lit("other"), F.lit(""), F.lit(0))
    return _placed(bad.select("path", F.col("e.line").alias("line"), F.lit(0).alias("head"), f.alias("f")), policy)
