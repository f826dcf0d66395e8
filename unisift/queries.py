"""One query per operator of the scan, over whole tables, and the same as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import chars as c
from .functions import tables as t
from .operators import lexer, rules
from .plans import report
from .plans.scan import file_risk, scan, should_fail, with_changes
from .sources import files as src
from .sources.policy import Policy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- pieces of SQL -------------------------------------------------------------------------------------------------

_LINES = "lines AS (SELECT path, unnest(ls) AS text, generate_subscripts(ls, 1)::INTEGER AS line FROM (SELECT path, regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+$') AS ls FROM files))"
_CHARS = "chars AS (SELECT path, line, text, unnest(cs) AS ch, (generate_subscripts(cs, 1) - 1)::INTEGER AS col FROM (SELECT *, string_split(text, '') AS cs FROM lines WHERE regexp_matches(text, '[^\\x09\\x0A\\x0D\\x20-\\x7E]')))"


def _between(cp: str, ranges: list[tuple[int, int, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {cp} BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in ranges) + " END"


def _map(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k if isinstance(k, int) else repr(k)} THEN {fx.sql_text(v)}" for k, v in values.items()) + " END"


_HEX = "upper(lpad(to_hex(unicode(ch)), greatest(4, length(to_hex(unicode(ch))))::INTEGER, '0'))"
_INFO = f"'U+' || {_HEX} || ' ' || coalesce({_map('unicode(ch)', t.CHAR_NAMES)}, '<unnamed U+' || {_HEX} || '>')"
_SNIPPET = """CASE WHEN length(text) = 0 THEN '' ELSE (CASE WHEN greatest(least(col, length(text) - 1) - 20, 0) > 0 THEN '...' ELSE '' END)
  || regexp_replace(substr(text, greatest(least(col, length(text) - 1) - 20, 0) + 1, least(least(col, length(text) - 1) + 20, length(text)) - greatest(least(col, length(text) - 1) - 20, 0)), '[\\r\\n]+$', '')
  || (CASE WHEN least(least(col, length(text) - 1) + 20, length(text)) < length(text) THEN '...' ELSE '' END) END"""
_CLASSED = f"classed AS (SELECT *, CASE WHEN unicode(ch) = 65279 THEN 'USC009' ELSE {_between('unicode(ch)', t.CLASS_RANGES)} END AS rule_id FROM chars)"
_CHAR_FINDINGS = f"found AS (SELECT rule_id, path AS file, line, col, {_INFO} AS char_info, {_SNIPPET} AS snippet FROM classed WHERE rule_id <> 'VS' AND NOT (rule_id = 'USC009' AND line = 1 AND col = 0))"
_WITH_CHARS = f"WITH {fx.files_sql()}, {_LINES}, {_CHARS}, {_CLASSED}, {_CHAR_FINDINGS}"

# tokens of .txt files: strings by quotes, identifiers, and what is between, as one tiling of each line
_WORD = "[A-Za-z_\\x{80}-\\x{10FFFF}][A-Za-z0-9_\\x{80}-\\x{10FFFF}]*"
_STRING = "|".join(q + f"[^{q}\\\\\\r\\n]*(?:\\\\[^\\r\\n][^{q}\\\\\\r\\n]*)*(?:{q}|\\\\)?" for q in ('"', "''", "`"))
_STRING_RE = _STRING.replace("''", "\x00").replace("\x00", "''")
_TOKENS = f"""pieces AS (SELECT path, line, text, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT *, regexp_extract_all(text, '{_STRING_RE}|{_WORD}|[\\s\\S]') AS ps FROM lines)),
placed AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY path, line ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM pieces),
inner_pieces AS (SELECT path, line, pos, k, p AS whole, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM (SELECT *, regexp_extract_all(p, '{_WORD}|[\\s\\S]') AS ws FROM placed)),
inner_placed AS (SELECT *, pos + coalesce(sum(length(w)) OVER (PARTITION BY path, line, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS col FROM inner_pieces),
tokens AS (SELECT path, line, col::INTEGER AS col, w AS text, CASE WHEN left(whole, 1) IN ('"', '''', '`') THEN 'string' ELSE 'identifier' END AS context FROM inner_placed WHERE regexp_full_match(w, '{_WORD}'))"""
_WITH_TOKENS = f"WITH {fx.files_sql(True)}, {_LINES}, {_TOKENS}"
_TOKEN_CHARS = "letters AS (SELECT path, line, col, text, context, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM tokens WHERE regexp_matches(text, '[^\\x00-\\x7F]'))"
_SCRIPT = f"CASE WHEN regexp_matches(ch, '^[\\p{{N}}\\p{{P}}\\p{{S}}\\p{{Z}}]$') THEN 'Common' WHEN regexp_matches(ch, '^\\p{{M}}$') THEN 'Inherited' ELSE coalesce({_between('unicode(ch)', t.SCRIPT_RANGES)}, 'Unknown') END"

_FINDING = ("rule_id", "file", "line", "col", "char_info", "snippet")


def _lines(spark: SparkSession, sf_dir: str, plain: bool = False) -> DataFrame:
    return with_changes(lexer.lexed_lines(fx.files(spark, sf_dir, plain)), None)


def _tokens_of(spark: SparkSession, sf_dir: str, policy: Policy) -> DataFrame:
    lines = _lines(spark, sf_dir, True)
    return rules.exploded(lines, rules.token_findings(policy), policy)


# --- lines, languages, paths ---------------------------------------------------------------------------------------


@query(f"WITH {fx.files_sql()}, {_LINES} SELECT path, line, length(text)::INTEGER AS n_chars, ends_with(text, chr(10)) AS ended FROM lines")
def q_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every file."""
    return src.file_lines(fx.files(spark, sf_dir)).select("path", "line", F.length("text").alias("n_chars"), F.endswith("text", F.lit("\n")).alias("ended"))


_EXT = "regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1)"


@query(f"WITH {fx.files_sql()} SELECT path, {_EXT} AS extension, coalesce({_map(f'lower({_EXT})', t.LANGUAGE_BY_EXTENSION)}, 'unknown') AS language FROM files")
def q_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every file."""
    return fx.files(spark, sf_dir).select("path", c.extension(F.col("path")).alias("extension"), c.language(F.col("path")).alias("language"))


_HIGH = ", ".join(f"'{x}'" for x in t.HIGH_EXTENSIONS)
_MEDIUM = ", ".join(f"'{x}'" for x in t.MEDIUM_EXTENSIONS)
_RISK_POLICY = Policy(file_policies={"high": ["*_7?.md"], "medium": ["src/*.[gj]*"], "low": ["*.po"]})
_RISK = f"CASE WHEN regexp_full_match(path, '.*_7.\\.md') THEN 'high' WHEN regexp_full_match(path, 'src/.*\\.[gj].*') THEN 'medium' WHEN path LIKE '%.po' THEN 'low' WHEN {_EXT} IN ({_HIGH}) THEN 'high' WHEN lower({_EXT}) IN ({_HIGH}) THEN 'high' WHEN lower({_EXT}) IN ({_MEDIUM}) THEN 'medium' ELSE 'high' END"


@query(f"WITH {fx.files_sql()} SELECT path, {_RISK} AS risk FROM files")
def q_file_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of every file, by globs, then by extension."""
    return fx.files(spark, sf_dir).select("path", file_risk(F.col("path"), _RISK_POLICY).alias("risk"))


_DIRS = "|".join(x.replace(".", "\\.") for x in t.EXCLUDED_DIRECTORIES)
_SUFFIXES = "|".join(x.replace(".", "\\.") for x in t.EXCLUDED_SUFFIXES)
_SOME_PATHS = "[url || '/logo.PNG', 'mydist/' || url, url || '/a.min.js', 'x/' || page_id || '.py', 'gen/' || page_id || '.py', 'a\\vendor\\' || page_id || '.c']"


@query(f"WITH paths AS (SELECT page_id, unnest({_SOME_PATHS}) AS path FROM pages) SELECT path, regexp_matches(replace(path, chr(92), '/'), '({_DIRS})/') OR regexp_matches(lower(regexp_extract(replace(path, chr(92), '/'), '[^/]*$')), '({_SUFFIXES})$') OR regexp_full_match(path, 'gen/.*[0-4]\\.py') AS excluded FROM paths")
def q_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that a scan leaves out."""
    page = F.col("page_id").cast("string")
    made = [F.concat("url", F.lit("/logo.PNG")), F.concat(F.lit("mydist/"), "url"), F.concat("url", F.lit("/a.min.js")), F.concat(F.lit("x/"), page, F.lit(".py")), F.concat(F.lit("gen/"), page, F.lit(".py")), F.concat(F.lit("a\\vendor\\"), page, F.lit(".c"))]
    paths = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.explode(F.array(*made)).alias("path"))
    return paths.select("path", src.excluded(F.col("path"), ["gen/*[0-4].py"]).alias("excluded"))


# --- rules on characters and lines ---------------------------------------------------------------------------------


@query(f"{_WITH_CHARS} SELECT * FROM found")
def q_char_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on characters."""
    lines = _lines(spark, sf_dir)
    found = rules.exploded(lines, rules.char_findings(Policy()), Policy())
    return found.select(*_FINDING)


def _char_rule(rule_id: str) -> None:
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        return q_char_rules(spark, sf_dir).where(F.col("rule_id") == rule_id)

    one.__name__ = f"r{rule_id[-2:]}_{t.RULES[rule_id].name.replace('-', '_')}"
    query(f"{_WITH_CHARS} SELECT * FROM found WHERE rule_id = '{rule_id}'")(one)


for _id in ("USC001", "USC002", "USC005", "USC007", "USC009", "USC011", "USC012", "USC013", "USC014", "USC016"):
    _char_rule(_id)


@query(f"{_WITH_CHARS} SELECT rule_id, count(*)::BIGINT AS n, sum(line)::BIGINT AS sum_line, sum(col)::BIGINT AS sum_col FROM found GROUP BY rule_id")
def q_char_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on characters by rule."""
    return q_char_rules(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("sum_line"), F.sum("col").alias("sum_col"))


@query(f"WITH {fx.files_sql()}, {_LINES} SELECT path, line, len(regexp_extract_all(text, '[\\x{{FE00}}-\\x{{FE0F}}\\x{{E0100}}-\\x{{E01EF}}]'))::INTEGER AS n FROM lines WHERE len(regexp_extract_all(text, '[\\x{{FE00}}-\\x{{FE0F}}\\x{{E0100}}-\\x{{E01EF}}]')) >= 3")
def q_vs_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with three variation selectors or more."""
    lines = src.file_lines(fx.files(spark, sf_dir))
    return lines.select("path", "line", F.regexp_count("text", F.lit(c.VARIATION)).alias("n")).where("n >= 3")


def _depths_sql(openers: tuple[int, ...], closer: int) -> str:
    cps = ", ".join(map(str, openers))
    return f"""(SELECT path, line, -least(min(run), 0) AS orphans, sum(step) - least(min(run), 0) AS unclosed FROM (
      SELECT path, line, step, sum(step) OVER (PARTITION BY path, line ORDER BY col ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT path, line, col, CASE WHEN unicode(ch) IN ({cps}) THEN 1 ELSE -1 END AS step FROM chars WHERE unicode(ch) IN ({cps}, {closer})))
      GROUP BY path, line)"""


@query(f"WITH {fx.files_sql()}, {_LINES}, {_CHARS} SELECT 'embedding' AS kind, path, line, unclosed::INTEGER AS unclosed, orphans::INTEGER AS orphans FROM {_depths_sql(t.EMBED_OPEN, t.EMBED_CLOSE)} UNION ALL SELECT 'isolate', path, line, unclosed::INTEGER, orphans::INTEGER FROM {_depths_sql(t.ISOLATE_OPEN, t.ISOLATE_CLOSE)}")
def q_bidi_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpaired bidirectional controls of every line that has such controls."""
    lines = src.file_lines(fx.files(spark, sf_dir))
    out = []
    for kind, openers, closer in (("embedding", t.EMBED_OPEN, t.EMBED_CLOSE), ("isolate", t.ISOLATE_OPEN, t.ISOLATE_CLOSE)):
        opened, orphans = c.bidi_depths(F.col("text"), openers, closer)
        own = lines.where(F.col("text").rlike("[" + "".join(map(chr, (*openers, closer))) + "]"))
        out.append(own.select(F.lit(kind).alias("kind"), "path", "line", opened.alias("unclosed"), orphans.alias("orphans")))
    return out[0].unionByName(out[1])


def _line_rule(rule_id: str) -> Callable[[SparkSession, str], DataFrame]:
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rules.exploded(_lines(spark, sf_dir), rules.line_findings(), Policy())
        return found.where(F.col("rule_id") == rule_id).select("file", "line", "col", "severity", "message", "char_info", "snippet")

    one.__name__ = f"r{rule_id[-2:]}_{t.RULES[rule_id].name.replace('-', '_')}"
    return one


_VS = "len(regexp_extract_all(text, '[\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]'))"
query(
    f"""WITH {fx.files_sql()}, {_LINES} SELECT path AS file, line, 0 AS col, 'critical' AS severity, {_VS} || ' variation selectors on one line' AS message, {_VS} || ' variation selectors' AS char_info, substr(text, 1, 80) AS snippet
    FROM lines WHERE {_VS} >= 3"""
)(_line_rule("USC010"))
query(
    f"""WITH {fx.files_sql()}, {_LINES}, {_CHARS}, unpaired AS (SELECT 'embedding/override' AS kind, 'embed' AS word, path, line, unclosed, orphans FROM {_depths_sql(t.EMBED_OPEN, t.EMBED_CLOSE)} UNION ALL SELECT 'isolate', 'isolate', path, line, unclosed, orphans FROM {_depths_sql(t.ISOLATE_OPEN, t.ISOLATE_CLOSE)})
    SELECT path AS file, line, 0 AS col, 'critical' AS severity, 'Unbalanced bidi ' || kind || ' controls (unclosed: ' || unclosed::INTEGER || ', orphan closers: ' || orphans::INTEGER || ')' AS message, word || ' imbalance: ' || (unclosed + orphans)::INTEGER AS char_info, substr(text, 1, 80) AS snippet
    FROM unpaired JOIN lines USING (path, line) WHERE unclosed + orphans > 0"""
)(_line_rule("USC015"))


_ENDS = "len(regexp_extract_all(text, '\\r\\n'))"
_LF, _CR = f"length(text) - length(replace(text, chr(10), '')) > {_ENDS}", f"length(text) - length(replace(text, chr(13), '')) > {_ENDS}"
_KINDS = f"concat_ws(', ', CASE WHEN {_ENDS} > 0 THEN 'CRLF' END, CASE WHEN {_LF} THEN 'LF' END, CASE WHEN {_CR} THEN 'CR' END)"


@query(f"WITH {fx.files_sql()} SELECT path AS file, 'Mixed line endings: ' || kinds AS message, 'mixed: ' || kinds AS char_info FROM (SELECT path, {_KINDS} AS kinds FROM files) WHERE kinds LIKE '%,%'")
def q_line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with more than one kind of line end."""
    return rules.line_endings(fx.files(spark, sf_dir), Policy()).select("file", "message", "char_info")


# --- tokens --------------------------------------------------------------------------------------------------------


@query(f"{_WITH_TOKENS} SELECT * FROM tokens")
def q_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents as plain text files."""
    return lexer.tokens(fx.files(spark, sf_dir, True))


@query(f"{_WITH_TOKENS} SELECT path, line, CASE WHEN bool_or(context = 'identifier') THEN 'identifier' ELSE 'string' END AS context, count(*)::BIGINT AS n FROM tokens GROUP BY path, line")
def q_line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of every line with tokens."""
    lines = lexer.lexed_lines(fx.files(spark, sf_dir, True), suspicious=False)
    return lines.where(F.size("tokens") > 0).select("path", "line", "context", F.size("tokens").cast("long").alias("n"))


@query()
def q_tokens_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in every language's own lexical form, by context; nested comments need more than SQL."""
    files = fx.files(spark, sf_dir)
    return lexer.tokens(files).groupBy(c.language(F.col("path")).alias("language"), "context").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_WITH_TOKENS}, {_TOKEN_CHARS}, scripted AS (SELECT path, line, col, text, list_sort(list_distinct(list({_SCRIPT}))) AS all_scripts FROM letters WHERE context = 'identifier' GROUP BY ALL), own AS (SELECT *, list_filter(all_scripts, lambda s: s NOT IN ('Common', 'Inherited', 'Unknown')) AS scripts FROM scripted) SELECT path AS file, line, col, 'Mixed-script identifier ''' || text || ''' (' || array_to_string(scripts, ', ') || ')' AS message, 'scripts: ' || array_to_string(scripts, ', ') AS char_info, text AS snippet FROM own WHERE len(scripts) > 1")
def q_mixed_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R03, F1, G5, O4."""
    return _tokens_of(spark, sf_dir, Policy()).where("rule_id = 'USC003'").select("file", "line", "col", "message", "char_info", "snippet")


@query(f"{_WITH_TOKENS}, {_TOKEN_CHARS}, firsts AS (SELECT path, line, col, text, min_by(ch, i) AS ch, min(i) AS i FROM letters WHERE context = 'identifier' AND unicode(ch) > 127 GROUP BY ALL) SELECT path AS file, line, (col + i)::INTEGER AS col, 'Non-ASCII ' || {_INFO} || ' in identifier ''' || text || ''' (policy: ascii-only)' AS message, {_INFO} AS char_info, text AS snippet FROM firsts")
def q_non_ascii_ident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R19a, O5."""
    return _tokens_of(spark, sf_dir, Policy()).where("rule_id = 'USC019'").select("file", "line", "col", "message", "char_info", "snippet")


_PERMITTED = Policy(identifier_policy="permitted-scripts", permitted_scripts={"Latin", "Cyrillic"})


@query(f"{_WITH_TOKENS}, {_TOKEN_CHARS}, bad AS (SELECT *, {_SCRIPT} AS script FROM letters WHERE context = 'identifier'), firsts AS (SELECT path, line, col, text, min_by(script, i) AS script FROM bad WHERE script NOT IN ('Common', 'Inherited', 'Latin', 'Cyrillic') GROUP BY ALL) SELECT path AS file, line, col, 'Identifier ''' || text || ''' uses script ''' || script || ''' not in permitted set' AS message, 'script ' || script AS char_info, text AS snippet FROM firsts")
def q_permitted_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R19b."""
    return _tokens_of(spark, sf_dir, _PERMITTED).where("rule_id = 'USC019'").select("file", "line", "col", "message", "char_info", "snippet")


_TARGET = _map("unicode(ch)", t.CONFUSABLES)


@query(f"{_WITH_TOKENS}, {_TOKEN_CHARS} SELECT path AS file, line, (col + i)::INTEGER AS col, 'Homoglyph ' || {_INFO} || ' looks like ''' || {_TARGET} || ''' in ' || context AS message, {_INFO} AS char_info, text AS snippet FROM letters WHERE context <> 'string' AND unicode(ch) > 127 AND {_TARGET} IS NOT NULL")
def q_homoglyph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R17, F2, J4."""
    return _tokens_of(spark, sf_dir, Policy()).where("rule_id = 'USC017'").select("file", "line", "col", "message", "char_info", "snippet")


@query(f"{_WITH_TOKENS} SELECT path AS file, line, col, text AS snippet, 'NFC: ''' || nfc_normalize(text) || '''' AS char_info FROM tokens WHERE regexp_matches(text, '[^\\x00-\\x7F]') AND nfc_normalize(text) <> text")
def q_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R06, F4."""
    return _tokens_of(spark, sf_dir, Policy()).where("rule_id = 'USC006'").select("file", "line", "col", "snippet", "char_info")


_LOOKS = "translate(text, " + " || ".join(f"chr({k})" for k in t.CONFUSABLES) + ", '" + "".join(t.CONFUSABLES.values()) + "')"


@query(f"{_WITH_TOKENS}, named AS (SELECT *, nfc_normalize({_LOOKS}) AS skeleton FROM tokens WHERE context = 'identifier'), seen AS (SELECT *, first_value(text) OVER w AS first_text, first_value(line) OVER w AS first_line, first_value(col) OVER w AS first_col FROM named WINDOW w AS (PARTITION BY path, skeleton ORDER BY line, col)) SELECT path AS file, line, col, '''' || text || ''' has same skeleton as ''' || first_text || ''' (line ' || first_line || ':' || first_col || ')' AS message, 'confusable with ''' || first_text || '''' AS char_info, text AS snippet FROM seen WHERE text <> first_text")
def q_confusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R04, F3, J8, W1."""
    return rules.collisions(_lines(spark, sf_dir, True), Policy()).select("file", "line", "col", "message", "char_info", "snippet")


# --- policy, diffs -------------------------------------------------------------------------------------------------

_ALLOW = Policy(allow=[(["src/*1?.*"], {0x202E, 0x0430, 0x200B}), (["doc_*.go", "*.rs"], {0xE000})])


@query(f"{_WITH_CHARS} SELECT * FROM found WHERE NOT (rule_id <> 'USC009' AND (left(char_info, 6) IN ('U+202E', 'U+200B') AND regexp_full_match(file, 'src/.*1.\\..*') OR left(char_info, 6) = 'U+E000' AND regexp_full_match(file, '.*/doc_[^/]*\\.go|.*\\.rs')))")
def q_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12, J2."""
    lines = _lines(spark, sf_dir)
    return rules.exploded(lines, rules.char_findings(_ALLOW), _ALLOW).select(*_FINDING)


_IGNORE = Policy(contexts={"identifier": {"bidi-control": "ignore", "mixed-script": "ignore"}, "other": {"control-character": "ignore"}})


@query(f"{_WITH_TOKENS}, {_CHARS}, {_CLASSED}, contexts AS (SELECT path, line, CASE WHEN bool_or(context = 'identifier') THEN 'identifier' ELSE 'string' END AS context FROM tokens GROUP BY 1, 2) SELECT rule_id, c.path AS file, c.line, col, coalesce(context, 'other') AS context FROM classed c LEFT JOIN contexts x ON c.path = x.path AND c.line = x.line WHERE rule_id <> 'VS' AND NOT (rule_id = 'USC009' AND c.line = 1 AND col = 0) AND rule_id <> 'USC009' AND NOT (rule_id = 'USC001' AND coalesce(context, 'other') = 'identifier') AND NOT (rule_id = 'USC007' AND coalesce(context, 'other') = 'other')")
def q_context_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13, G4."""
    lines = _lines(spark, sf_dir, True)
    found = rules.exploded(lines, rules.char_findings(_IGNORE), _IGNORE)
    return found.where("rule_id != 'USC009'").select("rule_id", "file", "line", "col", "context")


_SEVERE = Policy(severity={"bidi-control": "low", "suspicious-spacing": "critical"})


def _severity_sql(policy: Policy) -> str:
    return _map("rule_id", {k: policy.severity_of(k) for k in t.RULES})


@query(f"{_WITH_CHARS} SELECT rule_id, {_map('rule_id', {k: r.name for k, r in t.RULES.items()})} AS rule_name, {_severity_sql(_SEVERE)} AS severity, count(*)::BIGINT AS n FROM found GROUP BY 1")
def q_severity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16, J3."""
    lines = _lines(spark, sf_dir)
    found = rules.exploded(lines, rules.char_findings(_SEVERE), _SEVERE)
    return found.groupBy("rule_id", "rule_name", "severity").agg(F.count(F.lit(1)).alias("n"))


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for every second document: some hunks, one of deletions only, or no hunk."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 2 = 0").select("doc_id")
    ext = F.get(F.array(*map(F.lit, fx.EXTENSIONS)), (F.col("doc_id") % 24).cast("int"))
    name = F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    n = F.col("doc_id").cast("string")
    hunks = F.array(F.concat(F.lit("--- a/"), name), F.concat(F.lit("+++ b/"), name), F.when(F.col("doc_id") % 6 == 0, F.lit("nothing")).otherwise(F.lit("@@ -1,2 +1,2 @@ x")), F.concat(F.lit("@@ -9 +"), (F.col("doc_id") % 9 + 3).cast("string"), F.lit(" @@")), F.concat(F.lit("@@ -3,"), n, F.lit(" +4,0 @@")))
    return docs.select(F.col("doc_id").alias("diff_id"), F.posexplode(hunks).alias("line_no", "text"))


_CHANGED = "SELECT path, unnest([NULL, CASE WHEN doc_id % 6 <> 0 THEN 1 END, CASE WHEN doc_id % 6 <> 0 THEN 2 END, (doc_id % 9 + 3)::INTEGER]) AS line FROM files WHERE doc_id % 2 = 0"


@query(f"WITH {fx.files_sql()} SELECT DISTINCT path, coalesce(line, 0)::INTEGER AS line FROM ({_CHANGED})")
def q_diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, F14, W3."""
    return src.changed_from_diff(_diff(spark, sf_dir)).fillna(0, ["line"])


@query(f"{_WITH_CHARS}, changed AS ({_CHANGED}) SELECT * FROM found WHERE rule_id IN ('USC001', 'USC009', 'USC011', 'USC012') OR file NOT IN (SELECT path FROM changed) OR (file, line) IN (SELECT (path, line) FROM changed WHERE line IS NOT NULL)")
def q_changed_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10, C11, J1."""
    lines = with_changes(lexer.lexed_lines(fx.files(spark, sf_dir)), src.changed_from_diff(_diff(spark, sf_dir)))
    return rules.exploded(lines, rules.char_findings(Policy()), Policy()).select(*_FINDING)


# --- reports, over the findings on characters ----------------------------------------------------------------------

_REPORTED = f"{_WITH_CHARS}, reported AS (SELECT *, {_severity_sql(Policy())} AS severity, {_map('rule_id', {k: r.name for k, r in t.RULES.items()})} AS rule_name FROM found)"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return rules.exploded(lines, rules.char_findings(Policy()), Policy())


@query(f"{_REPORTED} SELECT severity, count(*)::BIGINT AS n FROM reported GROUP BY severity")
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G2, O1, B2, B6."""
    return report.by_severity(_findings(spark, sf_dir))


@query(f"{_REPORTED} SELECT severity, rn::INTEGER AS rn, rule_id, file, line, col FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY file, line, col) AS rn FROM reported) WHERE rn <= 10")
def q_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2, B2: the first ten findings of each severity."""
    return report.top_by_severity(_findings(spark, sf_dir), 10).select("severity", "rn", "rule_id", "file", "line", "col")


_NOUN = _map("rule_id", {k: r.noun for k, r in t.RULES.items() if r.noun})
_MESSAGE = f"CASE WHEN rule_id = 'USC009' THEN 'Misplaced byte-order mark' ELSE {_NOUN} || ' ' || char_info END"


@query(f"{_REPORTED} SELECT file, line, col, rule_id, severity FROM reported ORDER BY file, line, col LIMIT 20")
def q_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty findings."""
    return _findings(spark, sf_dir).orderBy(*report.ORDER).limit(20).select("file", "line", "col", "rule_id", "severity")


_FAILS = f"(severity = 'critical' OR severity = 'high' AND {_RISK.replace('path', 'file')} = 'high')"


@query(f"{_REPORTED} SELECT coalesce(bool_or({_FAILS}), false) AS has_fail, coalesce(bool_or(NOT {_FAILS} AND severity IN ('medium', 'low')), false) AS has_warn, CASE WHEN coalesce(bool_or({_FAILS}), false) THEN 1 ELSE 0 END::INTEGER AS exit_code FROM reported")
def q_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C15, G7, B7."""
    return report.verdict(_findings(spark, sf_dir), _RISK_POLICY)


@query(f"{_REPORTED} SELECT file, count(*)::BIGINT AS n, count_if({_FAILS})::BIGINT AS n_fail FROM reported GROUP BY file")
def q_file_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and failing findings of each file."""
    found = _findings(spark, sf_dir)
    fails = should_fail(F.col("severity"), file_risk(F.col("file"), _RISK_POLICY))
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(fails).alias("n_fail"))


_SHOWN = "array_to_string(list_transform(list_filter(string_split(snippet, ''), lambda x: x <> ''), lambda x: CASE WHEN (unicode(x) < 32 AND unicode(x) NOT IN (9, 10, 13)) OR unicode(x) = 127 OR (unicode(x) > 127 AND " + _between("unicode(x)", t.CLASS_RANGES) + " IS NOT NULL) THEN '\\u{' || upper(lpad(to_hex(unicode(x)), greatest(4, length(to_hex(unicode(x))))::INTEGER, '0')) || '}' ELSE x END), '')"


@query(f"{_REPORTED} SELECT file, line, col, {_SHOWN} AS shown, '::' || CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END || ' file=' || file || ',line=' || line || ',col=' || (col + 1) || ',title=Unicode Safety [' || rule_name || ']::' || char_info AS head FROM reported")
def q_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, B3, B8, F10, F17, F18."""
    head = F.substring_index(report.annotation(), " -- ", 1)
    return _findings(spark, sf_dir).select("file", "line", "col", c.escape_invisible(F.col("snippet")).alias("shown"), head.alias("head"))


@query(f"{_REPORTED} SELECT rule_id AS \"ruleId\", CASE severity WHEN 'low' THEN 'note' WHEN 'medium' THEN 'warning' ELSE 'error' END AS level, file AS uri, line AS start_line, (col + 1)::INTEGER AS start_column FROM reported")
def q_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every SARIF result, read back from its JSON."""
    found = _findings(spark, sf_dir).select(report.sarif_result().alias("j"))
    region = "$.locations[0].physicalLocation.region"
    field = lambda path: F.get_json_object("j", path)
    return found.select(field("$.ruleId").alias("ruleId"), field("$.level").alias("level"), field("$.locations[0].physicalLocation.artifactLocation.uri").alias("uri"), field(f"{region}.startLine").cast("int").alias("start_line"), field(f"{region}.startColumn").cast("int").alias("start_column"))


@query(
    f"""WITH {fx.files_sql()}, cuts AS (SELECT path, left(text, (doc_id % 50)::INTEGER) AS p FROM files)
    SELECT 'USC008' AS rule_id, path AS file, (length(p) - length(replace(p, chr(10), '')) + 1)::INTEGER AS line, length(regexp_extract(p, '[^\\n]*$'))::INTEGER AS col,
           'Not valid UTF-8: byte ' || strlen(p) || ': invalid utf-8 sequence of 1 bytes from index ' || strlen(p) AS message FROM cuts"""
)
def q_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as bytes, with a byte that isn't UTF-8 put in at a place of its own."""
    docs = fx.files(spark, sf_dir)
    cut = (F.col("doc_id") % 50).cast("int")
    content = F.concat(F.encode(F.substring(F.col("text"), F.lit(1), cut), "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.substring(F.col("text"), cut + 1, F.length("text")), "UTF-8"))
    return rules.invalid_encoding(docs.select("path", content.alias("content")), Policy()).select("rule_id", "file", "line", "col", "message")


@query()
def q_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan of all documents with every rule."""
    return scan(fx.files(spark, sf_dir)).drop("seq")


@query()
def q_scan_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan of pages and conversations as files."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat_ws("/", F.lit("chat"), F.col("conv_id").cast("string"), F.concat(F.col("turn").cast("string"), F.lit(".md"))).alias("path"), "text")
    return scan(pages.unionByName(turns)).drop("seq")


# --- whole findings of plain text files, where SQL knows every token's context ---------------------------------------------

_NOUNS = {k: r.noun for k, r in t.RULES.items() if r.noun}
_TOLD = f"""contexts AS (SELECT path, line, CASE WHEN bool_or(context = 'identifier') THEN 'identifier' ELSE 'string' END AS context FROM tokens GROUP BY path, line),
told AS (SELECT rule_id, file, found.line AS line, col, char_info, snippet, CASE rule_id WHEN 'USC009' THEN 'other' ELSE coalesce(context, 'other') END AS context,
         CASE rule_id WHEN 'USC009' THEN 'Misplaced byte-order mark' ELSE {_map('rule_id', _NOUNS)} || ' ' || char_info || ' in ' || coalesce(context, 'other') END AS message FROM found LEFT JOIN contexts ON file = contexts.path AND found.line = contexts.line)"""
_WITH_TOLD = f"{_WITH_TOKENS}, {_CHARS}, {_CLASSED}, {_CHAR_FINDINGS}, {_TOLD}"
_TOLD_REPORTED = f"{_WITH_TOLD}, reported AS (SELECT *, {_severity_sql(Policy())} AS severity, {_map('rule_id', {k: r.name for k, r in t.RULES.items()})} AS rule_name FROM told)"


def _plain_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.exploded(_lines(spark, sf_dir, True), rules.char_findings(Policy()), Policy())


@query(f"{_WITH_TOLD} SELECT rule_id, file, line, col, context, message, char_info, snippet FROM told")
def q_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole findings on characters with message and context."""
    return _plain_findings(spark, sf_dir).select("rule_id", "file", "line", "col", "context", "message", "char_info", "snippet")


@query(
    f"""{_TOLD_REPORTED} SELECT '  ' || upper(severity) || ' [' || rule_id || ' ' || rule_name || '] ' || file || ':' || line || ':' || col || chr(10) || '    ' || char_info || chr(10) || '    ' || message
    || CASE WHEN snippet <> '' THEN chr(10) || '    near: "' || {_SHOWN} || '"' ELSE '' END AS rendered,
    '::' || CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END || ' file=' || file || ',line=' || line || ',col=' || (col + 1) || ',title=Unicode Safety [' || rule_name || ']::' || char_info || ' -- ' || message AS annotation FROM reported"""
)
def q_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as the terminal and the annotations show them."""
    return _plain_findings(spark, sf_dir).select(report.rendered().alias("rendered"), report.annotation().alias("annotation"))


@query(
    f"""{_TOLD_REPORTED} SELECT '| ' || severity || ' | ' || rule_id || ' ' || rule_name || ' | `' || file || '` | ' || line || ' | ' || replace(left(message, 80), '|', '\\|') || ' |' AS row,
    '{{"ruleId":"' || rule_id || '","level":"' || CASE severity WHEN 'low' THEN 'note' WHEN 'medium' THEN 'warning' ELSE 'error' END || '","message":{{"text":"' || char_info || ' -- ' || message || '"}},"locations":[{{"physicalLocation":'
    || '{{"artifactLocation":{{"uri":"' || file || '","uriBaseId":"%SRCROOT%"}},"region":{{"startLine":' || line || ',"startColumn":' || (col + 1) || '}}}}}}]}}' AS sarif FROM reported"""
)
def q_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as rows of the Markdown table and as SARIF results."""
    return _plain_findings(spark, sf_dir).select(report.table_row().alias("row"), report.sarif_result().alias("sarif"))


_PLAIN_RULES = {"USC003": "q_mixed_script", "USC019": "q_non_ascii_ident", "USC017": "q_homoglyph", "USC006": "q_normalization", "USC004": "q_confusable", "USC010": "r10_variation_selector", "USC015": "r15_bidi_pairing"}
_PLAIN_SCAN = " UNION ALL ".join(
    [
        f"SELECT rule_id, file, line, col, char_info, snippet FROM ({_WITH_TOLD} SELECT * FROM told)",
        *(f"SELECT '{rule}', file, line, col, char_info, snippet FROM ({ORACLE[name].replace(fx.files_sql(), fx.files_sql(True))})" for rule, name in _PLAIN_RULES.items()),
        f"SELECT 'USC018', file, 1, 0, char_info, '' FROM ({ORACLE['q_line_endings'].replace(fx.files_sql(), fx.files_sql(True))})",
    ]
)


@query(_PLAIN_SCAN)
def q_scan_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan of all documents as plain text files, with every rule of the default policy."""
    return scan(fx.files(spark, sf_dir, True)).select("rule_id", "file", "line", "col", "char_info", "snippet")
