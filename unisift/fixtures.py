"""Files made of the driver's documents, with suspicious characters put in by one list that is both Columns and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of document id % 24: file extension, what is replaced, and by what. "+" appends; of line ends only the first is replaced.
POISON: dict[int, tuple[str, str, str]] = {
    0: ("py", ". ", "." + chr(0x202E) + " "),
    1: ("py", "e t", chr(0x0435) + " t"),
    2: ("js", " o", chr(0x00A0) + "o"),
    3: ("txt", "the", "th" + chr(0x200B) + "e"),
    4: ("md", "+", chr(0xFE00) + chr(0xFE01) + chr(0xFE02)),
    5: ("go", ". ", "." + chr(0xE000) + " "),
    6: ("rs", ". ", "." + chr(0xE0041) + " "),
    7: ("txt", ". ", "." + chr(0x206A) + chr(0xFFF9) + " "),
    8: ("csv", ". ", "." + chr(0x3164) + " "),
    9: ("py", chr(0xE9), "e" + chr(0x0301)),
    10: ("txt", chr(10), chr(0x000D) + chr(0x000A)),
    11: ("txt", ". ", "." + chr(0x0007) + " "),
    12: ("java", ". ", "." + chr(0xFEFF) + " "),
    13: ("js", ". ", "." + chr(0x2066) + "x" + chr(0x2069) + " "),
}
_CLEAN = ["html", "c", "yml", "sql", "rb", "lua", "kt", "toml", "po", "sh"]
EXTENSIONS = [POISON[k][0] if k in POISON else _CLEAN[k - 14] for k in range(24)]


def poisoned(text: Column, number: Column) -> Column:
    out = None
    for k, (_, old, new) in POISON.items():
        if old == "+":
            value = F.concat(text, F.lit(new))
        elif old == "\n":
            at = F.instr(text, "\n")
            value = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + 1, F.length(text)))).otherwise(text)
        else:
            value = F.replace(text, F.lit(old), F.lit(new))
        out = F.when(number % 24 == k, value) if out is None else out.when(number % 24 == k, value)
    return out.otherwise(text)


def sql_text(value: str) -> str:
    """A DuckDB expression for a text."""
    parts, plain = [], ""
    for ch in value:
        if " " <= ch <= "~" and ch != "'":
            plain += ch
            continue
        if plain:
            parts.append(f"'{plain}'")
        parts.append(f"chr({ord(ch)})")
        plain = ""
    return " || ".join([*parts, *([f"'{plain}'"] if plain else [])]) or "''"


def poisoned_sql(text: str, number: str) -> str:
    cases = []
    for k, (_, old, new) in POISON.items():
        if old == "+":
            value = f"{text} || {sql_text(new)}"
        elif old == "\n":
            value = f"CASE WHEN instr({text}, chr(10)) > 0 THEN substr({text}, 1, instr({text}, chr(10)) - 1) || {sql_text(new)} || substr({text}, instr({text}, chr(10)) + 1) ELSE {text} END"
        else:
            value = f"replace({text}, {sql_text(old)}, {sql_text(new)})"
        cases.append(f"WHEN {k} THEN {value}")
    return f"CASE {number} % 24 {' '.join(cases)} ELSE {text} END"


def files(spark: SparkSession, sf_dir: str, plain: bool = False) -> DataFrame:
    """doc_id, path, text of all documents; plain: every path ends in .txt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ext = F.lit("txt") if plain else F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 24).cast("int"))
    return docs.select("doc_id", F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), poisoned(F.col("text"), F.col("doc_id")).alias("text"))


def files_sql(plain: bool = False) -> str:
    """`files` as the WITH entry `files`."""
    ext = "'txt'" if plain else "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "][(doc_id % 24 + 1)::INTEGER]"
    return f"files AS (SELECT doc_id, 'src/doc_' || doc_id || '.' || {ext} AS path, {poisoned_sql('text', 'doc_id')} AS text FROM documents WHERE text IS NOT NULL)"
