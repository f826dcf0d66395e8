"""Language-aware tokens of whole files.

A file is lexed at once by one alternation of its language family, in which every piece that can span lines (block
comments, triple quotes, templates) is a single match; so no state is carried from line to line. Comments that nest
aren't regular: their end is found by counting. The files are rows, one task reads whole files, nothing is shuffled.

Forms that the patterns keep: quotes open strings in every language; an unterminated string ends with its line, but for
triple quotes and templates; on a template's later lines the first character can't close it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chars
from ..functions import tables as t
from ..functions.unicode import forms

WORD = "[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*+"
_WORD = re.compile(WORD)
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")
_NEST = re.compile(r"/\*|\*/")
_SUSPICIOUS = re.compile(r"[^\x09\x0A\x0D\x20-\x7E]")


def _quoted(q: str) -> str:
    return rf"{q}[^{q}\\\r\n]*+(?:\\[^\r\n][^{q}\\\r\n]*+)*+(?:{q}|\\)?"


@functools.cache
def pattern(lang: str) -> re.Pattern:
    """The alternation of a language: named groups s (string), c (comment), n (opens a nesting comment), w (word)."""
    out = []
    if lang == "python":
        out += [rf"(?P<s0>[rR]?{q}{{3}}[\s\S]*?(?:{q}{{3}}|\Z))" for q in ('"',)]
        out += [r"(?P<s1>[rR]?'{3}[\s\S]*?(?:'{3}|\Z))"]
    if lang in t.HASH:
        out.append(r"(?P<c0>#[^\r\n]*)")
    if lang in t.SLASH:
        out.append(r"(?P<c1>//[^\r\n]*)")
    if lang in t.DASH:
        out.append(r"(?P<c2>--[^\r\n]*)")
    if lang in t.MARKUP:
        out.append(r"(?P<c3><!--(?:[^\r\n]*?-->|[^\r\n]*))")
    if lang in t.NESTED:
        out.append(r"(?P<n>/\*)")
    elif lang in t.BLOCK:
        out.append(r"(?P<c4>/\*[\s\S]*?(?:\*/|\Z))")
    if lang == "python":
        out.append(r"""(?P<s2>[rR](?:"[^"\r\n]*+"?|'[^'\r\n]*+'?))""")
    out.append(f"(?P<s3>{_quoted(chr(34))}|{_quoted(chr(39))})")
    if lang in t.TEMPLATE:
        body = r"[^`\\\r\n]*+(?:\\[^\r\n][^`\\\r\n]*+)*+"
        out.append(rf"(?P<s4>`{body}(?:\\?(?:\r\n|\r|\n)[^\r\n]?{body})*+(?:`|\\)?)")
    else:
        out.append(f"(?P<s4>{_quoted('`')})")
    out.append(f"(?P<w>{WORD})")
    return re.compile("|".join(out))


def lex(text: str, lang: str) -> Iterator[tuple[str, int, int]]:
    """context, start, end of every word, in order."""
    find, at = pattern(lang).search, 0
    while m := find(text, at):
        begin, at = m.span()
        kind = m.lastgroup[0]
        if kind == "w":
            yield "identifier", begin, at
            continue
        if kind == "n":
            depth = 1
            while depth and (x := _NEST.search(text, at)):
                depth += 1 if x[0] == "/*" else -1
                at = x.end()
            if depth:
                at = len(text)
        for w in _WORD.finditer(text, begin, at):
            yield ("string" if kind == "s" else "comment"), w.start(), w.end()


_RANK = {"identifier": 3, "comment": 2, "string": 1}
TOKEN_LINES = "path string, line int, text string, context string, tokens array<struct<i: int, text: string, context: string, col: int, nfc: string, nfkc: string, skeleton: string>>"


def lexed_lines(files: DataFrame, suspicious: bool = True) -> DataFrame:
    """files: path, text. One row per line: path, line, text, context, tokens (i, text, context, col, and nfc, nfkc, skeleton of those beyond ASCII).

    A line's context is that of its tokens with the highest rank (identifier, comment, string), or "other". With
    `suspicious`, files of printable ASCII don't reach Python at all, and only lines are returned that have another
    character, or an identifier when the file has one beyond ASCII: all other lines can't have a finding by characters
    or tokens. Files with a null text or path have no lines.

    Files are dealt by path over as many tasks as a shuffle has, since one row group, or a run of large files, would keep
    one task busy for long.
    """
    rows = files.select(F.col("path").cast("string").alias("path"), chars.language(F.col("path")).alias("lang"), "text").where("text is not null and path is not null")
    if suspicious:
        rows = rows.where(F.col("text").rlike(chars.SUSPICIOUS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Lines()
            for path, lang, text in zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "text")), strict=True):
                found = list(lex(text, lang))
                wide = suspicious and any(context == "identifier" and not text[a:b].isascii() for context, a, b in found)
                at = 0
                for number, m in enumerate(_LINE.finditer(text), 1):
                    begin, end = m.span()
                    first = at
                    while at < len(found) and found[at][1] < end:
                        at += 1
                    own = found[first:at]
                    if not suspicious or _SUSPICIOUS.search(text, begin, end) or (wide and any(w[0] == "identifier" for w in own)):
                        out.add(path, number, text, begin, end, own)
                if out.size > 1 << 20:
                    yield out.batch()
                    out = _Lines()
            if out.path:
                yield out.batch()

    deal = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(deal, "path").mapInArrow(run, TOKEN_LINES)


_TOKEN_FIELDS = [pa.field(name, kind) for name, kind in (("i", pa.int32()), ("text", pa.string()), ("context", pa.string()), ("col", pa.int32()), ("nfc", pa.string()), ("nfkc", pa.string()), ("skeleton", pa.string()))]


class _Lines:
    """Lines and their tokens, column by column."""

    def __init__(self) -> None:
        self.path, self.line, self.text, self.context, self.ends = [], [], [], [], [0]
        self.tokens: dict[str, list] = {f.name: [] for f in _TOKEN_FIELDS}
        self.size = 0

    def add(self, path: str, line: int, text: str, begin: int, end: int, own: list[tuple[str, int, int]]) -> None:
        self.path.append(path)
        self.line.append(line)
        self.text.append(text[begin:end])
        self.context.append(max((w[0] for w in own), key=_RANK.__getitem__, default="other"))
        cols = self.tokens
        for i, (context, a, b) in enumerate(own):
            word = text[a:b]
            cols["i"].append(i)
            cols["text"].append(word)
            cols["context"].append(context)
            cols["col"].append(a - begin)
            more = {} if word.isascii() else forms(word)
            for name in ("nfc", "nfkc", "skeleton"):
                cols[name].append(more.get(name))
        self.ends.append(len(cols["i"]))
        self.size += end - begin

    def batch(self) -> pa.RecordBatch:
        tokens = pa.StructArray.from_arrays([pa.array(self.tokens[f.name], f.type) for f in _TOKEN_FIELDS], fields=_TOKEN_FIELDS)
        lists = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), tokens)
        return pa.RecordBatch.from_arrays([pa.array(self.path, pa.string()), pa.array(self.line, pa.int32()), pa.array(self.text, pa.string()), pa.array(self.context, pa.string()), lists], ["path", "line", "text", "context", "tokens"])


def tokens(files: DataFrame) -> DataFrame:
    """All tokens of files: path, line, col, text, context."""
    return lexed_lines(files, suspicious=False).select("path", "line", F.explode("tokens").alias("t")).select("path", "line", "t.col", "t.text", "t.context")
