"""Column expressions on characters, texts and paths: all JVM-side, none needs Python workers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as t

#: Anything that isn't tab, line end or printable ASCII: only lines with such a character can have a character finding.
SUSPICIOUS = r"[^\x09\x0A\x0D\x20-\x7E]"
NON_ASCII = r"[^\x00-\x7F]"
#: A line with its end: \r\n, \n or a lone \r.
LINE = r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$"
VARIATION = r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"


def _class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges) + "]"


#: Characters of any class; letters of other scripts than Latin; characters that look like an ASCII letter.
CLASSIFIED = _class([(lo, hi) for lo, hi, _ in t.CLASS_RANGES])
FOREIGN = _class([(lo, hi) for lo, hi, label in t.SCRIPT_RANGES if label != "Latin"])
ALIKE = _class([(cp, cp) for cp in sorted(t.CONFUSABLES) if cp > 0x7F])
#: Lines with more hits are taken character by character.
_FEW = 64


def _ranges(cp: Column, ranges: list[tuple[int, int, str]], default: Column) -> Column:
    """CASE over labelled ranges; ranges of one label are one branch."""
    labels: dict[str, list[tuple[int, int]]] = {}
    for lo, hi, label in ranges:
        labels.setdefault(label, []).append((lo, hi))
    case = None
    for label, own in labels.items():
        test = reduce(lambda a, b: a | b, (cp == lo if lo == hi else cp.between(lo, hi) for lo, hi in own))
        case = F.when(test, label) if case is None else case.when(test, label)
    return case.otherwise(default)


def classify(cp: Column) -> Column:
    """Rule of a code point, "VS" for variation selectors, or null."""
    return _ranges(cp, t.CLASS_RANGES, F.lit(None).cast("string"))


def script(ch: Column) -> Column:
    """Script of a character: Common, Inherited, a block's script, or Unknown."""
    kind = F.when(ch.rlike(r"^[\p{N}\p{P}\p{S}\p{Z}]$"), "Common").when(ch.rlike(r"^\p{M}$"), "Inherited")
    return kind.otherwise(_ranges(F.ascii(ch), t.SCRIPT_RANGES, F.lit("Unknown")))


def hex4(cp: Column) -> Column:
    """At least four hexadecimal digits."""
    digits = F.hex(cp)
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), "0")


def char_info(cp: Column) -> Column:
    """`U+XXXX NAME`."""
    names = F.create_map(*(F.lit(x) for kv in t.CHAR_NAMES.items() for x in kv))
    code = F.concat(F.lit("U+"), hex4(cp))
    return F.concat(code, F.lit(" "), F.coalesce(F.try_element_at(names, cp), F.concat(F.lit("<unnamed "), code, F.lit(">"))))


def confusable(cp: Column) -> Column:
    """The ASCII letter that a code point looks like, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in t.CONFUSABLES.items() for x in kv)), cp)


def characters(text: Column) -> Column:
    """array<struct<i, ch, cp>> of a text's code points."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.struct(i.alias("i"), c.alias("ch"), F.ascii(c).alias("cp")))


def hits(text: Column, kind: str) -> Column:
    """`characters` of one regular expression's class only. A text is cut before each of them, and places are summed over pieces."""
    pieces = F.split(text, f"(?={kind})")
    none = F.array().cast("array<struct<i: int, ch: string, cp: int>>")

    def step(acc: Column, piece: Column) -> Column:
        ch = F.substring(piece, 1, 1)
        hit = F.struct(acc["at"].alias("i"), ch.alias("ch"), F.ascii(ch).alias("cp"))
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.concat(acc["found"], F.array(hit)).alias("found"))

    begun = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"]
    few = F.size(pieces) <= _FEW
    return F.when(text.rlike(kind), F.filter(F.when(few, begun).otherwise(characters(text)), lambda x: x["ch"].rlike(kind))).otherwise(none)


def snippet(text: Column, col: Column, width: int = 40) -> Column:
    """What stands around a column, with dots where it's cut."""
    half = width // 2
    n = F.length(text)
    center = F.least(col, n - 1)
    begin, end = F.greatest(center - half, F.lit(0)), F.least(center + half, n)
    body = F.regexp_replace(F.substring(text, begin + 1, end - begin), r"[\r\n]+$", "")
    return F.when(n == 0, "").otherwise(F.concat(F.when(begin > 0, "...").otherwise(""), body, F.when(end < n, "...").otherwise("")))


def escape_invisible(text: Column) -> Column:
    """`\\u{XXXX}` for control characters other than tab and line ends, and for all classified ones beyond ASCII."""
    def shown(c: Column) -> Column:
        cp = F.ascii(c)
        hidden = ((cp < 0x20) & ~cp.isin(9, 10, 13)) | (cp == 0x7F) | ((cp > 0x7F) & classify(cp).isNotNull())
        return F.when(hidden, F.concat(F.lit("\\u{"), hex4(cp), F.lit("}"))).otherwise(c)

    return F.when(text.rlike(SUSPICIOUS), F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), shown), "")).otherwise(text)


def lines(text: Column) -> Column:
    """A text's lines with their ends; no line for an empty text."""
    return F.regexp_extract_all(text, F.lit(LINE), 0)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; none for names like `.env`."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)


def language(path: Column) -> Column:
    name = F.create_map(*(F.lit(x) for kv in t.LANGUAGE_BY_NAME.items() for x in kv))
    ext = F.create_map(*(F.lit(x) for kv in (t.LANGUAGE_BY_EXTENSION | {"dockerfile": "dockerfile", "makefile": "makefile"}).items() for x in kv))
    return F.coalesce(F.try_element_at(name, basename(path)), F.try_element_at(ext, F.lower(extension(path))), F.lit("unknown"))


def severity_rank(severity: Column) -> Column:
    """0 (low) to 3 (critical)."""
    return F.array_position(F.array(*map(F.lit, t.SEVERITIES)), severity).cast("int") - 1


def bidi_depths(text: Column, openers: tuple[int, ...], closer: int) -> tuple[Column, Column]:
    """Unclosed openers and closers without opener, in order of the text: a fold over its controls only."""
    keep = "".join(map(chr, (*openers, closer)))
    controls = F.split(F.regexp_replace(text, f"[^{keep}]", ""), "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("orphan"))

    def step(acc: Column, c: Column) -> Column:
        closes = c == chr(closer)
        return F.struct(
            F.when(c == "", acc["open"]).when(~closes, acc["open"] + 1).otherwise(F.greatest(acc["open"] - 1, F.lit(0))).alias("open"),
            (acc["orphan"] + F.when(closes & (acc["open"] == 0), 1).otherwise(0)).alias("orphan"),
        )

    folded = F.aggregate(controls, start, step)
    return folded["open"], folded["orphan"]
