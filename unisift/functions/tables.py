"""Fixed values of the detector: rules, character classes, scripts, confusables, names, file types. Plain data."""

from __future__ import annotations

import unicodedata
from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    severity: str
    #: What a message calls the character, for rules on single characters.
    noun: str = ""
    description: str = ""


# Rule ids, names and default severities.
RULES: dict[str, Rule] = {
    "USC001": Rule("bidi-control", "critical", "Bidirectional control character", "Bidirectional control characters can reorder displayed text"),
    "USC002": Rule("invisible-format", "critical", "Invisible formatting character", "Invisible format characters hide in text"),
    "USC003": Rule("mixed-script", "high", "", "Identifier mixes scripts"),
    "USC004": Rule("confusable-collision", "high", "", "Identifier looks like another one of the file"),
    "USC005": Rule("suspicious-spacing", "medium", "Suspicious spacing character", "Unusual space characters"),
    "USC006": Rule("normalization-drift", "medium", "", "Token changes under normalization"),
    "USC007": Rule("control-character", "critical", "Disallowed control character", "Control characters other than tab and line ends"),
    "USC008": Rule("invalid-encoding", "critical", "", "File isn't valid UTF-8"),
    "USC009": Rule("misplaced-bom", "critical", "", "Byte-order mark that isn't the file's first character"),
    "USC010": Rule("variation-selector", "critical", "", "Runs of variation selectors can carry a payload"),
    "USC011": Rule("private-use", "critical", "Private Use Area code point", "Private use code points"),
    "USC012": Rule("tag-character", "critical", "Tag character (payload encoding)", "Tag characters can carry a payload"),
    "USC013": Rule("deprecated-format", "critical", "Deprecated format character", "Deprecated format characters"),
    "USC014": Rule("annotation-anchor", "critical", "Interlinear annotation anchor", "Interlinear annotation characters"),
    "USC015": Rule("bidi-pairing", "critical", "", "Bidirectional controls that aren't paired on their line"),
    "USC016": Rule("default-ignorable", "high", "Default-ignorable code point", "Other code points without a glyph"),
    "USC017": Rule("homoglyph", "high", "", "Character that looks like an ASCII one"),
    "USC018": Rule("mixed-line-endings", "medium", "", "More than one kind of line end"),
    "USC019": Rule("non-ascii-identifier", "medium", "", "Identifier against the identifier policy"),
}

# Severities from least to most.
SEVERITIES = ("low", "medium", "high", "critical")

# Disjoint character classes (first, last, rule); "VS" are variation selectors.
CLASS_RANGES: list[tuple[int, int, str]] = [
    (0x0000, 0x0008, "USC007"), (0x000B, 0x000C, "USC007"), (0x000E, 0x001F, "USC007"), (0x007F, 0x009F, "USC007"),
    (0x00A0, 0x00A0, "USC005"), (0x00AD, 0x00AD, "USC002"), (0x034F, 0x034F, "USC016"), (0x061C, 0x061C, "USC001"),
    (0x115F, 0x1160, "USC016"), (0x1680, 0x1680, "USC005"), (0x17B4, 0x17B5, "USC016"), (0x180B, 0x180D, "USC016"),
    (0x180E, 0x180E, "USC002"), (0x180F, 0x180F, "USC016"), (0x2000, 0x200A, "USC005"), (0x200B, 0x200D, "USC002"),
    (0x200E, 0x200F, "USC001"), (0x202A, 0x202E, "USC001"), (0x202F, 0x202F, "USC005"), (0x205F, 0x205F, "USC005"),
    (0x2060, 0x2060, "USC002"), (0x2061, 0x2065, "USC016"), (0x2066, 0x2069, "USC001"), (0x206A, 0x206F, "USC013"),
    (0x3000, 0x3000, "USC005"), (0x3164, 0x3164, "USC016"), (0xE000, 0xF8FF, "USC011"), (0xFE00, 0xFE0F, "VS"),
    (0xFEFF, 0xFEFF, "USC002"), (0xFFA0, 0xFFA0, "USC016"), (0xFFF0, 0xFFF8, "USC013"), (0xFFF9, 0xFFFB, "USC014"),
    (0x1BCA0, 0x1BCA3, "USC016"), (0x1D173, 0x1D17A, "USC016"), (0xE0000, 0xE0000, "USC016"), (0xE0001, 0xE007F, "USC012"),
    (0xE0080, 0xE00FF, "USC016"), (0xE0100, 0xE01EF, "VS"), (0xE01F0, 0xE0FFF, "USC016"), (0xF0000, 0xFFFFD, "USC011"),
    (0x100000, 0x10FFFD, "USC011"),
]

#: Rules that run on unchanged lines too, besides those on line structure.
ALWAYS = ("USC001", "USC011", "USC012")

# Bidirectional openers and closers, embeddings and isolates.
EMBED_OPEN, EMBED_CLOSE = (0x202A, 0x202B, 0x202D, 0x202E), 0x202C
ISOLATE_OPEN, ISOLATE_CLOSE = (0x2066, 0x2067, 0x2068), 0x2069

# Blocks of scripts (first, last, script), by code point.
SCRIPT_RANGES: list[tuple[int, int, str]] = [
    (0x0041, 0x005A, "Latin"), (0x0061, 0x007A, "Latin"), (0x00C0, 0x00D6, "Latin"), (0x00D8, 0x00F6, "Latin"), (0x00F8, 0x02AF, "Latin"),
    (0x0370, 0x0377, "Greek"), (0x037A, 0x037F, "Greek"), (0x0384, 0x038A, "Greek"), (0x038C, 0x038C, "Greek"), (0x038E, 0x03A1, "Greek"),
    (0x03A3, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"),
    (0x0700, 0x074F, "Syriac"), (0x0750, 0x077F, "Arabic"), (0x0780, 0x07BF, "Thaana"), (0x0870, 0x08FF, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B00, 0x0B7F, "Oriya"), (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0D80, 0x0DFF, "Sinhala"), (0x0E00, 0x0E7F, "Thai"),
    (0x0E80, 0x0EFF, "Lao"), (0x0F00, 0x0FFF, "Tibetan"), (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0x1200, 0x139F, "Ethiopic"), (0x13A0, 0x13FF, "Cherokee"), (0x1400, 0x167F, "Canadian_Aboriginal"), (0x1780, 0x17FF, "Khmer"),
    (0x19E0, 0x19FF, "Khmer"), (0x1D00, 0x1DBF, "Latin"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x2C60, 0x2C7F, "Latin"),
    (0x2D00, 0x2D2F, "Georgian"), (0x2D80, 0x2DDF, "Ethiopic"), (0x2DE0, 0x2DFF, "Cyrillic"), (0x3040, 0x309F, "Hiragana"),
    (0x30A0, 0x30FF, "Katakana"), (0x3130, 0x318F, "Hangul"), (0x31F0, 0x31FF, "Katakana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"),
    (0xA640, 0xA69F, "Cyrillic"), (0xA720, 0xA7FF, "Latin"), (0xA8E0, 0xA8FF, "Devanagari"), (0xAB30, 0xAB6F, "Latin"), (0xAB70, 0xABBF, "Cherokee"),
    (0xAC00, 0xD7AF, "Hangul"), (0xF900, 0xFAFF, "Han"), (0xFB00, 0xFB06, "Latin"), (0xFB13, 0xFB17, "Armenian"), (0xFB1D, 0xFB4F, "Hebrew"),
    (0xFB50, 0xFDFF, "Arabic"), (0xFE70, 0xFEFF, "Arabic"), (0x20000, 0x2A6DF, "Han"),
]

# Confusable characters and the ASCII letter that they look like, by code point.
CONFUSABLES: dict[int, str] = {
    0x0251: "a", 0x0261: "g", 0x026A: "i", 0x0391: "A", 0x0392: "B", 0x0395: "E", 0x0396: "Z", 0x0397: "H", 0x0399: "I", 0x039A: "K", 0x039C: "M",
    0x039D: "N", 0x039F: "O", 0x03A1: "P", 0x03A4: "T", 0x03A5: "Y", 0x03A7: "X", 0x03B1: "a", 0x03B2: "B", 0x03B5: "e", 0x03B7: "n", 0x03B9: "i",
    0x03BA: "k", 0x03BD: "v", 0x03BF: "o", 0x03C1: "p", 0x03C4: "t", 0x03C5: "u", 0x03C7: "x", 0x03C9: "w", 0x0401: "E", 0x0405: "S", 0x0406: "I",
    0x0408: "J", 0x040C: "K", 0x0410: "A", 0x0412: "B", 0x0415: "E", 0x041A: "K", 0x041C: "M", 0x041D: "H", 0x041E: "O", 0x0420: "P", 0x0421: "C",
    0x0422: "T", 0x0423: "Y", 0x0425: "X", 0x042C: "b", 0x0430: "a", 0x0435: "e", 0x043E: "o", 0x0440: "p", 0x0441: "c", 0x0443: "y", 0x0445: "x",
    0x044C: "b", 0x0455: "s", 0x0456: "i", 0x0458: "j", 0x04AE: "Y", 0x04AF: "y", 0x04BA: "h", 0x04BB: "h", 0x04C0: "I", 0x054C: "L", 0x054D: "S",
    0x0555: "O", 0x0566: "q", 0x0570: "h", 0x0578: "n", 0x057C: "n", 0x057D: "s", 0x0585: "o", 0x13A0: "D", 0x13A1: "R", 0x13A2: "T", 0x13A9: "Y",
    0x13AA: "A", 0x13AB: "J", 0x13AC: "E", 0x13B1: "G", 0x13B3: "W", 0x13B7: "M", 0x13BB: "H", 0x13BE: "S", 0x13C0: "P", 0x13C2: "Z", 0x13C3: "B",
    0x13CB: "V", 0x13CF: "K", 0x13D2: "L", 0x13DA: "C", 0x1D00: "a", 0x2126: "O", 0x212A: "K", 0x212B: "A", 0x2160: "I", 0x2164: "V", 0x2169: "X",
    0x216C: "L", 0x216D: "C", 0x216E: "D", 0x216F: "M",
}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: By rule: bold and italic mathematical letters (one italic letter has no code point there), and full-width ones.
CONFUSABLES |= {0x1D400 + i: c for i, c in enumerate(_LETTERS)}
CONFUSABLES |= {0x1D434 + i: c for i, c in enumerate(_LETTERS) if 0x1D434 + i != 0x1D455}
CONFUSABLES |= {0xFF21 + i: c for i, c in enumerate(_LETTERS[:26])} | {0xFF41 + i: c for i, c in enumerate(_LETTERS[26:])}

# Which characters are named in reports; the names themselves are Unicode's.
_NAMED = [
    0xA0, 0xAD, 0x61C, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x202A, 0x2030), 0x205F, 0x2060, *range(0x2066, 0x206A), 0x3000,
    *range(0xFE00, 0xFE10), 0xFEFF, *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B),
]
CHAR_NAMES: dict[int, str] = {0x09: "CHARACTER TABULATION", 0x0A: "LINE FEED", 0x0D: "CARRIAGE RETURN"}
CHAR_NAMES |= {cp: unicodedata.name(chr(cp)) for cp in sorted({*_NAMED, *(c for c in CONFUSABLES if c < 0x10000 and not 0x13A0 <= c <= 0x13FF)})}

# Names for characters in policies.
NAMED_CHARACTERS = {"ZWJ": 0x200D, "ZWNJ": 0x200C, "NBSP": 0xA0, "SOFT_HYPHEN": 0xAD, "BOM": 0xFEFF}

# Languages by file extension and by file name.
LANGUAGE_BY_EXTENSION: dict[str, str] = {
    "py": "python", "pyw": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "scala": "scala", "c": "c", "h": "c",
    "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "sh": "shell", "bash": "shell", "zsh": "shell", "pl": "perl",
    "pm": "perl", "r": "r", "swift": "swift", "lua": "lua", "yml": "yaml", "yaml": "yaml", "toml": "toml", "md": "markdown", "rst": "rst",
    "html": "html", "htm": "html", "css": "css", "scss": "scss", "sql": "sql", "zig": "zig", "nim": "nim", "json": "json", "xml": "xml",
}
LANGUAGE_BY_NAME = {"Dockerfile": "dockerfile", "Makefile": "makefile", "Gemfile": "ruby", "Rakefile": "ruby", "Vagrantfile": "ruby"}

# Which lexical forms languages have.
HASH = frozenset("python ruby perl shell yaml toml makefile dockerfile r".split())
SLASH = frozenset("javascript typescript go rust java kotlin scala c cpp csharp swift zig nim php css scss sql".split())
BLOCK = SLASH - {"zig", "nim"}
NESTED = frozenset("rust swift kotlin scala".split())
DASH = frozenset("lua sql".split())
MARKUP = frozenset("html xml".split())
TEMPLATE = frozenset("javascript typescript".split())

# File types by risk (all others are high).
HIGH_EXTENSIONS = (
    "py js ts tsx jsx mjs cjs go rs java kt scala c cpp h hpp cs rb php pl pm sh bash zsh yml yaml toml cfg ini env tf hcl sql r R swift m mm lua zig nim v dockerfile"
).split()
MEDIUM_EXTENSIONS = "md rst txt adoc asciidoc html htm css scss less xml xsl xslt csv tsv".split()

# Paths that a scan leaves out, and its limits.
EXCLUDED_DIRECTORIES = ".git node_modules .vscode __pycache__ .mypy_cache .tox vendor dist build _site .next target".split()
EXCLUDED_SUFFIXES = (
    ".woff .woff2 .ttf .otf .eot .png .jpg .jpeg .gif .ico .svg .webp .pdf .wasm .pyc .pyo .class .o .so .dylib .dll .exe .a .lib .jar .war"
    " .zip .tar .gz .bz2 .xz .7z .rar .lock .min.js .min.css .pb.go"
).split()
MOST_BYTES, PROBE_BYTES, MOST_DEPTH = 50 * 1024 * 1024, 8192, 64
