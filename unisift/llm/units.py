"""Operator 6: substring dedup by hashing lines, paragraphs or sentences.

Texts are cut into units, with their place in the original text (in characters):

* `line`: between \\n; `paragraph`: between blank lines; `sentence`: within a line, up to a run of `.`, `!` or `?`
  or the line's end, so a passage that was pasted into a line still has units of its own.

Several kinds can be asked for at once: a unit goes if its line, its paragraph or its sentence has an earlier occurrence.
`least_words` is one number for sentences, and one word for lines and paragraphs then; or a number for each kind.

A unit is normalised: A-Z to a-z, white space runs to one space, ends trimmed of white space and `.!?`. Units with at
least `least_words` words are grouped by a 128-bit digest over the whole table; the occurrence of smallest rank
(document id, null last, text hash, then place) stays and all others are to be removed. `repeated_units` returns their original
offsets and where the kept one is; `dedup_units` returns the texts without them.

Scale: one narrow pass makes units (no text is shuffled, only digests and places), which are written once; counts and smallest ranks are summed
map-side, so a unit that a third of all documents share costs one row per task; only units found more than once
are joined back, by a join whose hot digests Spark splits.

Nulls: a null text has no units; a null id ranks last; rows with one id and different texts are told apart by the text's hash; rows of
equal rank (repeated with id and text) count as one occurrence each, and only the one at the kept rank stays, on all
rows of that rank; an empty table gives an empty result. Long texts are whole. Extra columns aren't read, and pass through
`dedup_units` unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .stage import written

_UNITS = {
    "line": re.compile(r"[^\n]+"),
    "paragraph": re.compile(r"[^\n]+(?:\n[^\n]+)*"),
    "sentence": re.compile(r"[^\n.!?]+[.!?]*"),
}
_WHITE = re.compile(r"[\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})
_TRIM = "\x20\x09\x0a\x0b\x0c\x0d.!?"


def _lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def _units(documents: DataFrame, unit: str | tuple[str, ...], least_words: int | dict[str, int], id_column: str, text_column: str) -> DataFrame:
    """doc_id, text_hash, start, length, n_words, h1, h2 of all units that are long enough; of several kinds, unit too."""
    rows = documents.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    several = not isinstance(unit, str)
    kinds = [*unit] if several else [unit]
    least_of = least_words if isinstance(least_words, dict) else {k: 1 if several and k != "sentence" else least_words for k in kinds}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            texts = part.column("text").to_pylist()
            for kind_of in kinds:
                pattern, least = _UNITS[kind_of], least_of[kind_of]
                owner, start, length, words, digests = [], [], [], [], []
                for i, text in enumerate(texts):
                    for m in pattern.finditer(text or ""):
                        normal = _WHITE.sub(" ", _lower(m[0])).strip(_TRIM)
                        n = normal.count(" ") + 1
                        if n >= least and (normal or not several):
                            owner.append(i)
                            start.append(m.start())
                            length.append(m.end() - m.start())
                            words.append(n)
                            digests.append(hashlib.blake2b(normal.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                if not owner:
                    continue
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                rows_of = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows_of), part.column("text_hash").take(rows_of), *(pa.array(x, pa.int32()) for x in (start, length, words)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), *([pa.array([kind_of] * len(owner))] if several else [])],
                    ["doc_id", "text_hash", "start", "length", "n_words", "h1", "h2", *(["unit"] if several else [])],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, text_hash long, start int, length int, n_words int, h1 long, h2 long" + (", unit string" if several else ""))


def _repeated(documents: DataFrame, unit: str | tuple[str, ...], least_words: int | dict[str, int], id_column: str, text_column: str) -> DataFrame:
    """Units to remove with the text_hash of their documents, and first, the rank of the one that stays."""
    kind = [] if isinstance(unit, str) else ["unit"]
    units = written(_units(documents, unit, least_words, id_column, text_column), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "start")
    first = units.groupBy("h1", "h2", *kind).agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).where("n > 1").select("h1", "h2", *kind, "first")
    first = written(first, "repeated-units")
    return units.withColumn("rank", rank).join(first, ["h1", "h2", *kind]).where("rank > first")


def repeated_units(documents: DataFrame, unit: str | tuple[str, ...] = "sentence", least_words: int | dict[str, int] = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Units to remove: doc_id, start, length, n_words, first_doc_id, first_start (of the one that stays); of several kinds, unit too."""
    kind = [] if isinstance(unit, str) else ["unit"]
    found = _repeated(documents, unit, least_words, id_column, text_column)
    return found.select("doc_id", "start", "length", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), *kind)


def dedup_units(documents: DataFrame, unit: str | tuple[str, ...] = "sentence", least_words: int | dict[str, int] = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with all their columns, and texts without the units to remove; documents are told by id and text."""
    gone = _repeated(documents, unit, least_words, id_column, text_column)
    if not isinstance(unit, str):
        # kinds lie in one another: the widest span stands for those within it
        end = F.col("start") + F.col("length")
        before = Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
        gone = gone.select("doc_id", "text_hash", "start", "length").distinct().withColumn("covered", F.coalesce(F.max(end).over(before), F.lit(0))).where(end > F.col("covered"))
    gone = gone.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("gone"))
    rows = documents.select(F.struct("*").alias("row"))
    text = F.col("row")[text_column]
    joined = rows.join(gone.hint("shuffle_hash"), F.col("row")[id_column].eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("hash")), "left")
    # each piece that stays runs from the end of one removed unit to the start of the next
    begins = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["start"] + g["length"]))
    ends = F.concat(F.transform("gone", lambda g: g["start"]), F.array(F.length(text)))
    pieces = F.zip_with(begins, ends, lambda b, e: F.substring(text, b + 1, e - b))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(pieces, ""))
    return joined.select(*(kept.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in documents.columns))


def repeated_units_sql(least_words: int, kinds: tuple[str, ...] = ()) -> str:
    """`repeated_units` as SQL for DuckDB over `documents`: by sentences, or of several kinds with one least number of words."""
    white, trim = "[\\x20\\x09-\\x0D]+", "^[\\x20\\x09-\\x0D.!?]+|[\\x20\\x09-\\x0D.!?]+$"
    lower = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    between = {"sentence": r"[\n.!?]", "line": r"\n", "paragraph": r"\n"}
    tiles = " UNION ALL ".join(
        rf"SELECT '{k}' AS unit, doc_id, unnest(regexp_extract_all(text, '{_UNITS[k].pattern}|{between[k]}+')) AS x, generate_subscripts(regexp_extract_all(text, '{_UNITS[k].pattern}|{between[k]}+'), 1) AS i FROM documents"
        for k in kinds or ("sentence",)
    )
    return rf"""
WITH tiles AS ({tiles}),
placed AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY unit, doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start, length(x)::INTEGER AS length,
           regexp_replace(regexp_replace({lower}, '{white}', ' ', 'g'), '{trim}', '', 'g') AS normal FROM tiles),
units AS (SELECT unit, doc_id, start, length, (length(normal) - length(replace(normal, ' ', '')) + 1)::INTEGER AS n_words, normal FROM placed WHERE NOT regexp_matches(x, CASE unit WHEN 'sentence' THEN '^[
.!?]' ELSE '^
' END)),
ranked AS (SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(start) OVER w AS first_start FROM units WHERE n_words >= {least_words} WINDOW w AS (PARTITION BY unit, normal ORDER BY doc_id IS NULL, doc_id, start))
SELECT doc_id, start, length, n_words, first_doc_id, first_start{", unit" if kinds else ""} FROM ranked WHERE (doc_id IS NULL, doc_id, start) > (first_doc_id IS NULL, first_doc_id, first_start)"""
