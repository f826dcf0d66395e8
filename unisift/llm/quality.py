"""Operator 7: quality rules by distribution divergence.

`judge(documents)` compares two histograms of each whole text with references of its language by the
Jensen-Shannon distance (square root of the divergence, base 2, so from 0 to 1):

* character classes: lower case, upper case, digits, ASCII white space, common punctuation, symbols,
  and letters or other characters beyond ASCII, by bytes of the text;
* common words: the `COMMON` most frequent lower-cased words of the language (by 64-bit hash, ties by hash), and one
  class for all other words.

A reference is the sum over all documents of the language, made in a first pass: words are counted in the tasks, then by
key, and a language's `COMMON` first ones found by partial ranking before they meet. It has a fixed size. Every language has its own, however many there are:
those of the `LANGUAGES` languages with the most words are sent to every task; documents of any other language are
joined with theirs. So what is sent at once has a fixed size bound, whatever the corpus.

A document without a language takes the nearest of all references (least sum of both distances), that of all such
documents among them; they are tried `LANGUAGES` at a time. A reference of fewer than `LEAST_WORDS` words is no
evidence: distances from it are left out (null), and base rules alone decide.

Minimum-length guards: the class distance counts for texts of at least `class_bytes` bytes, the word distance
for at least `word_count` words; the limits widen with 1 / sqrt(length), as sampling noise does. A text fails
if a distance that counts exceeds its limit.

Base rules come first (see `base` columns); a document is kept if it passes both.

Nulls: a null text has no word and fails the base rules; a null language takes the nearest reference; a null id
is kept; each repeated row is judged on its own; an empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .stage import written

COMMON = 64
#: Words that a task counts at once before it passes the counts on.
_HELD = 1 << 20
LANGUAGES = 256
LEAST_WORDS = 2000
CLASSES = 7

_CLASS = np.full(256, 5, np.uint8)
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x20, *range(9, 14)]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[0x80:] = 6
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_doc(owner: np.ndarray, what: np.ndarray, docs: int, kinds: int) -> np.ndarray:
    return np.bincount(owner * kinds + what, minlength=docs * kinds).reshape(docs, kinds)


def _histograms(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class counts per row; row and hash of each word."""
    rows = len(at) - 1
    classes = _per_doc(np.repeat(np.arange(rows), np.diff(at)), _CLASS[data].astype(np.int64), rows, CLASSES)
    *_, hashes, owner = tx.row_words(at, data, True)
    return classes, owner, hashes.view(np.int64)


#: Class shares, common words, and their shares with the rest's last.
Reference = tuple[np.ndarray, np.ndarray, np.ndarray]
_PARTS = ["classes", "common", "shares"]
#: Kinds of counts: bytes of a class, a word, all words.
_CLASSES, _WORD, _TOTAL = 0, 1, 2


def references(documents: DataFrame, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """lang (null: documents without one), words, classes, common, shares of every language with enough words. Over all documents."""
    rows = documents.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(words)).astype(np.int64)
                kinds = np.repeat(np.asarray([_CLASSES, _WORD, _TOTAL], np.int8), [CLASSES, len(words), 1])
                keys = np.concatenate([np.arange(CLASSES), words, [0]])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(kinds), pa.array(keys), pa.array(np.concatenate([sums[lang], counts, [counts.sum()]]))], ["lang", "kind", "key", "n"])
            held.clear()
            sums.clear()

        for part in tx.slices(batches, "text"):
            classes, owner, hashes = _histograms(*tx.flat(part.column("text")))
            coded = part.column("lang").dictionary_encode()
            code = np.asarray(coded.indices.fill_null(len(coded.dictionary)))
            for k, lang in enumerate([*coded.dictionary.to_pylist(), None]):
                own = code == k
                if own.any():
                    sums[lang] = sums.get(lang, 0) + classes[own].sum(0)
                    held.setdefault(lang, []).append(np.unique(hashes[own[owner]], return_counts=True))
                    size += len(held[lang][-1][0]) + CLASSES
            if size > _HELD:
                yield from flush()
                size = 0
        yield from flush()

    def reference(table: pa.Table) -> pa.Table:
        kind, n = table["kind"].to_numpy(), table["n"].to_numpy()
        classes = np.zeros(CLASSES)
        classes[table["key"].to_numpy()[kind == _CLASSES]] = n[kind == _CLASSES]
        common, heavy, total = table["key"].to_numpy()[kind == _WORD], n[kind == _WORD], int(n[kind == _TOTAL].sum())
        order = np.argsort(common)
        shares = np.append(heavy[order], total - heavy.sum())
        parts = classes / max(1, classes.sum()), common[order], shares / max(1, total)
        return pa.table([table["lang"].slice(0, 1), pa.array([total]), *(pa.array([x]) for x in parts)], ["lang", "words", *_PARTS])

    counted = rows.mapInArrow(count, "lang string, kind byte, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    heaviest = counted.withColumn("place", place).where(F.col("place") <= COMMON)
    made = heaviest.groupBy("lang").applyInArrow(reference, "lang string, words long, classes array<double>, common array<long>, shares array<double>")
    return made.where(F.col("words") >= LEAST_WORDS)  # at most CLASSES + COMMON + 1 rows a group


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def _base(at: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(at) - 1
    joined, starts, ends, hashes, owner = tx.row_words(at, data, False)
    n_words = np.bincount(owner, minlength=rows)
    points = tx.code_points(joined)
    word_chars = np.bincount(owner, weights=points[ends] - points[starts], minlength=rows).astype(np.int64)
    symbols = np.bincount(np.repeat(np.arange(rows), np.diff(at)), weights=_SYMBOL[data], minlength=rows).astype(np.int64)
    dup_lines = np.zeros(rows, np.int64)
    repeat = np.zeros(rows, np.int64)
    windows = tx.rolled(hashes, 8)
    first = np.searchsorted(owner, np.arange(rows + 1))
    body = data.tobytes()
    for i in range(rows):
        lo, hi = first[i], first[i + 1]
        if hi - lo > 8:
            w = windows[lo : hi - 7]
            _, back, counts = np.unique(w, return_inverse=True, return_counts=True)
            if len(counts) < len(w):
                cover = np.zeros(hi - lo + 1, np.int64)
                hit = np.flatnonzero(counts[back] > 1)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + 8, -1)
                repeat[i] = (np.cumsum(cover) > 0).sum()
        if hi > lo:
            lines = [x for x in body[at[i] : at[i + 1]].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            dup_lines[i] = len(lines) - len(set(lines))
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat}


#: Columns of a verdict after the document's id.
_VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def _measured(texts: pa.Array, langs: pa.Array, known: dict[str | None, Reference], near: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Both distances of each text from the reference of its language; without a language, from the nearest, `near` included. NaN without a reference."""
    classes, owner, hashes = _histograms(*tx.flat(texts))
    coded = langs.dictionary_encode()
    code = np.asarray(coded.indices.fill_null(len(coded.dictionary)))
    first, second = near or (np.full(len(classes), np.nan), np.full(len(classes), np.nan))
    for k, lang in enumerate([*coded.dictionary.to_pylist(), None]):
        own = np.flatnonzero(code == k)
        if not len(own):
            continue
        number = np.full(len(classes), -1)
        number[own] = np.arange(len(own))
        mine = number[owner] >= 0
        for class_shares, common, shares in known.values() if lang is None else [known[lang]] if lang in known else []:
            at = np.minimum(np.searchsorted(common, hashes[mine]), len(common) - 1)
            counts = _per_doc(number[owner[mine]], np.where(common[at] == hashes[mine], at, len(common)), len(own), len(common) + 1)
            one = distance(classes[own] / np.maximum(1, classes[own].sum(1, keepdims=True)), class_shares)
            two = distance(counts / np.maximum(1, counts.sum(1, keepdims=True)), shares)
            better = ~(first[own] + second[own] <= one + two)
            first[own[better]], second[own[better]] = one[better], two[better]
    return first, second


def _verdicts(class_limit: float = 0.17, class_noise: float = 1.5, word_limit: float = 0.115, word_noise: float = 3.0, class_bytes: int = 100, word_count: int = 20):
    """A function from texts (Arrow) and their distances to the columns of _VERDICT."""

    def verdict(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> dict[str, pa.Array]:
        at, data = tx.flat(texts)
        out = _base(at, data)
        n, size = out["n_words"], np.diff(at)
        base_failed = (n < 20) | (100 * out["n_repeat_words"] > 30 * n)
        first_counts, second_counts = (size >= class_bytes) & ~np.isnan(first), (n >= word_count) & ~np.isnan(second)
        far = (first_counts & (first > class_limit + class_noise / np.sqrt(np.maximum(1, size)))) | (second_counts & (second > word_limit + word_noise / np.sqrt(np.maximum(1, n))))
        return {c: pa.array(v.astype(np.int64)) for c, v in out.items()} | {"base_failed": pa.array(base_failed), "kept": pa.array(~base_failed & ~far), "class_distance": pa.array(first, mask=~first_counts), "word_distance": pa.array(second, mask=~second_counts)}

    return verdict


def _judged(rows: DataFrame, known: DataFrame, emit: Callable[[pa.RecordBatch, dict[str, pa.Array]], pa.RecordBatch], schema: T.StructType | str, limits: dict) -> DataFrame:
    """What `emit` makes of slices of rows (text, lang and others) and their verdicts."""
    verdict = _verdicts(**limits)
    known = written(known, "quality-references")

    def parts(found: list | dict) -> Reference:
        return tuple(np.array(found[c]) for c in _PARTS)

    def sent(batches: Iterator[pa.RecordBatch], refs: dict) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            yield emit(part, verdict(part.column("text"), *_measured(part.column("text"), part.column("lang"), refs)))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            refs = {}
            for i, lang in enumerate(part.column("lang").to_pylist()):
                if lang not in refs and part.column("shares")[i].is_valid:
                    refs[lang] = parts({c: part.column(c)[i].as_py() for c in _PARTS})
            yield emit(part, verdict(part.column("text"), *_measured(part.column("text"), part.column("lang"), refs)))

    ranked = known.orderBy(F.desc("words"), "lang").limit(LANGUAGES)
    heavy = {r.lang: parts(r.asDict()) for r in ranked.collect()}  # at most LANGUAGES rows
    if known.count() <= LANGUAGES:
        return rows.mapInArrow(lambda batches: sent(batches, heavy), schema)
    lang, most = F.col("lang"), [x for x in heavy if x is not None]
    light = known.where(lang.isNotNull() & ~lang.isin(most))
    out = rows.where(lang.isin(most)).mapInArrow(lambda batches: sent(batches, heavy), schema)
    out = out.unionByName(rows.where(lang.isNotNull() & ~lang.isin(most)).join(light.drop("words"), "lang", "left").mapInArrow(joined, schema))

    # rows without a language meet all references, LANGUAGES at a time, and keep the least distances so far
    near = rows.where(lang.isNull()).withColumns({"first": F.lit(float("nan")), "second": F.lit(float("nan"))})
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in near.schema])

    def nearest(refs: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in tx.slices(batches, "text"):
                so_far = tuple(np.array(part.column(c)) for c in ("first", "second"))
                both = _measured(part.column("text"), part.column("lang"), refs, so_far)
                others = [c for c in part.schema.names if c not in ("first", "second")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *map(pa.array, both)], [*others, "first", "second"])

        return run

    chunk: dict = {}
    for r in known.toLocalIterator():
        chunk[r.lang] = parts(r.asDict())
        if len(chunk) == LANGUAGES:
            near, chunk = near.mapInArrow(nearest(chunk), shape), {}
    if chunk:
        near = near.mapInArrow(nearest(chunk), shape)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            yield emit(part, verdict(part.column("text"), *(np.array(part.column(c)) for c in ("first", "second"))))

    return out.unionByName(near.mapInArrow(decided, schema))


def judge(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **limits) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    n_dup_lines: \\n-split lines with a word, equal to an earlier line. n_repeat_words: words in 8-word windows found
    twice or more in the text. base_failed: n_words < 20 or 100 * n_repeat_words > 30 * n_words. A distance that a
    length guard leaves out is null. limits: class_limit, class_noise, word_limit, word_noise, class_bytes, word_count.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def emit(part: pa.RecordBatch, found: dict[str, pa.Array]) -> pa.RecordBatch:
        columns = {"doc_id": part.column("doc_id")} | found
        return pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return _judged(rows, references(documents, lang_column, text_column), emit, f"doc_id {kind}, {_VERDICT}", limits)


def keep_documents(documents: DataFrame, text_column: str = "text", lang_column: str = "lang", **limits) -> DataFrame:
    """The documents that `judge` keeps, with all their columns, which pass through unread. Only documents of light languages are shuffled."""
    names = documents.columns
    own = ["text" if c == text_column else f"c{i}" for i, c in enumerate(names)]  # no name clashes, and no text is sent twice
    rows = documents.toDF(*own).withColumn("lang", F.col(own[names.index(lang_column)]).cast("string"))

    def emit(part: pa.RecordBatch, found: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(c).filter(found["kept"]) for c in own], own)

    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(own, documents.schema, strict=True)])
    return _judged(rows, references(documents, lang_column, text_column), emit, schema, limits).toDF(*names)
