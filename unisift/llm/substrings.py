"""Operator 4: exact removal of long repeated substrings with a run-length compressed index.

`repeated_bytes(documents, length)` finds every byte covered by a string of `length` bytes that also starts anywhere
else in the table (the same document included; matches never cross documents). Texts are UTF-8 bytes.

1. Anchors. A window is a string of `length` bytes. Its anchor is the place of its smallest `GRAM`-byte hash (the last of
   equal ones), so equal windows have equal anchors at equal offsets. Neighbouring windows with one anchor, split by
   offset into steps, form a piece; its key is a hash of the bytes that all windows of that step share (the core). Equal
   windows lie in pieces of equal key, at the same offset. Only keys, digests and places are shuffled.
2. Keys found once are done. Copies: pieces of equal key and digest are equal strings, so all their windows repeat; they
   are counted map-side and represented once, however many there are.
3. Keys with several different pieces go to the index, one representative each. Shards of about `SHARD` bytes hold whole
   keys. For its text (pieces, each with an own end mark) a shard builds the Burrows-Wheeler transform, keeps its
   runs with suffix samples at both ends of each run, and finds there the irreducible match lengths with the
   neighbouring suffix. Matching statistics are then streamed along the text: within a run, a position's length is
   that of the sampled position before it, less the distance. Windows with a statistic of `length` or more repeat.
4. Keys with more than `WIDE` bytes of different pieces (a passage that very many documents share, in different
   surroundings) would fill a shard: their pieces are split by finer offset steps, which have longer cores, and
   take steps 2 to 4 again; at step 1 the core is the window itself, so nothing is left. Every case has an exact way.
5. Marked ranges meet their document by (id, text hash) and are merged.

Memory is bounded by slices of text, shards and one document. Executors can be lost: intermediate results are tables in
the shared folder, all steps are deterministic.

Nulls: a null text is empty; a null id is kept; repeated rows repeat each other's strings; an empty table gives an empty
result; texts shorter than `length` have no window. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .stage import written

GRAM = 32
#: Bytes of text in a shard's index; bytes of different pieces of one key beyond which they are split more finely.
SHARD, WIDE = 1 << 20, 1 << 18
#: Offset steps, from coarse to single windows.
STEPS = (200, 48, 1)

_BASE = 0xB5297A4D3F84D5A5
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    table = _tables.get(base, np.ones(1, np.uint64))
    while len(table) < n:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
    _tables[base] = table
    return table[:n]


class Hasher:
    """Hashes of any stretches of some bytes."""

    def __init__(self, data: np.ndarray):
        codes = tx._BYTE_CODE[data]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(_BASE, len(data)))])
        self.inverse = _powers(_INVERSE, len(data) + 1)
        self.codes = codes

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tx.mix((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all stretches of n bytes, n a power of two."""
        h, width = self.codes, 1
        while width < n:
            h = h[: len(h) - width] * np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64)) + h[width:]
            width *= 2
        return tx.mix(h)


def _anchors(hasher: Hasher, length: int) -> np.ndarray:
    """The anchor of each window start (windows inside the bytes)."""
    grams = hasher.grams(GRAM)
    low = np.uint64((1 << 24) - 1)
    least = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return (low - (least & low)).astype(np.int64)


def _pieces(hasher: Hasher, start: np.ndarray, anchor: np.ndarray, length: int, step: int) -> tuple[np.ndarray, ...]:
    """Pieces of windows (starts in order, with their anchors): first start, windows, anchor - start, key, digest."""
    block = (anchor - start) // step
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(start)))
    s, p, q = start[at], anchor[at], block[at]
    far = np.minimum((q + 1) * step - 1, length - GRAM)
    key = tx.mix(hasher.of(p - q * step, p + length - far) + q.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    digest = tx.mix(hasher.of(s, s + count - 1 + length) ^ (p - s).astype(np.uint64))
    return s, count, p - s, key.view(np.int64), digest.view(np.int64)


_PIECE = "start long, n_windows int, anchor int, key long, digest long"


def _all_pieces(documents: DataFrame, length: int) -> DataFrame:
    """doc_id, text_hash and the pieces of every text, at the coarsest step."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    stretch = tx.SLICE_BYTES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            at, data = tx.flat(part.column("text"))
            # a long text is cut into stretches that overlap by a window, so that arrays stay small
            for begin in range(0, max(1, len(data)), stretch):
                some = data[begin : begin + stretch + length - 1]
                if len(some) < length:
                    continue
                hasher = Hasher(some)
                anchor = _anchors(hasher, length)
                start = np.arange(len(anchor))
                owner = np.searchsorted(at, start + begin, side="right") - 1
                inside = np.flatnonzero(start + begin + length <= at[owner + 1])
                if not len(inside):
                    continue
                s, count, offset, key, digest = _pieces(hasher, inside, anchor[inside], length, STEPS[0])
                rows = owner[s]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(s + begin - at[rows]), pa.array(count.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(key), pa.array(digest)],
                    ["doc_id", "text_hash", "start", "n_windows", "anchor", "key", "digest"],
                )

    return documents.mapInArrow(cut, f"doc_id {kind}, text_hash long, {_PIECE}")


def suffix_ranks(text: np.ndarray, ends: np.ndarray, deepest: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes of a text of pieces by their first 7, 14, ... symbols, until deeper than `deepest`.

    text: 0 at end marks (which are distinct, in order), else byte + 1. ends: the end mark's place for each symbol.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    left = ends - np.arange(n)
    key = np.zeros(n, np.int64)
    for i in range(7):
        key = (key << 9) | np.where(left >= i, padded[i : i + n], 0)
    _, rank = np.unique(key, return_inverse=True)
    marks = np.cumsum(text == 0)
    which = np.where(left < 7, marks + (text != 0), 0)  # suffixes that reach their own end mark are told apart by it
    _, rank = np.unique(rank * (marks[-1] + 2) + which, return_inverse=True)
    out, width = [(7, rank)], 7
    while width <= deepest and rank.max() < n - 1:
        after = np.minimum(np.arange(n) + width, n - 1)
        _, rank = np.unique(rank * n + rank[after], return_inverse=True)
        width *= 2
        out.append((width, rank))
    return out


def matching_statistics(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """For the concatenated pieces: the longest match of each place with any other place, where each piece begins, runs.

    Builds the run-length Burrows-Wheeler transform with samples at run ends, and streams the statistics from these.
    """
    sizes = np.asarray([len(p) for p in pieces]) + 1
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = int(sizes.sum())
    text = np.zeros(n, np.int16)
    for b, p in zip(begins.tolist(), pieces, strict=True):
        text[b : b + len(p)] = p
        text[b : b + len(p)] += 1
    ends = np.repeat(begins + sizes - 1, sizes)
    ranks = suffix_ranks(text, ends, int(sizes.max()))
    suffix = np.argsort(ranks[-1][1], kind="stable")
    before = text[suffix - 1].astype(np.int64)  # the transform
    before[suffix == 0] = -1
    marks = before == 0
    before[marks] = -2 - np.flatnonzero(marks)  # end marks are distinct, so none continues a run
    heads = np.flatnonzero(before[1:] != before[:-1]) + 1  # rows that begin a run; the row above ends one

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix within pieces, from the ranks and at last symbol by symbol."""
        got = np.zeros(len(x), np.int64)
        for width, rank in reversed(ranks):
            a, b = np.minimum(x + got, n - 1), np.minimum(y + got, n - 1)
            got += np.where((rank[a] == rank[b]) & (a != b), width, 0)
        for _ in range(7):
            a, b = np.minimum(x + got, n - 1), np.minimum(y + got, n - 1)
            got += (text[a] == text[b]) & (text[a] > 0)
        return got

    lengths = np.append(common(suffix[heads], suffix[heads - 1]), 0)
    best = np.zeros(n, np.int64)
    place = np.arange(n)
    # matches with the suffix before (sampled where runs begin; the first row has none), and after (where runs end)
    for sampled in (np.append(suffix[heads], suffix[0]), np.append(suffix[heads - 1], suffix[-1])):
        order = np.argsort(sampled)
        spots, values = sampled[order], lengths[order]
        last = np.searchsorted(spots, place, side="right") - 1
        known = last >= 0
        streamed = values[last[known]] - (place[known] - spots[last[known]])
        best[known] = np.maximum(best[known], streamed)
    return np.minimum(best, ends - place), begins, len(heads) + 1


def _indexed(rows: DataFrame, shards: int, length: int) -> DataFrame:
    """doc_id, text_hash, begin, end of repeated stretches of representatives, by a shard's index."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def search(table: pa.Table) -> pa.Table:
        key, digest = table.column("key").to_numpy(), table.column("digest").to_numpy()
        _, first = np.unique(np.stack([key, digest], 1), axis=0, return_index=True)
        table = table.take(pa.array(np.sort(first)))
        pieces = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("data")]
        best, begins, _ = matching_statistics(pieces)
        hit = best >= length
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(begins, a, side="right") - 1
        start = table.column("start").to_numpy()[owner]
        take = pa.array(owner)
        return pa.table({"doc_id": table.column("doc_id").take(take), "text_hash": table.column("text_hash").take(take), "begin": start + a - begins[owner], "end": start + b - 1 - begins[owner] + length})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(search, f"doc_id {kind}, text_hash long, begin long, end long")


def _finer(rows: DataFrame, length: int, step: int) -> DataFrame:
    """The windows of representatives in pieces of a finer step, each with its bytes."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            out: dict[str, list] = {c: [] for c in ("row", "start", "n_windows", "anchor", "key", "digest", "data")}
            columns = [batch.column(c).to_pylist() for c in ("start", "n_windows", "anchor", "data")]
            for i, (start, count, anchor, data) in enumerate(zip(*columns, strict=True)):
                s, n, offset, key, digest = _pieces(Hasher(np.frombuffer(data, np.uint8)), np.arange(count), np.full(count, anchor), length, step)
                for c, v in (("start", s + start), ("n_windows", n), ("anchor", offset), ("key", key), ("digest", digest)):
                    out[c] += v.tolist()
                out["row"] += [i] * len(s)
                # a single window is told by its key; nothing reads its bytes any more
                out["data"] += [data[a : a + w - 1 + length] if step > 1 else b"" for a, w in zip(s.tolist(), n.tolist(), strict=True)]
            take = pa.array(out["row"], pa.int64())
            kinds = {"start": pa.int64(), "n_windows": pa.int32(), "anchor": pa.int32(), "key": pa.int64(), "digest": pa.int64(), "data": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text_hash").take(take), *(pa.array(out[c], t) for c, t in kinds.items())], ["doc_id", "text_hash", *kinds])

    return rows.mapInArrow(split, f"doc_id {kind}, text_hash long, {_PIECE}, data binary")


def _bytes_of(documents: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Places (doc_id, text_hash, start, n_windows, anchor, key, digest) with the bytes of their windows."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    wanted = places.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_list(F.struct("start", "n_windows", "anchor", "key", "digest")).alias("places"))
    joined = documents.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("doc_id", "text_hash", "text", "places")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            at, data = tx.flat(part.column("text"))
            lists = part.column("places")
            owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            start, count = flat.field("start").to_numpy(), flat.field("n_windows").to_numpy()
            body = data.tobytes()
            own = [body[a : a + w - 1 + length] for a, w in zip((at[owner] + start).tolist(), count.tolist(), strict=True)]
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(rows), part.column("text_hash").take(rows), *(flat.field(c) for c in ("start", "n_windows", "anchor", "key", "digest")), pa.array(own, pa.binary())], ["doc_id", "text_hash", "start", "n_windows", "anchor", "key", "digest", "data"])

    return joined.mapInArrow(take, f"doc_id {kind}, text_hash long, {_PIECE}, data binary")


def _ranges(documents: DataFrame, length: int) -> DataFrame:
    """doc_id, text_hash, begin, end: bytes to remove, overlapping ones not merged."""
    pieces = written(_all_pieces(documents, length), "pieces")
    found = None
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "start", "n_windows", "anchor")
    for level, step in enumerate((*STEPS[1:], None)):
        many = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        shared = written(pieces.join(written(many, "keys"), "key"), "shared")
        content = [F.min("data").alias("data")] if level else []
        kinds = shared.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("rep"), *content)
        kinds = written(kinds, "kinds")
        same = written(kinds.where("n > 1").select("key", "digest"), "same")
        whole = shared.join(same, ["key", "digest"]).select("doc_id", "text_hash", F.col("start").alias("begin"), (F.col("start") + F.col("n_windows") - 1 + length).alias("end"))
        found = whole if found is None else found.unionByName(whole)
        if step is None:
            return found
        groups = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("rep.n_windows") + (length - 1)).alias("bytes")).where("kinds > 1")
        groups = written(groups.select("key", "bytes"), "groups")
        reps = kinds.join(groups, "key").select("rep.doc_id", "rep.text_hash", "rep.start", "rep.n_windows", "rep.anchor", "key", "digest", "bytes", *(["data"] if level else []))
        narrow, wide = reps.where(F.col("bytes") <= WIDE), reps.where(F.col("bytes") > WIDE)
        total = groups.where(F.col("bytes") <= WIDE).agg(F.sum("bytes")).first()[0]
        if total:
            rows = narrow.drop("bytes") if level else _bytes_of(documents, narrow.drop("bytes"), length)
            found = found.unionByName(written(_indexed(rows, -(-total // SHARD), length), "matches"))
        if not groups.where(F.col("bytes") > WIDE).take(1):
            return found
        rows = wide.drop("bytes") if level else _bytes_of(documents, wide.drop("bytes"), length)
        pieces = written(_finer(rows, length, step), "pieces")
    return found


def repeated_bytes(documents: DataFrame, length: int = 400, id_column: str = "doc_id", text_column: str = "text", texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, spans (begin, end in bytes); with `texts` also kept (binary)."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    docs = documents.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranges = _ranges(docs, length).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    joined = docs.join(ranges.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left").select("doc_id", "text", "ranges")
    extra = ", kept binary" if texts else ""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.slices(batches, "text"):
            at, data = tx.flat(part.column("text"))
            body = data.tobytes()
            lists = part.column("ranges")
            counts = lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten()
            begins, ends = flat.field("begin").to_numpy(), flat.field("end").to_numpy()
            own = np.concatenate([[0], np.cumsum(counts)])
            removed, spans, digests, lengths, merged, kept = [], [], [], [], [], []
            for i in range(part.num_rows):
                order = np.argsort(begins[own[i] : own[i + 1]], kind="stable")
                b, e = begins[own[i] : own[i + 1]][order], ends[own[i] : own[i + 1]][order]
                if len(b):
                    reach = np.maximum.accumulate(e)
                    new = np.concatenate([[True], b[1:] > reach[:-1]])  # stretches that touch are one
                    b, e = b[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                text = body[at[i] : at[i + 1]]
                left = b"".join(text[x:y] for x, y in zip([0, *e.tolist()], [*b.tolist(), len(text)], strict=True))
                removed.append(len(text) - len(left))
                spans.append(len(b))
                digests.append(hashlib.sha256(left).hexdigest())
                lengths.append(len(left))
                merged += [b, e]
                if texts:
                    kept.append(left)
            columns = {"doc_id": part.column("doc_id"), "n_bytes": pa.array(np.diff(at)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            ends = [np.concatenate([np.zeros(0, np.int64), *merged[i::2]]) for i in (0, 1)]
            pairs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in ends], ["begin", "end"])
            columns |= {"n_kept": pa.array(lengths, pa.int64()), "spans": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(spans)]), pa.int32()), pairs)}
            if texts:
                columns["kept"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return joined.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, spans array<struct<begin: long, end: long>>{extra}")
