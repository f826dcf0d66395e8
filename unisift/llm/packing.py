"""Operator 1: packing token streams into windows by Karmarkar-Karp multiway differencing.

`pack(documents, path, capacity)` encodes every whole text, adds the end id and cuts the stream into full
windows of `capacity` ids, then pieces of `grain` ids and one shorter piece. Full windows need no packing.
The pieces of a block are spread over windows by multiway differencing: partial partitions (each a set of
windows with their loads) are merged two at a time, those with the largest imbalance first, the fullest
windows of one with the emptiest of the other, until one partition is left, whose windows are nearly equal.
It begins with ceil(total / capacity) windows; whenever a window exceeds the capacity, the number of windows
rises and the block is partitioned again, so no window ever holds more.

One small row per document (lengths and check sums, never ids) reaches a block: cuts don't depend on the
packing, so the check sums are made where the text is encoded. Blocks have about `block` documents, dealt by
a hash, so neither a hot source nor copies fill one; each wastes less than a few windows. A block's result
depends on its rows alone, so a lost executor costs its own blocks only.

`sequence_id` is block number * 2**31 + window, unique over the table.

Nulls: a null text is empty and has just the end id; a null id is kept; repeated rows are packed each on its
own; an empty table gives no piece. Other columns aren't read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .tokens import encoder

#: Documents in a block, about: more of them waste less, and differencing takes items times windows at worst.
BLOCK = 1024
#: What is left of a document after its full windows is cut into pieces of so many ids: small pieces balance better.
GRAIN = 256


def spread(lengths: np.ndarray, windows: int) -> list[list[int]]:
    """Multiway differencing: the items of each window.

    A partial partition is a list of (load above its emptiest window, items), fullest first; windows that have
    got nothing so far are left out of it.
    """
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = [(-int(n), i, [(int(n), [i])]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    for tick in range(len(heap), 2 * len(heap) - 1):
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = max(0, len(a) + len(b) - windows)
        alone_a, alone_b = len(a) - over, len(b) - over
        # the emptiest `over` windows of both meet, the fullest with the emptiest
        met = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[alone_a:], reversed(b[alone_b:]), strict=True)]
        merged = sorted([*a[:alone_a], *b[:alone_b], *met], key=lambda w: -w[0])
        if len(merged) == windows and (floor := merged[-1][0]):
            merged = [(load - floor, items) for load, items in merged]
        heapq.heappush(heap, (-merged[0][0], tick, merged))
    parts = [items for _, items in heap[0][2]] if heap else []
    return parts + [[] for _ in range(windows - len(parts))]


def pack_block(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each item, and the number of windows; no window exceeds the capacity."""
    windows = -(-int(lengths.sum()) // capacity)
    while True:
        parts = spread(lengths, windows)
        if all(sum(int(lengths[i]) for i in items) <= capacity for items in parts):
            break
        windows += max(1, windows // 512)
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for w, items in enumerate(x for x in parts if x):
        at = 0
        for i in sorted(items):
            window[i], offset[i] = w, at
            at += int(lengths[i])
    return window, offset, sum(map(bool, parts))


def cuts(total: int, capacity: int, grain: int) -> list[int]:
    """Lengths of a document's pieces: full windows, then grains, then the rest."""
    full, left = divmod(total, capacity)
    grains, rest = divmod(left, grain)
    return [capacity] * full + [grain] * grains + [rest] * bool(rest)


def pack(documents: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, grain: int = GRAIN, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The number of documents is counted first (Parquet tells it without reading texts), for the number of blocks.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    blocks = max(1, -(-documents.count() // block))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).ids
        end = np.asarray([end_id], np.uint32)
        seen: Counter = Counter()  # copies of one row are told apart, else one block would get all of them
        for part in tx.slices(batches, "text"):
            tokens, sums, copy = [], [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.concatenate([ids_of(text), end]).astype("<u4") if text else end.astype("<u4")
                at, crcs = 0, []
                for n in cuts(len(ids), capacity, grain):
                    crcs.append(zlib.crc32(ids[at : at + n].tobytes()))
                    at += n
                tokens.append(len(ids))
                sums.append(crcs)
                copy.append(seen[key := hash((doc, *crcs))])
                seen[key] += 1
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(copy, pa.int64())], ["doc_id", "doc_tokens", "sums", "copy"])

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("copy", "ascending")])
        number = table.column("block")[0].as_py()
        tokens = table.column("doc_tokens").to_numpy()
        sums = pa.concat_arrays([c.flatten() for c in table.column("sums").chunks])
        pieces = [cuts(int(n), capacity, grain) for n in tokens]
        owner = np.repeat(np.arange(len(tokens)), [len(p) for p in pieces])
        length = np.asarray([n for p in pieces for n in p], np.int64)
        ends = np.cumsum(length)
        start = ends - length - np.repeat(np.concatenate([[0], np.cumsum(tokens)[:-1]]), [len(p) for p in pieces])
        window, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        small = length < capacity
        used = 0
        if small.any():
            window[small], offset[small], used = pack_block(length[small], capacity)
        window[~small] = used + np.arange(int((~small).sum()))
        return pa.table({"doc_id": table.column("doc_id").take(pa.array(owner)), "start": start, "length": length, "ids_crc32": sums, "doc_tokens": tokens[owner], "sequence_id": (number << 31) + window, "offset": offset})

    encoded = rows.mapInArrow(encode, f"doc_id {kind}, doc_tokens long, sums array<long>, copy long")
    dealt = encoded.withColumn("block", F.pmod(F.xxhash64("doc_id", "sums", "copy"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(fill, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
