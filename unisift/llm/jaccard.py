"""Operator 5: n-gram Jaccard join with token-combination prefixes; classes of similar documents.

A document's tokens are its distinct shingles of `width` words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); with fewer words
the whole sequence is one token, without words there is none. Two documents link when 100 * intersection >=
percent * union. `similar_documents` returns, for every row, the class reached by links. It's exact: filters only leave
out pairs that can't link, and every link between different sets is found or its two ends are already joined.

1. Copies: documents with equal token sets are one node (a 64-bit digest of the set), whatever their number.
2. Frequent tokens: every token of every document is counted in hashed slots (2**24 counters for each of `ranges`
   hash ranges, so fixed memory at any size; tokens travel as 3 bytes). The slots with most documents, above
   `OFTEN` and at most `FREQUENT` of them, are the frequent token class.
3. Order: rare tokens by hash, then frequent ones by count and hash. Any fixed order is right; this one keeps
   frequent tokens out of prefixes where it can.
   Where the frequent class is cut at `FREQUENT`, tokens below it may still be in many documents: an entry of more than
   `ENTRY` rows is dealt into chunks, and each pair of chunks meets in a task of its own.
4. Prefix: with p = n - ceil(percent * n / 100) + 1, two documents that link share a token of their first p; extended
   by K - 1, prefixes share at least K. Rare tokens of extended prefixes (K about p / 2) are indexed singly; a pair
   is a candidate if it shares at least K less the frequent tokens that it may share besides.
5. Documents whose extended prefix has K frequent tokens or more may link by frequent tokens alone. Combinations
   of two frequent tokens of the prefix extended by one are indexed (single ones for very short and long sets,
   with overlapping bounds, so both forms cover each pair). Members of an entry are only linked to its least one.
6. Candidate classes: components of the candidate links. A class is dealt into chunks of about `CHUNK` sets, and
   every pair of chunks is one small task that compares sets (a product of 0/1 matrices, column block by column
   block) and returns a spanning forest of its links, never the pairs. No class is gathered in one task.
7. Components of the verified links, and the smallest id of each.

Joins on keys that may hold a large share of the rows (nodes, classes, frequent tokens) are `spread_join`s.

Nulls: a null text has no tokens and links with nothing; a null id is kept, and is a class's id only if it has no
other; repeated rows are copies; an empty table gives an empty result; texts are whole at any length. Extra columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components, forest
from .skew import spread_join
from .stage import written

#: Tokens in more documents than this are frequent, if they're among the FREQUENT most frequent slots.
OFTEN, FREQUENT = 32, 1 << 18
#: Rows in a chunk of a rare token's entry.
ENTRY = 1024
#: Sets in a chunk of a candidate class.
CHUNK = 96
#: Set sizes up to which frequent tokens are combined.
COMBINED = 300
#: Bytes of a batch of texts or token sets: 10,000 rows, Spark's bound, may be all texts of a task.
BATCH_BYTES = 4 << 20
_SLOT_BITS = 24
_FLUSH = 1 << 20


def _prefix(n, percent: int):
    """p and K of set sizes."""
    p = n - (-(-percent * n // 100)) + 1
    return p, np.minimum(1 + p // 2, np.maximum(1, n - p + 1))


def _new_sets(batches: Iterator[pa.RecordBatch], width: int, copies: bool = False) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, np.ndarray]]]]:
    """Digest and set of each row; without copies, of each set that this task hasn't had yet."""
    seen: set[int] = set()
    for part in tx.slices(batches, "text"):
        out = []
        for s in tx.shingle_sets(*tx.flat(part.column("text")), width):
            d = tx.set_digest(s)
            if copies:
                out.append((d, s))
            elif len(s) and d not in seen:
                seen.add(d)
                out.append((d, s))
        yield part, out


def _frequent(texts: DataFrame, width: int, ranges: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sorted slots of the frequent class and their counts, at most FREQUENT; whether these are all slots above OFTEN."""
    bits = ranges.bit_length() - 1
    shift = np.uint64(64 - bits - _SLOT_BITS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            slots = np.sort(np.concatenate(held) >> shift)
            edges = np.searchsorted(slots, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(_SLOT_BITS))
            packed = slots.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            own = np.flatnonzero(np.diff(edges))
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array([packed[edges[i] : edges[i + 1]].tobytes() for i in own], pa.binary())], ["range", "slots"])

        for _, sets in _new_sets(batches, width):
            held += [s for _, s in sets]
            size += sum(len(s) for _, s in sets)
            if size > _FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << _SLOT_BITS, np.uint32)
        for batch in batches:
            for blob in batch.column("slots"):
                packed = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, 3)
                slots = packed[:, 0].astype(np.uint32) | packed[:, 1].astype(np.uint32) << 8 | packed[:, 2].astype(np.uint32) << 16
                slots, n = np.unique(slots, return_counts=True)
                counts[slots] += n.astype(np.uint32)
        often = np.flatnonzero(counts > OFTEN)
        yield pa.RecordBatch.from_arrays([pa.array((key[0].as_py() << _SLOT_BITS) + often), pa.array(counts[often].astype(np.int64))], ["slot", "n"])

    dealt = texts.mapInArrow(deal, "range long, slots binary")
    slots = written(dealt.groupBy("range").applyInArrow(count, "slot long, n long"), "frequent", BATCH_BYTES)
    levels = {r["level"]: r["rows"] for r in slots.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    least, rows, whole = 64, 0, True
    for level in sorted(levels, reverse=True):
        rows += levels[level]
        if rows > FREQUENT:
            whole = False
            break
        least = level
    table = slots.where(F.col("n") >= F.lit(2.0) ** least).orderBy("slot").toPandas()  # at most FREQUENT rows
    return table["slot"].to_numpy(np.uint64), table["n"].to_numpy(np.int64), whole


def _index(texts: DataFrame, width: int, percent: int, slots: np.ndarray, counts: np.ndarray, ranges: int) -> DataFrame:
    """kind (0: rare token, 1: frequent tokens), token, node, n, f (frequent tokens in the extended prefix)."""
    shift = np.uint64(64 - (ranges.bit_length() - 1) - _SLOT_BITS)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _new_sets(batches, width):
            rows: list[tuple[int, np.ndarray, int, int, int]] = []
            for d, s in sets:
                n = len(s)
                p, k = (int(x) for x in _prefix(n, percent))
                if len(slots):
                    at = np.minimum(np.searchsorted(slots, s >> shift), len(slots) - 1)
                    common = slots[at] == s >> shift
                    rare, often = s[~common], s[common]
                    often = often[np.lexsort((often, counts[at[common]]))]
                else:
                    rare, often = s, s[:0]
                length = p + k - 1
                f = max(0, length - len(rare))
                rows.append((0, rare[:length], d, n, f))
                if f >= int(_prefix(np.int64(-(-percent * n // 100)), percent)[1]):
                    alone = often[: max(0, p - len(rare))]
                    pairs = often[: max(0, p + 1 - len(rare))]
                    if n < 20 or 100 * n >= percent * COMBINED:
                        rows.append((1, alone, d, n, f))
                    if 100 * n >= percent * 20 - 100 and n <= COMBINED and len(pairs) > 1:
                        i, j = np.triu_indices(len(pairs), 1)
                        rows.append((1, tx.mix(tx.mix(pairs[i]) * np.uint64(3) + pairs[j]), d, n, f))
            if rows:
                sizes = [len(r[1]) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.asarray([r[0] for r in rows], np.int8), sizes)),
                        pa.array(np.concatenate([r[1] for r in rows]).view(np.int64)),
                        *(pa.array(np.repeat(np.asarray([r[i] for r in rows], kind), sizes)) for i, kind in ((2, np.int64), (3, np.int32), (4, np.int32))),
                    ],
                    ["kind", "token", "node", "n", "f"],
                )

    return texts.mapInArrow(entries, "kind byte, token long, node long, n int, f int")


def _dealt(rare: DataFrame) -> DataFrame:
    """The rows with entries of more than ENTRY dealt into chunks: one entry for each pair of chunks, whose sides meet one another only."""
    sizes = rare.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > ENTRY)
    sizes = written(sizes.withColumn("chunks", F.ceil(F.col("rows") / ENTRY).cast("int")), "entries")
    sized = spread_join(rare, sizes, "token", "rows", sizes.agg(F.sum("rows")).first()[0] or 0, "left").fillna(1, "chunks")
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = F.when(F.col("chunk") == F.col("other"), 0).when(F.col("chunk") < F.col("other"), 1).otherwise(2)
    own = F.when(F.col("chunks") > 1, F.xxhash64("token", F.least("chunk", "other"), F.greatest("chunk", "other"))).otherwise(F.col("token"))
    return sized.select(own.alias("token"), "node", "n", "f", side.alias("side"))


def _rare_pairs(index: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Candidate links a, b of rare tokens; whole: none of them is in more than OFTEN sets."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = {c: np.zeros(0, np.int64) for c in ("token", "node", "n", "f", "side")}
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found, c = np.unique(np.concatenate(held), axis=0, return_counts=True)
            return pa.RecordBatch.from_arrays([*(pa.array(found[:, i]) for i in range(3)), pa.array(c)], ["a", "b", "need", "c"])

        def meet(rows: dict[str, np.ndarray]) -> None:
            """All pairs of equal tokens, by their distance in the sorted rows."""
            nonlocal size
            token, node, n, f, side = (rows[c] for c in ("token", "node", "n", "f", "side"))
            p, k = _prefix(n, percent)
            left = np.flatnonzero(token[1:] == token[:-1])
            step = 1
            while len(left):
                x, y = left, left + step
                fits = (node[x] != node[y]) & ((side[x] == 0) | (side[x] != side[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                x, y = x[fits], y[fits]
                if len(x):
                    need = np.maximum(1, np.minimum(k[x], k[y]) - np.minimum(f[x], f[y]))
                    held.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), need], 1))
                    size += len(x)
                step += 1
                left = left[left + step < len(token)]
                left = left[token[left + step] == token[left]]

        for batch in batches:
            rows = {c: np.concatenate([tail[c], batch.column(c).to_numpy().astype(np.int64)]) for c in tail}
            # the last token may go on in the next batch
            cut = int(np.searchsorted(rows["token"], rows["token"][-1])) if len(rows["token"]) else 0
            tail = {c: v[cut:] for c, v in rows.items()}
            meet(_once({c: v[:cut] for c, v in rows.items()}))
            if size > _FLUSH:
                yield flush()
                held, size = [], 0
        meet(_once(tail))
        if size:
            yield flush()

    rare = index.where("kind = 0").select("token", "node", "n", "f")
    rare = rare.withColumn("side", F.lit(0)) if whole else _dealt(rare)
    met = rare.repartition("token").sortWithinPartitions("token", "node").mapInArrow(pairs, "a long, b long, need long, c long")
    return met.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b")


def _once(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows sorted by token and node without the copies that several tasks have made."""
    token, node = rows["token"], rows["node"]
    if not len(token):
        return rows
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
    return {c: v[new] for c, v in rows.items()}


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs (one of left, one of right) that link."""
    size = np.asarray([len(s) for s in sets], np.int64)
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    tokens = tokens[counts > 1]
    common = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(tokens), 8192):
        some = tokens[begin : begin + 8192]
        rows = np.zeros((len(sets), len(some)), np.float32)
        for i, s in enumerate(sets):
            own = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], side="right")]
            at = np.searchsorted(some, own)
            rows[i, at[some[at] == own]] = 1
        common += rows[left] @ rows[right].T
    inter = common.astype(np.int64)
    x, y = np.nonzero(100 * inter >= percent * (size[left][:, None] + size[right][None, :] - inter))
    return left[x], right[y]


def _verified(texts: DataFrame, nodes: DataFrame, reps: DataFrame, width: int, percent: int) -> DataFrame:
    """Links a, b, a spanning forest of those within each candidate class."""
    sizes = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("rows")).withColumn("chunks", F.ceil(F.col("rows") / CHUNK).cast("int"))
    wanted = written(spread_join(nodes, sizes, "root", "rows", nodes.count()).join(reps.select("node", "least"), "node"), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _new_sets(batches, width):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["node", "tokens"])

    ids = wanted.select(F.col("least").alias("id")).distinct()
    own = texts.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text").mapInArrow(sets, "node long, tokens binary")
    placed = own.join(wanted.select("node", "root", "chunks"), "node")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    placed = placed.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "tokens")

    def compare(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        _, first = np.unique(node, return_index=True)
        table = table.take(pa.array(first))
        node, chunk = table.column("node").to_numpy(), table.column("chunk").to_numpy()
        rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x, y = _linked(rows, np.flatnonzero(chunk == i), np.flatnonzero(chunk == j), percent)
        a, b = forest(node[x], node[y]) if len(x) else (node[:0], node[:0])
        return pa.table({"a": a, "b": b})

    return placed.groupBy("root", "i", "j").applyInArrow(compare, "a long, b long")


def similar_documents(documents: DataFrame, percent: int = 80, width: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reached by links, its own included), node."""
    texts = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_hash"))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _new_sets(batches, width, copies=True):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for _, s in sets], pa.int64()), pa.array([d for d, _ in sets], pa.int64())], ["doc_id", "text_hash", "n_shingles", "node"])

    rows = written(texts.mapInArrow(features, f"doc_id {kind}, text_hash long, n_shingles long, node long"), "features", BATCH_BYTES)
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = 1 << min(12, max(4, (total >> 21).bit_length()))
    slots, counts, whole = _frequent(texts.select("text"), width, ranges)
    index = written(_index(texts.select("text"), width, percent, slots, counts, ranges), "index", BATCH_BYTES)

    often = index.where("kind = 1").select("token", "node")
    hubs = often.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("rows"))
    starred = spread_join(often, hubs, "token", "rows", often.count()).where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    candidates = components(_rare_pairs(index, percent, whole).unionByName(starred))

    nodes = candidates.unionByName(candidates.select(F.col("root").alias("node"), "root").distinct())
    worded = rows.where("n_shingles > 0")
    reps = written(worded.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times")), "sets")
    # stored, or each task that compares would hold a second Python worker, which shrinks its links, and executors keep both
    joined = components(written(_verified(texts, nodes, reps, width, percent), "verified", BATCH_BYTES))

    roots = written(reps.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", "times"), "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    classes = written(spread_join(roots, least, "root", "rows", roots.count()).select("node", F.col("root").alias("class"), "component_id", "times"), "classes")
    out = ["doc_id", "n_shingles", "component_id", "node", "text_hash", "class"]
    alone = rows.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "class": F.col("node")})
    return spread_join(worded, classes, "node", "times", worded.count()).select(out).unionByName(alone.select(out))


def one_of_each(documents: DataFrame, percent: int = 80, width: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, with all their columns, without all but one of each class of similar ones.

    The row of smallest id (null last), then text hash, stays; of repeated rows one. Documents without tokens all stay.
    """
    found = written(similar_documents(documents, percent, width, id_column, text_column), "classes")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    stay = found.where("n_shingles > 0").groupBy("class").agg(F.min(rank).alias("rank")).select("rank.doc_id", "rank.text_hash")
    times = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"), F.max("n_shingles").alias("n"))
    stay = times.where("n = 0").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.lit(1).alias("times")).unionByName(
        stay.join(times.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "times"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("id", "hash", "times").withColumn("times", F.col("times").cast("int"))
    )
    stay = written(stay, "stay")
    rows = documents.select(F.struct("*").alias("row"))
    here = F.col("row")[id_column].eqNullSafe(F.col("id")) & (F.xxhash64(F.col("row")[text_column]) == F.col("hash"))
    kept = rows.join(stay.where("times = 1").hint("shuffle_hash"), here, "left_semi")
    if stay.where("times > 1").take(1):
        again = rows.join(stay.where("times > 1").hint("shuffle_hash"), here, "left_semi")
        key = [F.col("row")[id_column], F.xxhash64(F.col("row")[text_column])]
        kept = kept.unionByName(again.groupBy(*key).agg(F.first("row").alias("row")).select("row"))
    return kept.select("row.*")
