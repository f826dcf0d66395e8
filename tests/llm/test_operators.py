"""Each operator against SQL or a brute-force version, on tables with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, empty, same
from pyspark.sql import functions as F

from unisift.llm import chat, jaccard, lines, mixing, packing, quality, search, skew, stage, substrings, tokens, units
from unisift.llm import components as components_of
from unisift.llm import text as tx
from unisift.llm.components import components
from unisift.llm.queries import MIX_WEIGHTS, tokenizer_path

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(text):
    return library().encode(text, add_special_tokens=False).ids


def test_token_counts(docs, rows):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, tokenizer_path(), 100).collect())
    whole = library()
    n = [len(e.ids) for e in whole.encode_batch([t for _, t in rows], add_special_tokens=False)]
    assert got == sorted((i is None, i or 0, len(t.encode()), k, k > 100) for (i, t), k in zip(rows, n, strict=True))
    assert tokens.count_tokens(empty(docs), tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> a<|endoftext|>b", "x" * 5000, " " * 5000, "a  b \n\n c\t\td ", "don't WE'LL 'S", chr(0x4E00) * 50 + " " + chr(0x1F600), "1234 5", chr(0x85) + chr(0xA0) + "z" + chr(0x180E), ""])
def test_tokenizer_paths_agree(text, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_BYTES", 7)
    encode = tokens.Encoder(tokenizer_path())
    assert encode.ids(text).tolist() == ids_of(text) and encode.lengths([text]) == [len(ids_of(text))]


def test_packing(docs, rows):
    """Every id lies in exactly one piece, with its document's check sum; windows are full, gapless and not over capacity."""
    pieces = packing.pack(docs, tokenizer_path(), capacity=256, grain=64, block=16).collect()
    streams = collections.Counter((i, tuple([*ids_of(t), 0])) for i, t in rows)
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 256
    total = sum(len(ids) * n for (_, ids), n in streams.items())
    assert sum(p.length for p in pieces) == total and total / (256 * len(by)) > 0.8
    assert set(p.doc_id for p in pieces) == {i for i, _ in streams}
    left = collections.Counter((p.doc_id, p.doc_tokens, p.start, p.length, p.ids_crc32) for p in pieces)
    for (i, ids), times in streams.items():
        data = np.asarray(ids, "<u4")
        for _ in range(times):
            at = 0
            while at < len(ids):  # a piece that begins here and is of this document; repeated and null ids have several
                fit = next(k for k, n in left.items() if n and k[:3] == (i, len(ids), at) and zlib.crc32(data[at : at + k[3]].tobytes()) == k[4])
                left[fit] -= 1
                at += fit[3]
            assert at == len(ids)
    assert not +left
    assert packing.pack(empty(docs), tokenizer_path()).count() == 0


def test_differencing():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 65, 400)
    window, offset, n = packing.pack_block(lengths, 256)
    loads = np.bincount(window, weights=lengths)
    assert loads.max() <= 256 and n == len(loads) <= -(-lengths.sum() // 256) + 2
    assert loads.max() - loads.min() < 64


def test_mixing(docs):
    weights = {"src0": 0.5, "src1": 3.0, "*": 0.5}
    n = same(mixing.mix(docs, weights, seed=3, size=F.col("n_chars")).select("doc_id", "source", "mix_copy", "mix_key"), mixing.mix_sql(weights, 3, "n_chars", "doc_id, source"), documents=docs)
    assert n > 20
    many = mixing.mix(docs, {"src1": 1.0}, seed=3, target=5000)
    assert {r.source for r in many.select("source").distinct().collect()} == {"src1"} and abs(many.count() - 5000) < 400
    assert mixing.mix(empty(docs), MIX_WEIGHTS).count() == 0


@pytest.mark.parametrize("wide, steps, piece", [(1 << 18, (200, 48, 1), 1 << 20), (300, (200, 48, 1), 1 << 20), (300, (20, 7, 1), 500)])
def test_repeated_bytes(docs, rows, monkeypatch, wide, steps, piece):
    monkeypatch.setattr(substrings, "WIDE", wide)
    monkeypatch.setattr(substrings, "STEPS", steps)
    monkeypatch.setattr(tx, "SLICE_BYTES", piece)
    seen = collections.Counter(t.encode()[k : k + 64] for _, t in rows for k in range(len(t.encode()) - 63))
    want = []
    for i, t in rows:
        b = t.encode()
        mark = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 63):
            if seen[b[k : k + 64]] > 1:
                mark[k] += 1
                mark[k + 64] -= 1
        gone = np.cumsum(mark)[: len(b)] > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    key = lambda r: (r[0] is None, str(r))
    found = substrings.repeated_bytes(docs, 64)
    assert sorted((tuple(r)[:5] for r in found.collect()), key=key) == sorted(want, key=key)
    assert all(r.n_kept == r.n_bytes - r.n_removed and r.n_spans == len(r.spans) and r.n_removed == sum(s.end - s.begin for s in r.spans) for r in found.collect())


def test_repeated_bytes_at_full_length(spark):
    """The query's length on a driver's table, against counting every window."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").encode() for r in table.collect()}
    seen = collections.Counter(hash(t[k : k + 400]) for t in texts.values() for k in range(len(t) - 399))
    found = {r.doc_id: r for r in substrings.repeated_bytes(table, 400, texts=True).collect()}
    assert found.keys() == texts.keys() and any(r.n_removed for r in found.values())
    for i, t in texts.items():
        mark = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                mark[k] += 1
                mark[k + 400] -= 1
        gone = np.cumsum(mark)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert bytes(found[i].kept) == kept and found[i].kept_sha256 == hashlib.sha256(kept).hexdigest() and found[i].n_removed == gone.sum()


def test_repeated_bytes_of_nothing(docs):
    assert substrings.repeated_bytes(empty(docs)).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(2)
    pieces = [rng.integers(97, 100, rng.integers(1, 60)).astype(np.uint8) for _ in range(30)]
    best, begins, runs = substrings.matching_statistics(pieces)
    flat = [bytes(p) for p in pieces]
    for i, p in enumerate(flat):
        for k in range(len(p)):
            n = 0
            while k + n < len(p) and any(p[k : k + n + 1] == q[j : j + n + 1] and len(q) - j > n for x, q in enumerate(flat) for j in range(len(q)) if (x, j) != (i, k)):
                n += 1
            assert best[begins[i] + k] == n
    assert runs <= len(best)


@pytest.mark.parametrize("percent, width, often, chunk, frequent, entry, share", [(90, 3, 32, 96, 1 << 18, 1024, 1024), (80, 5, 32, 96, 1 << 18, 1024, 1024), (60, 2, 1, 2, 1 << 18, 1024, 4), (60, 2, 1, 2, 8, 2, 64)])
def test_similar_documents(docs, rows, monkeypatch, percent, width, often, chunk, frequent, entry, share):
    """The last cases cut the class of frequent tokens, deal the entries of others into chunks, and have both hot and other keys."""
    monkeypatch.setattr(jaccard, "OFTEN", often)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "ENTRY", entry)
    monkeypatch.setattr(skew, "SHARE", share)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    sets = []
    for _, t in rows:
        w = WORD.findall(t.translate(LOWER))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted(((d is None, d or 0), len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))
    got = jaccard.similar_documents(docs, percent, width)
    key = lambda r: (r[0], r[1], str(r[2]))
    assert sorted((((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in got.collect()), key=key) == sorted(want, key=key)
    left = jaccard.one_of_each(docs, percent, width)
    assert left.columns == docs.columns and left.count() == len({find(i) for i, s in enumerate(sets) if s}) + sum(not s for s in sets)


def test_similar_documents_of_nothing(docs):
    assert jaccard.similar_documents(empty(docs)).count() == 0 and jaccard.one_of_each(empty(docs)).count() == 0


def test_similar_documents_take_one_python_worker_a_task(docs, monkeypatch):
    plans = []

    def recorded(df, name, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage.written(df, name, *more)

    monkeypatch.setattr(jaccard, "written", recorded)
    monkeypatch.setattr(components_of, "written", recorded)
    jaccard.one_of_each(docs, 60, 2).count()
    assert any("FlatMapGroupsInArrow" in p for p in plans) and any("MapInArrow" in p for p in plans)
    for plan in plans:
        above = []
        for line in plan.splitlines():
            depth = re.search(r"\w", line + "x").start()
            above = [x for x in above if x[0] < depth]
            own = "python" if "InArrow" in line else "exchange" if "Exchange" in line else ""
            near = next((x[1] for x in reversed(above) if x[1]), "")
            assert (own, near) != ("python", "python"), plan
            above.append((depth, own))


def test_written_bounds_batches_by_bytes(spark):
    def rows_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 128).alias("text"))
    found = stage.written(texts.mapInArrow(rows_of, "n long"), "sizes", 1 << 18)
    assert found.agg(F.sum("n"), F.max("n") < 300).first() == (2000, True)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b"
    stage.discard(found)


def test_spread_join(spark):
    rows = spark.createDataFrame([(1, i) for i in range(40)] + [(None, 0), (2, 1), (3, 1)], "k int, x int")
    table = spark.createDataFrame([(1, "a", 40), (2, "b", 1)], "k int, y string, times int")
    for total in (41, 1 << 20):
        got = [tuple(r) for r in skew.spread_join(rows, table, "k", "times", total, "left").collect()]
        assert collections.Counter(got) == collections.Counter([(1, i, "a") for i in range(40)] + [(None, 0, None), (2, 1, "b"), (3, 1, None)])
        assert skew.spread_join(rows, table, "k", "times", total).count() == skew.spread_join(rows, table, "k", "times", total, plain=total).count() == 41


@pytest.mark.parametrize("share", [2, 1024])
def test_components(spark, monkeypatch, share):
    monkeypatch.setattr(skew, "SHARE", share)
    monkeypatch.setattr(skew, "PLAIN", 0 if share == 2 else 1 << 20)
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101), (7, 7)], "a long, b long").repartition(5)
    found = {r.node: r.root for r in components(chain).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


def test_units(docs):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).cache()  # the SQL tells rows by id
    assert same(units.repeated_units(unique), units.repeated_units_sql(5), documents=unique) > 5
    kinds = ("line", "paragraph", "sentence")
    assert same(units.repeated_units(unique, kinds, dict.fromkeys(kinds, 5)), units.repeated_units_sql(5, kinds), documents=unique) > 10


@pytest.mark.parametrize("kind", ["long", "string"])
def test_dedup_units(spark, kind):
    """All awkward rows: null and repeated ids with other texts, repeated rows, string ids."""
    more = [(7, "Nobody else has written this sentence. Again and again it is. end"), (None, "A row without id has this. Another of its own sentences here."), (7, None)]
    table = awkward(spark, kind=kind).select("doc_id", "text", "kept").unionByName(spark.createDataFrame(more, "doc_id long, text string").select(F.col("doc_id").cast(kind), "text", F.lit("k").alias("kept"))).cache()
    rows = [(r.doc_id, r.text or "", r.hash) for r in table.select("doc_id", "text", F.xxhash64("text").alias("hash")).collect()]
    first, found = {}, []
    for i, t, h in rows:
        for m in re.finditer(r"[^\n.!?]+[.!?]*", t):
            normal = re.sub("[\x20\x09-\x0D]+", " ", m[0].translate(LOWER)).strip("\x20\x09\x0a\x0b\x0c\x0d.!?")
            if normal.count(" ") >= 4:
                rank = (i is None, i or 0 if kind == "long" else i or "", h, m.start())
                first[normal] = min(first.get(normal, rank), rank)
                found.append((i, h, m.span(), normal, rank))
    want = []
    for i, t, h in rows:
        for a, b in sorted({span for j, g, span, normal, rank in found if (j, g) == (i, h) and rank > first[normal]}, reverse=True):
            t = t[:a] + t[b:]
        want.append((str(i), t))
    got = units.dedup_units(table)
    assert got.columns == table.columns and sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted(want)


def test_units_of_nothing(docs):
    for unit in ("line", "paragraph"):
        assert units.repeated_units(docs, unit).count() > 0
    assert units.repeated_units(empty(docs)).count() == 0


def test_units_of_several_kinds(spark, docs):
    table = docs.where("doc_id < 60").dropDuplicates(["doc_id"]).select("doc_id", "text")
    more = [(100, "Nt onor. The of it.\nfirst here\n\nx y\nz"), (101, "a. b.\nNt onor. The of it!\n...\n\nX y\nz.\n\n..."), (102, "The of it.\nfirst  HERE\nsome more. one two three four five. q"), (103, "y. one two three four five! end")]
    table = table.unionByName(spark.createDataFrame(more, "doc_id long, text string")).cache()
    kinds = {"line": (r"[^\n]+", 1), "paragraph": (r"[^\n]+(?:\n[^\n]+)*", 1), "sentence": (r"[^\n.!?]+[.!?]*", 5)}
    want, spans, seen = {}, set(), set()
    for r in sorted(table.collect(), key=lambda r: r.doc_id):
        drop = set()
        for kind, (pattern, least) in kinds.items():
            for m in re.finditer(pattern, r.text or ""):
                normal = " ".join(WORD.findall(m[0].translate(LOWER))).strip(" .!?")
                if normal and normal.count(" ") + 1 >= least:
                    if (kind, normal) in seen:
                        spans.add((r.doc_id, kind, m.start(), m.end() - m.start()))
                        drop.update(range(m.start(), m.end()))
                    seen.add((kind, normal))
        want[r.doc_id] = r.text and "".join(c for k, c in enumerate(r.text) if k not in drop)
    assert {(r.doc_id, r.unit, r.start, r.length) for r in units.repeated_units(table, tuple(kinds)).collect()} == spans
    assert {r.doc_id: r.text for r in units.dedup_units(table, tuple(kinds)).collect()} == want
    assert want[101] == "a. b.\n\n...\n\n\n\n..." and want[103] == "y. end"


def test_quality(docs, rows):
    found = quality.judge(docs)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found.collect())
    want = []
    for i, t in rows:
        w = WORD.findall(t)
        shingles = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = set()
        for k in range(len(w) - 7):
            if shingles[tuple(w[k : k + 8])] > 1:
                cover.update(range(k, k + 8))
        own = [x for x in t.split("\n") if WORD.search(x)]
        want.append(((i is None, i or 0), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)))
    assert got == sorted(want)
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == found.where("kept").count()
    assert found.where("kept and base_failed").count() == 0 and quality.judge(empty(docs)).count() == 0


def plain_verdicts(rows, least, class_limit=0.17, class_noise=1.5, word_limit=0.115, word_noise=3.0):
    """(class distance, word distance, kept) of rows (lang, text), by counting words as text."""
    kind = lambda b: 6 if b > 127 else 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in b" \t\n\x0b\x0c\r" else 4 if b in b".,;:!?'\"()-" else 5
    parts = [(lang, collections.Counter(map(kind, t.encode())), collections.Counter(WORD.findall(t.translate(LOWER))), t) for lang, t in rows]
    references = {}
    for lang in {x[0] for x in parts}:
        classes = sum((x[1] for x in parts if x[0] == lang), collections.Counter())
        words = sum((x[2] for x in parts if x[0] == lang), collections.Counter())
        if words.total() >= least:
            order = sorted(words, key=lambda w: (-words[w], int(tx.words(np.frombuffer(w.encode(), np.uint8))[2].view(np.int64)[0])))
            references[lang] = classes, words, order[:64]

    def distance(p, q):
        p, q = [x / max(1, sum(p)) for x in p], [x / max(1, sum(q)) for x in q]
        half = lambda a, b: sum(x * np.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
        return max(0.0, (half(p, q) + half(q, p)) / 2) ** 0.5

    def far(classes, words, ref):
        common = lambda c: [c[w] for w in ref[2]] + [c.total() - sum(c[w] for w in ref[2])]
        return distance([classes[k] for k in range(7)], [ref[0][k] for k in range(7)]), distance(common(words), common(ref[1]))

    out = []
    for lang, classes, words, t in parts:
        near = [far(classes, words, r) for x, r in references.items() if lang is None or x == lang]
        one, two = min(near, key=sum) if near else (None, None)
        size, n = len(t.encode()), words.total()
        own = WORD.findall(t)
        windows = collections.Counter(tuple(own[k : k + 8]) for k in range(n - 7))
        cover = {j for k in range(n - 7) if windows[tuple(own[k : k + 8])] > 1 for j in range(k, k + 8)}
        one, two = one if size >= 100 else None, two if n >= 20 else None
        bad = n < 20 or 100 * len(cover) > 30 * n or (one is not None and one > class_limit + class_noise / size**0.5) or (two is not None and two > word_limit + word_noise / n**0.5)
        out.append((one, two, not bad))
    return out


@pytest.mark.parametrize("kind, sent", [("long", 256), ("string", 1)])
def test_quality_verdicts(spark, monkeypatch, kind, sent):
    """Both distances and the verdict against plain Python; junk and thin languages among the rows."""
    monkeypatch.setattr(quality, "LEAST_WORDS", 300)
    monkeypatch.setattr(quality, "LANGUAGES", sent)
    table = awkward(spark, 80, 3, kind)
    junk = [(None, " ".join(f"{j}#" for j in range(60)), x) for x in ("en", "de", None, "thin")] + [(None, " ".join("the of"[k % 3 :] for k in range(60)), "en")]
    table = table.unionByName(spark.createDataFrame(junk, f"doc_id {kind}, text string, lang string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.lang, r.text or "") for r in table.collect()]
    show = lambda i, x, y, kept: (str(i), "-" if x is None else f"{x:.6f}", "-" if y is None else f"{y:.6f}", kept)
    want = sorted(show(i, *v) for (i, _, _), v in zip(rows, plain_verdicts([r[1:] for r in rows], 300), strict=True))
    assert sorted(show(r.doc_id, r.class_distance, r.word_distance, r.kept) for r in quality.judge(table).collect()) == want
    assert {x[3] for x in want} == {True, False}


def test_quality_rejects_other_distributions(spark):
    clean = [(i, " ".join(f"the w{(i * 7 + j) % 50} of a{j % 9}" for j in range(60)), "en") for i in range(60)]
    junk = [(100, " ".join("#$%&" for _ in range(30)) + " " + " ".join(f"{j}" for j in range(90)), "en"), (101, " ".join(f"ZZ{j}!!" for j in range(120)), "en")]
    found = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert all(found[i] for i in range(60)) and not found[100] and not found[101]


@pytest.mark.parametrize("sent", [256, 2])
def test_quality_has_a_reference_for_every_language(spark, monkeypatch, sent):
    say = lambda lang, i, n: " ".join(f"{lang}{(i * 7 + j) % 40}" + ("," if j % 9 == 0 else "") for j in range(n))
    rows = [(100 * k + i, say("pqrst"[k], i, 90), "pqrst"[k]) for k in range(5) for i in range(40 - k)]
    junk = [(900 + k, " ".join(f"{j}#" for j in range(90)), x) for k, x in enumerate([*"pqrst", None])]
    bare = [(1000 + k, say("pqrst"[k], 3, 90), None) for k in range(5)]  # each language's words, but no language
    thin = [(2000 + i, say("z", i, 60), "thin") for i in range(3)]
    table = spark.createDataFrame(rows + junk + bare + thin, "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr(quality, "LANGUAGES", sent)
    found = {r.doc_id: r for r in quality.judge(table).collect()}
    assert len(found) == table.count()
    assert all(found[r[0]].kept for r in rows + bare + thin) and not any(found[r[0]].kept for r in junk)
    assert all(found[r[0]].word_distance is None and found[r[0]].class_distance is None for r in thin)
    assert sorted(r.doc_id for r in quality.keep_documents(table).collect()) == sorted(r[0] for r in rows + bare + thin)


def test_quality_of_null_texts(docs):
    nothing = docs.withColumn("text", F.lit(None).cast("string"))
    assert quality.judge(nothing).where("base_failed and not kept").count() == docs.count() and quality.keep_documents(nothing).count() == 0
    assert quality.judge(docs.withColumn("lang", F.lit(None).cast("string"))).count() == docs.count()


def test_divergence():
    p = np.array([[1.0, 0.0], [0.5, 0.5]])
    assert quality.distance(p, np.array([0.0, 1.0]))[0] == 1 and quality.distance(p, np.array([0.5, 0.5]))[1] == 0


def test_linking_turns(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "a question that is long enough"), (1, 2, "assistant", 'an "answer"\n'), (1, 3, "user", "short"), (2, 0, "assistant", "no call"), (None, 1, "user", "x" * 30), (5, 2, "user", "z" * 30), (5, 4, "user", "z" * 30), (5, 6, "user", "z" * 30), (5, 4, "user", "again " * 9), (5, 10, "user", "z" * 30), (3, 0, "user", None), (3, 1, "assistant", None), (4, 0, "user", "y" * 30), (4, 1, "assistant", "b"), (4, 1, "assistant", "a")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = chat.link_calls(*chat.turns_as_calls(table), {"reply": chat.REPLY_SCHEMA})
    same(found, chat.linked_turns_sql(), conversations=table)
    assert sorted(r.wave for r in found.where("conv_id = 5").collect()) == [0, 0, 1, 1, 2]
    assert found.where("call_id is null").select("status").first()[0] == "missing_result"
    assert chat.link_calls(*chat.turns_as_calls(empty(table)), {}).count() == 0


@pytest.mark.parametrize("most", [2, 1 << 18])
def test_linking_order_of_any_length(spark, monkeypatch, most):
    """Random dependencies, backward, forward, cyclic and into other conversations, against peeling in plain Python."""
    monkeypatch.setattr(chat, "LONG", most)
    rng = np.random.default_rng(5)
    calls = [(c, t, f"{c}:{t}", "f", "{}", [f"{c if rng.random() < 0.9 else c + 1}:{k}" for k in rng.integers(0, 9, rng.integers(0, 2))]) for c in range(12) for t in range(8)]
    made = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    known = {r[2]: {x for x in r[5] if x.split(":")[0] == str(r[0]) and int(x.split(":")[1]) < 8} for r in calls}
    want: dict = {}
    while ready := [c for c in known if c not in want and known[c] <= set(want)]:
        want |= {c: max((want[x] + 1 for x in known[c]), default=0) for c in ready}
    found = chat.link_calls(made, spark.createDataFrame([], "conv_id long, turn long, call_id string, content string"), {})
    assert {r.call_id: r.wave for r in found.collect()} == {c: want.get(c) for c in known} and max(want.values()) > 1 and len(want) < len(known)


def test_linking_order_and_schemas(spark):
    schema = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer", "minimum": 1, "maximum": 3}, "tags": {"type": "array", "items": {"enum": ["a"]}}}}
    calls = [(1, 5, "c", "f", '{"n": 1}', []), (1, 1, "a", "f", '{"tags": ["a", "b"], "n": 4}', ["b"]), (1, 2, "b", "f", "{", ["c", "nowhere"]), (2, 1, "x", "g", "{}", ["y"]), (2, 2, "y", "f", '{"n": true, "m": 1}', ["x"]), (3, 1, "z", "f", '{"n": 2}', ["z0"]), (3, 0, "z0", "f", '{"n": "2"}', None)]
    made = spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, 6, "c", "done"), (1, 3, "c", "first"), (9, 9, "orphan", "o")], "conv_id long, turn long, call_id string, content string")
    found = {r.call_id: r for r in chat.link_calls(made, results, {"f": schema}).collect()}
    assert [found[x].wave for x in "cba"] == [0, 1, 2] and found["x"].status == "missing_result" and found["x"].wave is None
    assert found["c"].json == '{"arguments":{"n":1},"id":"c","name":"f","result":"first"}' and found["c"].valid and found["c"].n_results == 2
    assert found["a"].errors == ["$.n: too large", "$.tags[1]: not one of the values"] and found["b"].errors == ["arguments: not JSON"]
    assert found["y"].errors == ["$.m: unknown", "$.n: not integer"] and found["x"].errors == ["name: no schema"] and found["orphan"].status == "missing_call"
    odd = spark.createDataFrame([(1, i, str(i), "f", x, None) for i, x in enumerate(['{"n": NaN}', "[1e400]", "-Infinity", "[" * 100000, "[1]"])], made.schema)
    odd = {r.call_id: r for r in chat.link_calls(odd, results, {"f": schema}).collect()}
    assert [odd[str(i)].errors for i in range(5)] == [["arguments: not JSON"]] * 4 + [["$: not object"]] and '"arguments":"[1e400]"' in odd["1"].json
    assert (found["z"].wave, found["z0"].wave) == (1, 0) and found["z0"].errors == ["$.n: not integer"]


@pytest.mark.parametrize("schema", [{"pattern": "a"}, {"type": "object", "properties": {"n": {"exclusiveMinimum": 1}}}, {"items": {"anyOf": []}}, {"additionalProperties": {"type": "string"}}])
def test_linking_refuses_unknown_keywords(schema):
    with pytest.raises(ValueError, match="not supported"):
        chat.link_calls(None, None, {"f": schema})


def plain_line_dedup(rows, percent=80, width=5):
    """Texts by (id, text) of rows without the lines that match one of smaller rank: (id is null, id), text hash, line."""
    placed = []
    for i, text, text_hash in rows:
        for k, line in enumerate((text or "").split("\n")):
            w = [x for x in re.split("[\x20\x09\x0b-\x0d]+", line.lower()) if x]
            own = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
            placed.append(((i is None, str(type(i)), i or 0, text_hash, k), own))
    gone = set()
    for rank, own in placed:
        if own and any(x < rank and 100 * len(own & y) >= percent * len(own | y) for x, y in placed if y):
            gone.add(rank)
    return sorted(((i is None, str(i)), text and "\n".join(x for k, x in enumerate(text.split("\n")) if (i is None, str(type(i)), i or 0, h, k) not in gone) or "") for i, text, h in rows)


@pytest.mark.parametrize("kind, often", [("long", 32), ("string", 32), ("long", 1)])
def test_line_dedup(spark, monkeypatch, kind, often):
    """All awkward rows: null and repeated ids with other texts, repeated rows, string ids, short and empty lines."""
    monkeypatch.setattr(lines, "OFTEN", often)
    more = [(100, "And ornd.\n\n  \nOf, edti oner.\nAnd ornd."), (101, " and  ORND.\nof,\na b c d e\na b c d"), (102, "And ornd\nOf, edti oner.\na b c d\nOF,\n\na b c d e"), (7, "unrelated words that nobody else has\nAnd ornd."), (None, "And ornd.\nanother row without an id")]
    more += [(200 + i, " ".join(f"w{j}" if j != i % 3 else f"v{i}" for j in range(60))) for i in range(40)] + [(300, "\tW0  W1 w2 w3 w4\x0bw5 w6\r"), (301, "w0 w1 w2 w3 w4 w5 w6")]
    table = awkward(spark, kind=kind).select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))).cache()
    found = lines.dedup_lines(table, 80, 5)
    assert found.columns == table.columns
    want = plain_line_dedup([tuple(r) for r in table.select("doc_id", "text", F.xxhash64("text")).collect()])
    assert sorted(((r.doc_id is None, str(r.doc_id)), r.text or "") for r in found.collect()) == want
    assert found.where("text is null").count() == table.where("text is null").count()
    assert lines.dedup_lines(empty(table)).count() == 0


def test_line_prefixes(spark):
    """A prefix is the least tokens of the line, no more than needed, and no fewer where words or shingles repeat."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcde") for _ in range(n)) for n in range(5, 60)] + ["a a a a a a a a b c", "a b c d e " * 9, "a b c d", "A\tb  c d e f"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lines._lines(table, 80, 5, "doc_id", "text").select("doc_id", "prefix").collect()
    every = lines._numbers("hashes", F.sequence(F.lit(0), F.size("hashes") - 5), 5)
    hashed = table.where("doc_id != 57").select("doc_id", F.explode(F.array(lines._hashes(lines._words(F.translate("text", "A\t", "a "))))).alias("hashes"))
    want = {r.doc_id: sorted(r.every) for r in hashed.select("doc_id", every.alias("every")).collect()}
    assert len(found) == len(texts)
    for r in found:
        n = len(texts[r.doc_id].split()) - 4
        assert r.prefix == (want[r.doc_id][: n - -(-80 * n // 100) + 1] if n > 0 else None)


@pytest.mark.parametrize("percent, often", [(80, 1), (80, 32), (60, 2)])
def test_line_dedup_of_variants(spark, monkeypatch, percent, often):
    """Lines that gain, lose and repeat words, of few and of many different ones, around every bound of a prefix."""
    monkeypatch.setattr(lines, "OFTEN", often)
    rng = random.Random(percent + often)
    rows = []
    for i in range(60):
        own = [rng.choice(["x", "y", "z"] if i % 3 == 0 else [f"w{k}" for k in range(300)]) for _ in range(rng.randrange(5, 40))]
        for _ in range(rng.randrange(1, 5)):
            at, more = rng.randrange(len(own)), rng.randrange(-3, 4)
            rows.append((len(rows), " ".join(own[: len(own) + more] if more < 0 else own + own[at : at + more] if i % 2 else [f"v{rng.random()}"] * more + own)))
    table = spark.createDataFrame(rows, "doc_id long, text string").cache()
    want = plain_line_dedup([tuple(r) for r in table.select("doc_id", "text", F.xxhash64("text")).collect()], percent)
    assert sorted(((False, str(r.doc_id)), r.text or "") for r in lines.dedup_lines(table, percent, 5).collect()) == want
    assert sum(not text for _, text in want) > 20


def test_line_dedup_sql(spark, docs):
    unique = docs.where("doc_id < 60").dropDuplicates(["doc_id"])  # the SQL joins by id
    found = lines.dedup_lines(unique, 80, 5)
    assert found.columns == unique.columns
    same(found.select("doc_id", "text"), lines.line_dedup_sql(80, 5), documents=unique)


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_search(spark, docs, monkeypatch, kind):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "SHARD", 4000)
    asked = unique.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "text")
    own = {"long": F.col, "string": lambda c: F.lpad(F.col(c).cast("string"), 4, "0"), "date": lambda c: F.date_add(F.lit("2000-01-01").cast("date"), F.col(c).cast("int"))}[kind]
    back = {"long": F.col, "string": lambda c: F.col(c).cast("long"), "date": lambda c: F.datediff(F.col(c), F.lit("2000-01-01").cast("date")).cast("long")}[kind]
    found = search.search(unique.withColumn("doc_id", own("doc_id")), asked.withColumn("query_id", own("query_id")), k=3)
    assert same(found.withColumn("doc_id", back("doc_id")).withColumn("query_id", back("query_id")), search.search_sql(3, 5), documents=unique) > 10
    if kind == "long":
        monkeypatch.setattr(search, "GROUP", 150)
        assert same(search.search(unique, asked, k=3), search.search_sql(3, 5), documents=unique) > 10
        assert search.search(docs, asked, k=3).count() > 10
        assert search.search(empty(docs), empty(asked)).count() == 0 and search.search(docs, empty(asked)).count() == 0
        assert search.search(docs.withColumn("text", F.lit(None).cast("string")), asked).count() == 0


def test_search_reads_fewer_postings():
    """With the k-th score known, the best documents are found exactly, from a part of the postings."""
    rng = np.random.default_rng(4)
    lists = [np.unique(np.minimum(rng.zipf(1.3, 120), 3000)).astype(np.uint64) for _ in range(600)]
    owner, terms = np.repeat(np.arange(600), [len(x) for x in lists]).astype(np.int32), np.concatenate(lists)
    tf = rng.integers(1, 4, len(terms)).astype(np.int32)
    index, row = search.Index.of(owner, terms, tf, np.asarray([len(x) for x in lists]))
    words, df = np.unique(terms, return_counts=True)
    again = search.Index.loaded(index.stored())
    again.prepare(40.0, words, np.log(1 + (600 - df + 0.5) / (df + 0.5)))
    whole = pruned = 0
    for q in range(0, 600, 20):
        asked = np.searchsorted(words, lists[q])
        full = np.zeros(600)
        for t in asked:
            at = slice(again.bounds[t], again.bounds[t + 1])
            full[again.doc[at]] += again.impact[at]
            whole += again.bounds[t + 1] - again.bounds[t]
        least = int(np.sort(full)[-5])
        again.read = 0
        found, scores = again.search(asked, least)
        pruned += again.read
        assert found.tolist() == np.flatnonzero(full >= least).tolist() and (scores == full[found]).all()
    assert pruned < whole / 2 and again.looked < 600 * whole / 20 and sorted(row.tolist()) == list(range(600))


@pytest.mark.parametrize("dense, near, scores", [(1 << 40, 1 << 16, 1 << 20), (40, 1 << 16, 1 << 20), (0, 1 << 16, 1 << 20), (40, 700, 1500)])
def test_search_of_batches(monkeypatch, dense, near, scores):
    """Queries in batches, by products or by pivots, give the k best documents exactly, equal scores and close ones among them."""
    for name, value in {"DENSE": dense, "NEAR": near, "SCORES": scores, "BLOCK": 16}.items():
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(5)
    lists = [np.unique(np.minimum(rng.zipf(1.2, rng.integers(0, 150)), 2000)).astype(np.uint64) for _ in range(400)]
    lists += lists[:40]  # equal scores
    owner, terms = np.repeat(np.arange(440), [len(x) for x in lists]).astype(np.int32), np.concatenate(lists)
    tf = rng.integers(1, 4, len(terms)).astype(np.int32)
    tf[len(terms) - sum(map(len, lists[:40])) :] = tf[: sum(map(len, lists[:40]))]
    index, row = search.Index.of(owner, terms, tf, np.asarray([len(x) for x in lists]))
    words, df = np.unique(terms, return_counts=True)
    index.prepare(50.0, words, np.log(1 + (440 - df + 0.5) / (df + 0.5)))
    full = np.zeros((440, 440))
    for q, asked in enumerate(lists):
        for t in np.searchsorted(words, asked):
            at = slice(index.bounds[t], index.bounds[t + 1])
            full[q, index.doc[at]] += index.impact[at]
    starts, places = np.append(0, np.cumsum([len(x) for x in lists])), np.searchsorted(words, terms)
    for floor in (1, 30_000_000):
        least = np.full(440, floor, np.int64)
        found = [x for part in index.best(np.arange(440), starts, places, least, row, 7) for x in zip(*(y.tolist() for y in part), strict=True)]
        want = [(q, d, full[q, d]) for q in range(440) for d in np.lexsort((row, -full[q]))[:7].tolist() if full[q, d] >= floor]
        assert sorted(found) == sorted(want) and len(want) > 500
        assert all(least[q] == max(floor, np.sort(full[q])[-7]) for q in range(440))


def test_search_deals_like_documents_together(spark):
    """Documents of several languages that come mixed are held by shards of one language each."""
    common = [[f"{x}{i}" for i in range(40)] for x in "abc"]
    rng = np.random.default_rng(6)
    texts = [(i, " ".join([*rng.choice(common[i % 3], 30), f"own{i}"])) for i in range(600)]
    shards = search._shards(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)).collect()
    assert len(shards) >= 3 and sorted(i for s in shards for i in s.ids) == list(range(600))
    assert all(len({i % 3 for i in s.ids}) == 1 for s in shards)
