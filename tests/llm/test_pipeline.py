"""The pipeline against plain Python, stage by stage, and its contract."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
from helpers import awkward

import corpus_pipeline
from unisift.llm import mixing, quality
from unisift.llm.queries import MIX_WEIGHTS, tokenizer_path


def shingles(text):
    w = re.findall("[^\x20\x09-\x0D]+", text.lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def alike(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def plain_lines(rows):
    seen, out = [], []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        kept = []
        for line in r["text"].split("\n"):
            s = shingles(line)
            if not s or not any(alike(s, x) for x in seen):
                kept.append(line)
            if s:
                seen.append(s)
        text = "\n".join(kept)
        if text.strip(" "):
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def plain_near(rows):
    rows, sets = sorted(rows, key=lambda r: r["doc_id"]), {}
    root = {}
    find = lambda x: x if root[x] == x else find(root[x])
    for r in rows:
        i, s = r["doc_id"], shingles(r["text"])
        root[i], sets[i] = i, s
        for j in list(sets):
            if j != i and alike(s, sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def plain_mix(rows):
    part = lambda r: r["source"] if r["source"] in MIX_WEIGHTS else "*"
    size = collections.Counter()
    for r in rows:
        size[part(r)] += r["n_chars"]
    draw = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:13], 16) / 2**52
    out = []
    for r in rows:
        rate = MIX_WEIGHTS[part(r)] / sum(MIX_WEIGHTS.values()) * sum(size.values()) / size[part(r)]
        parts = max(1, math.ceil(rate / mixing.SPLIT))
        for k in range(parts):
            u, below, n = draw(7, r["doc_id"], k), 0.0, 0
            while (below := below + math.exp(-rate / parts + n * math.log(rate / parts) - math.lgamma(n + 1))) <= u:
                n += 1
            out += [r["doc_id"]] * n
    return out


def test_pipeline(spark, tmp_path):
    docs = awkward(spark, 80).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 82")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "source mixing", "packing"]
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], str(tmp_path)).write.parquet(str(tmp_path / f"stage{i}"))
        tables.append(spark.read.parquet(str(tmp_path / f"stage{i}")))
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [[r.asDict() for r in t.collect()] for t in tables]
    verdict = {(r.doc_id, r.n_words) for r in quality.judge(docs).collect() if r.kept}
    assert len(rows[1]) >= len(verdict) > 20
    key = lambda r: (r["doc_id"], r["text"], r["n_chars"])
    assert sorted(map(key, rows[2])) == sorted(map(key, plain_lines(rows[1])))
    assert sorted(r["doc_id"] for r in rows[3]) == sorted(r["doc_id"] for r in plain_near(rows[2]))
    assert sorted(r["doc_id"] for r in rows[4]) == sorted(plain_mix(rows[3]))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    text = {r["doc_id"]: r["text"] for r in rows[4]}
    for p in rows[5]:
        stream = [*whole.encode(text[p["doc_id"]], add_special_tokens=False).ids, 0]
        part = np.asarray(stream[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
        assert len(stream) == p["doc_tokens"] and zlib.crc32(part) == p["ids_crc32"]
    assert sum(p["length"] for p in rows[5]) == sum(len(whole.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows[4])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows[5])


def test_line_stage_keeps_texts_without_lines(spark, tmp_path):
    rows = [(1, "a b c d e f", 11), (2, "A b c d e f", 11), (3, None, 3), (4, "", 0), (5, "  ", 2), (6, "a b c d e f\nown", 15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    left = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect())) == [(1, "a b c d e f", 11), (3, None, 3), (4, "", 0), (5, "  ", 2), (6, "own", 3)]
