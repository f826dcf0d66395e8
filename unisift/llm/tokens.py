"""Operator 3: token counts of whole texts by batch encoding, lengths only.

`count_tokens(documents, path, limit)` adds nothing to the texts and cuts nothing: every whole text
is counted as the tokenizer library that belongs to the file gives it (`tokenizers` for `.json`,
`sentencepiece` for `.model`, `tiktoken` for `.tiktoken`), without begin, end or added special
tokens; special strings inside a text are handled as that library does by default.

Texts arrive in Arrow batches. They are encoded in batches balanced by bytes; a text longer than
`PIECE_BYTES` is split where no token of the vocabulary can cross (between a character that isn't
white space and one that is, which the pre-tokenizer of byte-level BPE always separates), so memory
and time per call stay bounded while the sum equals the count of the whole text. A long stretch
without such a place stays whole. Other pre-tokenizers and SentencePiece get the text unsplit.

A byte-level BPE `.json` whose merges are in the order of its ids is the same function as a rank
table, and `tiktoken` evaluates that table about five times as fast. It's used for texts in scripts
on which the two libraries' character classes can't differ (Unicode blocks up to U+024F, and
punctuation U+2010-U+2027); other texts, and texts with very long unbroken runs, go through
`tokenizers` itself. Tests hold both paths equal.

Nulls: a null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows pass through, one
result row per input row; an empty table gives an empty result. Further columns are not read, so
their names can't clash.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Longer texts are split at safe places into pieces of about this size.
PIECE_BYTES = 1 << 20
#: Bytes of text in one call of the encoder.
BATCH_BYTES = 1 << 20
#: Fixed pattern of byte-level BPE pre-tokenization, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PLAIN = re.compile("[\x00-ɏ‐-‧]*")
_LONG_RUN = re.compile(r"\S{2000}|\s{2000}")
_CUT = re.compile(r"(?<=\S)(?=\s)")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE, by rule: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The rank table of a plain byte-level BPE file, or None if the file is anything more than that."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not spec.get("post_processor")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", ())):
        return None
    alphabet, vocab = _byte_alphabet(), model["vocab"]
    special = {t["content"] for t in spec.get("added_tokens", ())}
    ids = [vocab["".join(m.split(" ")) if isinstance(m, str) else "".join(m)] for m in model["merges"]]
    if ids != sorted(ids) or any(b >= ids[0] for s, b in vocab.items() if len(s) == 1 and ids and s not in special):
        return None
    return {bytes(alphabet[c] for c in s): i for s, i in vocab.items() if s not in special}


class Encoder:
    """Ids and counts of texts for one tokenizer file; made once in each Python worker."""

    def __init__(self, path: str):
        self.fast, self.splits = None, False
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.slow = lambda texts: pieces.encode(texts, num_threads=1)
        elif path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.slow = lambda texts: [encoding.encode_ordinary(t) for t in texts]
            self.splits = True
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.no_truncation()
            whole.no_padding()
            self.slow = lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            if ranks := _ranks(spec):
                import tiktoken

                special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
                self.splits = not any(re.search(r"\s", s) for s in special)
                encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
                self.fast = lambda t: encoding.encode_to_numpy(t, allowed_special="all")

    def pieces(self, text: str) -> list[str]:
        """The text, split where no token crosses."""
        if not self.splits or len(text) <= PIECE_BYTES:
            return [text]
        out, begin = [], 0
        while len(text) - begin > PIECE_BYTES:
            cut = _CUT.search(text, begin + PIECE_BYTES)
            if not cut:
                break
            out.append(text[begin : cut.start()])
            begin = cut.start()
        return [*out, text[begin:]]

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text, uint32."""
        return np.concatenate([self._ids(p) for p in self.pieces(text)])

    def _ids(self, piece: str) -> np.ndarray:
        if self.fast and _PLAIN.fullmatch(piece) and not _LONG_RUN.search(piece):
            return self.fast(piece).astype(np.uint32, copy=False)
        return np.asarray(self.slow([piece])[0], np.uint32)

    def lengths(self, texts: list[str]) -> list[int]:
        """Token counts; `texts` are encoded in batches of about BATCH_BYTES."""
        out = [0] * len(texts)
        batch: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            for (i, _), ids in zip(batch, self.slow([p for _, p in batch]), strict=True):
                out[i] += len(ids)
            batch.clear()

        for i, text in enumerate(texts):
            for piece in self.pieces(text):
                if self.fast and _PLAIN.fullmatch(piece) and not _LONG_RUN.search(piece):
                    out[i] += len(self.fast(piece))
                    continue
                batch.append((i, piece))
                size += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
                if size >= BATCH_BYTES:
                    flush()
                    size = 0
        flush()
        return out


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def count_tokens(documents: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). No shuffle."""
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for part in tx.slices(batches, "text"):
            at, _ = tx.flat(part.column("text"))
            n = np.asarray(encode.lengths([t or "" for t in part.column("text").to_pylist()]), np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
