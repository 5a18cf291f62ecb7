"""Encoding and decoding with a public byte-level tokenizer (p6)."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
BLOCK = 128


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


def byte_table() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, the rest from code point 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    table = byte_table()
    return {i: bytes(table[c] for c in token) for token, i in tokenizer(path).get_vocab().items() if all(c in table for c in token)}


def encode_texts(texts: list[str | None], path: str) -> list[list[int]]:
    """Ids of each text; null and empty texts give an empty list."""
    t, out = tokenizer(path), []
    for i in range(0, len(texts), BLOCK):
        out += [e.ids for e in t.encode_batch_fast([x or "" for x in texts[i : i + BLOCK]], add_special_tokens=False)]
    return out


def offsets(text: str, ids: list[int], path: str) -> list[tuple[int, int]]:
    """The code points [start, end) that each token touches; tokens that split a character both have it."""
    table = token_bytes(path)
    data = text.encode("utf-8")
    char = np.cumsum([(b & 0xC0) != 0x80 for b in data]) - 1
    out, at = [], 0
    for i in ids:
        end = at + len(table[i])
        out.append((int(char[at]), int(char[end - 1]) + 1))
        at = end
    return out


def decode_ids(ids: list[int] | None, path: str) -> str | None:
    """The text of a list of ids; bytes of characters cut off at either end become U+FFFD, unknown ids vanish."""
    if ids is None:
        return None
    table = token_bytes(path)
    return b"".join(table.get(i, b"") for i in ids).decode("utf-8", "replace")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``(id_col, ids)`` for every row. Nulls in the id column stay; repeated rows stay; other columns are ignored."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                ids = encode_texts(part.column(1).to_pylist(), path)
                ends = np.cumsum([0] + [len(x) for x in ids], dtype=np.int32)
                flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids]) if ends[-1] else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def encode_with_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``(id_col, ids, starts, ends)``: like :func:`encode`, with the code points [start, end) that each token touches."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                texts = part.column(1).to_pylist()
                ids = encode_texts(texts, path)
                spans = [offsets(t or "", x, path) for t, x in zip(texts, ids)]
                lists = [pa.array(c, pa.list_(pa.int32())) for c in (ids, [[s for s, _ in x] for x in spans], [[e for _, e in x] for x in spans])]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], [id_col, "ids", "starts", "ends"])

    kind = dict(docs.dtypes)[id_col]
    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def counts(docs: DataFrame, keep: list[str], text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the length of the encoding; the ids themselves stay in the task."""

    def run(batches):
        for batch in batches:
            n = [len(x) for x in encode_texts(batch.column(len(keep)).to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*keep, "tokens"])

    kinds = dict(docs.dtypes)
    return spread(docs.select(*keep, text_col)).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens bigint")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``(id_col, text)``, the reverse of :func:`encode`; null lists give null."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_ids(x, path) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return encoded.select(id_col, F.col(ids_col)).mapInArrow(run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, text string")
