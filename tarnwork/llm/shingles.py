"""Text normalisation, trigram sets, bucketed minimum hashes and the exact check shared by the near-duplicate operators.

Signatures are made for a block of texts at once. Every distinct trigram is hashed into one bucket of each pass and the
smallest hash of a bucket stays (one-permutation hashing); an empty bucket borrows from a full one along a fixed
sequence, so any two texts agree in a slot with the probability of their similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.runtime import spread

MIN_CHARS = 40
BUCKETS, BLOCK_CHARS, BITS = 64, 100_000, 128
U = np.uint64
EMPTY = np.iinfo(np.uint64).max


def normal(text: str | None) -> str | None:
    """Lower case, single spaces, no space at the ends; None where the text takes no part."""
    if text is None:
        return None
    t = text.lower().replace("\t", " ").replace("\r", " ").replace("\n", " ")
    while "  " in t:
        t = t.replace("  ", " ")
    t = t.strip(" ")
    return t if len(t) >= MIN_CHARS else None


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U)


def trigrams(text: str) -> np.ndarray:
    """Distinct trigrams, sorted; three code points of 21 bits fit one number, so nothing collides."""
    c = codes(text)
    grams = np.sort(c[:-2] | (c[1:-1] << U(21)) | (c[2:] << U(42)))
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])] if len(grams) else grams


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact similarity of two sorted sets."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return both / (len(a) + len(b) - both)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hashed_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every distinct trigram of each text, ordered by text. At most 2^14 texts; sets are told apart by 50 bits."""
    lengths = np.array([len(t) for t in texts])
    c = codes("".join(texts))
    doc = np.repeat(np.arange(len(texts), dtype=U), lengths)
    whole = doc[2:] == doc[:-2]
    grams = (c[:-2] | (c[1:-1] << U(21)) | (c[2:] << U(42)))[whole]
    key = np.sort((doc[:-2][whole] << U(50)) | (mix(grams) >> U(14)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> U(50)).astype(np.int64), mix(key << U(14))


def _borrow(slots: np.ndarray, passes: int) -> None:
    """Fill empty buckets of a pass from full ones; the sequence depends on the bucket and the attempt only."""
    for p in range(passes):
        part = slots[:, p * BUCKETS : (p + 1) * BUCKETS]
        rows = np.flatnonzero((part == EMPTY).any(axis=1) & (part != EMPTY).any(axis=1))
        own, sub, turn = part[rows], part[rows].copy(), 0
        while len(rows) and (empty := sub == EMPTY).any():
            turn += 1
            pick = (mix(np.arange(BUCKETS, dtype=U) + U(turn * 1_000_003 + p)) % U(BUCKETS)).astype(np.int64)
            lent = own[:, pick]
            lent = np.where(lent == EMPTY, lent, mix(lent + U(turn)) >> U(6))
            sub = np.where(empty, lent, sub)
        part[rows] = sub


def signatures(texts: list[str], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the trigram sets and, for each text, ``passes`` x BUCKETS minima of 58 bits."""
    doc, h = hashed_sets(texts)
    size = np.bincount(doc, minlength=len(texts))
    slots = np.full((len(texts), passes * BUCKETS), EMPTY, dtype=U)
    for p in range(passes):
        g = mix(h ^ mix(np.full(1, 0xA5A5 + p, dtype=U)))
        np.minimum.at(slots.reshape(-1), doc * (passes * BUCKETS) + p * BUCKETS + (g & U(BUCKETS - 1)).astype(np.int64), g >> U(6))
    _borrow(slots, passes)
    return size, slots


def bits(slots: np.ndarray) -> np.ndarray:
    """Two numbers of 64 bits for each text, one bit of each of its first 128 slots."""
    one = (mix(slots[:, :BITS]) & U(1)).astype(np.uint8)
    return np.packbits(one, axis=1).view(np.int64)


def blocks(ids: list, texts: list):
    """(ids, normal texts) of those that take part, in blocks of about BLOCK_CHARS characters."""
    own, kept, size = [], [], 0
    for i, text in zip(ids, texts):
        norm = normal(text)
        if i is None or norm is None:
            continue
        own.append(i)
        kept.append(norm)
        size += len(norm)
        if size > BLOCK_CHARS:
            yield own, kept
            own, kept, size = [], [], 0
    if own:
        yield own, kept


def hopeful(a: str, b: str, threshold: float, passes: int = BITS // BUCKETS, slack: float = 5.0) -> Column:
    """Whether two rows with ``size``, ``f`` and ``g`` can belong to texts above the threshold.

    Sizes must allow it, and the bits may differ in at most ``slack`` standard deviations more places than they do on average
    at the threshold. Small sets fill few buckets, so fewer of their bits are independent and the deviation is wider.
    """
    col = lambda s, c: F.col(f"{s}.{c}" if s else c)
    odds = (1 - threshold) / 2
    free = F.lit(float(BITS)) * (1 - F.exp(-F.least(col(a, "size"), col(b, "size")) / BUCKETS))
    most = BITS * odds + slack * BITS * float(np.sqrt(odds * (1 - odds))) / F.sqrt(free)
    differ = F.bit_count(col(a, "f").bitwiseXOR(col(b, "f"))) + F.bit_count(col(a, "g").bitwiseXOR(col(b, "g")))
    return (F.least(col(a, "size"), col(b, "size")) >= threshold * F.greatest(col(a, "size"), col(b, "size"))) & (differ <= most)


def alike(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b, norm_a, norm_b) whose texts are at least ``threshold`` alike, exactly."""

    def run(batches):
        sets: dict[int, np.ndarray] = {}

        def of(i, text):
            if i not in sets:
                if len(sets) > 2_000:
                    sets.clear()
                sets[i] = trigrams(text)
            return sets[i]

        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            s = np.array([jaccard(of(a[k], ta[k]), of(b[k], tb[k])) for k in range(batch.num_rows)], dtype=np.float64)
            keep = pa.array(s >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(s).filter(keep)], ["a", "b", "similarity"])

    return spread(pairs.select("a", "b", "norm_a", "norm_b"), "a", "b").mapInArrow(run, "a bigint, b bigint, similarity double")
