"""Distances and quantizers over array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for null or zero vectors and for vectors of different length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_wide(a), _wide(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalize(a: Column) -> Column:
    """Length one; zero vectors stay."""
    n = norm(a)
    return F.when(n > 0, F.transform(_wide(a), lambda x: x / n)).otherwise(_wide(a))


def top_k(rows: DataFrame, query: list[float], k: int = 10, threshold: float | None = None, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k rows most similar to a query vector, ``similarity`` beside their columns; ties go to the smaller id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    near = rows.withColumn("similarity", cosine(F.col(vector_col), q)).where("similarity is not null")
    if threshold is not None:
        near = near.where(F.col("similarity") >= threshold)
    return near.orderBy(F.desc("similarity"), id_col).limit(k)


def strategy(rows: int, selected: float, most: int = 1000, share: float = 0.001) -> str:
    """``exact`` where a filter leaves fewer than ``most`` rows or less than ``share`` of all, else ``index``."""
    return "exact" if rows * selected < most or selected < share else "index"


def sq8_ranges(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(pos, low, range) of every dimension; a range of nothing counts as 1."""
    flat = rows.select(F.posexplode(vector_col).alias("pos", "x"))
    low, high = F.min("x").cast("double"), F.max("x").cast("double")
    return flat.groupBy("pos").agg(low.alias("low"), F.when(high - low < 1e-9, 1.0).otherwise(high - low).alias("range"))


def sq8(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``codes``: one number from 0 to 255 for each dimension; ``restored``: what they stand for. One range row per dimension is collected."""
    ranges = sq8_ranges(rows, vector_col).orderBy("pos").collect()
    low, span = F.array(*[F.lit(r.low) for r in ranges]), F.array(*[F.lit(r.range) for r in ranges])
    part = F.zip_with(F.zip_with(_wide(F.col(vector_col)), low, lambda x, m: x - m), span, lambda x, r: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / r)) * 255).cast("int"))
    back = F.zip_with(F.zip_with(F.col("codes"), span, lambda c, r: c / F.lit(255.0) * r), low, lambda x, m: x + m)
    return rows.withColumn("codes", part).withColumn("restored", back)


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rabitq(rows: DataFrame, dim: int, seed: int = 0, vector_col: str = "embedding") -> DataFrame:
    """``code``: sign bits of the rotated unit vector, lowest bit first; null where the vector is null or of another length."""
    turn = rotation(dim, seed)

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        fits = v.map(lambda x: x is not None and len(x) == dim)
        out = pd.Series([None] * len(v), index=v.index, dtype=object)
        if fits.any():
            signs = np.stack(v[fits].to_list()).astype(np.float64) @ turn.T > 0
            out[fits] = [b.tobytes() for b in np.packbits(signs, axis=1, bitorder="little")]
        return out

    return rows.withColumn("code", pack(vector_col))


def fp16(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``half``: IEEE half floats, little-endian."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f2").tobytes())

    return rows.withColumn("half", pack(vector_col))


def fp16_restored(rows: DataFrame, half_col: str = "half") -> DataFrame:
    """``restored``: the numbers that half floats stand for."""

    @F.pandas_udf("array<float>")
    def unpack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.frombuffer(x, dtype="<f2").astype(np.float32))

    return rows.withColumn("restored", unpack(half_col))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Bits in which two codes of equal length differ; null where either is null."""

    @F.pandas_udf("int")
    def differ(x: pd.Series, y: pd.Series) -> pd.Series:
        one = lambda p, q: None if p is None or q is None else int(np.bitwise_count(np.frombuffer(p, np.uint8) ^ np.frombuffer(q, np.uint8)).sum())
        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype="Int32")

    return differ(a, b)


def nearest_in_blocks(rows: DataFrame, asked: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096) -> DataFrame:
    """``(q, id_col, similarity)``: the k rows most similar to each asked row, itself apart; exact.

    Rows and asked rows are dealt into blocks of about ``block``, each pair of blocks is one matrix product, and only its k best for each
    asked row leave it. Null and zero vectors are no one's neighbour; ties go to the smaller id. Vectors have one length, ids are bigint.
    """
    give_blocks, ask_blocks = max(1, -(-rows.count() // block)), max(1, -(-asked.count() // block))
    part = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = lambda df, own: df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), *own)
    give = cols(rows, [part(give_blocks).alias("g"), every(ask_blocks).alias("a"), F.lit(False).alias("ask")])
    ask = cols(asked, [every(give_blocks).alias("g"), part(ask_blocks).alias("a"), F.lit(True).alias("ask")])

    def search(table: pa.Table) -> pa.Table:
        asks, ids = table.column("ask").to_numpy(), table.column("id").to_numpy()
        x = np.array(table.column("v").to_pylist(), dtype=np.float64)
        size = np.linalg.norm(x, axis=1)
        x = x / np.where(size > 0, size, np.nan)[:, None]
        q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        r = r[np.argsort(ids[r], kind="stable")]
        sims = x[q] @ x[r].T
        sims[np.isnan(sims) | (ids[q][:, None] == ids[r][None, :])] = -np.inf
        best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(sims, best, axis=1)
        at, c = np.nonzero(np.isfinite(found))
        return pa.table({"q": ids[q][at], id_col: ids[r][best[at, c]], "similarity": found[at, c]})

    pairs = give.union(ask).groupBy("g", "a").applyInArrow(search, f"q bigint, `{id_col}` bigint, similarity double")
    first = Window.partitionBy("q").orderBy(F.desc("similarity"), id_col)
    return pairs.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")
