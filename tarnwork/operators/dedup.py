"""Rows of a near-duplicate group reduced to one, and MinHash signatures."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.buckets import across
from tarnwork.operators.components import connected_components
from tarnwork.runtime import Workspace, shuffles_freed, width

SLOTS = 128
PRIME = (1 << 61) - 1


def not_duplicate(rows: DataFrame, group_col: str, key_col: str) -> DataFrame:
    """One row for each group, the smallest key as text, and every row without group.

    Rows without group skip the window, so they never meet in one task.
    """
    first = F.row_number().over(Window.partitionBy(group_col).orderBy(F.col(key_col).cast("string")))
    grouped = rows.where(F.col(group_col).isNotNull()).withColumn("_n", first).where("_n = 1").drop("_n")
    return grouped.unionByName(rows.where(F.col(group_col).isNull()))


def coefficients(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, PRIME, SLOTS, dtype=np.uint64), rng.integers(0, PRIME, SLOTS, dtype=np.uint64)


COEFFICIENTS = coefficients()


def times_mod(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a * x modulo 2^61 - 1 in 64-bit arithmetic, by halves of x; a and x below the modulus."""
    fold = lambda v: (v & np.uint64(PRIME)) + (v >> np.uint64(61))
    low, high = x & np.uint64(0x7FFFFFFF), x >> np.uint64(31)
    a_low, a_high = a & np.uint64(0x7FFFFFFF), a >> np.uint64(31)
    mid = a_low * high + a_high * low
    total = fold(a_high * high * np.uint64(2)) + fold((mid >> np.uint64(30)) + ((mid & np.uint64(0x3FFFFFFF)) << np.uint64(31))) + fold(a_low * low)
    total = fold(fold(total))
    return np.where(total >= PRIME, total - np.uint64(PRIME), total)


def signature(text: str | None, ab=coefficients()) -> list[int] | None:
    """128 slots of 32 bits over character trigrams; texts of one or two characters are one padded shingle,
    empty texts have all slots at the maximum, null gives null."""
    if text is None:
        return None
    if not text:
        return [0xFFFFFFFF] * SLOTS
    grams = {text[i : i + 3] for i in range(len(text) - 2)} or {text.ljust(3, "\0")}
    x = np.array([xxhash.xxh3_64_intdigest(g.encode("utf-8", "surrogatepass")) % PRIME for g in grams], dtype=np.uint64)
    best = np.full(SLOTS, PRIME, dtype=np.uint64)
    for i in range(0, len(x), 2048):
        h = times_mod(ab[0][:, None], x[None, i : i + 2048]) + ab[1][:, None]
        best = np.minimum(best, (np.where(h >= PRIME, h - np.uint64(PRIME), h)).min(axis=1))
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64).tolist()


def minhash(texts: Column | str) -> Column:
    """The signature of a text column."""

    @F.pandas_udf("array<bigint>")
    def signatures(texts: pd.Series) -> pd.Series:
        return texts.map(signature)

    return signatures(texts)


def estimated_jaccard(a: Column, b: Column) -> Column:
    """Equal slots of two signatures over their number."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def equal_groups(rows: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """``(group_id, key)`` of rows whose whole texts are equal, groups of two or more; group_id is the smallest key. Null texts have none."""
    sized = rows.where(F.col(text_col).isNotNull()).groupBy(F.sha2(text_col, 256).alias("d")).agg(F.min(key_col).alias("group_id"), F.count("*").alias("n"))
    return rows.select(F.col(key_col).alias("key"), F.sha2(text_col, 256).alias("d")).join(sized.where("n > 1"), "d").select("group_id", "key")


#: Characters hashed at once, and in one piece of a text; trigrams whose hashes a process keeps.
CHARS, PIECE, KEPT = 131_072, 4096, 32_768


class Trigrams:
    """Hashes of trigrams, each given as three code points of 21 bits; those met first are kept."""

    def __init__(self):
        self.grams, self.rows, self.kept = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty((0, SLOTS), dtype=np.uint64)

    def hashes(self, grams: np.ndarray) -> np.ndarray:
        """A row of 128 for each of the sorted distinct trigrams."""
        out, there = np.empty((len(grams), SLOTS), dtype=np.uint64), np.isin(grams, self.grams, assume_unique=True)
        out[there] = self.kept[self.rows[np.searchsorted(self.grams, grams[there])]]
        new = grams[~there]
        out[~there] = fresh = self._fresh(new)
        if room := min(KEPT - len(self.kept), len(new)):
            every = np.concatenate([self.grams, new[:room]])
            order = np.argsort(every)
            self.rows = np.concatenate([self.rows, np.arange(len(self.kept), len(self.kept) + room)])[order]
            self.grams, self.kept = every[order], np.concatenate([self.kept, fresh[:room]])
        return out

    @staticmethod
    def _fresh(grams: np.ndarray) -> np.ndarray:
        mask, out = np.uint64((1 << 21) - 1), np.empty((len(grams), SLOTS), dtype=np.uint64)
        spelt = np.stack([grams & mask, grams >> np.uint64(21) & mask, grams >> np.uint64(42)], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        x = np.array([xxhash.xxh3_64_intdigest(spelt[i : i + 3].encode("utf-8", "surrogatepass")) % PRIME for i in range(0, len(spelt), 3)], dtype=np.uint64)
        for i in range(0, len(x), 1024):
            h = times_mod(COEFFICIENTS[0][None, :], x[i : i + 1024, None]) + COEFFICIENTS[1][None, :]
            out[i : i + 1024] = np.where(h >= PRIME, h - np.uint64(PRIME), h)
        return out


KNOWN = Trigrams()


def signatures(texts: list[str]) -> np.ndarray:
    """The signatures of texts that aren't empty, as rows of 128 slots; a trigram is hashed once for many texts."""
    pieces, owner = [], []
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - 2), PIECE):
            pieces.append(text[at : at + PIECE + 2].ljust(3, "\0"))
            owner.append(i)
    best = np.full((len(texts), SLOTS), PRIME, dtype=np.uint64)
    first = 0
    while first < len(pieces):
        last, size = first, 0
        while last < len(pieces) and (last == first or size + len(pieces[last]) <= CHARS):
            size += len(pieces[last])
            last += 1
        points = np.frombuffer("".join(pieces[first:last]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        grams, which = np.unique(points[:-2] | points[1:-1] << np.uint64(21) | points[2:] << np.uint64(42), return_inverse=True)
        hashed = KNOWN.hashes(grams)
        at = 0
        for k in range(first, last):
            np.minimum(best[owner[k]], hashed[which[at : at + len(pieces[k]) - 2]].min(axis=0), out=best[owner[k]])
            at += len(pieces[k])
        first = last
    return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32)


#: Buckets of more members are not paired in full at first. Columns of slots are read in so many rounds.
FULL, ROUNDS = 8, 4


def layout(threshold: float) -> tuple[int, list[list[np.ndarray]]]:
    """Slots that may differ, and the slots of both bands of each part: so many parts that one has a single differing slot at most."""
    differ = next(n for n in range(SLOTS, -1, -1) if n == 0 or (SLOTS - n) / SLOTS >= threshold)
    parts = min(max(13, differ // 2 + 1), SLOTS // 2)
    return differ, [np.array_split(p, 2) for p in np.array_split(np.arange(SLOTS), parts)]


def similar_groups(rows: DataFrame, key_col: str, text_col: str, threshold: float = 0.8) -> DataFrame:
    """``(group_id, key)`` of rows whose signatures agree in at least ``threshold`` of their slots, also through other rows.

    group_id is the smallest key, so it depends on the keys alone, not on their order or layout. Keys are bigint; null and empty texts have
    no group. Equal texts are folded first. The slots form parts of two bands. Signatures that agree in enough slots have a part in which one
    slot differs at most, so they have one band of it in common and all but a slot of the other: those are the buckets, and no pair is missed.
    Members of a small bucket all meet; in others each meets the smallest key first, then only signatures of other components, in blocks.
    """
    spark = rows.sparkSession
    with shuffles_freed(spark):
        return _similar_groups(rows, key_col, text_col, threshold, Workspace(spark, "similar"))


def _similar_groups(rows: DataFrame, key_col: str, text_col: str, threshold: float, ws: Workspace) -> DataFrame:
    differ, parts = layout(threshold)
    slots = [(f"p{i}", np.concatenate(p)) for i, p in enumerate(parts)]
    rounds = [[int(i) for i in r] for r in np.array_split(np.arange(len(parts)), ROUNDS)]
    text, d = F.col(text_col), F.unhex(F.sha2(text_col, 256)).alias("d")
    given = rows.where(F.col(key_col).isNotNull() & (text != "")).select(F.col(key_col).cast("bigint").alias("id"), text.alias("text"), d)
    every = ws.save(given.select("id", "d"), "every")
    reps = ws.save(every.groupBy("d").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n")), "reps")
    once = given.repartition(width(rows.sparkSession), "d").groupBy("d").agg(F.min("id").alias("id"), F.any_value("text").alias("text"))
    twice = ws.save(reps.groupBy("rep").agg(F.min("d").alias("kept"), F.count("*").alias("texts")).where("texts > 1").drop("texts"), "twice")
    if twice.limit(1).count():  # a key with several texts is signed by one of them
        once = once.join(twice.withColumnRenamed("rep", "id"), "id", "left").where("kept is null or kept = d")

    def sign(batches):
        for batch in batches:
            sig = signatures(batch.column("text").to_pylist()).view(np.int32)
            ends = lambda n: pa.array(np.arange(len(sig) + 1, dtype=np.int32) * n)
            arrays = [pa.ListArray.from_arrays(ends(len(at)), pa.array(sig[:, at].ravel())) for _, at in slots]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", *(name for name, _ in slots)])

    signed = ws.save(once.select("id", "text").mapInArrow(sign, "id bigint, " + ", ".join(f"{name} array<int>" for name, _ in slots)), "signed")
    met = [_meetings(signed, r, parts, ws) for r in rounds]
    every_met = reduce(DataFrame.union, met)

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs whose signatures agree, read in rounds of parts; a pair leaves once too many slots differ."""
        left = ws.save(pairs.where("a < b").distinct().withColumn("differ", F.lit(0)), "pairs")
        for r in rounds if left.limit(1).count() else ():
            names = [slots[i][0] for i in r]
            side = lambda n: signed.select(F.col("id").alias(n), *[F.col(x).alias(f"{x}_{n}") for x in names])  # noqa: E731, B023
            off = sum((F.size(F.filter(F.zip_with(f"{x}_a", f"{x}_b", lambda x, y: x != y), lambda e: e)) for x in names), F.col("differ"))
            new = ws.save(left.join(side("a"), "a").join(side("b"), "b").select("a", "b", off.alias("differ")).where(F.col("differ") <= differ), "pairs")
            ws.drop(left)
            left = new
        return left

    edges = linked(every_met.select("a", "b"))
    comps = connected_components(edges, ws)
    placed = ws.save(every_met.where("key is not null").select("key", F.col("b").alias("id")), "placed")
    ws.drop(*met)
    more = linked(across(placed, comps).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")))
    if more.limit(1).count():
        ws.drop(comps)
        comps = connected_components(edges.union(more), ws)
    ws.drop(signed, placed, edges, more)
    owner = reps.join(comps.withColumnRenamed("id", "rep"), "rep", "left").where("comp is not null or n > 1").select("d", F.coalesce("comp", "rep").alias("group_id"))
    out = ws.save(every.join(owner, "d").select("group_id", F.col("id").alias("key")).distinct(), "groups")
    ws.drop(every, reps, twice, comps)
    return out


def _meetings(signed: DataFrame, chosen: list[int], parts: list[list[np.ndarray]], ws: Workspace) -> DataFrame:
    """``(a, b, key)`` of the buckets of some parts: pairs without key, and with the bucket's key its smallest member and each one where it is large.

    Rows are sent once, by their band; the buckets of all but a slot of the other band are formed where they are. Slots of the other band
    count as 12 bits here: pairs are compared in full later.
    """
    rows = []
    for i in chosen:
        size = len(parts[i][0])
        for own, n in ((0, size), (1, len(parts[i][1]))):
            other = range(size, size + len(parts[i][1])) if own == 0 else range(size)
            band = F.xxhash64(F.lit(2 * i + own), F.slice(f"p{i}", 1 + own * size, n))
            bits = [F.shiftleft((F.col(f"p{i}")[j] % 4096 + 4096) % 4096 + F.lit(0).cast("bigint"), 12 * k) for k, j in enumerate(other)]
            rows.append(F.struct(band.alias("band"), reduce(lambda x, y: x.bitwiseOR(y), bits).alias("other"), F.lit(len(other)).alias("slots")))
    bands = signed.select("id", F.explode(F.array(*rows)).alias("r")).select("id", "r.*")
    shared = bands.withColumn("n", F.count("*").over(Window.partitionBy("band"))).where("n > 1")
    near = shared.select("id", "band", "other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("but"))
    near = near.withColumn("other", F.expr("other & ~shiftleft(4095L, 12 * but)"))
    inside = Window.partitionBy("band", "but", "other").orderBy("id")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = F.array(*[F.lag("id", k).over(inside) for k in range(1, FULL)])
    sized = near.select("id", "band", "but", "other", F.count("*").over(whole).alias("n"), F.min("id").over(whole).alias("hub"), earlier.alias("earlier"))
    few = F.filter("earlier", lambda x: x.isNotNull())
    pairs = sized.where("n > 1").select("id", F.explode(F.when(F.col("n") <= FULL, few).otherwise(F.array("hub"))).alias("a"), F.when(F.col("n") > FULL, F.xxhash64("band", "but", "other")).alias("key"))
    return ws.save(pairs.select("a", F.col("id").alias("b"), "key").distinct(), "met")
