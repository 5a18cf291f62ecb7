"""Near-duplicate groups by HyperMinHash registers (p5).

One hash of every trigram goes into one bucket of each of four passes; a bucket's register is the leading-zero count (6 bits) and
10 mantissa bits of its smallest hash. Bands of seven registers propose pairs; one bit of each of 128 registers, and the set
sizes, drop most of the hopeless ones where they are proposed; a collision-corrected estimate drops the rest, and exact trigram sets
decide. Equal texts are folded to one representative before anything else.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.shingles import BUCKETS, U, alike, bits, blocks, digest, hopeful, mix, signatures
from tarnwork.operators.buckets import BLOCK, across
from tarnwork.operators.components import connected_components
from tarnwork.runtime import Workspace, spread

BANDS, ROWS, MANTISSA, PASSES = 32, 7, 10, 4
SLOTS = PASSES * BUCKETS
WIDTH = 58


def registers(slots: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of minima of 58 bits: leading zeros and the bits behind the first one."""
    low = np.maximum(slots, U(1))
    zeros = (WIDTH - np.frexp(low.astype(np.float64))[1]).clip(0, 57).astype(U)
    fine = ((low << (zeros + U(1))) & U((1 << WIDTH) - 1)) >> U(WIDTH - MANTISSA)
    return ((zeros << U(MANTISSA)) | fine).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of registers, for each row of them."""
    r = regs[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(U)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=U)), r.shape[:2])
    for i in range(ROWS):
        key = mix(key ^ r[:, :, i])
    return key.view(np.int64)


@lru_cache(maxsize=4096)
def chance(n: int, m: int) -> float:
    """Probability that registers of two disjoint sets of n and m members agree by accident."""
    lz = np.arange(0, 40)[:, None]
    cell = np.arange(2**MANTISSA)[None, :]
    low = 2.0 ** -(lz + 1) * (1 + cell / 2**MANTISSA)
    high = low + 2.0 ** -(lz + 1 + MANTISSA)
    p = lambda k: (np.exp(-k * low) - np.exp(-k * high)) / (1 - np.exp(-k))
    return float((p(n) * p(m)).sum())


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard from agreeing registers, less the agreement that chance alone gives to buckets of n / BUCKETS and m / BUCKETS members."""
    grid = lambda k: 2.0 ** np.ceil(np.log2(max(1, k) / BUCKETS))
    lucky = chance(*sorted((float(grid(n)), float(grid(m)))))
    return ((a == b).mean() - lucky) / (1 - lucky)


ENTRY = "id bigint, digest binary, norm string, size int, regs binary, bands array<bigint>, f bigint, g bigint"


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Registers, band keys and bits of every text long enough to take part."""

    def run(batches):
        for batch in batches:
            for ids, norms in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size, slots = signatures(norms, PASSES)
                regs, two = registers(slots), bits(slots)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(regs).reshape(-1)))
                cols = [pa.array(ids, pa.int64()), pa.array([digest(t) for t in norms], pa.binary()), pa.array(norms, pa.string()), pa.array(size.astype(np.int32))]
                cols += [pa.array([r.tobytes() for r in regs], pa.binary()), keys, pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "digest", "norm", "size", "regs", "bands", "f", "g"])

    return spread(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, ENTRY)


def likely(pairs: DataFrame, threshold: float, slack: float = 5.0) -> DataFrame:
    """The pairs (a, b, size_a, size_b, regs_a, regs_b) whose estimate lies less than ``slack`` standard deviations below the threshold."""

    def run(batches):
        for batch in batches:
            na, nb, ra, rb = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k in range(batch.num_rows):
                x, y = np.frombuffer(ra[k], np.uint16), np.frombuffer(rb[k], np.uint16)
                free = SLOTS * (1 - np.exp(-min(na[k], nb[k]) / BUCKETS))
                keep[k] = estimate(x, y, na[k], nb[k]) >= threshold - slack * np.sqrt(threshold * (1 - threshold) / free)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])

    return pairs.select("a", "b", "size_a", "size_b", "regs_a", "regs_b").mapInArrow(run, "a bigint, b bigint")


def verify(pairs: DataFrame, sketches: DataFrame, threshold: float, ws: Workspace) -> DataFrame:
    """The pairs (a, b) whose texts are at least ``threshold`` alike: by the estimate first, then exactly."""

    def side(x: str, *cols: str) -> DataFrame:
        return sketches.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])

    hope = ws.save(likely(pairs.join(side("a", "size", "regs"), "a").join(side("b", "size", "regs"), "b"), threshold), "hope")
    return ws.save(alike(hope.join(side("a", "norm"), "a").join(side("b", "norm"), "b"), threshold).select("a", "b"), "edges")


def crossing(placed: DataFrame, comps: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Hopeful pairs (a, b) of different components in one bucket."""
    both = across(placed, comps, block).where(hopeful("l", "r", threshold))
    return both.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``(group_id, id)`` of every row in a group of two or more near-duplicate rows.

    * Rows without id, and texts that are null or shorter than 40 characters once normalised, take no part.
    * Equal texts (copies and repeated rows with other ids) share one representative, the smallest id;
      the copies rejoin at the end by digest, so a text that fills a third of the table costs one sketch pair.
    * Within a band bucket each member is first compared with the bucket's smallest id. Only members that are
      then in different components are compared with each other (see :func:`crossing`), so a bucket full of mutually
      similar texts yields a number of pairs in proportion to its size, and no link between components is lost.
    * An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    ws = Workspace(docs.sparkSession, "near")
    every = ws.save(sketch(docs, id_col, text_col), "every")
    classes = ws.save(every.groupBy("digest").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n")), "classes")
    reps = ws.save(every.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]), "reps")

    bands = reps.select(F.explode("bands").alias("key"), "id", "size", "f", "g")
    hub = [F.min_by(c, "id").alias(f"hub_{c}") for c in ("size", "f", "g")]
    hubs = bands.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("z"), *hub).where("hub < z").drop("z")
    placed = ws.save(bands.join(hubs, "key"), "placed")
    own = placed.select(F.struct("id", "size", "f", "g").alias("own"), F.struct(F.col("hub").alias("id"), *[F.col(f"hub_{c}").alias(c) for c in ("size", "f", "g")]).alias("hub"))
    stars = own.where("own.id > hub.id").where(hopeful("own", "hub", threshold)).select(F.col("hub.id").alias("a"), F.col("own.id").alias("b")).distinct()
    stars = ws.save(stars, "stars")
    edges = verify(stars, reps, threshold, ws)
    comps = connected_components(edges, ws)

    cross = crossing(placed.select("key", "id", "size", "f", "g"), comps, threshold)
    cross = ws.save(cross.join(stars, ["a", "b"], "left_anti"), "cross")
    more = verify(cross, reps, threshold, ws)
    if more.limit(1).count():
        edges = edges.union(more)
        comps = connected_components(edges, ws)

    whole = classes.join(comps, classes.rep == comps.id, "left").select("digest", "n", F.coalesce("comp", "rep").alias("comp"), F.col("id").isNotNull().alias("linked"))
    member = every.select("id", "digest").join(whole.where("linked or n > 1"), "digest")
    out = ws.save(member.select(F.col("comp").alias("group_id"), "id").distinct(), "groups")
    ws.drop(every, classes, reps, placed, stars, cross, more, comps)
    return out
