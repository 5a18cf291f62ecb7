"""Most similar vectors of every vector by a hierarchical k-means tree (p3).

A tree of unit centroids is fitted on a bounded sample and sent to every task. Each vector is indexed under
its nearest leaf and walks the tree best bin first to a number of further leaves; that number is widened
on probe vectors that the tree wasn't fitted on, compared with all rows, until the recall is surely reached. Leaves beyond
BLOCK rows are searched in pairs of blocks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.runtime import Workspace, spread, width

SAMPLE_ROWS, PROBES, FAN, SLACK = 262_144, 512, 32, 5e-5
BLOCK, GROUP, PART_BYTES, WALK, MET = 8192, 65_536, 8 << 20, 2048, 1 << 22


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of usable vectors and the vectors at length one.

    Usable: not null, of ``dim`` finite values, not all zero.
    """
    lengths = np.array(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(lengths == dim)
    flat = column.take(pa.array(at)).flatten()
    x = np.asarray(flat.fill_null(float("nan")).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(x).max(axis=1, initial=0)
        good = np.isfinite(top) & (top > 0) & np.isfinite(x).all(axis=1)
    at, x = at[good], x[good] / top[good, None]
    return at, x / np.linalg.norm(x, axis=1, keepdims=True)


def _small(df: DataFrame, n: int, most: int = 200_000) -> DataFrame:
    """A counted list of single numbers: sent to every task up to ``most`` rows, shuffled beyond."""
    return F.broadcast(df) if n <= most else df


def packed(x: np.ndarray) -> np.ndarray:
    """Two bytes for each component and the row's scale behind them: the form in which vectors travel to leaves.

    Similarities of packed rows are off by a few millionths; whatever lies within SLACK of a decision is scored again in full.
    """
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-12).astype(np.float32) / 32767
    return np.hstack([np.round(x / scale).astype(np.int16).view(np.int8), scale.view(np.int8).reshape(len(x), 4)])


def unpacked(blob: bytes, dim: int) -> np.ndarray:
    both = np.frombuffer(blob, dtype=np.int8).reshape(-1, 2 * dim + 4)
    return both[:, : 2 * dim].copy().view(np.int16).astype(np.float32) * both[:, 2 * dim :].copy().view(np.float32)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; empty clusters restart at random rows."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), x[rng.integers(0, len(x), k)])
    return c


class Tree:
    """Centroids of inner nodes and leaves. Flat arrays, so it is cheap to broadcast."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.children: list[np.ndarray | None] = [np.arange(0)]
        self.centroid: list[np.ndarray] = [np.zeros(sample.shape[1], np.float32)]
        heap = [(-len(sample), 0, np.arange(len(sample)))]
        made = 1
        while heap and made < leaves:
            size, node, rows = heapq.heappop(heap)
            k = min(FAN, leaves - made + 1, -size // 4)
            if k < 2:
                continue
            c = kmeans(sample[rows], k, rng)
            near = (sample[rows] @ c.T).argmax(axis=1)
            first = len(self.centroid)
            self.children[node] = np.arange(first, first + k)
            for j in range(k):
                self.centroid.append(c[j])
                self.children.append(np.arange(0))
                heapq.heappush(heap, (-int((near == j).sum()), first + j, rows[near == j]))
            made += k - 1
        self.centroid = np.array(self.centroid, dtype=np.float32)
        self.gain = self._gains(sample)
        self.kids = np.full((len(self.children), FAN), -1, dtype=np.int32)
        for node, kids in enumerate(self.children):
            self.kids[node, : len(kids)] = kids

    def _gains(self, sample: np.ndarray) -> np.ndarray:
        """How much closer than a node's own centroid its best leaf is to the sample rows that pass the node, on average.

        Added to a node's score, it makes bins of different depth comparable in one queue.
        """
        gain = np.zeros(len(self.centroid), dtype=np.float32)

        def down(node: int, rows: np.ndarray) -> np.ndarray:
            own = sample[rows] @ self.centroid[node]
            if not len(self.children[node]):
                return own
            kids = self.children[node]
            near = (sample[rows] @ self.centroid[kids].T).argmax(axis=1)
            best = np.empty(len(rows), dtype=np.float32)
            for j, kid in enumerate(kids):
                best[near == j] = down(kid, rows[near == j])
            gain[node] = (best - own).mean() if len(rows) else 0.0
            return best

        down(0, np.arange(len(sample)))
        return gain

    def visits(self, x: np.ndarray, n: int) -> np.ndarray:
        """The first n leaves of each vector, best bin first; -1 where the tree has fewer. WALK vectors walk at once, so memory doesn't grow with x."""
        return np.concatenate([self._walk(x[i : i + WALK], n) for i in range(0, len(x), WALK)] or [np.zeros((0, n), dtype=np.int64)])

    def _walk(self, x: np.ndarray, n: int) -> np.ndarray:
        """All vectors of the block walk at once. The queue of each holds the nodes it has opened the way to and nothing else; the bins of a
        node that many vectors open are scored in one product.
        """
        m = len(x)
        nodes, score, used = np.zeros((m, 4 * FAN), dtype=np.int32), np.full((m, 4 * FAN), -np.inf, dtype=np.float32), FAN
        opened = np.zeros(m, dtype=np.int64)
        score[:, 0] = 2.0
        out, got, live = np.full((m, n), -1, dtype=np.int64), np.zeros(m, dtype=np.int64), np.arange(m)
        while len(live):
            top = (score[live, :used] if len(live) < m else score[:, :used]).argmax(axis=1)
            some = np.isfinite(score[live, top])
            live, top = live[some], top[some]
            node = nodes[live, top]
            score[live, top] = -np.inf
            inner = self.kids[node, 0] >= 0
            done = live[~inner]
            out[done, got[done]] = node[~inner]
            got[done] += 1
            wide, node = live[inner], node[inner]
            if len(wide):
                opened[wide] += 1
                if (used := max(used, (int(opened.max()) + 1) * FAN)) > score.shape[1]:
                    nodes, score = np.hstack([nodes, np.zeros_like(nodes)]), np.hstack([score, np.full_like(score, -np.inf)])
                order = np.argsort(node, kind="stable")
                wide, node = wide[order], node[order]
                kids, sims = self.kids[node], np.empty((len(wide), FAN), dtype=np.float32)
                starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                sizes = np.diff(np.r_[starts, len(node)])
                for i, size in zip(starts[sizes >= 16], sizes[sizes >= 16]):
                    sims[i : i + size] = x[wide[i : i + size]] @ self.centroid[kids[i]].T
                few = np.flatnonzero(np.repeat(sizes < 16, sizes))
                for i in range(0, len(few), 256):
                    rows = few[i : i + 256]
                    sims[rows] = (self.centroid[kids[rows]] @ x[wide[rows], :, None])[:, :, 0]
                at = opened[wide, None] * FAN + np.arange(FAN)
                nodes[wide[:, None], at] = kids
                score[wide[:, None], at] = np.where(kids >= 0, sims + self.gain[kids], -np.inf)
            live = live[got[live] < n]
        return out


def nearest(docs: DataFrame, id_col: str = "pk", vector_col: str = "embedding", dim: int = 64, k: int = 5, floor: float = 0.85, recall: float = 0.985, leaf_rows: int = 512, visits_from: int = 6) -> DataFrame:
    """``(a, b, similarity)`` with a < b: one of the two is among the k most similar rows of the other and cosine >= floor.

    * Null vectors, vectors of another length, zero vectors and vectors with null, NaN or infinite values take no part;
      rows without id neither. A repeated id counts with one of its vectors. An empty table gives an empty result.
    * Equal directions (equal bytes at length one) tie; the smaller id wins. Only the first k + 1 rows of one direction are indexed: no other
      row can need more of them, and the remaining copies get the k smallest ids of their direction by join.
    * The tree is fitted on at most SAMPLE_ROWS rows, with at least eight of them for each leaf; every row is indexed and searched. Visits are
      widened from ``visits_from``, to all leaves if need be, on PROBES other vectors until the lower bound of the share of their exact partners that
      are met, those found among all rows, reaches ``recall``.
    """
    spark, ws, copies = docs.sparkSession, Workspace(docs.sparkSession, "knn"), k + 1
    source = spread(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")))

    def direction(batches):
        for batch in batches:
            at, x = unit_rows(batch.column(1), dim)
            x32 = x.astype(np.float32)
            mark = [xxhash.xxh3_64_intdigest(r.tobytes()) for r in x32 + np.float32(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(np.array(mark, dtype=np.uint64).view(np.int64)), pa.array([r.tobytes() for r in x32], pa.binary())],
                ["id", "mark", "v"],
            )

    rows = ws.save(source.mapInArrow(direction, "id bigint, mark bigint, v binary"), "rows")
    total, ids_ = rows.agg(F.count("*"), F.count_distinct("id")).first()
    if ids_ < total:
        rows, total = ws.save(rows.groupBy("id").agg(F.min(F.struct("v", "mark")).alias("r")).select("id", "r.mark", "r.v"), "rows"), ids_
    order = Window.partitionBy("mark").orderBy("id")
    first = ws.save(rows.select("id", "mark").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= copies), "first")
    crowded = first.where(F.col("n") == copies).select("mark")
    full = crowded.count()
    main = rows.select("id", "v")
    if full:
        over = rows.select("id", "mark").distinct().join(_small(crowded, full), "mark").join(first.select("mark", "id"), ["mark", "id"], "left_anti").select("id")
        over = ws.save(over, "over")
        main = main.join(_small(over, over.count()), "id", "left_anti")

    leaves = max(1, min(total // leaf_rows, SAMPLE_ROWS // 8))
    wanted = min(total, SAMPLE_ROWS, max(16_384, 16 * leaves))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    cut = int(min(1.0, wanted / max(1, total)) * (1 << 30)) if total > wanted + 4 * PROBES else 1 << 30
    matrix = lambda got: np.frombuffer(b"".join(got), dtype=np.float32).reshape(-1, dim)
    drawn = rows.where(place < cut).select("v")
    sample = np.concatenate([matrix(c.to_pylist()) for c in drawn.toArrow().column("v").chunks] or [matrix([])])
    if not len(sample):
        return spark.createDataFrame([], "a bigint, b bigint, similarity double")
    size, tree = len(sample), Tree(sample, int(min(leaves, max(1, len(sample) // 8))))
    del sample
    shared = spark.sparkContext.broadcast(tree)
    held = rows.where(place >= cut) if cut < 1 << 30 else rows
    probes = held.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(PROBES).select("id", "v").collect()
    visits = calibrate(rows, shared, np.array([r.id for r in probes], dtype=np.int64), matrix([r.v for r in probes]), k, floor, recall, visits_from)

    # leaves expected to hold more than BLOCK rows are dealt into blocks; every pair of blocks meets in a group of its own
    def loads(batches):
        load = np.zeros(len(shared.value.children), dtype=np.int64)
        for batch in batches:
            bins = shared.value.visits(matrix(batch.column(0).to_pylist()), visits)
            load += np.bincount(bins[bins >= 0], minlength=len(load))
        met = np.flatnonzero(load)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(load[met])], ["leaf", "n"])

    load = np.zeros(len(tree.children))
    for leaf, n in drawn.mapInArrow(loads, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n")).collect():
        load[leaf] = n * (total / size)
    blocks = np.maximum(1, np.ceil(load / BLOCK)).astype(np.int64)
    group = grouped(tree.children, load, blocks)

    def route(batches):
        for batch in batches:
            blob = batch.column(1).to_pylist()
            if not blob:
                continue
            x = np.frombuffer(b"".join(blob), dtype=np.float32).reshape(-1, dim)
            ids = batch.column(0).to_numpy()
            small = [r.tobytes() for r in packed(x)]
            for i in range(0, len(x), WALK):
                bins = shared.value.visits(x[i : i + WALK], visits)
                r, c = np.nonzero(bins >= 0)
                leaf, r = bins[r, c], i + r
                many = blocks[leaf]
                mine = (ids[r].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many
                other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                leaf, r, mine = (np.repeat(z, many) for z in (leaf, r, mine))
                pair = np.minimum(mine, other) * (1 << 20) + np.maximum(mine, other)
                # one row for each vector and group, with the leaves of the group that it visits
                order = np.lexsort((leaf, pair, group[leaf], r))
                leaf, r, pair, side = leaf[order], r[order], pair[order], (mine > other)[order]
                new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (group[leaf[1:]] != group[leaf[:-1]]) | (pair[1:] != pair[:-1])])
                held = pa.ListArray.from_arrays(pa.array(np.r_[new, len(r)].astype(np.int32)), pa.array(leaf.astype(np.int32)))
                cols = [group[leaf[new]].astype(np.int32), pair[new], side[new].astype(np.int8), ids[r[new]]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), held, pa.array([small[j] for j in r[new].tolist()], pa.binary())], ["bin", "pair", "side", "id", "leaves", "v"])

    def search(table):
        every, sides = table.column("id").to_numpy(), table.column("side").to_numpy()
        vectors = unpacked(b"".join(table.column("v").to_pylist()), dim)
        lists = table.column("leaves").combine_chunks()
        leaf, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(every)), lists.value_lengths().to_numpy())
        order = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[order])) + 1
        pair = table.column("pair")[0].as_py()
        found = [search_leaf(every[rows], sides[rows], vectors[rows], pair) for rows in np.split(row[order], cuts)]
        a, b, s = (np.concatenate(z) for z in zip(*found))
        best = np.lexsort((-s, b, a))  # a pair that meets in several leaves leaves once
        a, b, s = a[best], b[best], s[best]
        once = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
        return pa.table({"a": a[once], "b": b[once], "similarity": s[once]})

    def search_leaf(ids, side, x, pair):
        order = np.lexsort((ids, side))
        ids, n, cut, x = ids[order], len(ids), int((side == 0).sum()), x[order]
        a, b, s = [], [], []
        low_block, high_block = divmod(pair, 1 << 20)
        turns = [(0, n, 0, n)] if low_block == high_block else [(0, cut, cut, n), (cut, n, 0, cut)]
        for low, high, first, last_ in turns:
            for i in range(low, high, 1024):
                sims = x[i : min(i + 1024, high)] @ x[first:last_].T
                r, c = np.nonzero(sims >= floor - SLACK)
                other = ids[i + r] != ids[first + c]
                r, c = r[other], c[other]
                best = np.lexsort((ids[first + c], -sims[r, c], r))
                r, c = r[best], c[best]
                start = np.searchsorted(r, r)
                last = sims[r[np.minimum(start + k - 1, len(r) - 1)], c[np.minimum(start + k - 1, len(r) - 1)]] if len(r) else sims[:0, 0]
                near = (np.arange(len(r)) - start < k) | (sims[r, c] >= last - SLACK)
                a.append(ids[i + r[near]])
                b.append(ids[first + c[near]])
                s.append(sims[r[near], c[near]].astype(np.float64))
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        return np.minimum(a, b), np.maximum(a, b), np.concatenate(s) if s else np.zeros(0)

    routed = main.mapInArrow(route, "bin int, pair bigint, side byte, id bigint, leaves array<int>, v binary")
    parts = max(width(spark), -(-total * visits * (2 * dim + 32) // PART_BYTES))
    found = routed.repartition(parts, "bin", "pair").groupBy("bin", "pair").applyInArrow(search, "a bigint, b bigint, similarity double")
    found = ws.save(found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "found")

    def exact(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.float32).reshape(-1, dim).astype(np.float64) for i in (2, 3))
            sim = (x * y).sum(axis=1) / np.maximum(1e-12, np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], ["a", "b", "exact"])

    approx = found
    turned = lambda df: df.union(df.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    by = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    ranked = turned(found).withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + copies)
    at = lambda n: F.max(F.when(F.col("n") == n, F.col("similarity"))).over(Window.partitionBy("a"))
    ranked = ranked.withColumns({"last": at(k), "next": at(k + 1)})
    tight = (F.col("last") - F.col("next") <= SLACK) & (F.abs(F.col("similarity") - F.col("last")) <= SLACK)
    doubt = ranked.where(tight | (F.abs(F.col("similarity") - floor) <= SLACK))
    doubt = ws.save(doubt.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "doubt")
    ids = ws.save(doubt.select(F.col("a").alias("id")).union(doubt.select("b")).distinct(), "ids")
    asked = ids.count()
    if asked:
        needed = ws.save(rows.join(_small(ids, asked), "id", "left_semi").dropDuplicates(["id"]).select("id", "v"), "needed")
        vec = lambda n: needed.select(F.col("id").alias(n), F.col("v").alias(f"v{n}"))
        sure = doubt.join(vec("a"), "a").join(vec("b"), "b").select("a", "b", "va", "vb").mapInArrow(exact, "a bigint, b bigint, exact double")
        found = found.join(sure, ["a", "b"], "left").select("a", "b", F.coalesce("exact", "similarity").alias("similarity"))
    scored = ws.save(found.where(F.col("similarity") >= floor), "scored")
    top = turned(scored).withColumn("n", F.row_number().over(by)).where(F.col("n") <= k)
    pairs = top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct()
    if not full:
        out = ws.save(pairs, "pairs")
        ws.drop(rows, first, approx, doubt, ids, scored)
        return out

    heads = first.where(F.col("n") <= k).join(crowded, "mark", "left_semi").select("mark", F.col("id").alias("b"))
    rest = rows.select("id", "mark").distinct().join(crowded, "mark", "left_semi").join(first.select("mark", "id"), ["mark", "id"], "left_anti")
    copies = rest.join(heads, "mark").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"), F.lit(1.0).alias("similarity"))
    out = ws.save(pairs.union(copies), "pairs")
    ws.drop(rows, first, approx, doubt, ids, scored)
    return out


def grouped(children: list[np.ndarray], load: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """A group for each leaf: neighbours in the tree share one up to GROUP routed rows, so that a vector travels once to several leaves. Leaves in blocks stay alone."""
    group, last, size, stack = np.zeros(len(children), dtype=np.int64), 0, 0.0, [0]
    while stack:
        node = stack.pop()
        if len(children[node]):
            stack.extend(children[node][::-1].tolist())
            continue
        if size and (size + load[node] > GROUP or blocks[node] > 1):
            last, size = last + 1, 0.0
        group[node], size = last, size + max(1.0, load[node]) if blocks[node] == 1 else GROUP + 1.0
    return group


def calibrate(rows: DataFrame, shared, ids: np.ndarray, probes: np.ndarray, k: int, floor: float, recall: float, least: int, sure: float = 1.64) -> int:
    """The fewest leaf visits, ``least`` or more, whose recall on the probes is above ``recall`` even at its lower confidence bound; all leaves if need be.

    A pair is met when the two share a visited leaf. Every row is compared with every probe; the rows above the
    floor come back with the probe they belong to, best k of each task, which is bounded by probes x k x tasks.
    """
    dim = probes.shape[1]

    def run(batches):
        held = []
        for batch in batches:
            blob = batch.column(1).to_pylist()
            if not blob:
                continue
            x = np.frombuffer(b"".join(blob), dtype=np.float32).reshape(-1, dim)
            sims = x @ probes.T
            r, c = np.nonzero((sims >= floor) & (batch.column(0).to_numpy()[:, None] != ids[None, :]))
            held.append((c, sims[r, c], x[r]))
        if held:
            c, s, x = (np.concatenate(z) for z in zip(*held))
            best = np.lexsort((-s, c))
            c, s, x = c[best], s[best], x[best]
            near = np.arange(len(c)) - np.searchsorted(c, c) < k
            yield pa.RecordBatch.from_arrays([pa.array(c[near].astype(np.int32)), pa.array(s[near]), pa.array([v.tobytes() for v in x[near]], pa.binary())], ["p", "s", "v"])

    got = rows.select("id", "v").mapInArrow(run, "p int, s float, v binary")
    got = got.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("s")))).where(F.col("n") <= k).select("p", "v").collect()
    if not got:
        return least
    tree, leaves = shared.value, sum(not len(c) for c in shared.value.children)
    theirs_ = np.frombuffer(b"".join(r[1] for r in got), dtype=np.float32).reshape(-1, dim)
    at = np.array([r[0] for r in got])
    most, n = max(8, least), least
    while True:
        step = max(1, MET // most)
        meets = np.concatenate([first_met(tree.visits(probes[at[i : i + step]], most), tree.visits(theirs_[i : i + step], most)) for i in range(0, len(at), step)])
        for n in range(n, most + 1):
            met = np.mean(meets <= n)
            if met - sure * np.sqrt(met * (1 - met) / len(got)) >= recall or n >= leaves:
                return n
        most = min(2 * most, max(leaves, 2))


def first_met(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """After how many visits the two vectors of each row share a leaf; infinite where they never do."""
    found = np.full(len(mine), np.inf)
    for i, (a, b) in enumerate(zip(mine, theirs)):
        _, p, q = np.intersect1d(a[a >= 0], b[b >= 0], assume_unique=True, return_indices=True)
        if len(p):
            found[i] = np.maximum(p, q).min() + 1
    return found
