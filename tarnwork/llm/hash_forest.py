"""Deduplicating batches against history with a prefix-tree hash forest (p1).

A text's signature is read in TREES orders; the first DEPTH slots of an order make its key in that tree, so the texts
that share a prefix lie in one key range. A run is a table of keys sorted by place (tree, then key) with the range of every file
in the forest's manifest, and a table of texts sorted by id. A batch looks up its ranges: only files whose range meets one are
read. Prefixes start at full depth and widen until the recall measured on held-out texts is met; exact trigram sets decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm.shingles import U, alike, bits, blocks, digest, hopeful, jaccard, mix, signatures, trigrams
from tarnwork.runtime import Workspace, spread
from tarnwork.sources.manifest import Manifest

TREES, DEPTH, PART, PASSES = 16, 6, 9, 2
FIRST, STEP, PROBES, PRIOR = 16, 16, 64, 4
ROWS_PER_FILE, MOST_FILES, ONE_TASK, SMALL = 1 << 18, 1 << 16, 1_000_000, 500_000
ENTRY = "id bigint, digest binary, norm string, size int, places array<bigint>, f bigint, g bigint"


def places(slots: np.ndarray) -> np.ndarray:
    """The place of each text in every tree: the tree's number, then DEPTH parts of PART bits; a prefix is a range."""
    parts = (mix(slots[:, : TREES * DEPTH]) >> U(64 - PART)).reshape(-1, TREES, DEPTH)
    at = np.broadcast_to(np.arange(TREES, dtype=U), parts.shape[:2])
    for d in range(DEPTH):
        at = (at << U(PART)) | parts[:, :, d]
    return at.astype(np.int64)


def missed(similarity, depth: int):
    """The chance that a pair of this similarity shares no prefix of ``depth`` parts in any tree."""
    return (1 - similarity**depth) ** TREES


def entries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Signatures of the texts that take part."""

    def run(batches):
        for batch in batches:
            for ids, norms in blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size, slots = signatures(norms, PASSES)
                at, two = places(slots), bits(slots)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * TREES), pa.array(at.reshape(-1)))
                cols = [pa.array(ids, pa.int64()), pa.array([digest(t) for t in norms], pa.binary()), pa.array(norms, pa.string())]
                cols += [pa.array(size.astype(np.int32)), keys, pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "digest", "norm", "size", "places", "f", "g"])

    return spread(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, ENTRY)


def hits(values: DataFrame, low: str, high: str, runs: list[list]) -> list[list[int]]:
    """Per run the numbers of the files whose [low, high] range meets a range of ``values``.

    ``runs`` holds [lows, highs] of each run's files in order. What comes back is bounded by the number of files.
    """

    def run(batches):
        cover = [np.zeros(len(lows) + 1, dtype=np.int64) for lows, _ in runs]
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c, (lows, highs) in zip(cover, runs):
                first, last = np.searchsorted(highs, a, "left"), np.searchsorted(lows, b, "right")
                some = first < last
                np.add.at(c, first[some], 1)
                np.add.at(c, last[some], -1)
        found = [np.flatnonzero(np.cumsum(c)[:-1] > 0) for c in cover]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(runs)), [len(x) for x in found]).astype(np.int32)), pa.array(np.concatenate(found).astype(np.int32))], ["run", "file"]
        )

    got = values.select(low, high).mapInArrow(run, "run int, file int").distinct().collect()
    return [sorted(r.file for r in got if r.run == i) for i in range(len(runs))]


class HashForest:
    """Accepted texts as sorted runs below ``path``, and the search for a batch among them.

    The manifest below ``path`` names the runs, so any later session opens the forest by its path alone and goes on; a batch
    that fails half-way leaves the forest as it was. History is never signed again: of its keys a batch reads the files its ranges
    meet, of its texts those that hold a proposed partner. ``fanout`` runs of like size are merged into one, so a row is rewritten
    about log(rows) times. ``path`` defaults to a fresh folder in the shared folder.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, threshold: float = 0.8, target: float = 0.9999, fanout: int = 4, rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.ws = spark, Workspace(spark, "forest")
        self.path = (path or f"{self.ws.root}-runs").rstrip("/")
        self.manifest = Manifest(spark, self.path, {"threshold": threshold, "depth": None, "recall": None, "runs": [], "batches": []})
        self.threshold, self.target, self.fanout, self.rows_per_file = self.state["threshold"], target, fanout, rows_per_file
        self.ask_from, self.files_read = spark.sparkContext.defaultParallelism, {}

    @property
    def state(self) -> dict:
        return self.manifest.state

    @property
    def depth(self) -> int:
        """Parts of a prefix; without anything held out, by the similarity at the threshold alone."""
        if self.state["depth"] is None:
            self._choose({})
        return self.state["depth"]

    # -- storing ------------------------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, name: str, order: str, tie: str, most: int) -> None:
        """Write a table in order; ``most`` rows at most."""
        files = max(1, min(MOST_FILES, -(-most // self.rows_per_file)))
        placed = rows.repartitionByRange(files, order, tie) if files > 1 else rows.coalesce(1)
        placed.sortWithinPartitions(order).write.option("compression", "zstd").parquet(f"{self.path}/{name}")

    def _run(self, keys: DataFrame, texts: DataFrame, most: int) -> dict:
        """Write a run of ``most`` texts at most; it counts once the manifest names it. Files are [name, low, high] in order."""
        self.state["serial"] = self.state.get("serial", 0) + 1
        mark = f"{self.manifest.number:06d}-{self.state['serial']:06d}-{self.ws.root[-12:]}"
        self._write(keys, f"keys-{mark}", "place", "id", most * TREES)
        self._write(texts, f"texts-{mark}", "id", "id", most)
        name = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")
        spans = [self.spark.read.parquet(f"{self.path}/{p}-{mark}").select(F.lit(p).alias("part"), name, F.col(c).alias("v")) for p, c in (("keys", "place"), ("texts", "id"))]
        got = spans[0].unionByName(spans[1]).groupBy("part", "file").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).collect()
        parts = {p: {"dir": f"{p}-{mark}", "files": sorted(([r.file, r.low, r.high] for r in got if r.part == p), key=lambda f: f[1:])} for p in ("keys", "texts")}
        return {"rows": sum(r.n for r in got if r.part == "texts")} | parts

    def _read(self, run: dict, part: str, files: list[int] | None = None) -> DataFrame | None:
        names = run[part]["files"] if files is None else [run[part]["files"][i] for i in files]
        if not names:
            return None
        schema = "place bigint, id bigint, size int, f bigint, g bigint" if part == "keys" else "id bigint, norm string"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{run[part]['dir']}/{f[0]}" for f in names])

    def _union(self, parts: list) -> DataFrame | None:
        out = None
        for p in parts:
            if p is not None:
                out = p if out is None else out.unionByName(p)
        return out

    def _level(self, run: dict) -> int:
        return int(np.log(max(1, run["rows"])) / np.log(self.fanout) + 1e-9)

    def add(self, accepted: DataFrame, most: int, **batch) -> None:
        """Persist accepted entries, one per distinct text and ``most`` at most, as a new run; merge runs of like size; publish."""
        keys = accepted.select(F.explode("places").alias("place"), "id", "size", "f", "g")
        new, drop = self._run(keys, accepted.select("id", "norm"), most), []
        if new["rows"]:
            self.state["runs"].append(new)
        while True:
            levels: dict[int, list] = {}
            for r in self.state["runs"]:
                levels.setdefault(self._level(r), []).append(r)
            full = next((rs for _, rs in sorted(levels.items()) if len(rs) >= self.fanout), None)
            if full is None:
                break
            parts = [self._union([self._read(r, p) for r in full]) for p in ("keys", "texts")]
            merged = self._run(*parts, sum(r["rows"] for r in full))
            self.state["runs"] = [r for r in self.state["runs"] if r not in full] + [merged]
            drop += full
        self.state["batches"].append({"accepted": new["rows"]} | batch)
        self.manifest.publish()
        for r in drop:
            for p in ("keys", "texts"):
                self.manifest.files.delete(f"{self.path}/{r[p]['dir']}")

    def seed(self, history: DataFrame, id_col: str = "id", text_col: str = "text") -> None:
        """Accept every row without a check. Equal texts are kept once, under their smallest id."""
        ws = Workspace(self.spark, "forest-seed")
        once = self._once(ws.save(entries(history, id_col, text_col), "every"), ws)
        self.calibrate(once)
        self.add(once, once.count())
        ws.drop_all()

    def _once(self, every: DataFrame, ws: Workspace) -> DataFrame:
        """The first row of each distinct text."""
        n = F.row_number().over(Window.partitionBy("digest").orderBy("id"))
        return ws.save(every.withColumn("n", n).where("n = 1").drop("n"), "once")

    # -- widening -----------------------------------------------------------------------------------------------------------

    def calibrate(self, reps: DataFrame) -> None:
        """Choose the prefix depth on PROBES held-out texts, whose exact partners are found among all of ``reps``."""
        threshold = self.threshold
        probes = reps.orderBy(F.xxhash64("id"), "id").limit(PROBES).select("id", "norm", "size", "places", "f", "g").collect()
        if not probes:
            return self._choose({})
        ids, size, two = np.array([p.id for p in probes]), np.array([p["size"] for p in probes]), np.array([[p.f, p.g] for p in probes]).view(U)
        grams, at = [trigrams(p.norm) for p in probes], np.array([p.places for p in probes])

        def run(batches):
            total, met, loss = np.zeros(DEPTH + 1), np.zeros(DEPTH + 1), np.zeros(DEPTH + 1)
            for batch in batches:
                own, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                mine = np.stack([batch.column(4).to_numpy(), batch.column(5).to_numpy()], axis=1).view(U)
                differ = np.bitwise_count(mine[:, None, 0] ^ two[None, :, 0]).astype(int) + np.bitwise_count(mine[:, None, 1] ^ two[None, :, 1])
                small, large = np.minimum(n[:, None], size[None, :]), np.maximum(n[:, None], size[None, :])
                r, c = np.nonzero((differ < 45) & (small >= threshold * large) & (own[:, None] != ids[None, :]))
                for i, j in zip(r.tolist(), c.tolist()):
                    s = jaccard(trigrams(batch.column(1)[i].as_py()), grams[j])
                    if s >= threshold:
                        apart = np.array(batch.column(3)[i].as_py()) ^ at[j]
                        shared = DEPTH - min(-(-int(x).bit_length() // PART) for x in apart)
                        d = np.arange(DEPTH + 1)
                        total += 1
                        met += d <= shared
                        loss += missed(s, d)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DEPTH + 1, dtype=np.int32)), pa.array(total), pa.array(met), pa.array(loss)], ["d", "total", "met", "loss"])

        seen = reps.select("id", "norm", "size", "places", "f", "g").mapInArrow(run, "d int, total double, met double, loss double")
        self._choose({r.d: r for r in seen.groupBy("d").agg(*[F.sum(c).alias(c) for c in ("total", "met", "loss")]).collect()})

    def _choose(self, seen: dict) -> None:
        """Widen from full depth until the recall meets the target.

        The recall of a depth is what the held-out pairs' similarities and PRIOR pairs right at the threshold let expect, and not more than
        the share of held-out pairs really met where there are enough of them to tell.
        """
        for depth in range(DEPTH, 0, -1):
            r = seen.get(depth)
            total, met, loss = (r.total, r.met, r.loss) if r else (0.0, 0.0, 0.0)
            recall = 1 - (loss + PRIOR * missed(self.threshold, depth)) / (total + PRIOR)
            if total * (1 - self.target) >= 1:
                recall = min(recall, met / total)
            if recall >= self.target:
                break
        self.state["depth"], self.state["recall"] = depth, float(recall)

    def _met(self, edges: DataFrame, heads: DataFrame) -> tuple[int, float, int]:
        """In one job: the number of links, the share of all links that those found stand for, and the most heads of a range.

        A link's weight is the reciprocal of its chance to be met at this depth.
        """
        odds = 1 - F.pow(1 - F.pow("similarity", F.lit(self.depth)), F.lit(TREES))
        links = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(1 / odds), F.lit(0.0)).alias("all"), F.lit(0).alias("most"))
        ranges = heads.agg(F.lit(0).alias("n"), F.lit(0.0).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
        n, every, most = links.union(ranges).agg(F.sum("n"), F.sum("all"), F.max("most")).first()
        return n, (n + PRIOR) / (every + PRIOR / (1 - missed(self.threshold, self.depth))), most

    # -- searching ----------------------------------------------------------------------------------------------------------

    def _small(self, df: DataFrame, n: int) -> DataFrame:
        """A counted table of numbers: sent to every task up to SMALL rows, shuffled beyond."""
        return F.broadcast(df) if n <= SMALL else df

    def _mine(self, reps: DataFrame) -> DataFrame:
        shift = PART * (DEPTH - self.depth)
        return reps.select(F.explode("places").alias("place"), "id", "size", "f", "g").select(F.shiftright("place", shift).alias("prefix"), "id", "size", "f", "g")

    def _pick(self, part: str, spans: DataFrame) -> DataFrame | None:
        """The rows of all runs from the files that meet a span (low, high); as few files as cores are read without asking."""
        runs = self.state["runs"]
        every = sum(len(r[part]["files"]) for r in runs)
        if every <= self.ask_from:
            met = [None] * len(runs)
        else:
            met = hits(spans, "low", "high", [[np.array([f[i] for f in r[part]["files"]]) for i in (1, 2)] for r in runs])
        self.files_read[part] = every if not met or met[0] is None else sum(map(len, met))
        return self._union([self._read(r, part, files) for r, files in zip(runs, met)])

    def _there(self, mine: DataFrame, n: int) -> DataFrame | None:
        """The accepted keys in the ranges of ``mine``, n rows at most, read from the files whose ranges they meet."""
        shift = PART * (DEPTH - self.depth)
        low = F.shiftleft("prefix", shift)
        rows = self._pick("keys", mine.select(low.alias("low"), (low + F.lit((1 << shift) - 1)).alias("high")))
        if rows is None:
            return None
        rows = rows.select(F.shiftright("place", shift).alias("prefix"), "id", "size", "f", "g")
        return rows.join(self._small(mine.select("prefix"), n), "prefix", "left_semi")

    def _verified(self, pairs: DataFrame, reps: DataFrame, pool: DataFrame) -> DataFrame:
        full = pairs.join(pool.select(F.col("id").alias("other"), F.col("norm").alias("norm_b")), "other").join(reps.select("id", F.col("norm").alias("norm_a")), "id")
        return alike(full.select(F.col("id").alias("a"), F.col("other").alias("b"), "norm_a", "norm_b"), self.threshold).toDF("id", "other", "similarity")

    def _against(self, pairs: DataFrame, reps: DataFrame, ws: Workspace) -> DataFrame:
        """Links of the pairs (id, other) to accepted texts."""
        pairs = ws.save(pairs, "pairs")
        pool = self._pick("texts", pairs.select(F.col("other").alias("low"), F.col("other").alias("high")))
        return ws.save(self._verified(pairs, reps, pool), "edges") if pool is not None else self.spark.createDataFrame([], "id bigint, other bigint, similarity double")

    def _past(self, mine: DataFrame, reps: DataFrame, n: int, ws: Workspace) -> tuple[DataFrame, float]:
        """(id, match_id) and the recall: the smallest accepted id that each text resembles; the id itself if it was accepted before.

        The FIRST lowest ids of every range are compared first; what they find bounds the rest, for only smaller ids can
        change it, and a range whose next id lies above the match is left before anything is joined. So a range full of mutually
        similar texts doesn't pair each newcomer with all of them.
        """
        there = self._there(mine, n)
        if there is None:
            return self.spark.createDataFrame([], "id bigint, match_id bigint"), 1.0
        there = ws.save(there, "there")
        first = Window.partitionBy("prefix").orderBy("id")
        heads = ws.save(there.withColumn("n", F.row_number().over(first)).where(F.col("n") <= FIRST + 1), "heads")
        low = mine.alias("o").join(heads.where(F.col("n") <= FIRST).alias("h"), "prefix").where("h.id <= o.id").where(hopeful("o", "h", self.threshold))
        edges = self._against(low.select(F.col("o.id").alias("id"), F.col("h.id").alias("other")).distinct(), reps, ws)
        _, recall, most = self._met(edges, heads)
        found = edges.groupBy("id").agg(F.min("other").alias("match_id"))
        if most > FIRST:
            ends = heads.where(F.col("n") == FIRST + 1).select("prefix", F.col("id").alias("next"))
            left = mine.join(ends, "prefix").join(found, "id", "left").where("next <= id and (match_id is null or match_id > next)")
            deep = left.alias("o").join(there.alias("h"), "prefix").where("h.id >= o.next and h.id <= o.id and (o.match_id is null or h.id < o.match_id)")
            deep = deep.where(hopeful("o", "h", self.threshold)).select(F.col("o.id").alias("id"), F.col("h.id").alias("other")).distinct()
            more = self._against(deep, reps, ws)
            found = edges.unionByName(more).groupBy("id").agg(F.min("other").alias("match_id"))
        return ws.save(found, "past"), recall

    def _within(self, mine: DataFrame, reps: DataFrame, ws: Workspace) -> DataFrame:
        """(id, match_id) of the cases among rows that resemble nothing accepted before; every other row is to be accepted.

        Each range compares its members with its lowest ids, FIRST at first and STEP times as many in each further round; cases leave
        before the next round. A range of mutually similar texts is so down to its accepted rows after one round.
        """
        gone, edges, tested, late, cap = None, None, None, None, FIRST
        order = Window.partitionBy("prefix").orderBy("id")
        while True:
            live = mine if gone is None else mine.join(gone.select("id"), "id", "left_anti")
            heads = ws.save(live.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap + 1), "heads")
            pairs = live.alias("o").join(heads.where(F.col("n") <= cap).alias("h"), "prefix").where("h.id < o.id").where(hopeful("o", "h", self.threshold))
            pairs = pairs.select(F.col("o.id").alias("id"), F.col("h.id").alias("other")).distinct()
            pairs = ws.save(pairs if tested is None else pairs.join(tested, ["id", "other"], "left_anti"), "pairs")
            new = ws.save(self._verified(pairs, reps, reps), "inner")
            edges, tested = new if edges is None else edges.unionByName(new), pairs if tested is None else tested.unionByName(pairs)
            n, _, most = self._met(edges, heads)
            if most <= cap:
                cases = self._settle(edges, n, None, ws)
                break
            ends = heads.where(F.col("n") == cap + 1).select("prefix", F.col("id").alias("next"))
            unsure = ws.save(live.join(ends, "prefix").where("id > next").select("id").distinct(), "unsure")
            cases = self._settle(edges, n, unsure, ws)
            early = cases.join(unsure, "id", "left_semi").select("id")
            late = early if late is None else late.unionByName(early)
            gone, cap = cases, cap * STEP
        if late is None:
            return cases
        kept = mine.join(cases.select("id"), "id", "left_anti")
        lowest = kept.groupBy("prefix").agg(F.min("id").alias("lowest"))
        asked = mine.join(cases.join(late.distinct(), "id", "left_semi"), "id").join(lowest, "prefix").where("lowest < match_id")
        pairs = asked.alias("o").join(kept.alias("h"), "prefix").where("h.id < o.match_id").where(hopeful("o", "h", self.threshold))
        pairs = pairs.select(F.col("o.id").alias("id"), F.col("h.id").alias("other")).distinct().join(tested, ["id", "other"], "left_anti")
        below = self._verified(ws.save(pairs, "below"), reps, reps).groupBy("id").agg(F.min("other").alias("match_id"))
        return ws.save(cases.unionByName(below).groupBy("id").agg(F.min("match_id").alias("match_id")), "cases")

    def _settle(self, edges: DataFrame, n: int, unsure: DataFrame | None, ws: Workspace) -> DataFrame:
        """(id, match_id) of the rows that surely are cases, from n links to smaller ids; ``unsure`` rows may have links yet unseen.

        A row without link to a smaller id is accepted unless unsure; a row linked to an accepted one is a case. Links beyond ONE_TASK
        are settled in rounds, the lowest rows of all chains at once; the rest in order by one task, as numbers only.
        """
        decided, rest = None, edges.select("id", "other")
        doubt = unsure if unsure is not None else self.spark.createDataFrame([], "id bigint")
        while n > ONE_TASK:
            sure = rest.select(F.col("other").alias("id")).distinct().join(rest.select("id").distinct(), "id", "left_anti").join(doubt, "id", "left_anti")
            hit = ws.save(rest.join(sure.select(F.col("id").alias("other")), "other", "left_semi").select("id").distinct(), "hit")
            if not hit.limit(1).count():
                break
            decided = hit if decided is None else decided.unionByName(hit)
            rest = ws.save(rest.join(hit, "id", "left_anti").join(hit.select(F.col("id").alias("other")), "other", "left_anti"), "rest")
            n = rest.count()

        def run(batches):
            got = list(batches)
            if not got:
                return
            table = pa.Table.from_batches(got)
            ids, others = table.column("id").to_numpy(), table.column("other").to_pylist()
            open_ = {i for i, o in zip(ids.tolist(), others) if o is None}
            state, match = {}, {}
            for k in np.argsort(ids, kind="stable").tolist():
                i, o = int(ids[k]), others[k]
                if o is None:
                    continue
                before = state.get(o, "open" if o in open_ else "kept")
                if before == "kept":
                    state[i], match[i] = "case", min(o, match.get(i, o))
                elif state.get(i) != "case":
                    state[i] = "open" if before == "open" or i in open_ or state.get(i) == "open" else "kept"
            for i in open_ & set(state):
                if state[i] == "kept":
                    state[i] = "open"
            yield pa.RecordBatch.from_arrays([pa.array(list(match), pa.int64()), pa.array(list(match.values()), pa.int64())], ["id", "match_id"])

        if unsure is not None:
            ends = rest.select("id").union(rest.select("other")).distinct()
            rest = rest.unionByName(doubt.join(ends, "id", "left_semi").select("id", F.lit(None).cast("bigint").alias("other")))
        cases = ws.save(rest.repartition(1).mapInArrow(run, "id bigint, match_id bigint"), "settled")
        if decided is None:
            return cases
        every = decided.unionByName(cases.select("id"))
        kept = edges.select("id", "other").join(every.select(F.col("id").alias("other")), "other", "left_anti")
        waits = rest.select("id").unionByName(doubt).join(every, "id", "left_anti")
        kept = kept.join(waits.select(F.col("id").alias("other")), "other", "left_anti") if unsure is not None else kept
        return ws.save(kept.join(every, "id", "left_semi").groupBy("id").agg(F.min("other").alias("match_id")), "settled")

    def check(self, batch: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
        """``(match_id, id)`` of the batch's repeats; everything else of the batch is accepted and added.

        Rows count in the order of id. Ids must be unique and ascend over batches; a repeated row counts once, and a row accepted by
        an earlier batch is neither case nor added again. Texts that are null, empty or shorter than 40 characters are neither cases nor
        kept; rows without id are skipped; other columns are ignored. Equal texts inside the batch are settled with their first row. An
        empty forest or batch is allowed.
        """
        ws, self.files_read = Workspace(self.spark, "forest-batch"), {}
        every = ws.save(entries(batch, id_col, text_col), "batch")
        reps = self._once(every, ws)
        n = reps.count()
        while True:
            mine = self._mine(reps)
            past, recall = self._past(mine, reps, n * TREES, ws)
            if recall >= self.target or self.depth == 1:
                break
            self.state["depth"] -= 1
        cases = self._within(mine.join(past.select("id"), "id", "left_anti"), reps, ws)
        best = past.unionByName(cases)
        firsts = reps.select("digest", F.col("id").alias("rep")).join(best.withColumnRenamed("id", "rep"), "rep", "left")
        found = every.select("id", "digest").distinct().join(firsts, "digest").select(F.coalesce("match_id", "rep").alias("match_id"), "id").where("match_id < id")
        found = self.ws.save(found, "found")
        self.add(reps.join(best.select("id"), "id", "left_anti"), n, depth=self.depth, recall=recall)
        ws.drop_all()
        return found

    def close(self) -> None:
        """Remove the forest itself; results stay."""
        self.manifest.files.delete(self.path)


def repeats(docs: DataFrame, batch_col: str = "batch_no", history: int = 0, id_col: str = "id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(match_id, id)`` over all batches after ``history``, in order of batch number.

    Rows without batch number are never taken. An empty table gives an empty result. Without ``path`` the forest is removed at the end.
    """
    spark = docs.sparkSession
    forest = HashForest(spark, path)
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(batch_col).alias("batch"))
    forest.seed(cols.where(F.col("batch") == history))
    later = [r[0] for r in cols.where(F.col("batch") > history).select("batch").distinct().orderBy("batch").collect()]
    out = forest._union([forest.check(cols.where(F.col("batch") == b)) for b in later])
    if path is None:
        forest.close()
    return out if out is not None else spark.createDataFrame([], "match_id bigint, id bigint")
