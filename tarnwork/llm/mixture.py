"""Mixing sources to target weights by hierarchical budgets (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.tokens import VOCABULARY, counts
from tarnwork.operators.hash_prefix import priority, running_totals
from tarnwork.runtime import Workspace


def fill(budget: float, weights: dict, room: dict) -> dict:
    """Divide a budget by weight; what a full child can't take goes to its siblings by weight, until all are full."""
    got, open_ = dict.fromkeys(weights, 0.0), {k for k in weights if weights[k] > 0 and room[k] > 0}
    left = min(budget, sum(room[k] for k in open_))
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if weights[k] / total * left >= room[k] - got[k]}
        if not full:
            for k in open_:
                got[k] += weights[k] / total * left
            break
        for k in full:
            left -= room[k] - got[k]
            got[k] = room[k]
        open_ -= full
    return got


def budgets(tree: dict, weights: dict, room: dict, total: float) -> dict:
    """Budgets of the leaves of a nested dict, top down.

    Keys are paths. A node's room is what its leaves can give, so a shortage below a node is settled among siblings there,
    and only what all of them lack is missing at the node and goes to its own siblings.
    """

    def space(path: tuple, node: dict) -> float:
        return room[path] if not node else sum(space((*path, k), v) for k, v in node.items())

    def down(path: tuple, node: dict, budget: float) -> dict:
        if not node:
            return {path: budget}
        kids = {k: (*path, k) for k in node}
        parts = fill(budget, {k: weights[p] for k, p in kids.items()}, {k: space(p, node[k]) for k, p in kids.items()})
        out = {}
        for k, p in kids.items():
            out |= down(p, node[k], parts[k])
        return out

    return down((), tree, total)


def language(col: str = "lang"):
    """The two-letter language in lower case, ``und`` where there is none; so there are at most 677 of them."""
    code = F.lower(F.regexp_extract(F.trim(F.col(col)), "^([A-Za-z]{2})(?:[-_].*)?$", 1))
    return F.when(code != "", code).otherwise("und")


class Mixture:
    """A corpus in which sources have their target shares of tokens.

    The tree is domain, language, source: a source's weight is its share, spread over its languages by their tokens.
    ``domain_of`` maps sources to domains; unnamed sources share one. A domain's and a language's weight is the sum below it.
    The corpus has as many tokens as the targeted documents have, or ``total``. Each leaf is read in whole seeded epochs
    and then the shortest prefix of the next epoch's order whose last document still lies at least half inside the budget.

    Documents without target, without id, or without tokens are not used; a repeated doc_id counts once, with its first
    source in order. Targets that are null or not above zero count as no target; max_repeats null counts as 1. Sources without
    documents get share 0. Empty tables give empty results.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, path: str = VOCABULARY, seed: int = 7, total: float | None = None, domain_of: dict | None = None):
        spark = docs.sparkSession
        ws = Workspace(spark, "mix")
        shared = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))
        self.targets = [r for r in shared.where("source is not null").collect()]
        live = {r.source: r for r in self.targets if r.share and r.share > 0 and r.most > 0}
        used = docs.where(F.col("source").isin(*live) & F.col("doc_id").isNotNull()) if live else docs.limit(0)
        sized = counts(used.select("doc_id", "source", language().alias("lang"), "text"), ["doc_id", "source", "lang"], path=path)
        once = sized.groupBy("doc_id").agg(F.min(F.struct("source", "lang", "tokens")).alias("d")).select("doc_id", "d.*")
        once = once.where("tokens > 0").withColumn("leaf", F.concat_ws("/", "source", "lang"))
        self.sized = ws.save(once, "sized")
        leaves = self.sized.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).collect()
        have = {}
        for r in leaves:
            have[r.source] = have.get(r.source, 0) + r.tokens
        tree, weights, room = {}, {}, {}
        for r in sorted(leaves):
            path_ = ((domain_of or {}).get(r.source, "all"), r.lang, r.source)
            node = tree
            for i, k in enumerate(path_):
                node = node.setdefault(k, {})
                weights[path_[: i + 1]] = weights.get(path_[: i + 1], 0) + live[r.source].share * r.tokens / have[r.source]
            room[path_] = r.tokens * live[r.source].most
        self.total = float(sum(have.values()) if total is None else total)
        plan = budgets(tree, weights, room, self.total) if tree else {}
        tokens = {(r.source, r.lang): r.tokens for r in leaves}
        self.plan = [(f"{s}/{lang}", int(b // tokens[s, lang]), float(b - b // tokens[s, lang] * tokens[s, lang])) for (_, lang, s), b in plan.items()]
        self.seed, self.ws, self.spark = seed, ws, spark

    def documents(self) -> DataFrame:
        """``(doc_id, source, tokens, repeats)`` of the chosen documents."""
        schema = "leaf string, epochs int, rest double"
        plan = F.broadcast(self.spark.createDataFrame(self.plan, schema) if self.plan else self.spark.createDataFrame([], schema))
        rows = self.sized.join(plan, "leaf").withColumn("order", priority(self.seed, F.col("epochs"), F.col("doc_id")))
        placed = running_totals(rows, "leaf", "order", "doc_id", "tokens")
        extra = (F.col("before") + F.col("tokens") / 2 <= F.col("rest")).cast("int")
        return placed.withColumn("repeats", F.col("epochs") + extra).where("repeats > 0").select("doc_id", "source", "tokens", F.col("repeats").cast("int").alias("repeats"))

    def shares(self) -> DataFrame:
        """``(source, target_share, tokens, documents, actual_share)`` of every target."""
        goals = self.spark.createDataFrame([(r.source, r.share) for r in self.targets], "source string, target_share double")
        got = self.documents().groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"))
        full = goals.join(got, "source", "left").withColumn("all", F.sum("tokens").over(Window.partitionBy(F.lit(1))))
        n = F.coalesce("tokens", F.lit(0))
        return full.select("source", "target_share", n.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.round(n / F.col("all"), 6).alias("actual_share"))
