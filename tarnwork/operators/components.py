"""Connected components of an edge list as written-table iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.runtime import Workspace


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``edges(a, b)`` of bigint to ``(id, comp)``: comp is the smallest id reachable from id.

    Smallest-label propagation with pointer jumping. Each round is written to the shared folder, so
    its lineage stays one round long; only the number of changed rows reaches the driver. Messages are
    combined before the shuffle, so a node with very many edges sends one row per task. Null ends,
    self loops and repeated edges have no effect beyond making the node known; an empty edge list gives
    an empty result.
    """
    clean = edges.select("a", "b").where("a is not null and b is not null")
    both = ws.save(clean.union(clean.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = ws.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("offer")), "b")
        heard = seen.groupBy(F.col("a").alias("id")).agg(F.min("offer").alias("heard"))
        step = labels.join(heard, "id", "left").select("id", "comp", F.least("comp", "heard").alias("near"))
        far = labels.select(F.col("id").alias("near"), F.col("comp").alias("jump"))
        moved = step.join(far, "near", "left").select("id", F.col("comp").alias("old"), F.least("near", "jump").alias("comp"))
        new = ws.save(moved, "labels")
        changed = new.where("comp <> old").limit(1).count()
        ws.drop(labels)
        labels = new.select("id", "comp")
        labels._tarnwork_path = new._tarnwork_path
        if not changed:
            ws.drop(both)
            return labels
