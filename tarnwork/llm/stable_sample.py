"""A reproducible sample that keeps its records as the data grows (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.hash_prefix import priority, running_totals
from tarnwork.runtime import Workspace
from tarnwork.sources.manifest import Manifest

FRACTION = 0.1


class SelectionLedger:
    """Keys seen and selected so far under each seed, as tables below ``path`` that its manifest names.

    ``take`` keeps every key of the ledger that the new export still has and fills the rest of the quota,
    ceil(fraction x distinct keys), from keys never seen before, lowest priority first; seen keys
    that were not selected follow only when the unseen ones run out. A later session opens the ledger by its path and goes on; a
    draw that fails half-way leaves it as it was. Without ``path`` it lies in a fresh folder of the shared folder.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.ws = spark, Workspace(spark, "ledger")
        self.path = (path or f"{self.ws.root}-state").rstrip("/")
        self.manifest = Manifest(spark, self.path, {"serial": 0, "past": {}, "draws": {}})

    def _keep(self, df: DataFrame, name: str) -> str:
        self.manifest.state["serial"] += 1
        folder = f"{name}-{self.manifest.state['serial']:06d}-{self.ws.root[-12:]}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return folder

    def _past(self, seed: str) -> DataFrame | None:
        folder = self.manifest.state["past"].get(seed)
        return folder and self.spark.read.schema("primary_key string, selected boolean").parquet(f"{self.path}/{folder}")

    def drawn(self, draw: str) -> DataFrame:
        """The sample of an earlier draw."""
        return self.spark.read.schema("primary_key string, priority string, position bigint").parquet(f"{self.path}/{self.manifest.state['draws'][draw]}")

    def take(self, keys: DataFrame, seed, fraction: float = FRACTION, draw: str | None = None) -> DataFrame:
        """``(primary_key, priority, position)`` of the sample of the keys; position counts from 1.

        Null keys are left out, repeated rows of a key count once, an empty export gives an empty sample.
        A null seed counts as 0. A ``draw`` of a name known to the ledger gives what it gave before and changes nothing.
        """
        state, ws = self.manifest.state, Workspace(self.spark, "draw")
        if draw in state["draws"]:
            return self.drawn(draw)
        seed = 0 if seed is None else seed
        name, past = str(seed), self._past(str(seed))
        now = keys.where("primary_key is not null").select("primary_key").distinct().withColumn("priority", priority(seed, F.col("primary_key")))
        now = now.join(past, "primary_key", "left") if past is not None else now.withColumn("selected", F.lit(None).cast("boolean"))
        rank = F.when(F.col("selected"), "0").when(F.col("selected").isNull(), "1").otherwise("2")
        now = ws.save(now.select("primary_key", "priority", rank.alias("class"), F.lit(1).alias("one")), "now")
        size = {r[0]: r[1] for r in now.groupBy("class").count().collect()}
        total, kept = sum(size.values()), size.get("0", 0)
        left = max(0, -int(-(round(fraction * total, 9)) // 1) - kept)
        fresh = min(left, size.get("1", 0))
        limit = F.when(F.col("class") == "1", fresh).otherwise(left - fresh)
        ranked = running_totals(now.where("class <> '0'"), "class", "priority", "primary_key", "one")
        chosen = now.where("class = '0'").select("primary_key", "priority").union(ranked.where(F.col("before") < limit).select("primary_key", "priority"))
        placed = running_totals(chosen.withColumns({"all": F.lit("a"), "one": F.lit(1)}), "all", "priority", "primary_key", "one")
        state["draws"][draw or f"draw {state['serial']}"] = folder = self._keep(placed.select("primary_key", "priority", (F.col("before") + 1).cast("bigint").alias("position")), "draw")
        out = self.spark.read.schema("primary_key string, priority string, position bigint").parquet(f"{self.path}/{folder}")
        seen = now.select("primary_key").join(out.select("primary_key", F.lit(True).alias("hit")), "primary_key", "left")
        seen = seen.select("primary_key", F.coalesce("hit", F.lit(False)).alias("selected"))
        if past is not None:
            seen = past.unionByName(seen).groupBy("primary_key").agg(F.bool_or("selected").alias("selected"))
        old, state["past"][name] = state["past"].get(name), self._keep(seen, "past")
        self.manifest.publish()
        ws.drop_all()
        if old:
            self.manifest.files.delete(f"{self.path}/{old}")
        return out


def tag_samples(exported: DataFrame, tags: DataFrame, prefix: str = "docs_", fraction: float = FRACTION, path: str | None = None) -> DataFrame:
    """``(tag_name, primary_key, position)`` of the sample of each training tag whose name begins with ``prefix``.

    Tags are taken by created_at, then name; those sharing a seed share a ledger. Position is null unless the tag's
    deterministic_order is true. Tags not for training, null tags and tags without rows have no sample. With ``path`` the ledger there
    goes on: tags it knows keep their sample, only new ones are drawn.
    """
    spark = exported.sparkSession
    ledger, parts = SelectionLedger(spark, path), []
    wanted = tags.where(F.col("for_training") & F.col("tag_name").startswith(prefix)).select("tag_name", "seed", "deterministic_order", "created_at")
    wanted = wanted.dropDuplicates(["tag_name"]).orderBy(F.asc_nulls_last("created_at"), "tag_name").collect()
    keys = exported.where(F.col("tag_name").isin([t.tag_name for t in wanted]) & F.col("primary_key").isNotNull()).select("tag_name", "primary_key").distinct()
    keys = ledger.ws.save(keys, "keys", by=["tag_name"]) if wanted else keys
    for tag in wanted:
        rows = keys.where(F.col("tag_name") == tag.tag_name).select("primary_key")
        place = F.col("position") if tag.deterministic_order else F.lit(None).cast("bigint")
        parts.append(ledger.take(rows, tag.seed, fraction, tag.tag_name).select(F.lit(tag.tag_name).alias("tag_name"), "primary_key", place.alias("position")))
    if not parts:
        return spark.createDataFrame([], "tag_name string, primary_key string, position bigint")
    ledger.ws.drop(keys)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def oracle(tags: int = 5, fraction: float = FRACTION) -> str:
    """The same sample in SQL, one step for each of the first ``tags`` docs tags; all of them share one seed."""
    sql = ["tag AS (SELECT *, row_number() OVER (ORDER BY created_at, tag_name) AS step FROM training_tag WHERE for_training AND starts_with(tag_name, 'docs_'))",
           "keys AS (SELECT DISTINCT t.step, e.primary_key, md5(concat_ws(':', CAST(coalesce(t.seed, 0) AS VARCHAR), e.primary_key)) AS p FROM exported_row e JOIN tag t USING (tag_name) WHERE e.primary_key IS NOT NULL)",
           "s0 AS (SELECT primary_key, false AS hit FROM keys WHERE false)"]
    for i in range(1, tags + 1):
        sql.append(f"n{i} AS (SELECT k.primary_key, k.p, CASE WHEN s.hit THEN 0 WHEN s.hit IS NULL THEN 1 ELSE 2 END AS c FROM keys k LEFT JOIN s{i - 1} s USING (primary_key) WHERE k.step = {i})")
        sql.append(f"r{i} AS (SELECT *, row_number() OVER (ORDER BY c, p, primary_key) AS r, count(*) OVER () AS total, count(*) FILTER (WHERE c = 0) OVER () AS kept FROM n{i})")
        sql.append(f"t{i} AS (SELECT primary_key, p FROM r{i} WHERE r <= greatest(kept, CAST(ceil(round({fraction} * total, 9)) AS BIGINT)))")
        sql.append(f"s{i} AS (SELECT primary_key, bool_or(hit) AS hit FROM (SELECT * FROM s{i - 1} UNION ALL SELECT n.primary_key, t.primary_key IS NOT NULL FROM n{i} n LEFT JOIN t{i} t USING (primary_key)) GROUP BY primary_key)")
    parts = " UNION ALL ".join(f"SELECT {i} AS step, primary_key, row_number() OVER (ORDER BY p, primary_key) AS position FROM t{i}" for i in range(1, tags + 1))
    return f"WITH {', '.join(sql)} SELECT tag_name, primary_key, CASE WHEN deterministic_order THEN position END AS position FROM ({parts}) JOIN tag USING (step)"
