"""Registered queries of the vector, statistics, duplicate and copy operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwork.functions import stats, vectors
from tarnwork.operators import dedup
from tarnwork.runtime import load

PROBE = 7
COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
FROM = f"FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {PROBE}) q"


def _probe(spark, sf):
    rows = load(spark, sf, "embeddings")
    return rows, rows.where(F.col("vec_id") == PROBE).first()["embedding"]


def _scored(fn):
    def query(spark, sf):
        rows, probe = _probe(spark, sf)
        q = F.array(*[F.lit(float(x)) for x in probe])
        return rows.select("vec_id", F.round(fn(F.col("embedding"), q), 6).alias("score"))

    return query


def vec_normalize(spark, sf):
    rows = load(spark, sf, "embeddings")
    return rows.select("vec_id", F.round(vectors.norm(vectors.normalize(F.transform("embedding", lambda x: x * 3))), 6).alias("length"), F.round(vectors.normalize(F.col("embedding"))[0], 6).alias("first"))


def _top(k=10, threshold=None, where=None):
    def query(spark, sf):
        rows, probe = _probe(spark, sf)
        near = vectors.top_k(rows.where(where) if where else rows, probe, k, threshold)
        return near.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))

    return query


def vec_threshold(spark, sf):
    rows, probe = _probe(spark, sf)
    q = F.array(*[F.lit(float(x)) for x in probe])
    return rows.select("vec_id", F.round(vectors.cosine(F.col("embedding"), q), 6).alias("similarity")).where("similarity >= 0.2")


def vec_group_by(spark, sf):
    near = _top(100)(spark, sf)
    return near.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("similarity"), 5).alias("best"))


def vec_join(spark, sf):
    near = _top(50)(spark, sf)
    nation = load(spark, sf, "nation")
    return near.join(nation, near.label == nation.n_nationkey).select("vec_id", "n_name", "similarity")


def vec_knn_join(spark, sf):
    """Every vector whose id divides by 50 against all rows, the three most similar others."""
    rows = load(spark, sf, "embeddings").select("vec_id", "embedding")
    near = vectors.nearest_in_blocks(rows, rows.where("vec_id % 50 = 0"), 3)
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "vec_id"))
    return near.select("q", "vec_id", best.alias("r"))


def vec_sq8_roundtrip(spark, sf):
    coded = vectors.sq8(load(spark, sf, "embeddings"))
    return coded.select("vec_id", F.aggregate("codes", F.lit(0), lambda s, x: s + x).cast("bigint").alias("codes"), F.round(F.sqrt(vectors.l2_squared(F.col("embedding"), F.col("restored"))), 4).alias("error"))


def vec_rabitq(spark, sf):
    return vectors.rabitq(load(spark, sf, "embeddings"), 64, 11).select("vec_id", F.hex("code").alias("code"))


def vec_fp16(spark, sf):
    """Half floats take two bytes and restore each number to half a unit in its eleventh bit."""
    there = vectors.fp16_restored(vectors.fp16(load(spark, sf, "embeddings")))
    close = F.forall(F.zip_with("embedding", "restored", lambda x, y: F.abs(x - y) <= F.abs(x) * 2.0**-11 + 2.0**-25), lambda ok: ok)
    return there.select("vec_id", F.length("half").alias("bytes"), close.alias("close"))


def near_dup_exact(spark, sf):
    return dedup.equal_groups(load(spark, sf, "docs"), "id", "text")


def near_dup_minhash(spark, sf):
    return dedup.similar_groups(load(spark, sf, "docs"), "id", "text")


EQUAL, SPANS = (1, 10, 25, 50), ((1, 10), (5, 5), (20, 50))


def selectivity_eq(spark, sf):
    """Estimated shares of single values from the histogram that ANALYZE builds."""
    rows = load(spark, sf, "lineitem")
    hist, total = stats.histogram(rows, "l_quantity").orderBy("bucket").collect(), rows.count()
    return spark.createDataFrame([(v, round(stats.equality_selectivity(hist, v, total), 8)) for v in EQUAL], "value int, share double")


def selectivity_range(spark, sf):
    rows = load(spark, sf, "lineitem")
    hist, total = stats.histogram(rows, "l_quantity").orderBy("bucket").collect(), rows.count()
    return spark.createDataFrame([(a, b, round(stats.range_selectivity(hist, a, b, total), 8)) for a, b in SPANS], "low int, high int, share double")


HISTOGRAM = """
WITH f AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1),
p AS (SELECT v, n, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS posn, sum(n) OVER () AS total FROM f),
h AS (SELECT floor(posn * 100 / total) AS bucket, min(v) AS low, max(v) AS high, sum(n) AS rows, count(*) AS nd, any_value(total) AS total FROM p GROUP BY 1)
"""


def approx_ndv(spark, sf):
    return stats.approx_ndv(load(spark, sf, "events"))


def histogram_equi_height(spark, sf):
    return stats.histogram(load(spark, sf, "lineitem"), "l_extendedprice").select("bucket", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), "rows", "distinct")


def correlation_matrix(spark, sf):
    got = stats.correlations(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return got.select("a", "b", F.round("r", 6).alias("r"))


def null_fraction(spark, sf):
    return stats.null_fraction(load(spark, sf, "docs"), ["text", "category", "created_at"]).select("column", F.round("fraction", 8).alias("fraction"))


def stable_reservoir(spark, sf):
    return stats.sample(load(spark, sf, "orders"), "o_orderkey", 1000).select("o_orderkey")


def _grouped(spark, sf, where=None):
    docs = load(spark, sf, "documents").where(where or "true")
    groups = docs.where("text is not null").groupBy("text").agg(F.min("doc_id").alias("g"), F.count("*").alias("n")).where("n > 1")
    return docs.join(groups.select("text", "g"), "text", "left")


def not_duplicate(spark, sf):
    return dedup.not_duplicate(_grouped(spark, sf), "g", "doc_id").select("doc_id")


def not_duplicate_filtered(spark, sf):
    return dedup.not_duplicate(_grouped(spark, sf, "lang = 'en'"), "g", "doc_id").select("doc_id")


def minhash_signature(spark, sf):
    docs = load(spark, sf, "docs").select("id", dedup.minhash("text").alias("s"))
    return docs.select("id", F.size("s").alias("slots"), F.hex(F.xxhash64("s")).alias("mark"))


def copy_round_trip(spark, sf):
    """Rows as copy lines and back."""
    from tarnwork.sources.copy import from_lines, to_lines

    nation = load(spark, sf, "nation")
    return from_lines(to_lines(nation), nation.schema)


N5 = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY CAST(doc_id AS VARCHAR)) AS r, text FROM documents {}) WHERE r = 1 OR text IS NULL"
QUERIES = {
    "vec_cosine": (_scored(vectors.cosine), f"SELECT vec_id, round({COS}, 6) AS score {FROM}"),
    "vec_dot": (_scored(vectors.dot), f"SELECT vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score {FROM}"),
    "vec_l2": (_scored(vectors.l2_squared), f"SELECT vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2, 6) AS score {FROM}"),
    "vec_normalize": (vec_normalize, "SELECT vec_id, 1.0::DOUBLE AS length, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings"),
    "vec_topk": (_top(), f"SELECT vec_id, label, round({COS}, 6) AS similarity {FROM} ORDER BY {COS} DESC, vec_id LIMIT 10"),
    "vec_threshold": (vec_threshold, f"SELECT vec_id, round({COS}, 6) AS similarity {FROM} WHERE round({COS}, 6) >= 0.2"),
    "vec_hybrid": (_top(10, None, "label in (1, 2, 3)"), f"SELECT vec_id, label, round({COS}, 6) AS similarity {FROM} WHERE label IN (1, 2, 3) ORDER BY {COS} DESC, vec_id LIMIT 10"),
    "vec_group_by": (vec_group_by, f"SELECT label, count(*) AS n, round(max(s), 5) AS best FROM (SELECT label, round({COS}, 6) AS s {FROM} ORDER BY {COS} DESC, vec_id LIMIT 100) GROUP BY label"),
    "vec_join": (vec_join, f"SELECT vec_id, n_name, similarity FROM (SELECT vec_id, label, round({COS}, 6) AS similarity {FROM} ORDER BY {COS} DESC, vec_id LIMIT 50) JOIN nation ON label = n_nationkey"),
    "vec_knn_join": (vec_knn_join, "SELECT q, vec_id, r FROM (SELECT a.vec_id AS q, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE r <= 3"),
    "vec_sq8_roundtrip": (vec_sq8_roundtrip, "WITH f AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT pos, min(x) AS low, CASE WHEN max(x) - min(x) < 1e-9 THEN 1.0 ELSE max(x) - min(x) END AS r FROM f GROUP BY pos), c AS (SELECT vec_id, x, low, r, CAST(round((x - low) / r * 255) AS INT) AS code FROM f JOIN m USING (pos)) SELECT vec_id, CAST(sum(code) AS BIGINT) AS codes, round(sqrt(sum((x - (code / 255.0::DOUBLE * r + low)) ** 2)), 4) AS error FROM c GROUP BY vec_id"),
    "vec_rabitq": (vec_rabitq, None),
    "vec_fp16": (vec_fp16, "SELECT vec_id, CAST(2 * len(embedding) AS INT) AS bytes, true AS close FROM embeddings"),
    "approx_ndv": (approx_ndv, None),
    "histogram_equi_height": (histogram_equi_height, "WITH f AS (SELECT l_extendedprice AS v, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT v, n, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS posn, sum(n) OVER () AS total FROM f) SELECT CAST(floor(posn * 100 / total) + 1 AS INT) AS bucket, round(min(v), 2) AS low, round(max(v), 2) AS high, CAST(sum(n) AS BIGINT) AS rows, count(*) AS \"distinct\" FROM p GROUP BY 1"),
    "correlation_matrix": (correlation_matrix, " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" if a != b else f"SELECT '{a}' AS a, '{b}' AS b, 1.0::DOUBLE AS r" for a in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))),
    "null_fraction": (null_fraction, " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0 END), 8) AS fraction FROM docs" for c in ("text", "category", "created_at"))),
    "stable_reservoir": (stable_reservoir, None),
    "not_duplicate": (not_duplicate, N5.format("")),
    "not_duplicate_filtered": (not_duplicate_filtered, N5.format("WHERE lang = 'en'")),
    "minhash_signature": (minhash_signature, None),
    "near_dup_exact": (near_dup_exact, "SELECT m AS group_id, id AS key FROM (SELECT id, min(id) OVER (PARTITION BY text) AS m, count(*) OVER (PARTITION BY text) AS n FROM docs WHERE text IS NOT NULL) WHERE n > 1"),
    "near_dup_minhash": (near_dup_minhash, None),
    "selectivity_eq": (selectivity_eq, HISTOGRAM + f"SELECT CAST(v AS INT) AS value, round(CAST(rows AS DOUBLE) / nd / total, 8) AS share FROM h JOIN (SELECT unnest({list(EQUAL)}) AS v) ON v BETWEEN low AND high"),
    "selectivity_range": (selectivity_range, HISTOGRAM + "SELECT CAST(a AS INT) AS low, CAST(b AS INT) AS high, round((sum(CASE WHEN a <= h.low AND h.high <= b THEN rows ELSE 0 END) + sum(CASE WHEN NOT (a <= h.low AND h.high <= b) AND h.low <= b AND h.high >= a THEN rows ELSE 0 END) / 2) / any_value(total), 8) AS share FROM h, (VALUES " + ", ".join(map(str, SPANS)) + ") t(a, b) GROUP BY a, b"),
    "copy_round_trip": (copy_round_trip, "SELECT * FROM nation"),
}


def queries():
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
