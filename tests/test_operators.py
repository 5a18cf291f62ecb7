import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwork import dialect
from tarnwork.functions import stats, vectors
from tarnwork.operators import dedup
from tarnwork.operators.components import connected_components
from tarnwork.operators.hash_prefix import running_totals
from tarnwork.runtime import Workspace


@given(st.integers(0, dedup.PRIME - 1), st.integers(0, dedup.PRIME - 1))
@settings(max_examples=300)
def test_times_mod(a, x):
    assert int(dedup.times_mod(np.array([a], np.uint64), np.array([x], np.uint64))[0]) == a * x % dedup.PRIME


def test_signature():
    assert dedup.signature("") == [0xFFFFFFFF] * 128 and dedup.signature(None) is None
    assert dedup.signature("abcabc") == dedup.signature("abcabcabc") and len(dedup.signature("a")) == 128


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (2, 1), (None, 3)] + [(100 + i, 101 + i) for i in range(30)]
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Workspace(spark)).collect())
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and got[9] == got[8] == 8 and {got[100 + i] for i in range(31)} == {100} and got[5] == 5


def test_running_totals(spark):
    rows = spark.range(500).select(F.lit("g").alias("g"), "id", F.md5(F.col("id").cast("string")).alias("o"), (F.col("id") % 7).alias("w"))
    got = running_totals(rows, "g", "o", "id", "w").orderBy("o").collect()
    at = 0
    for r in got:
        assert r.before == at
        at += r.w


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 2.0]), (5, [1.0])], "vec_id int, embedding array<float>")
    got = [(r.vec_id, round(r.similarity, 4)) for r in vectors.top_k(rows, [1.0, 0.0], 5).collect()]
    assert got == [(1, 1.0), (4, 0.7071)]
    assert vectors.strategy(10**6, 0.5) == "index" and vectors.strategy(10**6, 0.0005) == "exact"
    codes = vectors.rabitq(rows, 2, 1).where("code is not null").count()
    assert codes == 3


def test_histogram_and_selectivity(spark):
    hist = stats.histogram(spark.range(1000).withColumn("v", F.col("id") % 10), "v", 5).orderBy("bucket").collect()
    assert sum(h.rows for h in hist) == 1000 and sum(h.distinct for h in hist) == 10
    assert abs(stats.equality_selectivity(hist, 3, 1000) - 0.1) < 1e-9 and stats.range_selectivity([], 1, 2, 9) == 0.33


def test_dialect():
    assert dialect.statements("a; 'x;y' ; -- z;\n") == ["a", "'x;y'"]
    sql, v = dialect.split_version("SELECT 'AT VERSION 1' AS x FROM t AT VERSION 'r1' CONSISTENCY 'SEMANTIC_FRESH'")
    assert v.value == "r1" and v.mode == "SEMANTIC_FRESH" and "AT VERSION 1" in sql
    assert dialect.split_not_duplicate("SELECT * FROM t WHERE NOT DUPLICATE AND a = 1")[0].split() == "SELECT * FROM t WHERE a = 1".split()
    assert "LAST" in dialect.place_nulls("SELECT * FROM t ORDER BY a LIMIT 1") and "DESC NULLS FIRST" in dialect.place_nulls("SELECT a FROM t ORDER BY b DESC")
    assert dialect.place_nulls("SELECT a FROM t ORDER BY f(a, b), c DESC NULLS LAST") == "SELECT a FROM t ORDER BY f(a, b) NULLS LAST, c DESC NULLS LAST"


def test_half_floats_and_hamming(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9, None)], "vec_id bigint, embedding array<float>")
    back = {r.vec_id: r.restored for r in vectors.fp16_restored(vectors.fp16(rows)).collect()}
    assert back[9] is None and all(np.allclose(back[i], x[i], rtol=2**-11, atol=1e-7) for i in range(6))
    signs = x.astype(np.float64) @ vectors.rotation(16, 3).T > 0
    codes = vectors.rabitq(rows, 16, 3)
    pairs = codes.select("vec_id", "code").crossJoin(codes.where("vec_id = 0").select(F.col("code").alias("other")))
    got = {r.vec_id: r.d for r in pairs.select("vec_id", vectors.hamming("code", "other").alias("d")).collect()}
    assert got[9] is None and all(got[i] == (signs[i] != signs[0]).sum() for i in range(6))


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((90, 8)).astype(np.float32)
    x[7] = x[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 8), (901, None)], "vec_id bigint, embedding array<float>")
    got = vectors.nearest_in_blocks(rows, rows.where("vec_id % 10 = 3"), 2, block=16).collect()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for q in range(3, 90, 10):
        sims = u @ u[q]
        sims[q] = -9
        assert {r.vec_id for r in got if r.q == q} == set(np.argsort(-sims, kind="stable")[:2].tolist())
    assert len(got) == 18


def test_core_groups(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{text} {i}") for i in range(5, 45)] + [(1, None), (2, ""), (3, "other words"), (4, "other words"), (50, "something else entirely, long enough")]
    table = spark.createDataFrame(rows, "id bigint, text string")
    want = {(5, i) for i in range(5, 45)} | {(3, 3), (3, 4)}
    assert {tuple(r) for r in dedup.similar_groups(table, "id", "text").collect()} == want
    assert {tuple(r) for r in dedup.similar_groups(table.orderBy(F.desc("id")).repartition(5), "id", "text").collect()} == want
    assert {tuple(r) for r in dedup.equal_groups(table, "id", "text").collect()} == {(3, 3), (3, 4)}
    assert dedup.similar_groups(table.limit(0), "id", "text").collect() == []


def test_batch_signatures():
    texts = ["a", "ab", "abc", "abcabc", "Größe 日本語 \U0001f600\U0001f601 x", "z" * 9000 + "end", " ".join(str(i * i) for i in range(4000)), "\0\0\0"]
    assert dedup.signatures(texts).tolist() == [dedup.signature(t) for t in texts] and dedup.signatures([]).shape == (0, 128)


def test_core_groups_of_texts_that_share_parts(spark):
    """Texts put together from the same sentences meet in many buckets; the groups are those of all pairs, and little is written for them."""
    rng = np.random.default_rng(3)
    parts = [" ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(5)) for _ in range(24)]
    texts = [" ".join(parts[k] for k in rng.choice(24, 9, replace=False)) for _ in range(900)]
    texts += [t[: 8 * k] + t[8 * k + 4 :] for k, t in enumerate(texts[:30])] + [texts[40] + " " + "".join(rng.choice(list("klmno"), 3)) for _ in range(30)] + texts[:5]
    sig = dedup.signatures(texts)
    owner = list(range(len(texts)))
    for i in range(len(texts)):
        for j in np.flatnonzero((sig[:i] == sig[i]).mean(axis=1) >= 0.8):
            low, high = sorted((owner[i], owner[j]))
            owner = [low if o == high else o for o in owner]
    want = {(owner[i], i) for i in range(len(texts)) if owner.count(owner[i]) > 1}
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    assert {tuple(r) for r in dedup.similar_groups(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text").collect()} == want
    assert written() - before < 2_000_000
