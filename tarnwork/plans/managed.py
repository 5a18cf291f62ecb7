"""Registered queries over managed tables: changes, versions and exports through the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.engine import Engine, content_hash
from tarnwork.runtime import Workspace, load


def _orders(spark, sf) -> Engine:
    """A fresh engine that holds the orders table."""
    db = Engine(spark, f"{Workspace(spark, 'managed').root}")
    db.execute("CREATE TABLE managed_orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT, o_orderstatus TEXT, o_totalprice DOUBLE PRECISION)")
    db.upsert("managed_orders", load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    return db


def dml_update_case(spark, sf):
    db = _orders(spark, sf)
    db.execute("UPDATE managed_orders SET o_totalprice = CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice * 2 END WHERE o_custkey % 2 = 0")
    return db.sql("SELECT o_orderkey, round(o_totalprice, 2) AS price FROM managed_orders")


def dml_delete(spark, sf):
    db = _orders(spark, sf)
    db.execute("DELETE FROM managed_orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000")
    return db.sql("SELECT o_orderstatus, count(*) AS n FROM managed_orders GROUP BY o_orderstatus")


def dml_upsert(spark, sf):
    db = _orders(spark, sf)
    more = load(spark, sf, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") + F.when(F.col("o_custkey") % 2 == 0, 0).otherwise(10_000_000)).alias("o_orderkey"), "o_custkey", F.lit("U").alias("o_orderstatus"), "o_totalprice")
    db.upsert("managed_orders", more)
    return db.sql("SELECT o_orderstatus, count(*) AS n FROM managed_orders GROUP BY o_orderstatus")


def managed_at_version(spark, sf):
    db = _orders(spark, sf)
    db.execute("CREATE VERSION TAG 'before'")
    db.execute("DELETE FROM managed_orders WHERE o_custkey < 500")
    db.compact("managed_orders")
    return db.sql("SELECT o_orderstatus, count(*) AS n FROM managed_orders GROUP BY o_orderstatus AT VERSION 'before'")


def training_export_rows(spark, sf):
    db = _orders(spark, sf)
    db.create_training_snapshot("t", 7)
    db.execute("DELETE FROM managed_orders WHERE o_orderstatus = 'F'")
    return spark.read.parquet(db.training_dataset("t", "managed_orders"))


def content_hash_query(spark, sf):
    """The hash stays under another layout and changes with one value, one row or a repeated row."""
    rows = load(spark, sf, "orders")
    n, mark = content_hash(rows)
    one = F.when(F.col("o_orderkey") == 77, 0.5).otherwise(F.col("o_totalprice"))
    others = [rows.withColumn("o_totalprice", one), rows.where("o_orderkey <> 77"), rows.union(rows.where("o_orderkey = 77"))]
    changed = len({mark, *[content_hash(r)[1] for r in others]}) == 4
    return spark.createDataFrame([(n, content_hash(rows.repartition(7)) == (n, mark), changed)], "n bigint, stable boolean, changed boolean")


def fn_int_division(spark, sf):
    return _orders(spark, sf).sql("SELECT o_orderkey, o_custkey / 7 AS d, -o_custkey / 7 AS nd, o_totalprice / 2 AS half FROM managed_orders")


def not_duplicate_join(spark, sf):
    db = Engine(spark, Workspace(spark, "managed").root)
    db.execute("CREATE TABLE m_customer (c_custkey BIGINT PRIMARY KEY, c_nationkey BIGINT, c_acctbal DOUBLE PRECISION, _near_duplicate_group BIGINT)")
    db.execute("CREATE TABLE m_nation (n_nationkey BIGINT PRIMARY KEY, n_regionkey BIGINT)")
    db.upsert("m_customer", load(spark, sf, "customer").withColumn("_near_duplicate_group", F.col("c_nationkey").cast("bigint")))
    db.upsert("m_nation", load(spark, sf, "nation"))
    return db.sql("SELECT c.c_custkey, n.n_regionkey FROM m_customer c JOIN m_nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 5000 AND n.n_regionkey < 3 AND NOT DUPLICATE")


VERSION = 5000


def _history(spark, sf) -> Engine:
    """Events as the change log of a table keyed by user: an event's id is its time, an error removes the row."""
    db = Engine(spark, Workspace(spark, "history").root)
    db.execute("CREATE TABLE last_event (user_id BIGINT PRIMARY KEY, event_id BIGINT, event_type TEXT, value DOUBLE PRECISION)")
    log = load(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    db.store.load_log("last_event", log.withColumns({"_commit_ts": F.col("event_id").cast("bigint"), "_op": F.when(F.col("event_type") == "error", "D").otherwise("U")}))
    return db


def scan_latest(spark, sf):
    return _history(spark, sf).sql("SELECT user_id, event_id, event_type, value FROM last_event")


def as_of_version(spark, sf):
    return _history(spark, sf).sql(f"SELECT user_id, event_id, event_type, value FROM last_event AT VERSION {VERSION}")


def as_of_group_by(spark, sf):
    return _history(spark, sf).sql(f"SELECT event_type, count(*) AS n FROM last_event GROUP BY event_type AT VERSION {VERSION}")


def as_of_compacted(spark, sf):
    db = _history(spark, sf)
    db.store.compact("last_event", [VERSION])
    return db.sql(f"SELECT user_id, event_id FROM last_event AT VERSION {VERSION}")


def version_diff(spark, sf):
    store = _history(spark, sf).store
    return store.diff("last_event", VERSION, store.last_ts()).select(F.col("pk").cast("bigint").alias("user_id"), "change")


def gc_keep(spark, sf):
    store = _history(spark, sf).store
    store.compact("last_event", [VERSION])
    return store.log("last_event").select("event_id")


STATE = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events{}) t WHERE r = 1 AND event_type <> 'error'"
THEN, NOW = STATE.format(f" WHERE event_id <= {VERSION}"), STATE.format("")
DIFF = f"""
SELECT coalesce(a.user_id, b.user_id) AS user_id,
       CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM ({THEN}) a FULL JOIN ({NOW}) b ON a.user_id = b.user_id WHERE a.event_id IS DISTINCT FROM b.event_id
"""
KEPT = f"""
WITH n AS (SELECT user_id, max(event_id) AS now, max(event_id) FILTER (WHERE event_id <= {VERSION}) AS pinned FROM events GROUP BY user_id)
SELECT DISTINCT e.event_id FROM events e JOIN n USING (user_id)
WHERE e.event_id = pinned OR (e.event_id = now AND (e.event_type <> 'error' OR pinned IS NOT NULL))
"""
CHOSEN = """
SELECT c.c_custkey, n.n_regionkey
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(c_custkey AS VARCHAR)) AS r FROM customer WHERE c_acctbal > 5000) c
JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE r = 1 AND n.n_regionkey < 3
"""


QUERIES = {
    "dml_update_case": (dml_update_case, "SELECT o_orderkey, round(CASE WHEN o_custkey % 2 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice * 2 END ELSE o_totalprice END, 2) AS price FROM orders"),
    "dml_delete": (dml_delete, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'O' AND o_totalprice > 100000) GROUP BY o_orderstatus"),
    "dml_upsert": (dml_upsert, "SELECT s AS o_orderstatus, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' AND o_custkey % 2 = 0 THEN 'U' ELSE o_orderstatus END AS s FROM orders UNION ALL SELECT 'U' FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 2 <> 0) GROUP BY s"),
    "managed_at_version": (managed_at_version, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"),
    "training_export_rows": (training_export_rows, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"),
    "content_hash": (content_hash_query, "SELECT count(*) AS n, true AS stable, true AS changed FROM orders"),
    "fn_int_division": (fn_int_division, "SELECT o_orderkey, o_custkey // 7 AS d, -(o_custkey // 7) AS nd, o_totalprice / 2 AS half FROM orders"),
    "not_duplicate_join": (not_duplicate_join, CHOSEN),
    "scan_latest": (scan_latest, NOW),
    "as_of_version": (as_of_version, THEN),
    "as_of_group_by": (as_of_group_by, f"SELECT event_type, count(*) AS n FROM ({THEN}) GROUP BY event_type"),
    "as_of_compacted": (as_of_compacted, f"SELECT user_id, event_id FROM ({THEN})"),
    "version_diff": (version_diff, DIFF),
    "gc_keep": (gc_keep, KEPT),
}


def queries():
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items()}
