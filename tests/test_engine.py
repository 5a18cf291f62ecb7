import pytest

from tarnwork.engine import Engine
from tarnwork.errors import EngineError


@pytest.fixture
def db(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


@pytest.fixture(scope="module")
def boats(spark, tmp_path_factory):
    db = Engine(spark, str(tmp_path_factory.mktemp("boats")))
    db.execute("CREATE TABLE boat (hull INT PRIMARY KEY, title TEXT, harbour TEXT, tons INT, afloat BOOLEAN)")
    db.execute("INSERT INTO boat VALUES (11,'Tern','Oban',45,true),(12,'Skua','Mallaig',7,false),(13,'Auk','Oban',31,true),(14,'Gannet','Lerwick',212,true),(15,'Shag','Mallaig',NULL,false)")
    db.execute("CREATE TABLE harbour (town TEXT PRIMARY KEY, berths INT); INSERT INTO harbour VALUES ('Oban',40),('Lerwick',90),('Wick',12)")
    return db


@pytest.mark.parametrize(
    ("sql", "rows"),
    [
        ("SELECT title FROM boat WHERE hull = 14", [("Gannet",)]),
        ("SELECT hull FROM boat WHERE harbour = 'Oban' OR tons >= 200 ORDER BY hull", [(11,), (13,), (14,)]),
        ("SELECT hull FROM boat WHERE afloat AND tons < 100 ORDER BY tons DESC", [(11,), (13,)]),
        ("SELECT hull FROM boat WHERE NOT afloat ORDER BY tons", [(12,), (15,)]),
        ("SELECT hull FROM boat WHERE tons IS NULL OR title LIKE 'T%' ORDER BY hull", [(11,), (15,)]),
        ("SELECT count(*) AS n, count(tons) AS known, sum(tons) AS s, max(title) AS z FROM boat", [(5, 4, 295, "Tern")]),
        ("SELECT harbour, min(tons) AS t FROM boat GROUP BY harbour HAVING count(*) > 1 ORDER BY harbour", [("Mallaig", 7), ("Oban", 31)]),
        ("SELECT title FROM boat ORDER BY tons LIMIT 2 OFFSET 1", [("Auk",), ("Tern",)]),
        ("SELECT title FROM boat ORDER BY tons DESC LIMIT 1", [("Shag",)]),
        ("SELECT h.town, count(b.hull) AS n FROM harbour h LEFT JOIN boat b ON b.harbour = h.town GROUP BY h.town ORDER BY h.town", [("Lerwick", 1), ("Oban", 2), ("Wick", 0)]),
        ("SELECT harbour FROM boat EXCEPT SELECT town FROM harbour", [("Mallaig",)]),
        ("SELECT tons / 2 AS half, tons / 2.0 AS h, -tons / 2 AS neg FROM boat WHERE hull = 11", [(22, 22.5, -22)]),
        ("SELECT 7/2 AS x, 1 + 9/2*2 AS y", [(3, 9)]),
    ],
)
def test_conformance(boats, sql, rows):
    assert [tuple(float(v) if hasattr(v, "as_tuple") else v for v in r.values()) for r in boats.execute(sql)] == rows


def test_changes_and_versions(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT, v INT)")
    db.execute("INSERT INTO t VALUES (1,'oak',1),(2,'elm',2)")
    db.execute("CREATE VERSION TAG 'one' FOR TRAINING WITH TRAINING PRECISION 'float32' TRAINING SEED 42")
    assert db.execute("UPDATE t SET v = v + 10, name = 'ash' WHERE id = 1 AND name LIKE 'o%'") == 1
    assert db.execute("DELETE FROM t WHERE id = 2") == 1
    now = [{"id": 1, "name": "ash", "v": 11}]
    then = [{"id": 1, "name": "oak", "v": 1}, {"id": 2, "name": "elm", "v": 2}]
    assert db.execute("SELECT * FROM t ORDER BY id") == now
    assert db.execute("SELECT * FROM t ORDER BY id AT VERSION 'one'") == then
    assert db.execute("SELECT * FROM t WHERE name = 'oak'") == []
    assert db.compact("t") == 3
    assert db.execute("SELECT * FROM t ORDER BY id AT VERSION 'one'") == then
    db.execute("ALTER TABLE t SET STORAGE ROW")
    assert db.execute("SELECT * FROM t") == now
    a, b = db.training_dataset("one", "t"), db.training_dataset("one", "t")
    assert db.spark.read.parquet(a).count() == 2
    marks = {r["content_hash"] for r in db.execute("SELECT content_hash FROM training_exports")}
    assert len(marks) == 1 and a != b
    with pytest.raises(EngineError, match="25006"):
        db.execute("DELETE FROM training_exports")
    again = Engine(db.spark, db.path)
    assert again.execute("SELECT * FROM t") == now


@pytest.mark.parametrize(
    ("sql", "state"),
    [
        ("INSERT INTO k VALUES (1, 'x')", "23505"), ("INSERT INTO k VALUES (NULL, 'x')", "23502"), ("SELECT * FROM missing", "42P01"),
        ("SELECT 1 / 0 AS x FROM k", "22012"), ("CREATE TABLE k (id INT)", "42P07"), ("CREATE FUNCTION f", "0A000"), ("UPDATE k SET id = 2", "428C9"),
        ("INSERT INTO k VALUES (2)", "42601"), ("SELECT * FROM k WHERE SEMANTIC_MATCH(v, 'x', 0.5) OR id = 1", "0A000"),
    ],
)
def test_errors(db, sql, state):
    db.execute("CREATE TABLE k (id INT PRIMARY KEY, v TEXT); INSERT INTO k VALUES (1, 'a')")
    with pytest.raises(EngineError) as e:
        db.execute(sql)
    assert e.value.sqlstate == state


def test_not_duplicate(db):
    db.execute("CREATE TABLE page (n INT PRIMARY KEY, words INT, kind TEXT, _near_duplicate_group BIGINT)")
    db.execute("INSERT INTO page VALUES (20,3,'x',7),(21,9,'a order by b',7),(22,9,'x',8),(23,9,'x',8),(24,1,'x',NULL),(25,1,'x',NULL)")
    db.execute("CREATE TABLE mark (n INT PRIMARY KEY, w INT); INSERT INTO mark VALUES (20,0),(21,5),(22,5),(23,5)")
    ids = lambda sql: [r["n"] for r in db.execute(sql)]
    assert ids("SELECT n FROM page WHERE NOT DUPLICATE ORDER BY n") == [20, 22, 24, 25]
    assert ids("SELECT p.n FROM page p WHERE p.words > 5 AND NOT DUPLICATE ORDER BY p.n") == [21, 22]
    assert ids("SELECT n FROM page WHERE kind = 'a order by b' AND NOT DUPLICATE") == [21]
    assert ids("SELECT page.n FROM page JOIN mark ON page.n = mark.n WHERE mark.w > 1 AND page.words BETWEEN 5 AND 9 AND NOT DUPLICATE ORDER BY page.n") == [21, 22]


def test_transactions(db):
    db.execute("CREATE TABLE stock (item INT PRIMARY KEY, n INT); INSERT INTO stock VALUES (5, 70), (6, 80)")
    db.execute("BEGIN; UPDATE stock SET n = 71 WHERE item = 5; SAVEPOINT s; DELETE FROM stock WHERE item = 6")
    assert db.execute("SELECT count(*) AS c FROM stock") == [{"c": 1}]
    db.execute("ROLLBACK TO s")
    mine, db.current = db.current, None
    with pytest.raises(EngineError, match="40001"):
        db.execute("UPDATE stock SET n = 0 WHERE item = 5")
    db.current = mine
    db.execute("COMMIT")
    assert [r["n"] for r in db.execute("SELECT n FROM stock ORDER BY item")] == [71, 80]
    a, b = db.begin(serializable=True), db.begin(serializable=True)
    for t, i in ((a, 5), (b, 6)):
        t.view("stock")
        t.put("stock", db.spark.createDataFrame([(i, 0, "U")], "item int, n int, _op string"))
    a.commit()
    with pytest.raises(EngineError, match="40001"):
        b.commit()


def test_version_graph_and_horizon(db):
    db.execute("CREATE TABLE leaf (k INT PRIMARY KEY, v INT); INSERT INTO leaf VALUES (1, 1), (2, 2)")
    db.execute("CREATE VERSION TAG 'early'")
    db.execute("UPDATE leaf SET v = 5 WHERE k = 1")
    loose = db.store.last_ts()
    db.execute("DELETE FROM leaf WHERE k = 2; INSERT INTO leaf VALUES (3, 3)")
    db.execute("CREATE VERSION TAG 'late'")
    assert sorted(map(tuple, db.store.diff("leaf", "early", "late").collect())) == [("1", "changed"), ("2", "removed"), ("3", "added")]
    assert [t["tag_name"] for t in db.execute("SHOW VERSION TAGS")] == ["early", "late"] and db.store.verify("early")
    assert db.store.version_at_or_before(loose) == "early"
    assert db.execute(f"SELECT v FROM leaf WHERE k = 1 AT VERSION {loose}") == [{"v": 5}]
    db.compact("leaf")
    assert db.execute("SELECT v FROM leaf WHERE k = 1 AT VERSION 'early'") == [{"v": 1}] and db.store.verify("early")
    with pytest.raises(EngineError, match="58P01"):
        db.execute(f"SELECT v FROM leaf AT VERSION {loose}")
    db.execute("DROP VERSION TAG 'early'")
    assert [t["tag_name"] for t in db.execute("SHOW VERSION TAGS")] == ["late"]
    other = Engine(db.spark, db.path)
    db.execute("INSERT INTO leaf VALUES (9, 9)")
    with pytest.raises(EngineError, match="40001"):
        other.execute("INSERT INTO leaf VALUES (8, 8)")


def test_copy_statements_statistics_and_models(spark, tmp_path):
    db = Engine(spark, str(tmp_path / "m"), lambda t: [float(len(t)), 1.0])
    db.execute("CREATE TABLE a (k INT PRIMARY KEY, t TEXT EMBEDDING MODEL 'm1' DIM 2); CREATE TABLE c (k INT PRIMARY KEY, t TEXT)")
    db.execute("INSERT INTO c VALUES (1, 'tab\there'), (2, 'back\\\\slash n\\\\t'), (3, NULL)")
    assert db.execute(f"COPY c TO '{tmp_path}/lines'") == 3
    want = db.execute("SELECT * FROM c ORDER BY k")
    db.execute("DELETE FROM c")
    assert db.execute(f"COPY c (k, t) FROM '{tmp_path}/lines'") == 3 and db.execute("SELECT * FROM c ORDER BY k") == want
    assert "3 rows" in db.execute("ANALYZE c") and db.store.table("c")["statistics"]["ends"]["k"] == ["1", "3"]
    db.execute("INSERT INTO a (k, t) VALUES (1, 'x'), (2, 'yy')")
    assert db.embed("a", "t") == 2 and db.execute("SHOW EMBEDDING HEALTH FOR a")[0]["stale"] == 0
    db.set_model("a", "t", "m2")
    assert db.execute("SHOW EMBEDDING HEALTH FOR a")[0]["stale"] == 2 and db.embed("a", "t") == 2
    assert db.execute("SHOW EMBEDDING HEALTH FOR a")[0]["stale"] == 0


def test_semantic_and_cache(spark, tmp_path):
    vec = {"red": [1.0, 0.0], "blue": [0.0, 1.0], "reddish": [0.9, 0.1]}
    db = Engine(spark, str(tmp_path / "v"), vec.__getitem__)
    db.execute("CREATE TABLE d (id INT PRIMARY KEY, c TEXT EMBEDDING MODEL 'm' DIM 2, cat TEXT)")
    db.execute("INSERT INTO d (id, c, cat) VALUES (1,'red','x'),(2,'blue','y'),(3,'reddish','x')")
    assert db.embed("d", "c") == 3
    got = db.execute("SELECT id, round(similarity, 3) AS s FROM d WHERE SEMANTIC_MATCH(c, 'red', 0.5) AND cat = 'x' ORDER BY s DESC")
    assert [r["id"] for r in got] == [1, 3]
    assert db.execute("SELECT cat, count(*) AS n FROM d WHERE SEMANTIC_MATCH(c, 'red', 0.5) GROUP BY cat") == [{"cat": "x", "n": 2}]
    db.execute("CREATE SEMANTIC CACHE FOR TABLE d SIMILARITY 0.95 TTL 60")
    assert db.semantic_search("d", "c", "red", 1) == db.semantic_search("d", "c", "reddish", 1)
    assert db.metrics()["cache_hits"] == 1
    db.embedder = None
    with pytest.raises(EngineError, match="55000"):
        db.execute("SELECT * FROM d WHERE SEMANTIC_MATCH(c, 'red', 0.5)")


def test_candidates_and_parameters(spark, tmp_path):
    db = Engine(spark, str(tmp_path / "v"), lambda t: [float(t), 1.0])
    db.execute("CREATE TABLE d (id INT PRIMARY KEY, c TEXT EMBEDDING MODEL 'm' DIM 2)")
    db.upsert("d", spark.range(130).selectExpr("CAST(id AS INT) AS id", "CAST(id AS STRING) AS c"))
    assert db.embed("d", "c") == 130
    assert len(db.execute("SELECT id FROM d WHERE SEMANTIC_MATCH(c, '129', 0.0)")) == 10
    assert len(db.execute("SELECT id FROM d WHERE SEMANTIC_MATCH(c, '129', 0.0) LIMIT 25")) == 25
    assert [r["id"] for r in db.execute("SELECT id FROM d WHERE SEMANTIC_MATCH(c, '129', 0.0) AND id < 3 ORDER BY id")] == [0, 1, 2]
    assert db.execute("SELECT count(*) AS n FROM d WHERE SEMANTIC_MATCH(c, '129', 0.0)") == [{"n": 100}]
    assert db.prepare("SELECT count(*) AS n FROM d WHERE id < $2 AND id >= $1")(3, 10) == [{"n": 7}]
    with pytest.raises(EngineError, match="08P01"):
        db.prepare("SELECT $1 AS x")()
    row = db.execute("SELECT version() AS v, current_user AS u, current_schema AS s")[0]
    assert row["v"].startswith("tarnwork") and (row["u"], row["s"]) == ("admin", "public")
    db.execute("BEGIN")
    with pytest.raises(EngineError, match="0A000"):
        db.execute("SELECT id FROM d WHERE SEMANTIC_MATCH(c, '1', 0.5)")


def test_roles_copy_backup(db, tmp_path):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v TEXT); INSERT INTO t VALUES (1, 'a\tb\\c'), (2, NULL)")
    db.execute("CREATE ROLE r; GRANT SELECT ON t TO r")
    db.user = "r"
    assert len(db.execute("SELECT * FROM t")) == 2
    with pytest.raises(EngineError, match="42501"):
        db.execute("DELETE FROM t")
    db.user = None
    lines = db.copy_to("t")
    db.execute("CREATE TABLE u (id INT PRIMARY KEY, v TEXT)")
    assert db.copy_from("u", lines) == 2
    assert db.execute("SELECT * FROM u ORDER BY id") == db.execute("SELECT * FROM t ORDER BY id")
    db.execute(f"BACKUP TO '{tmp_path}/b'")
    db.execute("DELETE FROM t")
    db.execute(f"RESTORE FROM '{tmp_path}/b'")
    assert len(db.execute("SELECT * FROM t")) == 2
    assert db.execute("SELECT relname FROM pg_class ORDER BY relname") == [{"relname": "t"}, {"relname": "u"}]
    assert db.execute("CREATE INDEX i ON t (v)") == 1
