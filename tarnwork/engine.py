"""The engine: SQL statements over versioned tables, with tags, transactions, vector search and training exports."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork import dialect
from tarnwork.errors import EngineError, translate
from tarnwork.functions import stats, vectors
from tarnwork.operators.dedup import not_duplicate
from tarnwork.runtime import ship
from tarnwork.sources.copy import from_lines, to_lines
from tarnwork.sources.versioned import Store
from tarnwork.sqltypes import spark_type

GROUP = "_near_duplicate_group"
CANDIDATES, DEFAULT_K = 100, 10
LINEAGE = "training_exports"
# How a plan shows whole division of numbers with a fraction: operands cast to decimals.
DECIMAL_DIVISION = re.compile(r"div cast\([^ ]+ as decimal|as decimal\(\d+,\d+\)\) div")
NAME = r'("?[\w.]+"?)'


class Transaction:
    """Buffered writes over a snapshot. Keys are locked when buffered; a lock held by another transaction raises 40001.

    Buffers hold rows of single statements, as DataFrames over the snapshot; what stays on the driver is the keys they touch,
    at most ``MOST_KEYS`` of them.
    """

    MOST_KEYS = 1_000_000

    def __init__(self, engine: Engine, serializable: bool = False):
        self.engine, self.serializable = engine, serializable
        self.read_ts = engine.store.last_ts()
        self.buffer: list[tuple[str, DataFrame]] = []
        self.saves: list[tuple[str, int]] = []
        self.keys: set = set()
        self.reads: set[str] = set()
        self.open = True

    def view(self, name: str) -> DataFrame:
        """The snapshot with this transaction's own writes on top."""
        self.reads.add(name.lower())
        rows, keys = self.engine.store.snapshot(name, self.read_ts), self.engine.store.keys(name)
        for table, change in self.buffer:
            if table == name.lower():
                rows = rows.join(change.select(*keys), keys, "left_anti").unionByName(change.where("_op <> 'D'").select(*rows.columns))
        return rows

    def put(self, name: str, change: DataFrame) -> int:
        store, change = self.engine.store, self.engine.hold(change)
        keys = change.select(*store.keys(name)).limit(self.MOST_KEYS + 1).collect()
        if len(keys) > self.MOST_KEYS:
            raise EngineError("54000", "too many rows for one transaction")
        for k in keys:
            owner = self.engine.locks.setdefault((name.lower(), *k), self)
            if owner is not self:
                raise EngineError("40001", f"row {tuple(k)} of {name} is written by another transaction")
        changed = store.snapshot(name, None, True).where(F.col("_commit_ts") > self.read_ts).join(change.select(*store.keys(name)), store.keys(name), "left_semi")
        if changed.limit(1).count():
            raise EngineError("40001", f"a row of {name} was changed after this transaction began")
        self.keys |= {(name.lower(), *k) for k in keys}
        self.buffer.append((name.lower(), change))
        return len(keys)

    def savepoint(self, name: str) -> None:
        self.saves.append((name, len(self.buffer)))

    def rollback_to(self, name: str) -> None:
        at = next((i for i in range(len(self.saves) - 1, -1, -1) if self.saves[i][0] == name), None)
        if at is None:
            raise EngineError("3B001", f"savepoint {name} does not exist")
        self.buffer = self.buffer[: self.saves[at][1]]
        self.saves = self.saves[: at + 1]

    def release(self, name: str) -> None:
        at = next((i for i in range(len(self.saves) - 1, -1, -1) if self.saves[i][0] == name), None)
        if at is None:
            raise EngineError("3B001", f"savepoint {name} does not exist")
        self.saves = self.saves[:at]

    def commit(self) -> int | None:
        """All writes under one commit time. Serializable transactions fail if a table they read was written since."""
        store = self.engine.store
        if self.serializable:
            for t in self.reads:
                if any(c["ts"] > self.read_ts for c in store.table(t)["commits"]):
                    self.rollback()
                    raise EngineError("40001", f"table {t} was changed by a concurrent transaction")
        if not self.buffer:
            self.rollback()
            return None
        ts, written = store.tick(), []
        for name in dict.fromkeys(n for n, _ in self.buffer):
            keys, rows = store.keys(name), None
            for table, change in self.buffer:
                if table == name:
                    rows = change if rows is None else rows.join(change.select(*keys), keys, "left_anti").unionByName(change)
            written.append((name, store.write(name, rows, ts)))
        for name, entry in written:
            store.table(name)["commits"].append(entry)
        store.publish()
        self.rollback()
        return ts

    def rollback(self) -> None:
        for k in self.keys:
            self.engine.locks.pop(k, None)
        self.open, self.buffer = False, []
        self.engine.transactions.discard(self)
        self.engine._let_go()


class Engine:
    """``execute(sql)`` runs one statement: rows as a list of dicts, a row count, or a message. ``sql`` gives the DataFrame.

    ``embedder`` maps a text to a vector for SEMANTIC_MATCH; without one such a query raises 55000, it never makes a vector up.
    ``user`` None is the superuser.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: Callable[[str], list[float]] | None = None):
        ship(spark)
        self.spark, self.path, self.embedder = spark, path, embedder
        self.store = Store(spark, path)
        self.user: str | None = None
        self.locks: dict = {}
        self.transactions: set = set()
        self.current: Transaction | None = None
        self.cache: dict = {}
        self.counters = dict.fromkeys(("statements", "selects", "writes", "errors", "semantic", "cache_hits", "exports"), 0)
        self._held = 0

    def __repr__(self) -> str:
        return f"Engine(path={self.path!r}, tables={self.table_count})"

    @property
    def table_count(self) -> int:
        return len(self.store.meta["tables"])

    def table_exists(self, name: str) -> bool:
        return name.lower() in self.store.meta["tables"]

    def health(self) -> dict:
        return {"status": "ok", "tables": self.table_count, "tags": len(self.store.meta["tags"]), "open_transactions": len(self.transactions)}

    def metrics(self) -> dict:
        return dict(self.counters)

    def hold(self, rows: DataFrame) -> DataFrame:
        """Write rows down before they are read again."""
        self._held += 1
        path = f"{self.store.root}/_held/{self._held}-{self.store.tick()}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # Statements

    def execute(self, sql: str, args=None):
        """Run one statement, or a script of which the last result counts."""
        result = None
        for text in dialect.statements(sql):
            self.counters["statements"] += 1
            try:
                result = self._run(text, args)
                result = [r.asDict() for r in result.collect()] if isinstance(result, DataFrame) else result
            except EngineError:
                self.counters["errors"] += 1
                raise
            except Exception as e:
                self.counters["errors"] += 1
                raise translate(e) from e
        return result

    def sql(self, sql: str, args=None) -> DataFrame:
        """The DataFrame of a query."""
        self.counters["selects"] += 1
        return self._select(sql, args)

    def prepare(self, sql: str) -> Callable:
        """One statement with ``$1`` to ``$n``, to be run with values: ``prepare("SELECT $1 + 1 AS x")(41)``."""
        if len(dialect.statements(sql)) != 1:
            raise EngineError("42601", "one statement can be prepared")
        wanted = dialect.parameters(sql)

        def run(*values):
            if len(values) != wanted:
                raise EngineError("08P01", f"{wanted} values are needed, not {len(values)}")
            return self.execute(sql, list(values))

        return run

    def _run(self, sql: str, args):
        head = " ".join(dialect.words(sql)[:3]).upper()
        for pattern, method in self._table:
            if m := re.match(pattern, sql, re.I | re.S):
                return getattr(self, method)(*[g if g is None else g.strip() for g in m.groups()])
        if head.split()[0] in ("SELECT", "WITH", "VALUES", "(", "SHOW"):
            return self.sql(sql, args)
        raise EngineError("0A000", f"statement {head} is not supported")

    _table = [
        (r"CREATE TABLE\s+(IF NOT EXISTS\s+)?" + NAME + r"\s*\((.*)\)\s*(APPEND ONLY)?\s*$", "_create"),
        (r"DROP TABLE\s+(IF EXISTS\s+)?" + NAME + r"\s*$", "_drop"),
        (r"ALTER TABLE\s+" + NAME + r"\s+SET STORAGE\s+(COLUMNAR|LEGACY|ROW)\s*$", "_storage"),
        (r"INSERT INTO\s+" + NAME + r"\s*(\([^()]*\))?\s*((?:VALUES|SELECT|WITH)\b.*)$", "_insert"),
        (r"BULK INSERT INTO\s+" + NAME + r"\s*(\([^()]*\))?\s*(VALUES\b.*)$", "_bulk"),
        (r"BULK INSERT INTO\s+" + NAME + r"\s*(\([^()]*\))?\s*FROM\s+('[^']*')\s*$", "_bulk_file"),
        (r"UPDATE\s+" + NAME + r"\s+SET\s+(.*)$", "_update"),
        (r"DELETE FROM\s+" + NAME + r"(?:\s+WHERE\s+(.*))?$", "_delete"),
        (r"CREATE VERSION TAG\s+('[^']*')(.*)$", "_tag"),
        (r"ANALYZE\s+(?:TABLE\s+)?" + NAME + r"\s*$", "_analyze"),
        (r"CREATE (?:UNIQUE )?INDEX\s+(IF NOT EXISTS\s+)?" + NAME + r"\s+ON\s+" + NAME + r"\s*\(\s*" + NAME + r"\s*\)\s*$", "_index"),
        (r"DROP INDEX\s+(IF EXISTS\s+)?" + NAME + r"\s*$", "_drop_index"),
        (r"SHOW EMBEDDING HEALTH(?:\s+FOR\s+" + NAME + r")?\s*$", "_embedding_health"),
        (r"CREATE SEMANTIC CACHE FOR TABLE\s+" + NAME + r"\s+SIMILARITY\s+([\d.]+)\s+TTL\s+(\d+)\s*$", "_create_cache"),
        (r"DROP SEMANTIC CACHE FOR TABLE\s+" + NAME + r"\s*$", "_drop_cache"),
        (r"(CREATE|DROP|ALTER) ROLE\s+" + NAME + r"(.*)$", "_role"),
        (r"(GRANT|REVOKE)\s+(.*?)\s+ON\s+(?:TABLE\s+)?" + NAME + r"\s+(?:TO|FROM)\s+" + NAME + r"\s*$", "_grant"),
        (r"COPY\s+" + NAME + r"\s*(\([^()]*\))?\s+FROM\s+('[^']*')\s*$", "_copy_from"),
        (r"COPY\s+" + NAME + r"\s*(\([^()]*\))?\s+TO\s+('[^']*')\s*$", "_copy_to"),
        (r"DROP VERSION TAG\s+('[^']*')\s*$", "_untag"),
        (r"SHOW VERSION TAGS\s*$", "_tags"),
        (r"BACKUP TO\s+('[^']*')\s*$", "_backup"),
        (r"RESTORE FROM\s+('[^']*')\s*$", "_restore"),
        (r"(?:BEGIN|START)(?:\s+TRANSACTION|\s+WORK)?(\s+ISOLATION LEVEL SERIALIZABLE)?\s*$", "_begin"),
        (r"(?:COMMIT|END)(?:\s+\w+)?\s*$", "_commit"),
        (r"(?:ROLLBACK|ABORT)\s+TO\s+(?:SAVEPOINT\s+)?" + NAME + r"\s*$", "_rollback_to"),
        (r"(?:ROLLBACK|ABORT)(?:\s+\w+)?\s*$", "_rollback"),
        (r"SAVEPOINT\s+" + NAME + r"\s*$", "_savepoint"),
        (r"RELEASE\s+(?:SAVEPOINT\s+)?" + NAME + r"\s*$", "_release"),
    ]

    def _allow(self, action: str, table: str) -> None:
        if self.user is None or self.store.meta["roles"].get(self.user, {}).get("superuser"):
            return
        if [self.user, action, table.lower()] not in self.store.meta["grants"]:
            raise EngineError("42501", f"{self.user} may not {action} on {table}")

    def _admin(self) -> None:
        if self.user is not None and not self.store.meta["roles"].get(self.user, {}).get("superuser"):
            raise EngineError("42501", "only a superuser may do this")
        if self.current:
            raise EngineError("0A000", "not inside a transaction")

    # Definitions

    def _create(self, if_not, name, body, append_only):
        self._admin()
        fields, keys = [], []
        depth, part, parts = 0, "", []
        for t in dialect.tokens(body):
            depth += (t == "(") - (t == ")")
            if t == "," and depth == 0:
                parts.append(part)
                part = ""
            else:
                part += t
        for p in [*parts, part]:
            if m := re.match(r"\s*PRIMARY KEY\s*\(([^)]*)\)", p, re.I):
                keys += [dialect.unquote(c.strip()) for c in m[1].split(",")]
                continue
            if re.match(r"\s*(CONSTRAINT|UNIQUE|CHECK|FOREIGN)\b", p, re.I):
                continue
            m = re.match(r'\s*("[^"]+"|\w+)\s+(.*)$', p, re.S)
            column, rest = dialect.unquote(m[1]), m[2]
            kind = re.split(r"\b(?:PRIMARY KEY|NOT NULL|NULL|EMBEDDING|UNIQUE|DEFAULT|CHECK|REFERENCES)\b", rest, flags=re.I)[0]
            meta = {}
            if e := re.search(r"EMBEDDING MODEL\s+'([^']*)'(?:\s+DIM\s+(\d+))?", rest, re.I):
                meta = {"embedding": {"model": e[1], "dim": int(e[2] or 128)}}
            if re.search(r"\bPRIMARY KEY\b", rest, re.I):
                keys.append(column)
            needed = column in keys or re.search(r"\bNOT NULL\b", rest, re.I)
            fields.append(T.StructField(column, spark_type(kind), not needed, meta))
            if meta:
                fields.append(T.StructField(f"{column}_embedding", T.ArrayType(T.FloatType()), True))
        made = self.store.create(dialect.unquote(name), T.StructType(fields), keys, bool(if_not), append_only=bool(append_only))
        return "CREATE TABLE" if made else "table exists"

    def _drop(self, if_exists, name):
        self._admin()
        self.cache.clear()
        self.store.drop(dialect.unquote(name), bool(if_exists))
        return "DROP TABLE"

    def _storage(self, name, kind):
        self._admin()
        self.store.table(name)["storage"] = "columnar" if kind.upper() == "COLUMNAR" else "legacy"
        self.compact(name)
        return "ALTER TABLE"

    def _index(self, if_not, index, name, column):
        self._admin()
        if index in self.store.meta["indexes"]:
            if if_not:
                return 0
            raise EngineError("42P07", f"index {index} already exists")
        if column not in self.store.schema(name).names:
            raise EngineError("42703", f"column {column} does not exist")
        self.store.meta["indexes"][index] = {"table": name.lower(), "column": column}
        self.store.publish()
        return self.store.snapshot(name).where(F.col(column).isNotNull()).count()

    def _drop_index(self, if_exists, index):
        self._admin()
        if self.store.meta["indexes"].pop(index, None) is None and not if_exists:
            raise EngineError("42704", f"index {index} does not exist")
        self.store.publish()
        return "DROP INDEX"

    def _role(self, verb, role, rest):
        self._admin()
        roles = self.store.meta["roles"]
        if (verb.upper() == "CREATE") == (role in roles):
            raise EngineError("42710" if role in roles else "42704", f"role {role}")
        if verb.upper() == "DROP":
            del roles[role]
            self.store.meta["grants"] = [g for g in self.store.meta["grants"] if g[0] != role]
        else:
            roles[role] = {"superuser": bool(re.search(r"(?<!NO)\bSUPERUSER\b", rest, re.I))}
        self.store.publish()
        return f"{verb.upper()} ROLE"

    def _grant(self, verb, actions, name, role):
        self._admin()
        self.store.table(name)
        if role not in self.store.meta["roles"]:
            raise EngineError("42704", f"role {role} does not exist")
        wanted = ["SELECT", "INSERT", "UPDATE", "DELETE"] if actions.upper().startswith("ALL") else [a.strip().upper() for a in actions.split(",")]
        kept = [g for g in self.store.meta["grants"] if not (g[0] == role and g[1] in wanted and g[2] == name.lower())]
        self.store.meta["grants"] = kept + ([[role, a, name.lower()] for a in wanted] if verb.upper() == "GRANT" else [])
        self.store.publish()
        return verb.upper()

    def _backup(self, target):
        self._admin()
        self.store.backup(dialect.unquote(target))
        return "BACKUP"

    def _restore(self, source):
        self._admin()
        self.store.restore(dialect.unquote(source))
        self.cache.clear()
        return "RESTORE"

    # Changes

    def _rows(self, name: str, columns: str | None, source: str) -> DataFrame:
        schema = self.store.schema(name)
        names = [dialect.unquote(c.strip()) for c in columns.strip("()").split(",")] if columns else [f.name for f in schema if not f.name.endswith("_embedding") or not any("embedding" in g.metadata for g in schema)]
        unknown = set(names) - set(schema.names)
        if unknown:
            raise EngineError("42703", f"columns {sorted(unknown)} do not exist")
        got = self._select(source if not source.upper().startswith("VALUES") else f"SELECT * FROM {source}", None)
        if len(got.columns) != len(names):
            raise EngineError("42601", f"{len(names)} columns but {len(got.columns)} values")
        got = got.toDF(*names)
        return got.select(*[(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def _check_nulls(self, name: str, rows: DataFrame) -> None:
        needed = [f.name for f in self.store.schema(name) if not f.nullable]
        if needed and rows.where(" or ".join(f"`{c}` is null" for c in needed)).limit(1).count():
            raise EngineError("23502", f"null in one of {needed}")

    def _view(self, name: str) -> DataFrame:
        return self.current.view(name) if self.current else self.store.snapshot(name)

    def _write(self, name: str, change: DataFrame) -> int:
        self.counters["writes"] += 1
        self.cache.clear()
        if self.current:
            return self.current.put(name, change)
        locked = [k for k in self.locks if k[0] == name.lower()]
        change = self.hold(change)
        if locked and change.select(*self.store.keys(name)).join(self.spark.createDataFrame([k[1:] for k in locked], change.select(*self.store.keys(name)).schema), self.store.keys(name), "left_semi").limit(1).count():
            raise EngineError("40001", f"a row of {name} is written by a transaction")
        n = change.count()
        if n:
            self.store.append(name, change)
        self._let_go()
        return n

    def _let_go(self) -> None:
        """Remove rows held for finished statements; those of open transactions stay."""
        if not self.transactions:
            self.store.files.delete(f"{self.store.root}/_held")

    def _insert(self, name, columns, source):
        name = dialect.unquote(name)
        self._allow("INSERT", name)
        rows = self.hold(self._rows(name, columns, source))
        self._check_nulls(name, rows)
        keys = self.store.keys(name)
        if rows.groupBy(*keys).count().where("count > 1").limit(1).count() or self._view(name).join(rows, keys, "left_semi").limit(1).count():
            raise EngineError("23505", f"key of {name} exists")
        return self._write(name, rows.withColumn("_op", F.lit("I")))

    def upsert(self, name: str, rows: DataFrame) -> int:
        """Put rows whatever keys exist; of rows with one key, any one wins."""
        self._allow("INSERT", name)
        schema = self.store.schema(name)
        full = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        self._check_nulls(name, full)
        return self._write(name, full.dropDuplicates(self.store.keys(name)).withColumn("_op", F.lit("I")))

    def _bulk(self, name, columns, source):
        return self.upsert(name, self._rows(name, columns, source))

    def _bulk_file(self, name, columns, path):
        schema = self.store.schema(name)
        names = [c.strip() for c in columns.strip("()").split(",")] if columns else schema.names
        kinds = T.StructType([schema[n] for n in names])
        return self.upsert(name, self.spark.read.csv(dialect.unquote(path), schema=kinds, header=True, mode="FAILFAST"))

    def copy_from(self, name: str, lines: DataFrame, columns: list[str] | None = None) -> int:
        schema = self.store.schema(name)
        return self.upsert(name, from_lines(lines, T.StructType([schema[c] for c in columns or schema.names])))

    def _copy_from(self, name, columns, path):
        names = [dialect.unquote(c.strip()) for c in columns.strip("()").split(",")] if columns else None
        return self.copy_from(dialect.unquote(name), self.spark.read.text(dialect.unquote(path)), names)

    def _copy_to(self, name, columns, path):
        names = [dialect.unquote(c.strip()) for c in columns.strip("()").split(",")] if columns else None
        lines = self.copy_to(dialect.unquote(name), names)
        lines.write.text(dialect.unquote(path))
        return self.spark.read.text(dialect.unquote(path)).count()

    def _untag(self, name):
        self._admin()
        self.store.untag(dialect.unquote(name))
        return "DROP VERSION TAG"

    def _tags(self):
        rows = [(t["name"], t["ts"], bool(t.get("training")), t["root"]) for t in self.store.tag_list()]
        return self.spark.createDataFrame(rows, "tag_name string, version_timestamp bigint, for_training boolean, root_hash string")

    def copy_to(self, name: str, columns: list[str] | None = None) -> DataFrame:
        self._allow("SELECT", name)
        return to_lines(self._view(name).select(*(columns or self.store.schema(name).names)))

    def _changeable(self, action: str, name: str) -> None:
        self._allow(action, name)
        if self.store.table(name)["append_only"]:
            raise EngineError("25006", f"{name} is append-only")

    def _update(self, name, rest):
        self._changeable("UPDATE", name)
        ts, depth, cut = dialect.tokens(rest), 0, None
        for i, t in enumerate(ts):
            depth += (t == "(") - (t == ")")
            if depth == 0 and t.upper() == "WHERE":
                cut = i
                break
        sets, where = "".join(ts[:cut]), "".join(ts[cut + 1 :]) if cut is not None else "true"
        schema, new, part, depth = self.store.schema(name), {}, "", 0
        for t in [*dialect.tokens(sets), ","]:
            depth += (t == "(") - (t == ")")
            if t == "," and depth == 0:
                column, _, value = part.partition("=")
                new[dialect.unquote(column.strip())] = value.strip()
                part = ""
            else:
                part += t
        for c in new:
            if c not in schema.names:
                raise EngineError("42703", f"column {c} does not exist")
            if "embedding" in schema[c].metadata or c in self.store.keys(name):
                raise EngineError("428C9", f"column {c} can't be updated")
        hit = self._view(name).where(where)
        rows = hit.select(*[(F.expr(new[f.name]) if f.name in new else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema])
        self._check_nulls(name, rows)
        return self._write(name, rows.withColumn("_op", F.lit("U")))

    def _delete(self, name, where):
        self._changeable("DELETE", name)
        return self._write(name, self._view(name).where(where or "true").withColumn("_op", F.lit("D")))

    # Transactions

    def begin(self, serializable: bool = False) -> Transaction:
        t = Transaction(self, serializable)
        self.transactions.add(t)
        return t

    def _begin(self, serializable):
        if self.current:
            raise EngineError("25001", "a transaction is open")
        self.current = self.begin(bool(serializable))
        return "BEGIN"

    def _need(self) -> Transaction:
        if not self.current:
            raise EngineError("25P01", "no transaction is open")
        return self.current

    def _commit(self):
        t, self.current = self._need(), None
        t.commit()
        return "COMMIT"

    def _rollback(self):
        t, self.current = self._need(), None
        t.rollback()
        return "ROLLBACK"

    def _savepoint(self, name):
        self._need().savepoint(name)
        return "SAVEPOINT"

    def _rollback_to(self, name):
        self._need().rollback_to(name)
        return "ROLLBACK"

    def _release(self, name):
        self._need().release(name)
        return "RELEASE"

    # Queries

    def _select(self, sql: str, args) -> DataFrame:
        sql, version = dialect.split_version(sql)
        sql, unique = dialect.split_not_duplicate(sql)
        sql, match = dialect.split_semantic(sql)
        sql, args = dialect.numbered(dialect.session_words(sql, self.user), args)
        if self.current and (version or match):
            raise EngineError("0A000", "AT VERSION or SEMANTIC_MATCH inside a transaction")
        ts = self.store.resolve(version.value) if version else None
        if match and version and (version.mode or "").upper() not in ("SEMANTIC_FRESH", "SEMANTIC_SNAPSHOT"):
            raise EngineError("0A000", "a semantic query of the past names CONSISTENCY 'SEMANTIC_FRESH' or 'SEMANTIC_SNAPSHOT'")
        used = {w.lower().strip('"') for w in dialect.words(sql)} & set(self.store.meta["tables"])
        for name in sorted(used):
            self._allow("SELECT", name)
            rows = self.store.snapshot(name, ts) if ts is not None else self._view(name)
            if match and f"{match.column}_embedding" in rows.columns:
                rows = self._semantic(name, rows, match, sql)
            if unique and GROUP in rows.columns:
                rows = not_duplicate(self._narrowed(name, rows, sql), GROUP, self.store.keys(name)[0])
            rows.createOrReplaceTempView(name)
        if match and not any(f"{match.column}_embedding" in self.store.schema(n).names for n in used):
            raise EngineError("42703", f"column {match.column} has no embedding")
        for name, rows in self.system_tables(sql).items():
            rows.createOrReplaceTempView(name)
        text = self._whole_division(dialect.place_nulls(sql), args, used)
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def _narrowed(self, name: str, rows: DataFrame, sql: str) -> DataFrame:
        """Rows of a table that meet the query's conditions on that table alone: NOT DUPLICATE chooses among those."""
        for term in dialect.own_terms(sql, name):
            try:
                rows = rows.where(term)
                rows.schema
            except AnalysisException:
                continue  # names other tables too; the query itself applies it
        return rows

    def _whole_division(self, sql: str, args, used: set[str]) -> str:
        """``/`` between whole numbers truncates: it becomes ``div`` wherever the operands have whole types."""
        ts = dialect.tokens(sql)
        for i in dialect.divisions(sql):
            tried = "".join([*ts[:i], " div ", *ts[i + 1 :]])
            try:
                new = self.spark.sql(tried, args=args) if args else self.spark.sql(tried)
            except AnalysisException:
                continue  # no whole numbers
            near = {w.split(".")[-1].lower() for w in (dialect.words("".join(ts[:i]))[-1:] + dialect.words("".join(ts[i + 1 :]))[:1])}
            fine = {f.name.lower() for t in used for f in self.store.schema(t) if isinstance(f.dataType, T.DecimalType)}
            if not near & fine and not DECIMAL_DIVISION.search(new._jdf.queryExecution().analyzed().toString()):
                ts[i] = " div "
        return "".join(ts)

    def _semantic(self, name: str, rows: DataFrame, match: dialect.SemanticMatch, sql: str) -> DataFrame:
        """The candidates of a semantic query: the most similar rows at or above the threshold.

        A query that groups, aggregates or joins sees the CANDIDATES best, or as many as its LIMIT; any other the best of those that meet its
        own conditions, as many as its LIMIT or DEFAULT_K. The search is exact.
        """
        self.counters["semantic"] += 1
        if self.embedder is None:
            raise EngineError("55000", "no embedder is set")
        vector = [float(x) for x in self.embedder(match.query)]
        dim = self.store.schema(name)[match.column].metadata["embedding"]["dim"]
        if len(vector) != dim:
            raise EngineError("22000", f"the query vector has {len(vector)} values, the column {dim}")
        q = F.array(*[F.lit(x) for x in vector])
        near = rows.withColumn("similarity", vectors.cosine(F.col(f"{match.column}_embedding"), q)).where(F.col("similarity") >= match.threshold)
        limit, analytical = dialect.limit_of(sql), dialect.is_analytical(sql)
        if not analytical:
            near = self._narrowed(name, near, sql)
        most = max(CANDIDATES, limit or 0) if analytical or limit else DEFAULT_K
        return near.orderBy(F.desc("similarity"), *self.store.keys(name)).limit(most)

    def semantic_search(self, name: str, column: str, query: str, k: int = 10, threshold: float = 0.0, ttl_now: float | None = None) -> list[dict]:
        """The k best rows; answers come from the table's semantic cache while a query vector like it is fresh there."""
        import time

        self._allow("SELECT", name)
        if self.embedder is None:
            raise EngineError("55000", "no embedder is set")
        now, vector = ttl_now or time.time(), [float(x) for x in self.embedder(query)]
        setting = self.store.meta["caches"].get(name.lower())
        if setting:
            for (t, th, kk, v), (rows, until) in list(self.cache.items()):
                if until < now:
                    del self.cache[t, th, kk, v]
                elif (t, th, kk) == (name.lower(), threshold, k) and _cos(v, vector) >= setting["similarity"]:
                    self.counters["cache_hits"] += 1
                    return rows
        near = vectors.top_k(self._view(name), vector, k, threshold, f"{column}_embedding", self.store.keys(name)[0])
        rows = [r.asDict() for r in near.drop(f"{column}_embedding").collect()]
        if setting:
            if len(self.cache) >= 256:
                self.cache.pop(next(iter(self.cache)))
            self.cache[name.lower(), threshold, k, tuple(vector)] = (rows, now + setting["ttl"])
        return rows

    def embed(self, name: str, column: str) -> int:
        """Fill missing embeddings of a column in Arrow batches; the embedder runs in the tasks."""
        if self.embedder is None:
            raise EngineError("55000", "no embedder is set")
        embedder = self.embedder

        @F.pandas_udf("array<float>")
        def vector(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else [float(x) for x in embedder(t)])

        target = f"{column}_embedding"
        stale = self._view(name).where(F.col(target).isNull() & F.col(column).isNotNull())
        if self._model(name, column, "embedded") not in (None, self._model(name, column, "model")):
            stale = self._view(name).where(F.col(column).isNotNull())
        self.store.table(name).setdefault("embedded", {})[column] = self._model(name, column, "model")
        return self._write(name, stale.withColumn(target, vector(column)).withColumn("_op", F.lit("U")))

    def _model(self, name: str, column: str, which: str) -> str | None:
        """The model a column is declared with, or the one its stored vectors came from."""
        return self.store.table(name).get("embedded", {}).get(column) if which == "embedded" else self.store.schema(name)[column].metadata["embedding"]["model"]

    def set_model(self, name: str, column: str, model: str) -> None:
        """Declare another model version; every vector of the column is stale until it is embedded again."""
        self._admin()
        field = next(f for f in self.store.table(name)["schema"]["fields"] if f["name"] == column)
        field["metadata"]["embedding"]["model"] = model
        self.store.publish()

    def _embedding_health(self, name):
        rows = []
        for table in [name.lower()] if name else sorted(self.store.meta["tables"]):
            for f in self.store.schema(table):
                if "embedding" in f.metadata:
                    changed = self._model(table, f.name, "embedded") not in (None, f.metadata["embedding"]["model"])
                    missing = self.store.snapshot(table).where((F.lit(changed) | F.col(f"{f.name}_embedding").isNull()) & F.col(f.name).isNotNull()).count()
                    rows.append((table, f.name, f.metadata["embedding"]["model"], "ready" if self.embedder else "absent", missing))
        return self.spark.createDataFrame(rows, "table_name string, column_name string, model_version string, embedder string, stale bigint")

    def _create_cache(self, name, similarity, ttl):
        self._admin()
        if not any("embedding" in f.metadata for f in self.store.schema(name)):
            raise EngineError("42703", f"{name} has no embedding column")
        if not 0 < float(similarity) <= 1 or int(ttl) <= 0:
            raise EngineError("22023", "similarity lies above 0 and up to 1, the time above 0")
        self.store.meta["caches"][name.lower()] = {"similarity": float(similarity), "ttl": int(ttl)}
        self.store.publish()
        return "CREATE SEMANTIC CACHE"

    def _drop_cache(self, name):
        self._admin()
        self.store.meta["caches"].pop(name.lower(), None)
        self.cache.clear()
        self.store.publish()
        return "DROP SEMANTIC CACHE"

    def system_tables(self, sql: str) -> dict[str, DataFrame]:
        """Catalog views that the text names: pg_class, pg_attribute, pg_namespace, pg_database, pg_type."""
        named = {w.lower().rpartition(".")[2] for w in dialect.words(sql)}
        out, tables = {}, self.store.meta["tables"]
        if "pg_class" in named:
            out["pg_class"] = self.spark.createDataFrame([(i, t, "r") for i, t in enumerate(sorted(tables), 16384)], "oid bigint, relname string, relkind string")
        if "pg_attribute" in named:
            rows = [(i, f["name"], n, not f["nullable"]) for i, t in enumerate(sorted(tables), 16384) for n, f in enumerate(tables[t]["schema"]["fields"], 1)]
            out["pg_attribute"] = self.spark.createDataFrame(rows, "attrelid bigint, attname string, attnum int, attnotnull boolean")
        if "pg_namespace" in named:
            out["pg_namespace"] = self.spark.createDataFrame([(11, "pg_catalog"), (2200, "public")], "oid bigint, nspname string")
        if "pg_database" in named:
            out["pg_database"] = self.spark.createDataFrame([(1, "default")], "oid bigint, datname string")
        if "pg_type" in named:
            # Type numbers of the catalog.
            kinds = [(16, "bool"), (17, "bytea"), (20, "int8"), (21, "int2"), (23, "int4"), (25, "text"), (114, "json"), (700, "float4"), (701, "float8"), (1043, "varchar"), (1082, "date"), (1114, "timestamp"), (1184, "timestamptz"), (1700, "numeric"), (2950, "uuid"), (3802, "jsonb")]
            out["pg_type"] = self.spark.createDataFrame(kinds, "oid bigint, typname string")
        return out

    # Versions, statistics, exports

    def _tag(self, name, rest):
        self._admin()
        precision = re.search(r"PRECISION\s+'(\w+)'", rest, re.I)
        seed = re.search(r"SEED\s+(\d+)", rest, re.I)
        if precision and precision[1] not in ("float32", "sq8", "rabitq"):
            raise EngineError("22023", f"precision {precision[1]} is not known")
        training = bool(re.match(r"FOR TRAINING", rest, re.I))
        return self.store.tag(dialect.unquote(name), training=training, precision=precision[1] if precision else "float32", seed=int(seed[1]) if seed else None)

    def create_training_snapshot(self, name: str, seed: int | None = None) -> int:
        return self.store.tag(name, training=True, precision="float32", seed=seed)

    def compact(self, name: str) -> int:
        return self.store.compact(name, [t.read_ts for t in self.transactions])

    def _analyze(self, name):
        table, found = self.store.table(name), {r["column"]: r.asDict() for r in self.statistics(name).collect()}
        rows = self.store.snapshot(name)
        plain = [f.name for f in self.store.schema(name) if isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))]
        ends = rows.agg(F.count("*").alias("n"), *[F.struct(F.min(c).cast("string"), F.max(c).cast("string")).alias(c) for c in plain]).first()
        table["statistics"] = {"rows": ends["n"], "columns": found, "ends": {c: list(ends[c]) for c in plain}, "at": self.store.last_ts()}
        self.store.publish()
        return f"ANALYZE {name}: {ends['n']} rows"

    def statistics(self, name: str) -> DataFrame:
        """(column, ndv, fraction of nulls)."""
        rows = self.store.snapshot(name)
        flat = rows.select([c for c, k in rows.dtypes if not k.startswith("array")])
        return stats.approx_ndv(flat).join(stats.null_fraction(flat, flat.columns), "column")

    def training_dataset(self, tag: str, table: str | None = None, dedup: bool = False) -> str:
        """Write the rows of a tag, sorted by key, as Parquet with a content hash and a lineage record; the folder."""
        entry = self.store.meta["tags"].get(tag)
        if entry is None or not entry["training"]:
            raise EngineError("42704", f"{tag} is no training tag")
        names = [t for t in self.store.meta["tables"] if t != LINEAGE]
        if table is None and len(names) != 1:
            raise EngineError("42P01", "name the table to export")
        name = (table or names[0]).lower()
        self._allow("SELECT", name)
        rows, keys = self.store.snapshot(name, entry["ts"]), self.store.keys(name)
        if dedup and GROUP in rows.columns:
            rows = not_duplicate(rows, GROUP, keys[0])
        for i, f in enumerate(self.store.schema(name)):
            if isinstance(f.dataType, T.ArrayType) and entry["precision"] != "float32" and f.name.endswith("_embedding"):
                dims = [r[0] for r in rows.where(F.col(f.name).isNotNull()).select(F.size(f.name).alias("n")).distinct().limit(2).collect()]
                if len(dims) > 1:
                    raise EngineError("22000", f"{f.name} holds vectors of different length")
                if dims and entry["precision"] == "sq8":
                    rows = vectors.sq8(rows, f.name).drop("restored", f.name).withColumnRenamed("codes", f.name)
                elif dims:
                    rows = vectors.rabitq(rows, dims[0], (entry["seed"] or 0) + i, f.name).drop(f.name).withColumnRenamed("code", f.name)
        out = f"{self.store.root}/exports/{tag}-{name}-{self.store.tick()}"
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(out)
        count, mark = content_hash(self.spark.read.parquet(out))
        if not self.table_exists(LINEAGE):
            schema = T.StructType([T.StructField("lineage_id", T.LongType(), False), *[T.StructField(c, T.StringType()) for c in ("tag_name", "table_name", "precision", "path", "content_hash")], T.StructField("dedup", T.BooleanType()), T.StructField("row_count", T.LongType())])
            self.store.create(LINEAGE, schema, ["lineage_id"], append_only=True)
        record = (self.store.tick(), tag, name, entry["precision"], out, mark, dedup, count)
        self.store.append(LINEAGE, self.spark.createDataFrame([record], self.store.schema(LINEAGE)), "I")
        self.counters["exports"] += 1
        return out


def _cos(a, b) -> float:
    size = (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    return sum(x * y for x, y in zip(a, b)) / size if size else 0.0


def content_hash(rows: DataFrame) -> tuple[int, str]:
    """Rows and a hash of their content that no partitioning changes: exact sums of row digests, hashed once more."""
    row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    r = rows.agg(F.count("*"), *[part(i) for i in range(4)]).first()
    return r[0], hashlib.sha256(repr((sorted(rows.columns), *r)).encode()).hexdigest()
