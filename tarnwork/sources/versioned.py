"""Versioned tables: append-only Parquet commits, a manifest, snapshots, tags and compaction."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.errors import EngineError
from tarnwork.sources.manifest import Files, Manifest

SYSTEM = ("_commit_ts", "_op")


class Store:
    """All tables below one folder. One driver writes; readers see only commits that the manifest names.

    A commit is one Parquet folder with the rows it puts and the keys it removes (``_op`` I, U or D). The newest row of a key
    at or before a time is its state; filters come after that choice, so an old version never resurfaces.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root, self.files = spark, path.rstrip("/"), Files(spark)
        self._manifest = Manifest(spark, self.root, {"tables": {}, "tags": {}, "indexes": {}, "caches": {}, "roles": {}, "grants": [], "clock": 0})

    @property
    def meta(self) -> dict:
        return self._manifest.state

    def publish(self) -> None:
        self._manifest.publish()

    def table(self, name: str) -> dict:
        if name.lower() not in self.meta["tables"]:
            raise EngineError("42P01", f"table {name} does not exist")
        return self.meta["tables"][name.lower()]

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self.table(name)["schema"])

    def keys(self, name: str) -> list[str]:
        return self.table(name)["keys"]

    def create(self, name: str, schema: T.StructType, keys: list[str], if_not_exists: bool = False, **more) -> bool:
        if name.lower() in self.meta["tables"]:
            if if_not_exists:
                return False
            raise EngineError("42P07", f"table {name} already exists")
        keys = keys or [schema.fields[0].name]
        self.meta["tables"][name.lower()] = {"schema": json.loads(schema.json()), "keys": keys, "commits": [], "append_only": False, "storage": "columnar", "dir": f"{name.lower()}-{uuid.uuid4().hex[:8]}"} | more
        self.publish()
        return True

    def drop(self, name: str, if_exists: bool = False) -> bool:
        if name.lower() not in self.meta["tables"] and if_exists:
            return False
        folder = f"{self.root}/{self.table(name)['dir']}"
        del self.meta["tables"][name.lower()]
        self.publish()
        self.files.delete(folder)
        return True

    def tick(self) -> int:
        """The next commit time: microseconds, always ascending."""
        self.meta["clock"] = max(self.meta["clock"] + 1, time.time_ns() // 1000)
        return self.meta["clock"]

    def write(self, name: str, rows: DataFrame, ts: int | None = None) -> dict:
        """Write rows with ``_op`` as a commit that is not yet visible; the entry to publish."""
        table, ts = self.table(name), ts or self.tick()
        folder = f"{table['dir']}/{ts}-{uuid.uuid4().hex[:8]}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema(name)]
        out = rows.select(*columns, F.lit(ts).cast("bigint").alias("_commit_ts"), "_op")
        if table["storage"] == "columnar":
            out.write.parquet(f"{self.root}/{folder}")
        else:
            out.write.json(f"{self.root}/{folder}", ignoreNullFields=False)
        return {"ts": ts, "path": folder, "format": table["storage"]}

    def load_log(self, name: str, changes: DataFrame) -> int:
        """Take over a change log whose rows have their own ``_commit_ts`` (bigint) and ``_op``; the newest time."""
        table, mark = self.table(name), uuid.uuid4().hex[:8]
        folder = f"{table['dir']}/log-{mark}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema(name)]
        changes.select(*columns, F.col("_commit_ts").cast("bigint").alias("_commit_ts"), "_op").write.parquet(f"{self.root}/{folder}")
        first, last = self.spark.read.parquet(f"{self.root}/{folder}").agg(F.min("_commit_ts"), F.max("_commit_ts")).first()
        return self.commit(name, {"ts": last, "from": first, "path": folder, "format": "columnar"}) if last is not None else 0

    def commit(self, name: str, *entries: dict) -> int:
        self.table(name)["commits"] += entries
        self.publish()
        return max(e["ts"] for e in entries)

    def append(self, name: str, rows: DataFrame, op: str | None = None) -> int:
        return self.commit(name, self.write(name, rows if op is None else rows.withColumn("_op", F.lit(op))))

    def log(self, name: str, upto: int | None = None) -> DataFrame:
        """All versions at or before a time."""
        full = T.StructType([*self.schema(name).fields, T.StructField("_commit_ts", T.LongType()), T.StructField("_op", T.StringType())])
        parts = [c for c in self.table(name)["commits"] if upto is None or c.get("from", c["ts"]) <= upto]
        out = None
        for kind, reader in (("columnar", "parquet"), ("legacy", "json")):
            paths = [f"{self.root}/{c['path']}" for c in parts if c["format"] == kind]
            if paths:
                got = self.spark.read.schema(full).format(reader).load(paths)
                out = got if out is None else out.unionByName(got)
        if out is None:
            return self.spark.createDataFrame([], full)
        return out if upto is None else out.where(F.col("_commit_ts") <= upto)

    def snapshot(self, name: str, ts: int | None = None, with_ts: bool = False) -> DataFrame:
        """The state at a time, tombstones applied. A table of one commit needs no choice between versions.

        Compaction keeps the newest state and the pinned ones; of other times before it nothing is left, and reading one raises 58P01.
        """
        commits, keys = self.table(name)["commits"], self.keys(name)
        horizon = self.table(name).get("horizon", 0)
        if ts is not None and ts < horizon and ts not in self.table(name).get("pinned", []):
            raise EngineError("58P01", f"{name} was compacted at {horizon}; its state at {ts} is no longer kept")
        log = self.log(name, ts)
        if len(commits) > 1 or any("from" in c for c in commits):
            newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_commit_ts")))
            log = log.withColumn("_n", newest).where("_n = 1").drop("_n")
        log = log.where("_op <> 'D'")
        return log.select(*self.schema(name).names, *(["_commit_ts"] if with_ts else []))

    def last_ts(self) -> int:
        return max((c["ts"] for t in self.meta["tables"].values() for c in t["commits"]), default=0)

    def tag(self, name: str, **options) -> int:
        if name in self.meta["tags"]:
            raise EngineError("42710", f"tag {name} already exists")
        ts = self.last_ts()
        self.meta["tags"][name] = {"ts": ts, "created": self.tick(), "root": self.root_hash(ts)} | options
        self.publish()
        return ts

    def resolve(self, version: str | int) -> int:
        if isinstance(version, int):
            return version
        if version not in self.meta["tags"]:
            raise EngineError("42704", f"tag {version} does not exist")
        return self.meta["tags"][version]["ts"]

    def checksums(self, name: str, ts: int | None = None) -> DataFrame:
        """(pk, checksum) of every visible row."""
        rows = self.snapshot(name, ts)
        key = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in self.keys(name)])
        return rows.select(F.concat(F.lit(f"{name}:"), key).alias("pk"), F.xxhash64(key, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).alias("checksum"))

    def root_hash(self, ts: int) -> str:
        """One hash over all rows of all tables: order-free sums of row checksums, per table, hashed together.

        A table's sums at its last commit are kept with it, so a tag reads only tables changed since the tag before.
        """
        h = hashlib.sha256()
        for name in sorted(self.meta["tables"]):
            table = self.table(name)
            last = max((c["ts"] for c in table["commits"] if c["ts"] <= ts), default=0)
            kept = table.setdefault("sums", {})
            if str(last) not in kept or any("from" in c and c["from"] <= last < c["ts"] for c in table["commits"]):
                r = self.checksums(name, ts).agg(F.count("*"), F.sum(F.col("checksum").cast("decimal(20,0)")).cast("string"), F.bit_xor("checksum")).first()
                kept[str(last)] = list(r)
            h.update(repr((name, *kept[str(last)])).encode())
        return h.hexdigest()

    def tag_list(self) -> list[dict]:
        """Tags by time, then name."""
        return sorted(({"name": n} | t for n, t in self.meta["tags"].items()), key=lambda t: (t["ts"], t["name"]))

    def untag(self, name: str) -> None:
        """Remove a tag; the next compaction no longer keeps its state."""
        if self.meta["tags"].pop(name, None) is None:
            raise EngineError("42704", f"tag {name} does not exist")
        self.publish()

    def version_at_or_before(self, ts: int) -> str | None:
        """The newest tag whose state is not after a time."""
        return next((t["name"] for t in reversed(self.tag_list()) if t["ts"] <= ts), None)

    def verify(self, tag: str) -> bool:
        """Whether a tag's rows still have the hash it was made with."""
        return self.root_hash_fresh(self.resolve(tag)) == self.meta["tags"][tag]["root"]

    def root_hash_fresh(self, ts: int) -> str:
        """The root hash from the rows themselves, whatever sums are kept."""
        kept = {n: t.pop("sums", {}) for n, t in self.meta["tables"].items()}
        try:
            return self.root_hash(ts)
        finally:
            for n, t in self.meta["tables"].items():
                t["sums"] = kept[n]

    def diff(self, name: str, old: int | str, new: int | str) -> DataFrame:
        """(key columns, change): rows added, removed or changed between two versions, by row checksums."""
        a, b = self.checksums(name, self.resolve(old)), self.checksums(name, self.resolve(new))
        both = a.withColumnRenamed("checksum", "was").join(b.withColumnRenamed("checksum", "now"), "pk", "full").where("not (was <=> now)")
        change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
        return both.select(F.regexp_replace("pk", "^[^:]*:", "").alias("pk"), change.alias("change"))

    def compact(self, name: str, pins: list[int] | None = None) -> int:
        """Rewrite as one commit: of each key the newest version and the newest at or before each pin.

        Pins are the tags' times and those given (open snapshots). A key whose newest version is a tombstone goes once no pin needs it.
        """
        pinned = sorted({t["ts"] for t in self.meta["tags"].values()} | set(pins or []))
        table, keys = self.table(name), self.keys(name)
        if not table["commits"]:
            return 0
        log, by = self.log(name), Window.partitionBy(*keys)
        need = F.col("_commit_ts") == F.max("_commit_ts").over(by)
        live = need & (F.col("_op") != "D")
        for i, p in enumerate(pinned):
            best = F.max(F.when(F.col("_commit_ts") <= p, F.col("_commit_ts"))).over(by)
            live = live | (F.col("_commit_ts") == best)
        held = log.withColumns({"_live": F.coalesce(live, F.lit(False)), "_newest": need})
        held = held.withColumn("_any", F.max("_live").over(by)).where("_live or (_newest and _any)").select(*self.schema(name).names, "_commit_ts", "_op")
        ts, old = self.tick(), [c["path"] for c in table["commits"]]
        folder = f"{table['dir']}/{ts}-base"
        first = min(c.get("from", c["ts"]) for c in table["commits"])
        writer = held.sortWithinPartitions(*keys).write
        (writer.parquet if table["storage"] == "columnar" else writer.json)(f"{self.root}/{folder}")
        table["horizon"], table["pinned"] = max(c["ts"] for c in table["commits"]), pinned
        table["commits"] = [{"ts": max(c["ts"] for c in table["commits"]), "from": first, "path": folder, "format": table["storage"]}]
        self.publish()
        for p in old:
            self.files.delete(f"{self.root}/{p}")
        return len(old)

    def backup(self, target: str) -> None:
        """Copy every commit by the executors, then the manifest; the backup counts once its sums are written."""
        if self.files.exists(f"{target}/sums.json"):
            raise EngineError("58P02", "the target holds a backup already")
        sums = {n: self._sum(n) for n in self.meta["tables"]}
        self._copy(self, f"{target}/data", self.meta["tables"])
        Manifest(self.spark, f"{target}/data", self.meta).publish()
        self.files.create(f"{target}/sums.json", json.dumps(sums))

    def _copy(self, source: Store, root: str, tables: dict) -> None:
        """Rewrite the commits of tables below another root, same paths, as distributed jobs."""
        for name, table in tables.items():
            full = T.StructType([*T.StructType.fromJson(table["schema"]).fields, T.StructField("_commit_ts", T.LongType()), T.StructField("_op", T.StringType())])
            for c in table["commits"]:
                kind, folder = ("parquet" if c["format"] == "columnar" else "json"), f"{source.root}/{c['path']}"
                rows = self.spark.read.schema(full).format(kind).load(folder)
                rows.write.format(kind).options(**({"ignoreNullFields": "false"} if kind == "json" else {})).save(f"{root}/{c['path']}")

    def _sum(self, name: str) -> list:
        r = self.log(name).agg(F.count("*"), F.bit_xor(F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})))).first()
        return [r[0], r[1]]

    def restore(self, source: str) -> None:
        """Check every table of the backup against its sums, then take it over; a wrong sum changes nothing."""
        there = Store(self.spark, f"{source}/data")
        for name, wanted in json.loads(self.files.read(f"{source}/sums.json")).items():
            if there._sum(name) != wanted:
                raise EngineError("XX001", f"the backup of table {name} is damaged")
        # into folders of their own first: until the manifest names them, the live tables stay as they are
        tables = json.loads(json.dumps(there.meta["tables"]))
        for t in tables.values():
            fresh = f"{t['dir']}-r{uuid.uuid4().hex[:6]}"
            moved = {"x": t | {"commits": [c | {"path": c["path"]} for c in t["commits"]]}}
            self._copy(there, f"{self.root}/{fresh}.in", moved)
            for c in t["commits"]:
                c["path"] = f"{fresh}.in/{c['path']}"
            t["dir"] = fresh
        old = [t["dir"] for t in self.meta["tables"].values()] + [c["path"].split("/")[0] for t in self.meta["tables"].values() for c in t["commits"]]
        self._manifest.state = there.meta | {"tables": tables, "clock": max(there.meta["clock"], self.meta["clock"])}
        self.publish()
        for folder in set(old):
            self.files.delete(f"{self.root}/{folder}")
