"""Numbered manifests: a folder's state as JSON files of which the highest complete one holds."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from tarnwork.errors import EngineError


class Files:
    """Small files and folders through the cluster's file system."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def fs(self, p: str):
        return self.path(p).getFileSystem(self.conf)

    def exists(self, p: str) -> bool:
        return self.fs(p).exists(self.path(p))

    def delete(self, p: str) -> None:
        self.fs(p).delete(self.path(p), True)

    def names(self, p: str) -> list[str]:
        """Names of the files and folders directly below ``p``; none where it doesn't exist."""
        return [s.getPath().getName() for s in self.fs(p).listStatus(self.path(p))] if self.exists(p) else []

    def size(self, p: str) -> int:
        return self.fs(p).getContentSummary(self.path(p)).getLength()

    def read(self, p: str) -> str:
        stream = self.fs(p).open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, p: str, text: str) -> bool:
        """Write a file whole or not at all; false if it exists already."""
        new = f"{p}.{uuid.uuid4().hex}.part"
        out = self.fs(p).create(self.path(new), True)
        out.write(bytearray(text.encode()))
        out.close()
        done = not self.exists(p) and self.fs(p).rename(self.path(new), self.path(p))
        if not done:
            self.delete(new)
        return done


class Manifest:
    """``state`` of a folder, published as ``manifest-<number>.json``.

    A number is written beside its place and renamed there, and older numbers stay until a newer one is complete, so a crash
    at any moment leaves the state before or after. Of two writers with the same number the second raises 40001.
    """

    KEEP = 3

    def __init__(self, spark: SparkSession, root: str, empty: dict):
        self.files, self.root = Files(spark), root.rstrip("/")
        found = self._numbers()
        self.number = max(found, default=0)
        self.state: dict = json.loads(self.files.read(self._path(self.number))) if found else empty

    def _path(self, number: int) -> str:
        return f"{self.root}/manifest-{number:010d}.json"

    def _numbers(self) -> list[int]:
        names = self.files.names(self.root)
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())

    def publish(self) -> None:
        if not self.files.create(self._path(self.number + 1), json.dumps(self.state)):
            raise EngineError("40001", "another writer has published since this state was read")
        self.number += 1
        for old in self._numbers()[: -self.KEEP]:
            self.files.delete(self._path(old))
