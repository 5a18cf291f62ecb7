"""Session helpers shared by every operator: table loading, a shared work folder and partition sizing."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they start; once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_tarnwork_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="tarnwork-code-"), "tarnwork")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(home), os.path.basename(home)))
    sc._tarnwork_shipped = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    ``spark.checkpoint.dir`` decides. Only a local master may go without it; there
    a temporary folder takes its place.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or getattr(spark, "_tarnwork_dir", None)
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tarnwork-")
        sc.setCheckpointDir(found)
        spark._tarnwork_dir = found
    return found


def width(spark: SparkSession) -> int:
    """Partitions for Python-heavy stages: twice the cores, or more where the session asks for more."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Give a CPU-heavy Python stage enough partitions; a large input keeps its own splits."""
    spark = df.sparkSession
    ship(spark)
    if cols:
        return df.repartition(width(spark), *cols)
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(2 * spark.sparkContext.defaultParallelism)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a statement go when it ends, not when the driver happens to collect its garbage. For work that saves each step."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Workspace:
    """Written tables below the shared folder.

    ``save`` cuts lineage: the table is written once and later stages read the files, so a lost
    executor costs nothing that was computed before. ``drop`` removes tables no longer needed.
    """

    def __init__(self, spark: SparkSession, label: str = "w", root: str | None = None):
        ship(spark)
        self.spark = spark
        self.root = (root or f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}").rstrip("/")
        self._n = 0

    def save(self, df: DataFrame, name: str = "t", by: list[str] | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{name}-{self._n}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tarnwork_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete saved tables; frames that were never saved are skipped."""
        for df in dfs:
            if path := getattr(df, "_tarnwork_path", None):
                self._delete(path)

    def drop_all(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
