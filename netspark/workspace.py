"""Written tables in the shared folder: the way this library cuts lineage.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where
that is unset (a local test) a temporary folder of this machine is taken.
Tables written here survive the loss of an executor and are read back with
plain scans, so every later stage starts from files and not from shuffles.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_MADE: dict[str, list[Workspace]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a local folder where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="netspark-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


class Workspace:
    """A private folder of written tables below the shared one."""

    def __init__(self, spark: SparkSession, label: str = "job"):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._tables: dict[str, str] = {}
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(self)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        df.write.mode("overwrite").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def save_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """As ``save``, in ``buckets`` hash buckets of ``key``: joins on the key then need no exchange of this side."""
        table = f"netspark_{uuid.uuid4().hex}"
        df.repartition(buckets, key).sortWithinPartitions(key).write.format("parquet").bucketBy(buckets, key).option("path", self.at(name)).saveAsTable(table)
        self._tables[name] = table
        return self.spark.table(table)

    def own(self, name: str, table: str) -> None:
        """Let ``drop`` also remove the catalogue's entry of a table that was saved at ``name``."""
        self._tables[name] = table

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads; without names, the whole folder."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for n in names or list(self._tables):
            if n in self._tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(n)}")  # the catalogue's entry; the files go below
        for target in [self.at(n) for n in names] or [self.path]:
            p = jvm.org.apache.hadoop.fs.Path(target)
            p.getFileSystem(conf).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete all tables this application wrote: call it when its results are stored or read."""
    for ws in _MADE.pop(spark.sparkContext.applicationId, []):
        ws.drop()
