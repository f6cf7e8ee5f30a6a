"""Helpers that the training-data operators share: intermediate tables and session settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    A session on one machine that names neither, as in tests, gets a temporary folder; on a cluster it's an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = named.get() if named.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="lectern-")
        found = _local[app]
    return found.rstrip("/")


class Stash:
    """Intermediate tables of one query, written to the shared folder and read back.

    This cuts lineage, survives lost executors, and gives the planner true sizes, so that a
    join after it is broadcast only if the written table is under the session's threshold, and
    is otherwise a sort-merge join whose skewed partitions AQE may split. Tables that a result still reads
    live as long as the application; the folder is deleted when it ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        at, files = self._files(self.root)
        files.mkdirs(at)  # only what is there is marked
        files.deleteOnExit(at)

    def _files(self, path: str) -> tuple:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._lectern_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this stash that no later step reads."""
        path = getattr(df, "_lectern_path", None)
        if path is not None:
            at, files = self._files(path)
            files.delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: F.Column | str) -> F.Column:
    """What tells a text from others: the 16 bytes of its MD5."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def ascii_lower(text: F.Column) -> F.Column:
    """Lower-cases A-Z alone. Texts of ASCII alone, the common case, take the fast path."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, low))
