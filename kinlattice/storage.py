"""Tables in the shared folder: they cut lineage, survive lost executors, and end loops' growing plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured a local master gets a temporary one; a cluster is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="kinlattice-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Rows of an Arrow batch, in place of Spark's default of 10000: rows can hold whole texts.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, once per application.

    Arrow batches are kept to BATCH_ROWS unless the session says otherwise.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(sc, "_kinlattice_shipped", False):
        return
    root = Path(__file__).resolve().parent
    held = tempfile.mkdtemp(prefix="kinlattice-code-")  # the driver's file server hands it out
    path = shutil.make_archive(f"{held}/{root.name}", "zip", root.parent, root.name)
    sc.addPyFile(path)
    sc._kinlattice_shipped = True


#: Bytes in memory that a byte of a stored file may be. Repeated texts and sorted ids are packed so well that
#: files below Spark's limit for broadcasts would fill the driver; real sizes are known after a shuffle.
UNPACKED = 100.0


class Shelf:
    """Tables written to the shared folder.

    ``drop`` removes tables that nothing reads any more; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/kinlattice-{uuid.uuid4().hex}"
        self.count = 0
        if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) == 1.0:
            spark.conf.set("spark.sql.sources.fileCompressionFactor", str(UNPACKED))
        path, fs = self._at(self.base)
        fs.deleteOnExit(path)  # when the JVM ends
        atexit.register(self._quiet_drop)

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/t{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelf_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._shelf_path)

    def _at(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(sc._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def _quiet_drop(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.base)
        except Exception:  # noqa: BLE001 - the session is gone, and its shared folder with it
            pass
