"""Shared staging: tables that cut lineage and are visible to every executor."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_staged: list[str] = []
#: Rows that go to a Python worker at once; a batch is held by the executor and by its worker.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = "file://" + tempfile.mkdtemp(prefix="chunkloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: recovery never recomputes what lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """The paths of the tables staged so far."""
    return list(_staged)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Removes the tables staged so far, or those of some paths; results that read them must have been written."""
    for name in made() if paths is None else paths:
        if name in _staged:
            _staged.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of all executors, which needn't have it installed (once a context), and sends them smaller batches if the session sets no size."""
    if spark.conf.get(BATCH_ROWS) == "10000":  # Spark's own, far too many for whole texts
        spark.conf.set(BATCH_ROWS, "2000")
    sc = spark.sparkContext
    if getattr(sc, "_chunkloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # not from an archive already
        archive = Path(tempfile.mkdtemp(prefix="chunkloom-")) / "chunkloom.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(archive))
    sc._chunkloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; every query starts here, so the package is shipped here."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
