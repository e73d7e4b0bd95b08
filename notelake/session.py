"""Session helpers: worker-side imports, the shared scratch folder, table access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, as Spark reads it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all machines of the cluster share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that setting is absent and the master
    is local, as in tests on one machine, a temporary folder takes its place.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all machines share")
        root = Path(tempfile.mkdtemp(prefix="notelake-")).as_uri()
        spark.conf.set(CHECKPOINT_KEY, root)
    return f"{root.rstrip('/')}/notelake-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and the path of its table."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    return written(df, label)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stamps(spark: SparkSession, files: list[str]) -> list[tuple[str, int, int]]:
    """Name, time and size of files: what an index that is kept must still agree with."""
    out = []
    for name in files:
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        out.append((name, found.getModificationTime(), found.getLen()))
    return out


def partitions(df: DataFrame, megabytes: int = 64, least: int | None = None) -> int:
    """How many partitions a shuffle of about the tables that ``df`` reads needs: those of the session (or ``least``), more for large tables.

    A table whose size is unknown, as one made from rows of the driver, does not count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return max(least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(x for x in sizes if x < 1 << 60) // (megabytes << 20))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    import notelake

    sc = spark.sparkContext
    if getattr(notelake, "_shipped", None) == sc.applicationId:
        return
    package = Path(notelake.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="notelake-")) / "notelake.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, os.path.join("notelake", f.relative_to(package)))
    sc.addPyFile(str(archive))
    notelake._shipped = sc.applicationId
