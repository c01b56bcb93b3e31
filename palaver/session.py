"""Session helpers: table access, shared checkpoints and size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only when its counted rows stay under this bound.
BROADCAST_ROWS = 100_000
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors: one zip per Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="palaver-zip-")) / "palaver.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("palaver") / p.relative_to(root)))
    sc.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table of a scale-factor directory."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster sets it. A
    temporary folder of our own only where it is unset and all runs on one machine (local
    tests); on a cluster without it an error is raised."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.conf.get("palaver.shared.dir", None)
        if not where:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="palaver-")
            spark.conf.set("palaver.shared.dir", where)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def materialise(df: DataFrame, partition_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and stays columnar, so later
    reads prune columns and push filters. The table is removed when the application ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark).rstrip('/')}/palaver-{uuid.uuid4().hex}"
    writer = df.write
    if partition_rows:
        writer = writer.option("maxRecordsPerFile", partition_rows)
    writer.parquet(path)
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(gone)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a small iteration state in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_side(side: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``side`` if its counted ``rows`` stay under ``bound``; otherwise leave
    the choice to the optimiser (sort-merge with adaptive skew handling)."""
    return F.broadcast(side) if rows <= bound else side


def canonical_name(c: Column | str) -> Column:
    """Lower-case name without outer blanks; blank becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    name = F.lower(F.trim(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")))
    return F.when(name != "", name)
