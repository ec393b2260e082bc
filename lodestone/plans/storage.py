"""Where intermediate results live, and how the package reaches the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a session on one machine (master ``local``)
    gets a temporary folder, which goes when the process ends; any other is refused, as its machines share none.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, named, True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
        discarded_at_exit(spark, sc.getCheckpointDir())
    return named


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discarded_at_exit(spark: SparkSession, path: str) -> None:
    """Has the folder ``path``, in whatever store, deleted when the driver's JVM ends."""
    files, at = _files(spark, path)
    files.deleteOnExit(at)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes the folder ``path`` now."""
    files, at = _files(spark, path)
    files.delete(at, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df``, computed once into the shared folder; its lineage ends there, and lost executors lose nothing.

    A checkpoint's plan holds on to the plan that it came from. In loops, where each round uses the one before several
    times, such plans would grow exponentially, so the rows alone are taken over.
    """
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once as Parquet into the shared folder and read again: columns that aren't asked for aren't read. It goes with the session."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    discarded_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable for the Python workers, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
