"""Session helpers: shipping the package to executors and cutting lineage.

Nothing here changes a session's settings; queries run under whatever
configuration the caller's cluster has.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build(app: str = "loomspan", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use your own."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Kernels are pickled by reference, so Python workers have to be able to
    import the package even if the driver found it through its own path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.suffix == ".zip" or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="loomspan-ship-")
    archive = os.path.join(folder, "loomspan.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as bundle:
        for path in sorted(root.rglob("*.py")):
            bundle.write(path, os.path.join("loomspan", path.relative_to(root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shipped(frame: DataFrame) -> DataFrame:
    """The frame, after making sure that kernels over it find this package."""
    ship(frame.sparkSession)
    return frame


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a private one only in a local session without one.

    On a cluster a machine's own folder would be lost with it, or not be found by
    the others, so that a session without a folder is an error there.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="loomspan-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from those files."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the cluster's file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(frame: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where a scan has fewer splits than there are cores.

    Kernels take long for each row, so a small file would otherwise keep one
    core busy. A table of any size has enough splits and is left alone.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the input tables, as Parquet below ``folder``."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
