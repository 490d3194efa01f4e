"""Session settings and the few session-level services the operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests, the bench and the command line; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("millrace")
    settings = SETTINGS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone, on which casts between wall-clock and absolute times depend, and let Python workers find this package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    _ship(spark)
    return spark


_SHIPPED: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application, unless it is installed or on their path."""
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    reachable = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _SHIPPED or root in reachable or "site-packages" in root:
        return
    _SHIPPED.add(context.applicationId)
    place = tempfile.mkdtemp(prefix="millrace-package-")  # code, not data: the driver serves it to the executors
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    path = f"{place}/millrace-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    context.addPyFile(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is written on the way: the one the session names in ``spark.checkpoint.dir``.

    Only on one machine, where that is unset, as in tests, it is a temporary folder, which goes with the process.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_up_to(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast of df only if it is seen to have at most max_rows rows; otherwise leave the join to the planner.

    The check reads no more than max_rows + 1 rows.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its input comes in fewer than half as many pieces, as small files do; else df as it is.

    For scans that feed costly work. Counting the pieces plans the scan and reads nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def tasks(spark: SparkSession) -> int:
    """Reduce tasks of one shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


