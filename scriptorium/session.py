"""Session helpers: a tuned local session, and durable hand-over between stages."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "scriptorium", partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine runs; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return reachable(spark)


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver found it.

    On one machine its folder is put on their path; on a cluster the package is sent along
    once per session.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if context.master.startswith("local"):
        known = context.environment.get("PYTHONPATH", "")
        if home not in known.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (home, known) if x)
    elif not getattr(spark, "_scriptorium_sent", False):
        bundle = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "scriptorium"), "zip", home, "scriptorium")
        context.addPyFile(bundle)
        spark._scriptorium_sent = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none (tests, local mode) a temporary folder of
    this machine is taken, which is safe there because one machine is all there is.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    own = getattr(spark, "_scriptorium_shared", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="scriptorium-")
        spark._scriptorium_shared = own
        atexit.register(shutil.rmtree, own.removeprefix("file://"), ignore_errors=True)
    return own


#: Tables written by this driver and not yet removed.
_staged: list[str] = []


def drop_stages(spark: SparkSession) -> int:
    """Remove all tables that ``durable`` has written; frames made from them can't be read any
    more, so call it when results are stored. Tells how many were removed."""
    jvm = spark.sparkContext._jvm
    removed = 0
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        removed += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and computes ``df`` once; a lost executor costs nothing,
    because the files are not on it. ``drop_stages`` removes what a session has written.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), "stage", f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.option("compression", "zstd").parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a small input one partition per core.

    A table of a few small files is read by fewer tasks than there are cores, which
    leaves cores idle in a Python stage. Inputs of enough splits stay as they are,
    so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores // 2, 32) else df
