"""Session defaults and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SPREAD_CONF = "spark.placeweave.scan.partitions"


def local_session(cpus: int | str = 8, app: str = "placeweave", **conf: str) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus if cpus != "*" else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(SPREAD_CONF, str(cpus if cpus != "*" else 8))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """One JVM; ``local-cluster`` has executors of its own."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, of any store that Spark reads; none if it is not there."""
    if not path_exists(spark, path):
        return []
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return [f.getPath().getName() for f in found]


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session may lack it, a cluster may not.

    A local session's own folder goes when Python ends; in a shared one clean-up is its owner's."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not is_local(spark):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="placeweave-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir() or root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one written table; never reused, so a retry cannot read half a table."""
    return os.path.join(shared_root(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """The frame written once to the shared folder and read back.

    It survives the loss of executors, is not computed again by later uses, and its file
    size tells Catalyst whether it may be broadcast."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """A plain scan dealt out before heavy work per row, if the session asks for it.

    ``spark.placeweave.scan.partitions`` is for tables of one file with one row group, as tests have
    them. Without it nothing moves: on a cluster the scan's own splits are what is worked on, and
    ``spark.sql.files.maxPartitionBytes`` sets their size."""
    parts = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(parts), *by) if parts else df
