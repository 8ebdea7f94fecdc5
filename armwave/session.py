"""Session helpers: local session for tests, and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "armwave") -> SparkSession:
    """A local session for tests and the bench. On a cluster, pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            current = tempfile.mkdtemp(prefix="armwave-")
        sc.setCheckpointDir(current)
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path inside the shared folder."""
    return f"{shared_dir(spark)}/armwave-{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Reliable checkpoint: the rows are written to the shared folder and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def side_by_side(spark: SparkSession, jobs: Sequence[Callable], threads: int = 8) -> list:
    """Run some driver functions in threads, so that their Spark jobs share the cluster; results in order."""
    with ThreadPoolExecutor(max(1, min(threads, len(jobs)))) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs))
