"""Session construction and lineage cutting.

On a cluster the session already exists and ``spark.checkpoint.dir`` names the shared folder; we
only fill in defaults where nothing is set (local runs and tests).
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Defaults for a local session; a cluster session keeps its own values.
_LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "8g",
    # let the JIT compile large generated stage methods (wide CASE chains of the rating tables)
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}


def get_spark(master: str | None = None, app: str = "riskframe", **conf: str) -> SparkSession:
    """The active session, or a new one. Under ``spark-submit`` (or any other given configuration)
    nothing that is set is changed and no master is named; a plain Python process gets a local
    master and the defaults above. ``conf`` is the caller's own and always set."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    args = os.environ.get("PYSPARK_SUBMIT_ARGS", "").replace("pyspark-shell", "").strip()
    if args or "PYSPARK_GATEWAY_PORT" in os.environ:
        SparkContext._ensure_initialized()  # started by spark-submit or with its arguments: they can be read
    given = SparkConf()
    submitted = given.contains("spark.master")
    builder = SparkSession.builder.appName(app)
    if master or not submitted:
        builder = builder.master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    defaults = {} if submitted else {k: v for k, v in _LOCAL_CONF.items() if not given.contains(k)}
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    if not submitted:
        spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder from ``spark.checkpoint.dir``; a scratch one only where all runs on this machine."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        had = spark.sparkContext._jsc.sc().getCheckpointDir()
        current = had.get() if had.isDefined() else None
    if not current:
        # local and local[n] run in this process; local-cluster and all others have executors elsewhere
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) before cutting lineage")
        current = tempfile.mkdtemp(prefix="riskframe-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(str(current))
    return str(current)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss; never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


#: What is written or checkpointed gives its shuffle files back when it is done, not when the driver collects its garbage.
RELEASE_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A join's side that is partitioned by some of the join's keys stays where it is.
KEEP_PARTITIONING = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def configured(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """The session with these settings; the old ones hold again afterwards."""
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
