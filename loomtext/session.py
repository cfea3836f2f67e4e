"""Session settings the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning, split of skewed join partitions, UTC timestamps.  The
# last one spares the call-site lookup for each of the many small expressions
# the operators are built from; set it to true to see Python lines in errors.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "loomtext", master: str | None = None, **conf: str) -> SparkSession:
    """Return the active session or start one; ``conf`` wins over ``SETTINGS``."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir is not set; name a folder all executors share")
    return root.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """Where jobs put what later steps read: the folder named for checkpoints.
    Only a local session may do without and gets a temporary one."""
    master = spark.sparkContext.master
    if not spark.conf.get("spark.checkpoint.dir", None) and (master == "local" or master.startswith("local[")):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoint-"))
    return checkpoint_root(spark)


def stored_aside(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read from there: later steps
    neither repeat its work nor lose it with an executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
