"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.exchange.reuse": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # building a plan is several times faster without call sites for every column
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # files the checkpoints leave behind go when their DataFrame is collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app: str = "scorecraft", master: str | None = None, **extra: str
) -> SparkSession:
    """A session with the settings the reports are tuned for.

    Shuffle parallelism is left to the cluster's own configuration; AQE coalesces
    it per stage.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable without overriding the cluster's folder.

    ``spark.checkpoint.dir`` wins, else a folder in the session's own storage, the
    warehouse, which driver and executors share.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    context.setCheckpointDir(configured or f"{warehouse.rstrip('/')}/checkpoints")


class Scratch:
    """Tables of one computation in the folder that driver and executors share.

    A written table cuts the lineage like a checkpoint, and its size is known to the
    optimizer, so small ones are broadcast without a hint.  ``drop`` removes them all.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
            "spark.sql.warehouse.dir"
        )
        self.spark = spark
        self.folder = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.tables = 0

    def write(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        """``df`` written and read back, and the aggregates ``metrics`` of its rows, which are
        taken while it is written."""
        self.tables += 1
        path, seen = f"{self.folder}/{self.tables}", Observation()
        if metrics:
            df = df.observe(seen, *[value.alias(name) for name, value in metrics.items()])
        df.write.parquet(path)
        found = {name: seen.get.get(name) or 0 for name in metrics}
        return self.spark.read.schema(df.schema).parquet(path), found

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        configuration = self.spark.sparkContext._jsc.hadoopConfiguration()
        path.getFileSystem(configuration).delete(path, True)
