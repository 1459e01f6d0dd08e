"""Reports kept period by period, each of which can be written again.

A write adds its rows under a number of its own and lists, last of all, which number stands
for each period it holds.  Readers follow the list, so they see a period as it was or as it
is, never half written: a write that fails before the list changes nothing, a repeated one
replaces its periods only, and other periods are not touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the folder columns; a report has none of them.
PERIOD, WRITE = "in_period", "in_write"


class ReportStore:
    """A report under ``path``, in periods given by one of its columns."""

    def __init__(self, spark: SparkSession, path: str, period: str):
        self.spark, self.period = spark, period
        self.data, self.listed = (f"{path.rstrip('/')}/{part}" for part in ("data", "manifest"))

    def write(self, df: DataFrame) -> None:
        """Replace the periods that ``df`` has rows of.

        Rows without a period are a period of their own.  Within a period, rows are spread
        by Spark as they come, and a large one is several files.
        """
        name = uuid.uuid4().hex
        period = F.coalesce(F.concat(F.lit("="), F.col(self.period).cast("string")), F.lit("none"))
        kept = df.withColumns({PERIOD: period, WRITE: F.lit(name)})
        kept.write.mode("append").partitionBy(PERIOD, WRITE).parquet(self.data)
        self._list(name, df)

    def _list(self, name: str, df: DataFrame) -> None:
        """List what has really been written under ``name``, read back from its files."""
        found = self.spark.read.schema(self._schema(df)).parquet(self.data).where(F.col(WRITE) == name)
        digest = F.bit_xor(F.xxhash64(*df.columns)).alias("digest")
        periods = found.groupBy(PERIOD, WRITE).agg(F.count(F.lit(1)).alias("rows"), digest)
        (
            periods.coalesce(1)
            .write.option("partitionOverwriteMode", "dynamic")
            .mode("overwrite")
            .partitionBy(PERIOD)
            .parquet(self.listed)
        )

    @staticmethod
    def _schema(df: DataFrame):
        return df.withColumns({PERIOD: F.lit(""), WRITE: F.lit("")}).schema

    def manifest(self) -> DataFrame:
        """``in_period, in_write, rows, digest`` of every period."""
        kind = f"{WRITE} string, rows long, digest long, {PERIOD} string"
        return self.spark.read.schema(kind).parquet(self.listed)

    def read(self, schema: str) -> DataFrame:
        """The rows of all periods, as listed; folders of other writes are pruned."""
        rows = self.spark.read.schema(f"{schema}, {PERIOD} string, {WRITE} string").parquet(self.data)
        # a filter on the list makes the optimizer prune folders by it
        listed = self.manifest().where("rows > 0").select(PERIOD, WRITE)
        return rows.join(listed, [PERIOD, WRITE], "left_semi").drop(PERIOD, WRITE)

    def damaged(self, schema: str) -> DataFrame:
        """Listed periods whose files do not hold the rows that were listed."""
        names = [field.name for field in self.spark.createDataFrame([], schema).schema]
        rows = self.spark.read.schema(f"{schema}, {PERIOD} string, {WRITE} string").parquet(self.data)
        now = rows.groupBy(PERIOD, WRITE).agg(
            F.count(F.lit(1)).alias("rows_now"), F.bit_xor(F.xxhash64(*names)).alias("digest_now")
        )
        same = F.col("rows").eqNullSafe(F.col("rows_now")) & F.col("digest").eqNullSafe(
            F.col("digest_now")
        )
        return self.manifest().join(now, [PERIOD, WRITE], "left").where(~same).select(PERIOD)

    def tidy(self) -> int:
        """Delete the folders that no period is listed with; the number of them.

        Not to be run beside a write, whose rows are not listed yet.
        """
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.data)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        # a name for each period, never rows
        used = {f"{PERIOD}={r[PERIOD]}/{WRITE}={r[WRITE]}" for r in self.manifest().collect()}
        gone = 0
        for status in files.globStatus(hadoop.Path(root, f"{PERIOD}=*/{WRITE}=*")) or []:
            path = status.getPath()
            unescaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
            name = f"{unescaped.unescapePathName(path.getParent().getName())}/{path.getName()}"
            if name not in used:
                files.delete(path, True)
                gone += 1
        return gone
