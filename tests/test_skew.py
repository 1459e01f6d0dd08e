"""Reports on tables where one key holds a third of all rows."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from oracle_check import differences
from plan_text import executed_plan
from pyspark.sql import functions as F

from oracle.sql import SQL
from scorecraft.functions.numeric import presentable
from scorecraft.plans.registry import REPORTS, run
from scorecraft.sources.tables import SCHEMAS, StarSchema

FOLDER = "/root/testdata/sf0.001"
if not Path(FOLDER).exists():
    pytest.skip("no test tables", allow_module_level=True)

HOT = {  # table: columns of which a third of the rows get one value
    "lineitem": {"l_suppkey": 5, "l_partkey": 7, "l_orderkey": 9},
    "orders": {"o_custkey": 3},
    "customer": {"c_nationkey": 3},
    "supplier": {"s_nationkey": 3},
}
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
}


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    base = StarSchema(spark, FOLDER)
    for name in SCHEMAS:
        df = base.table(name)
        for shift, (column, value) in enumerate(HOT.get(name, {}).items()):
            row = F.abs(F.hash(*df.columns)) % 3
            hot = F.when(row == shift, F.lit(value)).otherwise(F.col(column))
            df = df.withColumn(column, hot.cast(df.schema[column].dataType))
        # several files give a hot shuffle partition several map outputs to be split by
        df.repartition(6 if name == "lineitem" else 1).write.parquet(
            str(folder / f"{name}.parquet")
        )
    before = {key: spark.conf.get(key) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield str(folder)
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.fixture(scope="module")
def db(skewed):
    import duckdb

    connection = duckdb.connect()
    for name in SCHEMAS:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM '{skewed}/{name}.parquet/*.parquet'"
        )
    return connection


@pytest.mark.parametrize("name", list(REPORTS))
def test_skewed_report_equals_sql(spark, skewed, db, name):
    assert differences(presentable(run(name, spark, skewed)), db, SQL[name]) == []


@pytest.mark.parametrize("name", ["earned_value", "claims_reimbursement"])
def test_hot_dimension_key_is_split(spark, skewed, name):
    plan = executed_plan(run(name, spark, skewed))
    assert re.search(r"^Arguments: .*skewed", plan, re.M)
