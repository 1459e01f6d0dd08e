"""Files are held against the declared schema before they are read."""

from __future__ import annotations

import pytest

from scorecraft.plans.registry import REPORTS
from scorecraft.sources.tables import SchemaMismatch, StarSchema

NATION = "n_nationkey int, n_name string, n_regionkey int"


def written(spark, tmp_path, schema, rows, mode="overwrite"):
    path = str(tmp_path / "nation.parquet")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(path)
    return StarSchema(spark, str(tmp_path))


def jobs_of(spark, action):
    context = spark.sparkContext
    context.setJobGroup("footers", "schema check")
    try:
        action()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return len(context.statusTracker().getJobIdsForGroup("footers"))


def test_missing_column_is_named_with_its_type(spark, tmp_path):
    base = written(spark, tmp_path, "n_nationkey int, nation_name string, n_regionkey int", [(1, "x", 2)])
    with pytest.raises(SchemaMismatch, match=r"nation: n_name is missing \(declared string\)"):
        base.table("nation")


def test_retyped_columns_are_named_with_both_types(spark, tmp_path):
    base = written(spark, tmp_path, "n_nationkey string, n_name string, n_regionkey bigint", [("1", "x", 2)])
    with pytest.raises(SchemaMismatch) as error:
        base.table("nation")
    assert "n_nationkey is string, declared int; n_regionkey is bigint, declared int" in str(error.value)


def test_narrower_types_and_other_case_are_read(spark, tmp_path):
    path = str(tmp_path / "supplier.parquet")
    rows = [(1, "x", 2, 1.5)]
    spark.createDataFrame(rows, "S_SUPPKEY int, s_name string, s_nationkey int, s_acctbal float").write.parquet(path)
    row = StarSchema(spark, str(tmp_path)).table("supplier").first()
    assert tuple(row) == (1, "x", 2, 1.5)
    assert row.__fields__ == ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]


def test_further_columns_are_ignored_unless_exact(spark, tmp_path):
    base = written(spark, tmp_path, f"{NATION}, n_comment string", [(1, "x", 2, "c")])
    assert base.table("nation").columns == ["n_nationkey", "n_name", "n_regionkey"]
    with pytest.raises(SchemaMismatch, match=r"n_comment \(string\) is not declared"):
        StarSchema(spark, str(tmp_path), exact=True).table("nation")


def test_every_file_can_be_held_against_it(spark, tmp_path):
    written(spark, tmp_path, NATION, [(1, "x", 2)])
    written(spark, tmp_path, "n_nationkey int, n_name string, n_regionkey string", [(2, "y", "3")], "append")
    with pytest.raises(SchemaMismatch, match="disagree"):
        StarSchema(spark, str(tmp_path), every_file=True).table("nation")


def test_footers_are_read_once_and_rows_never(spark, tmp_path):
    base = written(spark, tmp_path, NATION, [(1, "x", 2)])
    assert jobs_of(spark, lambda: base.table("nation")) <= 1
    spark.sparkContext.setJobGroup("again", "again")
    base.table("nation")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("again") == []


def test_a_report_fails_instead_of_giving_nulls(spark, tmp_path):
    source = StarSchema(spark, "/root/testdata/sf0.001")
    for name in ("customer", "nation", "supplier"):
        df = source.table(name)
        if name == "supplier":
            df = df.withColumnRenamed("s_nationkey", "nation")
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    with pytest.raises(SchemaMismatch, match="supplier: s_nationkey is missing"):
        REPORTS["provider_density"](StarSchema(spark, str(tmp_path)))
