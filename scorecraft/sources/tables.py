"""Parquet tables of the star schema, read with declared column types."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
        "c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
}


#: Types that the reader turns into the declared one without loss.
WIDER = {
    "tinyint": {"smallint", "int", "bigint"},
    "smallint": {"int", "bigint"},
    "int": {"bigint", "double"},
    "float": {"double"},
    "date": {"timestamp_ntz"},
}


class SchemaMismatch(ValueError):
    """A file's columns are not those declared."""


def check_schema(table: str, found: T.StructType, declared: T.StructType, exact: bool = False) -> None:
    """Raise ``SchemaMismatch`` naming every declared column that is missing or of a type that
    cannot be read as the declared one.

    Names are compared like Spark's, without case.  Further columns are ignored, but are
    named as well where ``exact`` is asked for.
    """
    types = {field.name.lower(): field.dataType.simpleString() for field in found}
    wrong = []
    for field in declared:
        want = field.dataType.simpleString()
        got = types.pop(field.name.lower(), None)
        if got is None:
            wrong.append(f"{field.name} is missing (declared {want})")
        elif got != want and want not in WIDER.get(got, ()):
            wrong.append(f"{field.name} is {got}, declared {want}")
    if exact:
        wrong += [f"{name} ({kind}) is not declared" for name, kind in types.items()]
    if wrong:
        raise SchemaMismatch(f"{table}: " + "; ".join(wrong))


class StarSchema:
    """The tables under one folder; the folder plays the part of the database.

    A table's files are read with the declared schema, and a column that they lack would
    silently be NULL.  So their own schema is read from their footers once, without a scan,
    and compared first: that of one file, or of all with ``every_file``.
    """

    def __init__(
        self, spark: SparkSession, folder: str, every_file: bool = False, exact: bool = False
    ):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.every_file, self.exact = every_file, exact
        self.checked: set[str] = set()

    def _check(self, name: str, path: str) -> None:
        declared = T._parse_datatype_string(SCHEMAS[name])
        reader = self.spark.read.option("mergeSchema", str(self.every_file).lower())
        try:
            found = reader.parquet(path).schema
        except AnalysisException as error:
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return  # a folder without files is an empty table
        except Py4JJavaError as error:
            cause = str(error.java_exception)
            if "MERGE_SCHEMA" not in cause:
                raise
            # two files have types without a common one
            raise SchemaMismatch(f"{name}: its files disagree: {cause}") from error
        check_schema(name, found, declared, self.exact)

    def table(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}.parquet"
        if name not in self.checked:
            self._check(name, path)
            self.checked.add(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(path)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` itself, or a ValueError naming the columns an input lacks."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"input lacks columns {missing}; it has {df.columns}")
    return df


def write_report(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite"
) -> None:
    """Store a result set as Parquet."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
