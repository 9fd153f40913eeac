"""Query source: the pipeline's query is Spark SQL over registered tables or views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltbed.plans.spec import RunContext, resolve_variables


def query_source(spark: SparkSession, query: str, ctx: RunContext) -> DataFrame:
    """Resolve date variables, drop trailing semicolons, and hand the text to Spark."""
    return spark.sql(resolve_variables(query, ctx).rstrip().rstrip(";"))


def lower_case_columns(df: DataFrame) -> DataFrame:
    """Sources that report upper-case names are landed in lower case."""
    return df.toDF(*[name.lower() for name in df.columns])


def register_tables(spark: SparkSession, folder: str, names: tuple[str, ...]) -> None:
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
