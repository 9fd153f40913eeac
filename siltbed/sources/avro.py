"""Avro source. The reader module of Spark is used where it is deployed, else Hadoop's Avro input format."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

AVRO_AS_TEXT = "org.apache.avro.mapred.AvroAsTextInputFormat"
TEXT = "org.apache.hadoop.io.Text"


def avro_kind(spark: SparkSession, path: str) -> str:
    """``data``, ``empty`` for a file without records, ``foreign`` for anything that is not an Avro file."""
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.avro.mapred.FsInput(
        jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()
    )
    try:
        reader = jvm.org.apache.avro.file.DataFileReader.openReader(
            source, jvm.org.apache.avro.generic.GenericDatumReader()
        )
        return "data" if reader.hasNext() else "empty"
    except Py4JJavaError:
        return "foreign"
    finally:
        source.close()


def read_avro(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    try:
        reader = spark.read.format("avro")
        return (reader.schema(schema) if schema else reader).load(paths)
    except AnalysisException:
        return _records_as_json(spark, paths, schema)


def _records_as_json(spark: SparkSession, paths: list[str], schema: T.StructType | None) -> DataFrame:
    """Splittable scan that renders each record as a JSON line. Without a schema, ``int`` comes back as ``bigint``."""
    records = spark.sparkContext.hadoopFile(",".join(paths), AVRO_AS_TEXT, TEXT, TEXT)
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(records.keys())
