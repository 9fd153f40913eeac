"""Stand-ins for what would arrive from outside: landing files and REST pages, written from the given tables.

Group sizes are bounded by construction (a fixed number of consecutive ids per file or page).
"""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed import storage
from siltbed.queries.views import table

PAGE_ROWS = 1000
PAGES_PER_ENDPOINT = 5
FILE_ROWS = 2000

EVENT_SCHEMA = "event_id bigint, ts string, user_id bigint, event_type string, value double, props string"
CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as numbered pages; a few pages make one endpoint, and each page names the next one of its endpoint."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    number = F.floor(F.col("event_id") / PAGE_ROWS)
    pages = (
        events.groupBy(number.alias("n"))
        .agg(F.sort_array(F.collect_list(F.struct(*events.columns))).alias("data"))
        .withColumns(
            {
                "endpoint": F.floor(F.col("n") / PAGES_PER_ENDPOINT).cast("string"),
                "page_no": (F.col("n") % PAGES_PER_ENDPOINT + 1).cast("int"),
                "n_records": F.size("data"),
            }
        )
    )
    following = F.when(
        (F.col("page_no") < PAGES_PER_ENDPOINT) & (F.col("n_records") == PAGE_ROWS),
        F.concat(F.lit("c"), F.col("page_no") + 1),
    )
    body = F.to_json(F.struct("data", following.alias("next")))
    return pages.select("n", "endpoint", "page_no", "n_records", body.alias("body"))


def with_pages_behind_the_end(pages: DataFrame) -> DataFrame:
    """Event pages and what a server may answer beyond an endpoint's end, none of which may be landed: behind a short page
    another page of records, behind a full one an empty page and then records again."""
    ends = pages.groupBy("endpoint").agg(F.max("page_no").alias("last"), F.min("n_records").alias("least"))
    again = pages.filter("page_no = 1").join(ends, "endpoint")
    short = F.col("least") < PAGE_ROWS
    behind = again.withColumn("page_no", (F.col("last") + F.when(short, 1).otherwise(2)).cast("int"))
    empty = again.filter(~short).withColumns({
        "page_no": (F.col("last") + 1).cast("int"), "n_records": F.lit(0), "body": F.lit('{"data":[]}')
    })
    return pages.unionByName(behind.select(*pages.columns)).unionByName(empty.select(*pages.columns))


def event_rows(records: DataFrame) -> DataFrame:
    return records.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def write_text(lines: DataFrame, path: str, *parts: str) -> str:
    """One file per value of ``parts``: the rows of a value meet in one task, and values are small."""
    lines.repartition(*parts).write.mode("append").partitionBy(*parts).text(path)
    return path


def write_drop(rows: DataFrame, path: str, kind: str, **options: str) -> str:
    """The folder of a drop of files, added to on repeated calls and missing as long as no row has come.

    Spark's first task writes a file even for no rows, and a blank file is refused on landing; below a partition
    folder only tasks with rows write one.
    """
    rows.withColumn("drop", F.lit(0)).write.mode("append").partitionBy("drop").format(kind).options(**options).save(path)
    return f"{path}/drop=0"


def directories(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Sub-directories of a written stand-in, in name order."""
    found = {entry.path.rsplit("/", 1)[0] for entry in storage.iter_files(spark, path) if "=" in entry.relative}
    return tuple(sorted(found))


def _zigzag(number: int) -> bytes:
    number = (number << 1) ^ (number >> 63)
    out = bytearray()
    while number > 0x7F:
        out.append((number & 0x7F) | 0x80)
        number >>= 7
    out.append(number)
    return bytes(out)


def _text(value: str) -> bytes:
    data = value.encode()
    return _zigzag(len(data)) + data


AVRO_CUSTOMER = {
    "type": "record",
    "name": "customer",
    "fields": [
        {"name": "c_custkey", "type": "long"},
        {"name": "c_name", "type": ["null", "string"]},
        {"name": "c_nationkey", "type": "int"},
        {"name": "c_acctbal", "type": "double"},
        {"name": "c_mktsegment", "type": "string"},
    ],
}


def write_avro_customers(customers: DataFrame, path: str) -> str:
    """Write Avro files from tasks, since no Avro writer is deployed here; a repeated task rewrites its own file."""
    storage.make_folder(customers.sparkSession, path)
    uri = storage.qualified(customers.sparkSession, path)

    def write(batches):
        import pandas as pd
        from pyarrow import fs
        from pyspark import TaskContext

        sync = bytes(range(16))
        header = b"Obj\x01" + _zigzag(2)
        header += _text("avro.schema") + _text(json.dumps(AVRO_CUSTOMER)) + _text("avro.codec") + _text("null")
        header += _zigzag(0) + sync
        store, root = fs.FileSystem.from_uri(as_uri(uri))
        name = f"{root}/part-{TaskContext.get().partitionId():05d}.avro"
        rows = 0
        with store.open_output_stream(name) as out:
            out.write(header)
            for batch in batches:
                block = b"".join(
                    _zigzag(int(r.c_custkey))
                    + (_zigzag(0) if r.c_name is None else _zigzag(1) + _text(r.c_name))
                    + _zigzag(int(r.c_nationkey))
                    + struct.pack("<d", r.c_acctbal)
                    + _text(r.c_mktsegment)
                    for r in batch.itertuples()
                )
                out.write(_zigzag(len(batch)) + _zigzag(len(block)) + block + sync)
                rows += len(batch)
        yield pd.DataFrame({"file": [name], "rows": [rows]})

    customers.mapInPandas(write, "file string, rows bigint").write.format("noop").mode("overwrite").save()
    return path


def as_uri(path: str) -> str:
    """Hadoop writes ``file:/x`` where other readers expect ``file:///x``."""
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
