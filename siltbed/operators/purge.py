"""Audited erasure of landed files."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed import storage
from siltbed.operators.ledger import AUDIT_LIMITS, append, latest, next_seq, page
from siltbed.plans.spec import static_prefix
from siltbed.session import scratch_path

# Fixed value: how a partition date is written in a path.
DATE_IN_PATH = r"_date=(\d{4}-\d{2}-\d{2})"
AUDIT_SCHEMA = """
    seq bigint, id string, pipeline_id string, requested_by string, before_date date, partition_filter string,
    files_deleted bigint, bytes_deleted bigint, status string, requested_at timestamp, completed_at timestamp
"""


@dataclass(frozen=True)
class PurgeResult:
    files_deleted: int
    bytes_deleted: int


def template_pattern(rest: str) -> str | None:
    """Pattern of the paths below a template's fixed part, with its (first) date as a group; none without a date."""
    if "{date}" not in rest:
        return None
    first, *others = (re.sub(r"([^A-Za-z0-9_/])", r"\\\1", part) for part in rest.strip("/").split("{date}"))
    day = r"\d{4}-\d{2}-\d{2}"
    return f"^{first}({day})" + f"(?:{day})".join(others) + "/"


def plan(
    spark: SparkSession, base_path: str, before: date | None = None, partition_filter: str | None = None
) -> DataFrame:
    """Files to delete: ``relative``, ``length``, ``partition_date``. File contents are not read.

    With ``before``, files outside a dated partition are left alone. The filter is matched inside the path below the
    base only. Of a ``{date}`` template only files that one of its paths holds are planned, and their partition date is
    the one in the template's place, so pipelines that share its fixed part are left alone.
    """
    root = static_prefix(base_path)
    template = template_pattern(base_path[len(root):])
    base = storage.qualified(spark, root).rstrip("/")
    if not storage.exists(spark, root):
        return spark.createDataFrame([], "path string, relative string, length bigint, partition_date date")
    scheme = r"^[a-z0-9]+:/+"
    plain_base = F.regexp_replace(F.lit(base), scheme, "/")
    plain_path = F.regexp_replace("path", scheme, "/")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(root)
        .select("path", "length")
        .withColumn("relative", F.substr(plain_path, F.length(plain_base) + 2))
        .withColumn("partition_date", F.regexp_extract("relative", template or DATE_IN_PATH, 1).try_cast("date"))
    )
    if template:
        files = files.filter(F.col("partition_date").isNotNull())
    if partition_filter:
        files = files.filter(F.contains("relative", F.lit(partition_filter)))
    if before is not None:
        files = files.filter(F.col("partition_date") < F.lit(before))
    return files.select("path", "relative", "length", "partition_date")


def totals(planned: DataFrame) -> DataFrame:
    return planned.agg(
        F.count(F.lit(1)).alias("estimated_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    )


def apply(spark: SparkSession, planned: DataFrame, manifest: str | None = None) -> PurgeResult:
    """Delete the planned files and report what was planned.

    The plan is written down before anything is deleted, so a purge that was interrupted can be repeated from its
    manifest with ``apply_manifest`` and still reports the full counts.
    """
    manifest = manifest or scratch_path(spark, "purge-manifest")
    planned.write.parquet(manifest)
    return apply_manifest(spark, manifest)


def whole_folders(listed: DataFrame) -> DataFrame:
    """Folders of the planned files, and how many of their files are planned."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return listed.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("planned"))


def apply_manifest(spark: SparkSession, manifest: str) -> PurgeResult:
    """Delete what a manifest names: a folder whose files are all planned by one call, others file by file.

    What a folder holds is counted when its turn comes. Folders, and the files of those that a filter splits, are streamed
    from the manifest to the deleting threads, never held as a whole.
    """
    listed = spark.read.parquet(manifest)
    split = scratch_path(spark, "purge-split")
    storage.make_folder(spark, split)

    def remove(row) -> None:
        found = storage.count_entries(spark, row["folder"])
        if found == row["planned"]:
            storage.delete_tree(spark, row["folder"])
        elif found:
            storage.write_text(spark, f"{split}/{uuid.uuid4().hex}", row["folder"])

    storage.in_parallel(remove, whole_folders(listed).toLocalIterator())
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    if next(storage.iter_files(spark, split), None) is not None:
        parts = spark.read.text(split).withColumnRenamed("value", "folder")
        rest = listed.select("path", folder.alias("folder")).join(parts, "folder", "left_semi")
        storage.delete_files(spark, (row["path"] for row in rest.toLocalIterator()))
    storage.delete_tree(spark, split)
    return PurgeResult(*totals(listed).first())


def run(
    spark: SparkSession,
    audit_path: str,
    base_path: str,
    now: datetime,
    pipeline_id: str | None = None,
    requested_by: str | None = None,
    before: date | None = None,
    partition_filter: str | None = None,
) -> PurgeResult:
    """Purge with its audit trail: an event when it is requested, another with the counts when it is done.

    A purge that dies in between stays ``in_progress`` in the audit.
    """
    event = {
        "seq": next_seq(now),
        "id": uuid.uuid4().hex,
        "pipeline_id": pipeline_id,
        "requested_by": requested_by,
        "before_date": before,
        "partition_filter": partition_filter,
        "files_deleted": None,
        "bytes_deleted": None,
        "status": "in_progress",
        "requested_at": now,
        "completed_at": None,
    }
    append(spark, audit_path, event, AUDIT_SCHEMA)
    result = apply(spark, plan(spark, base_path, before, partition_filter))
    closing = {**result.__dict__, "seq": event["seq"] + 1, "status": "completed", "completed_at": datetime.now(UTC)}
    append(spark, audit_path, event | closing, AUDIT_SCHEMA)
    return result


def audit(events: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Current state of every purge, newest request first."""
    return page(latest(events, "id"), [F.desc("requested_at"), F.desc("id")], limit, offset, AUDIT_LIMITS)


def audit_event(events: DataFrame, event_id: str) -> DataFrame:
    return latest(events.filter(F.col("id") == event_id), "id")
