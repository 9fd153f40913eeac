"""Parquet sink: write to a staging folder, promote when the run is accepted, discard otherwise.

The files of a run stay together in one folder (one for each partition), so a run becomes visible, is replaced or undone
by renaming or deleting folders; no single file is listed or moved.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed import storage
from siltbed.functions.masking import utc_wall_time

INGEST_DATE = "_date"
STAGING = "_staging"
#: Inside a run's staging folder: its rows, the note of what is moved where, and the note that it was.
DATA, MOVING, MOVED = "data", "_moving", "_moved"
#: A run's visible folder is named ``_run=<run id>~<attempt>``.
RUN = "_run"
ROWS_READ = "rows_read"
#: Between run id and attempt; run ids may not hold it.
MARK = "~"


@dataclass(frozen=True)
class StagedWrite:
    path: str
    run_id: str
    rows_read: int
    rows_written: int
    max_key: str | None = None
    partition_by: str | None = None

    @property
    def staging(self) -> str:
        return staging_path(self.path, self.run_id)


def staging_path(path: str, run_id: str) -> str:
    return f"{path.rstrip('/')}/{STAGING}/{run_id}"


def with_ingest_date(df: DataFrame, day: date) -> DataFrame:
    """One constant value per run, so writing by it needs no shuffle."""
    return df.withColumn(INGEST_DATE, F.lit(day.isoformat()))


def _key_text(df: DataFrame, name: str) -> Column:
    """Key as UTC text that sorts like the key itself."""
    key = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.TimestampType):
        key = utc_wall_time(key)
    return F.date_format(key.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def stage(
    df: DataFrame,
    path: str,
    run_id: str,
    partition_by: str | None = None,
    compression: str = "snappy",
    max_key: str | None = None,
) -> StagedWrite:
    """Write to staging in one job, counting rows on the way; the written count is then read from the file footers.

    The counter sits in the stage that writes, where only the first finished attempt of a task counts, so a lost
    executor does not inflate it.
    """
    if MARK in run_id or "/" in run_id or not run_id:
        raise ValueError(f"run id {run_id!r} may not be empty or hold {MARK!r} or '/'")
    spark = df.sparkSession
    recover(spark, path, run_id)  # of an earlier attempt
    target = f"{staging_path(path, run_id)}/{DATA}"
    metrics = [F.count(F.lit(1)).alias(ROWS_READ)]
    if max_key is not None:
        metrics.append(F.max(_key_text(df, max_key)).alias("max_key"))
    seen = Observation()
    writer = df.observe(seen, *metrics).write.option("compression", compression)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(target)
    found = seen.get
    written = spark.read.schema(df.schema).parquet(target).count()
    return StagedWrite(path, run_id, found[ROWS_READ], written, found.get("max_key"), partition_by)


def _note(path: str, run_id: str, name: str) -> str:
    return f"{staging_path(path, run_id)}/{name}"


def _below(root: str, folder: str) -> str:
    return f"{root}/{folder}" if folder else root


def _is_run(name: str, run_id: str) -> bool:
    return name.startswith(f"{RUN}={run_id}{MARK}")


def promote(
    spark: SparkSession, staged: StagedWrite, replace: bool, keep_marker: bool = False, repeated: bool = False,
    record: str = "",
) -> int:
    """Make a staged run visible: one rename for a run, or for each partition it wrote. Returns how many.

    A run's files stay together in a folder of their own, below the partition when the dataset is partitioned. First a
    note names these folders and what they replace: all that is visible beside them when ``replace`` is set (of a
    partitioned dataset only in the partitions written, so a run without rows replaces nothing), or the folders of an
    earlier attempt under the same run id when ``repeated`` is. Then the folders are moved in, and a second note
    makes the whole of it valid at one moment: ``read_landed`` sees the old rows before and the new ones from then on.
    What was replaced is deleted last. ``keep_marker`` leaves the notes to be discarded by the caller once the run is
    recorded; ``record`` is kept with them for ``recover``.
    """
    root, data = staged.path.rstrip("/"), f"{staged.staging}/{DATA}"
    folders = [""]
    if staged.partition_by is not None:
        folders = [e.name for e in storage.visible_entries(spark, data) if e.name.startswith(f"{staged.partition_by}=")]
    name = f"{RUN}={staged.run_id}{MARK}{uuid.uuid4().hex[:8]}"
    targets = [_below(folder, name) if folder else name for folder in folders]
    replaced = []
    if replace or repeated:
        for folder in folders:
            for entry in storage.visible_entries(spark, _below(root, folder)):
                if replace or _is_run(entry.name, staged.run_id):
                    replaced.append(_below(folder, entry.name) if folder else entry.name)
    storage.write_text(spark, _note(staged.path, staged.run_id, MOVING), json.dumps([targets, replaced]))
    for folder, target in zip(folders, targets):
        storage.make_folder(spark, _below(root, folder))
        storage.rename(spark, _below(data, folder), f"{root}/{target}")
    # Written aside and renamed, so that the note is there as a whole or not at all.
    storage.write_text(spark, _note(staged.path, staged.run_id, f"{MOVED}-new"), record)
    storage.rename(spark, _note(staged.path, staged.run_id, f"{MOVED}-new"), _note(staged.path, staged.run_id, MOVED))
    storage.delete_trees(spark, [f"{root}/{entry}" for entry in replaced])
    if not keep_marker:
        discard(spark, staged.path, staged.run_id)
    return len(targets)


def discard(spark: SparkSession, path: str, run_id: str) -> None:
    """Remove a run's staging folder; nothing in it is visible."""
    storage.delete_tree(spark, staging_path(path, run_id))


@dataclass(frozen=True)
class Promotion:
    """An unfinished promotion: the folders of the run, what they replace, and whether the run is valid already."""

    targets: list[str]
    replaced: list[str]
    valid: bool
    record: str = ""

    @property
    def void(self) -> list[str]:
        """What lies in the dataset but doesn't count."""
        return self.replaced if self.valid else self.targets


def _promotion(spark: SparkSession, path: str, run_id: str) -> Promotion | None:
    note = _note(path, run_id, MOVING)
    if not storage.exists(spark, note):
        return None
    text = storage.read_text(spark, note)
    try:
        targets, replaced = json.loads(text)
    except ValueError:  # died while writing the note, so nothing was moved
        return None
    moved = _note(path, run_id, MOVED)
    valid = storage.exists(spark, moved)
    return Promotion(targets, replaced, valid, storage.read_text(spark, moved) if valid else "")


def recover(spark: SparkSession, path: str, run_id: str) -> Promotion | None:
    """Settle a run that died before it was recorded: its promotion if the run is valid, none if it was undone.

    A valid run is completed by deleting what it replaces, any other by deleting the folders it had moved in.
    """
    found, root = _promotion(spark, path, run_id), path.rstrip("/")
    if found:
        storage.delete_trees(spark, [f"{root}/{entry}" for entry in found.void])
    discard(spark, path, run_id)
    return found if found and found.valid else None


def _visible_folders(spark: SparkSession, root: str, void: set[str], below: str = "") -> Iterator[str]:
    """Entries that hold rows, except void ones: run folders and plain files, inside partitions too."""
    for entry in storage.visible_entries(spark, _below(root, below)):
        relative = _below(below, entry.name) if below else entry.name
        if relative in void:
            continue
        if entry.is_folder and not entry.name.startswith(f"{RUN}="):
            yield from _visible_folders(spark, root, void, relative)
        else:
            yield f"{root}/{relative}"


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """A landed dataset, without what an unfinished promotion left in it.

    The ingest date keeps its text type instead of being inferred as a date; run folders aren't a column.
    """
    root = path.rstrip("/")
    unfinished = [
        found for entry in storage.visible_entries(spark, f"{root}/{STAGING}")
        if (found := _promotion(spark, path, entry.name))
    ]
    void = {entry for found in unfinished for entry in found.void}
    if void:
        kept = list(_visible_folders(spark, root, void))
        landed = spark.read.option("basePath", root).parquet(*kept) if kept else spark.createDataFrame([], T.StructType())
    else:
        landed = spark.read.parquet(path)
    landed = landed.drop(RUN)
    return landed.withColumn(INGEST_DATE, F.col(INGEST_DATE).cast("string")) if INGEST_DATE in landed.columns else landed
