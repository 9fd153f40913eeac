"""File operations through Hadoop's ``FileSystem``, so any path Spark can write can also be promoted or purged.

Only metadata passes through the driver: names, lengths and renames, never file contents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import SparkSession

PARALLEL_CALLS = 32


@dataclass(frozen=True)
class FileEntry:
    path: str
    relative: str
    length: int


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hadoop_path


def qualified(spark: SparkSession, path: str) -> str:
    fs, p = _open(spark, path)
    return fs.makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def delete_tree(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.delete(p, True)


def iter_files(spark: SparkSession, root: str, suffix: str = "") -> Iterator[FileEntry]:
    """Files below ``root``, streamed from the listing instead of held as one list."""
    fs, p = _open(spark, root)
    if not fs.exists(p):
        return
    base = fs.makeQualified(p).toString().rstrip("/") + "/"
    listing = fs.listFiles(p, True)
    while listing.hasNext():
        status = listing.next()
        path = status.getPath().toString()
        relative = path[len(base):]
        if relative.endswith(suffix):
            yield FileEntry(path, relative, status.getLen())


def data_files(spark: SparkSession, root: str) -> Iterator[FileEntry]:
    """Visible Parquet files of a dataset; anything below a hidden, non-partition directory is left out."""
    for entry in iter_files(spark, root, ".parquet"):
        if not any(part.startswith(("_", ".")) and "=" not in part for part in entry.relative.split("/")):
            yield entry


@dataclass(frozen=True)
class Entry:
    name: str
    is_folder: bool


def visible_entries(spark: SparkSession, folder: str) -> Iterator[Entry]:
    """What stands directly inside a folder and is not hidden (as Spark sees it); nothing for a missing folder."""
    fs, p = _open(spark, folder)
    if not fs.exists(p):
        return
    listing = fs.listStatusIterator(p)
    while listing.hasNext():
        status = listing.next()
        name = status.getPath().getName()
        if "=" in name or not name.startswith(("_", ".")):
            yield Entry(name, status.isDirectory())


def count_entries(spark: SparkSession, folder: str) -> int:
    """Files and folders directly inside a folder; markers of a finished write and checksums don't count."""
    fs, p = _open(spark, folder)
    if not fs.exists(p):
        return 0
    listing, n = fs.listStatusIterator(p), 0
    while listing.hasNext():
        name = listing.next().getPath().getName()
        n += name != "_SUCCESS" and not (name.startswith(".") and name.endswith(".crc"))
    return n


def delete_trees(spark: SparkSession, paths: Iterable[str]) -> int:
    return in_parallel(lambda path: delete_tree(spark, path), paths)


def in_parallel(action, items: Iterable, width: int = PARALLEL_CALLS) -> int:
    """Run ``action`` over the items with a bounded number in flight; the first error is raised."""
    done = 0
    source = iter(items)
    with ThreadPoolExecutor(max_workers=width) as pool:
        while block := list(islice(source, width * 16)):
            for _ in pool.map(action, block):
                done += 1
    return done


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _open(spark, path)
    if not fs.mkdirs(p):
        raise OSError(f"cannot create {path}")


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move one file or folder into an existing folder, under a name that is free."""
    fs, p = _open(spark, source)
    if not fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot move {source} to {target}")


def delete_files(spark: SparkSession, paths: Iterable[str]) -> int:
    def remove(path: str) -> None:
        fs, p = _open(spark, path)
        if not fs.delete(p, False) and fs.exists(p):
            raise OSError(f"cannot delete {path}")

    return in_parallel(remove, paths)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _open(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, name: str, data: bytes) -> None:
    """Write a file aside and rename it, so that readers see all of it or nothing."""
    hidden = f"{folder}/_{name}"
    write_bytes(spark, hidden, data)
    fs, p = _open(spark, hidden)
    if not fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")):
        raise OSError(f"cannot write {folder}/{name}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _open(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def empty_files(spark: SparkSession, directory: str) -> Iterator[str]:
    """Visible files without content directly inside a directory, streamed from its listing."""
    fs, p = _open(spark, directory)
    listing = fs.listStatusIterator(p)
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0 and status.isFile():
            path = status.getPath().toString()
            if not path.rsplit("/", 1)[-1].startswith(("_", ".")):
                yield path


def visible_start(spark: SparkSession, path: str, size: int) -> str:
    """The first characters that are neither white space nor a byte-order mark; shorter when the file ends before."""
    fs, p = _open(spark, path)
    stream = fs.open(p)
    found = ""
    try:
        while len(found) < size and (byte := stream.read()) >= 0:
            if byte not in (9, 10, 11, 12, 13, 32, 0xEF, 0xBB, 0xBF):
                found += chr(byte)
        return found
    finally:
        stream.close()
