"""Landing-directory source: list, filter, parse, and reject broken files as a whole."""

from __future__ import annotations

import codecs
import fnmatch
import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltbed import extensions, storage
from siltbed.operators.ledger import GOOD, OPEN, latest
from siltbed.session import scratch_path
from siltbed.sources.avro import avro_kind, read_avro

# Landing defaults.
SKIP_PATTERNS = ("TMP_*",)
CHARSETS = {"ascii": "US-ASCII", "iso8859-1": "ISO-8859-1", "utf-8": "UTF-8", "utf-8-sig": "UTF-8", "utf-16": "UTF-16"}

CORRUPT = "_corrupt_record"
SOURCE_FILE = "_source_file"
HELPERS = (CORRUPT, SOURCE_FILE)
UNUSABLE = ("empty", "foreign")
LISTING_SCHEMA = "path string, directory int, name string, length bigint, modified timestamp"
MANIFEST_SCHEMA = "path string, run_id string"
CLAIMS_PER_FILE = 100_000
LOCAL_SCHEME = "^file:/+"


class EmptySourceError(ValueError):
    """A file without any record, where the format needs at least one."""


@dataclass(frozen=True)
class LandingOptions:
    paths: tuple[str, ...]
    parser: str = "csv"
    schema: T.StructType | str | None = None
    parser_options: dict = field(default_factory=dict)
    skip_patterns: tuple[str, ...] = SKIP_PATTERNS
    max_files: int | None = None
    max_file_bytes: int | None = None
    fail_fast: bool = False
    manifest: str | None = None
    processed_folder: str | None = None


@dataclass(frozen=True)
class LandingRead:
    """Rows of the good files, the rejected and accepted files, and how many a limit on their number left for later."""

    rows: DataFrame
    failed_files: list[str]
    good_files: list[str] = field(default_factory=list)
    left_out: int = 0
    scratch: str | None = None


def name_skipped(name: Column, patterns: tuple[str, ...]) -> Column:
    """Shell-style patterns against the bare file name."""
    verdict = F.lit(False)
    for pattern in patterns:
        # fnmatch ends its expression with \Z or \z; Java spells the same anchor \z.
        expression = re.sub(r"\\Z$", r"\\z", fnmatch.translate(pattern))
        verdict = verdict | F.regexp_like(name, F.lit(f"^{expression}"))
    return verdict


def _plain(path: str) -> str:
    return re.sub(LOCAL_SCHEME, "/", path)


def list_directories(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """One row per file directly inside the given directories; missing directories are passed over.

    One scan over all directories that reads path, length and time only: the content column is pruned. Spark's file
    index leaves out empty files, which are added from the directory itself, and hidden names (leading ``_`` or ``.``),
    which no Spark reader would open.
    """
    present = [d for d in paths if storage.exists(spark, d)]
    if not present:
        return spark.createDataFrame([], LISTING_SCHEMA)
    roots = [_plain(storage.qualified(spark, d)).rstrip("/") for d in present]
    folder = F.regexp_replace(F.regexp_replace("path", LOCAL_SCHEME, "/"), "/[^/]*$", "")
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(present)
        .select(
            "path",
            (F.array_position(F.lit(roots), folder) - 1).cast("int").alias("directory"),
            F.element_at(F.split("path", "/"), -1).alias("name"),
            "length",
            F.col("modificationTime").alias("modified"),
        )
        .filter("directory >= 0")
    )
    empty = [
        (path, place, path.rsplit("/", 1)[-1], 0, None)
        for place, directory in enumerate(present)
        for path in storage.empty_files(spark, directory)
    ]
    return listed.unionByName(spark.createDataFrame(empty, LISTING_SCHEMA)) if empty else listed


def filter_listing(
    listing: DataFrame,
    skip_patterns: tuple[str, ...] = SKIP_PATTERNS,
    max_file_bytes: int | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Drop skipped names; drop larger files and keep the first ones in directory and name order, if limits are set."""
    kept = listing.filter(~name_skipped(F.col("name"), skip_patterns))
    if max_file_bytes is not None:
        kept = kept.filter(F.col("length") <= max_file_bytes)
    return kept if max_files is None else kept.orderBy("directory", "name", "path").limit(max_files)


def unprocessed(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of the listing that the manifest of processed files does not name."""
    return listing.join(manifest.select("path"), "path", "left_anti")


def probe_files(spark: SparkSession, paths: list[str], parser: str) -> dict[str, str]:
    """What each file holds: ``data``, for JSON ``array`` or ``lines``, or ``empty`` and ``foreign`` for unusable ones.

    JSON and Avro files are opened for their first bytes only.
    """

    def kind(path: str) -> str:
        if parser == "avro":
            return avro_kind(spark, path)
        start = storage.visible_start(spark, path, 2)
        if not start or start == "[]":
            return "empty"
        return "array" if start[0] == "[" else "lines"

    if parser not in ("avro", "json"):
        return dict.fromkeys(paths, "data")
    with ThreadPoolExecutor(max_workers=storage.PARALLEL_CALLS) as pool:
        return dict(zip(paths, pool.map(kind, paths), strict=True))


def _as_struct(schema: T.StructType | str | None) -> T.StructType | None:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _widened(schema: T.StructType) -> T.StructType:
    """Inferred integers are 64 bit, as in the canonical schemas."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return T.StructType(
        [T.StructField(f.name, T.LongType() if isinstance(f.dataType, small) else f.dataType) for f in schema.fields]
    )


def _reader(reader, schema: T.StructType, mode: str):
    if mode == "FAILFAST":
        return reader.schema(schema).option("mode", mode)
    return (
        reader.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
    )


def _with_file(rows: DataFrame) -> DataFrame:
    return rows.withColumn(SOURCE_FILE, F.col("_metadata.file_path"))


def _csv_settings(parser_options: dict) -> dict:
    """Reader settings: ``delimiter`` is taken for ``sep``, and Python's encoding names for Java's."""
    chosen = {"sep": parser_options.get("delimiter", ","), "encoding": "UTF-8", "enforceSchema": "false"}
    chosen |= {name: value for name, value in parser_options.items() if name != "delimiter"}
    try:
        chosen["encoding"] = CHARSETS.get(codecs.lookup(chosen["encoding"]).name, chosen["encoding"])
    except LookupError:
        pass  # a name only Java knows
    return {"header": "true", **chosen}


def _read_csv(spark: SparkSession, kinds: dict[str, str], options: LandingOptions, mode: str) -> DataFrame:
    settings = _csv_settings(options.parser_options)
    schema = _as_struct(options.schema)
    if schema is None:
        schema = _widened(spark.read.options(**settings).option("inferSchema", "true").csv(list(kinds)).schema)
    rows = _with_file(_reader(spark.read.options(**settings), schema, mode).csv(list(kinds)))
    # An empty field of a text column is empty text, not NULL.
    texts = {
        f.name: F.coalesce(F.col(f"`{f.name}`"), F.lit("")) for f in schema.fields if isinstance(f.dataType, T.StringType)
    }
    return rows.withColumns(texts) if texts else rows


def _read_json(spark: SparkSession, kinds: dict[str, str], options: LandingOptions, mode: str) -> DataFrame:
    """Array files and line files need different readers; both may lie in one directory."""
    schema = _as_struct(options.schema)
    parts = []
    for kind, multi_line in (("array", "true"), ("lines", "false")):
        paths = [path for path, found in kinds.items() if found == kind]
        if paths:
            reader = spark.read.options(**options.parser_options).option("multiLine", multi_line)
            known = schema or T.StructType([f for f in reader.json(paths).schema.fields if f.name != CORRUPT])
            parts.append(_with_file(_reader(reader, known, mode).json(paths)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read_avro(spark: SparkSession, kinds: dict[str, str], options: LandingOptions, mode: str) -> DataFrame:
    return read_avro(spark, list(kinds), _as_struct(options.schema))


def _read_binary(spark: SparkSession, kinds: dict[str, str], options: LandingOptions, mode: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(list(kinds))
    return _with_file(files).select(F.col("content").alias("raw"), SOURCE_FILE)


FORMATS = {"csv": _read_csv, "json": _read_json, "avro": _read_avro, "binary": _read_binary}


def parse_files(
    spark: SparkSession, paths: list[str] | dict[str, str], options: LandingOptions, mode: str = "PERMISSIVE"
) -> DataFrame:
    """Rows of the files; in permissive mode broken records carry their text in ``_corrupt_record``."""
    kinds = paths if isinstance(paths, dict) else probe_files(spark, paths, options.parser)
    kinds = {path: kind for path, kind in kinds.items() if kind not in UNUSABLE}
    if not kinds:
        raise EmptySourceError("no records to parse")
    if options.parser in FORMATS:
        return FORMATS[options.parser](spark, kinds, options, mode)
    rows = extensions.parse_bytes(spark, extensions.get_parser(options.parser), list(kinds), SOURCE_FILE, CORRUPT)
    if mode != "FAILFAST":
        return rows
    failure = F.raise_error(F.concat(F.col(SOURCE_FILE), F.lit(": "), F.col(CORRUPT))).cast("boolean")
    return rows.filter(F.when(F.col(CORRUPT).isNotNull(), failure).otherwise(F.lit(True)))


def _fingerprint(schema: T.StructType) -> Column:
    """A number that depends on every data column, so the scan must parse all of them."""
    columns = [F.col(f"`{f.name}`") for f in schema.fields if f.name not in HELPERS]
    if "map<" in schema.simpleString():  # maps have no hash
        columns = [F.to_json(F.struct(*columns))]
    return F.xxhash64(*columns)


def bad_files(parsed: DataFrame) -> DataFrame:
    """Files holding at least one broken record, with the number of broken records.

    The counts are combined before the shuffle. The fingerprint keeps column pruning from skipping the very fields
    whose values are broken.
    """
    return (
        parsed.groupBy(SOURCE_FILE)
        .agg(
            F.count_if(F.col(CORRUPT).isNotNull()).alias("bad_records"),
            F.bit_xor(_fingerprint(parsed.schema)).alias("fingerprint"),
        )
        .filter((F.col("bad_records") > 0) & F.col("fingerprint").isNotNull())
        .select(SOURCE_FILE, "bad_records")
    )


def broken_records(staged: DataFrame) -> DataFrame:
    """``bad_files`` of rows that were parsed and written before, from two of their columns."""
    return staged.filter(F.col(CORRUPT).isNotNull()).groupBy(SOURCE_FILE).agg(F.count(F.lit(1)).alias("bad_records"))


def split_staged(staged: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows of files without a broken record, and the names of the other files, from rows parsed and written before.

    The names need two columns of the staged rows; the rows are an anti-join with the broken files.
    """
    broken = staged.filter(F.col(CORRUPT).isNotNull()).select(SOURCE_FILE).distinct()
    names = [row[SOURCE_FILE] for row in broken.collect()]  # at most the files of one run
    return (staged.join(broken, SOURCE_FILE, "left_anti") if names else staged), names


def held_files(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """Claimed files (path) that no other run may land.

    A claim holds while its run has not ended and for good once it was accepted, except for files that the run rejected. It
    falls back when the run fails, be it that ``recover_unfinished`` finds out.
    """
    ended = latest(runs).select(
        F.col("job_id").alias("run_id"), "status", F.coalesce("failed_files", F.array()).alias("rejected")
    )
    return (
        claims.join(ended, "run_id")
        .filter(F.col("status").isin(*GOOD, *OPEN) & ~F.array_contains("rejected", F.col("path")))
        .select("path")
    )


def claim_files(spark: SparkSession, manifest: str, paths: list[str], run_id: str) -> None:
    """Note which files a run is about to land, before it reads any of them."""
    rows = spark.createDataFrame([(path, run_id) for path in paths], MANIFEST_SCHEMA)
    rows.repartition(-(-len(paths) // CLAIMS_PER_FILE)).write.mode("append").parquet(manifest)


def read_landing(
    spark: SparkSession, options: LandingOptions, processed: DataFrame | None = None, run_id: str | None = None,
    runs: DataFrame | None = None,
) -> LandingRead:
    """Land the files of the directories, except those that ``processed`` names or that a claim in the manifest holds.

    With ``fail_fast`` the first broken file stops the run, and rows are read as they are used. Otherwise files are parsed
    once, into a scratch table (``scratch``, the caller's to delete) that keeps each row's file and broken text, and one bad record
    keeps its whole file out. There is no limit unless the options set one: files above ``max_file_bytes`` are
    rejected like broken ones, and files beyond ``max_files`` are counted in ``left_out``.

    With a manifest and a ``run_id``, the files are claimed for that run before they are read; ``runs`` are the ledger's
    events, which tell which claims hold (see ``held_files``; without them all do). Runs that share a directory must
    not start at the same moment. The driver holds the names of the files of one run.
    """
    listing = list_directories(spark, options.paths)
    if processed is None and options.manifest and storage.exists(spark, options.manifest):
        claims = spark.read.schema(MANIFEST_SCHEMA).parquet(options.manifest)
        processed = claims if runs is None else held_files(claims, runs)
    if processed is not None:
        listing = unprocessed(listing, processed)
    named = filter_listing(listing, options.skip_patterns)
    found = named.orderBy("directory", "name", "path").collect()
    most = options.max_file_bytes
    too_large = [row["path"] for row in found if most is not None and row["length"] > most]
    found = [row for row in found if most is None or row["length"] <= most]
    left_out = 0 if options.max_files is None else max(0, len(found) - options.max_files)
    found = found[:len(found) - left_out]
    # Raw bytes may be empty; every other format needs content.
    sized = [row["path"] for row in found if row["length"] > 0 or options.parser == "binary"]
    kinds = probe_files(spark, sized, options.parser)
    usable = {path: kind for path, kind in kinds.items() if kind not in UNUSABLE}
    unusable = sorted([*too_large, *(row["path"] for row in found if row["path"] not in usable)])
    if unusable and options.fail_fast:
        raise EmptySourceError(f"no records in {unusable[0]}")
    if not usable:
        return LandingRead(spark.createDataFrame([], _as_struct(options.schema) or T.StructType([])), unusable, [], left_out)
    if options.manifest and run_id is not None:
        claim_files(spark, options.manifest, list(usable), run_id)
    if options.fail_fast or options.parser in ("avro", "binary"):
        return LandingRead(_data_columns(parse_files(spark, usable, options, "FAILFAST")), unusable, list(usable), left_out)
    parsed = parse_files(spark, usable, options)
    scratch = scratch_path(spark, "landing-rows")
    parsed.write.parquet(scratch)
    rows, names = split_staged(spark.read.schema(parsed.schema).parquet(scratch))
    # Spark's own formats name files by their encoded address, byte parsers by their plain path.
    broken = {_plain(unquote(name) if options.parser in FORMATS else name) for name in names}
    good = [path for path in usable if _plain(path) not in broken]
    failed = sorted([*unusable, *(path for path in usable if _plain(path) in broken)])
    return LandingRead(_data_columns(rows), failed, good, left_out, scratch)


def finish_landing(spark: SparkSession, options: LandingOptions, landed: LandingRead, run_id: str) -> None:
    """Call once the rows are visible: move the accepted files to the processed folder, if there is one.

    Rejected files stay where they are and are tried again. A name that is taken in the processed folder, or stands in
    several directories, gets the run id in front.
    """
    if options.processed_folder:
        folder = options.processed_folder.rstrip("/")
        storage.make_folder(spark, folder)
        names = [path.rsplit("/", 1)[-1] for path in landed.good_files]
        many, places = Counter(names), {}
        for place, (path, name) in enumerate(zip(landed.good_files, names)):
            taken = many[name] > 1 or storage.exists(spark, f"{folder}/{name}")
            places[path] = f"{folder}/{run_id}-{place}-{name}" if taken else f"{folder}/{name}"
        storage.in_parallel(lambda path: storage.rename(spark, path, places[path]), landed.good_files)


def _data_columns(rows: DataFrame) -> DataFrame:
    return rows.drop(*[name for name in HELPERS if name in rows.columns])
