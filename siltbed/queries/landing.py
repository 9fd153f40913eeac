"""File, REST, extension and streaming sources."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from siltbed import extensions, storage
from siltbed.functions.schema import descriptors
from siltbed.operators import ledger
from siltbed.plans.spec import PipelineSpec
from siltbed.queries import fixtures
from siltbed.queries.registry import query
from siltbed.queries.views import context, table
from siltbed.session import scratch_path
from siltbed.sinks.parquet import read_landed
from siltbed.sources import files, rest
from siltbed.streaming.landing import BatchRules, StreamOptions, land_stream, read_stream

CUSTOMER = "SELECT * FROM customer"
EVENTS = "SELECT * FROM events"


@query("csv_source", CUSTOMER)
def csv_source(spark, sf_dir):
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "customer").write.csv(path, header=True, sep=";")
    options = files.LandingOptions(
        (path,), "csv", fixtures.CUSTOMER_SCHEMA, {"sep": ";"}, fail_fast=True
    )
    return files.read_landing(spark, options).rows


@query("jsonl_source", CUSTOMER)
def jsonl_source(spark, sf_dir):
    path = fixtures.write_drop(table(spark, sf_dir, "customer"), scratch_path(spark, "jsonl"), "json")
    options = files.LandingOptions((path,), "json", fixtures.CUSTOMER_SCHEMA, fail_fast=True)
    return files.read_landing(spark, options).rows


@query("json_array_source", CUSTOMER)
def json_array_source(spark, sf_dir):
    """Files holding one JSON array each, among them line-delimited files; each is recognised by its first character."""
    customer = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "json-array")
    block = F.floor(F.col("c_custkey") / fixtures.FILE_ROWS)
    arrays = (
        customer.filter("c_mktsegment <> 'BUILDING'")
        .groupBy(block.alias("block"))
        .agg(F.collect_list(F.struct(*customer.columns)).alias("records"))
        .select("block", F.concat(F.lit("\n "), F.to_json("records")).alias("value"))
    )
    fixtures.write_text(arrays, f"{path}/arrays", "block")
    lines = fixtures.write_drop(customer.filter("c_mktsegment = 'BUILDING'"), f"{path}/lines", "json")
    options = files.LandingOptions(
        (*fixtures.directories(spark, f"{path}/arrays"), lines), "json", fixtures.CUSTOMER_SCHEMA, fail_fast=True
    )
    return files.read_landing(spark, options).rows


@query("avro_source", CUSTOMER)
def avro_source(spark, sf_dir):
    path = fixtures.write_avro_customers(table(spark, sf_dir, "customer"), scratch_path(spark, "avro"))
    options = files.LandingOptions((path,), "avro", fixtures.CUSTOMER_SCHEMA)
    return files.read_landing(spark, options).rows


@query(
    "binary_source",
    "SELECT source, sum(strlen(text) + 1)::BIGINT AS n_bytes FROM documents GROUP BY 1",
)
def binary_source(spark, sf_dir):
    """Documents written as text files per source and read back as raw bytes."""
    path = scratch_path(spark, "raw")
    table(spark, sf_dir, "documents").select("source", F.col("text").alias("value")).write.option(
        "maxRecordsPerFile", 1000
    ).partitionBy("source").text(path)
    raw = files.parse_files(spark, list(fixtures.directories(spark, path)), files.LandingOptions((), "binary"))
    source = F.regexp_extract(files.SOURCE_FILE, "source=([^/]+)", 1)
    return raw.groupBy(source.alias("source")).agg(F.sum(F.octet_length("raw")).alias("n_bytes"))


PAGE_NAME_SQL = r"regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]+)/?$', 1)"


def _page_listing(spark, sf_dir):
    """Pages as a directory listing: the address is the path, its last segment the file name, the text its content."""
    bare = F.split_part(F.split_part(F.col("url"), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return table(spark, sf_dir, "pages").select(
        F.concat_ws("#", "page_id", "url").alias("path"),
        F.lit(0).alias("directory"),
        F.regexp_extract(bare, "([^/]+)/?$", 1).alias("name"),
        F.octet_length("html").cast("bigint").alias("length"),
    )


@query(
    "landing_file_filter",
    f"""WITH listing AS (
          SELECT page_id || '#' || url AS path, {PAGE_NAME_SQL} AS name, strlen(html) AS length FROM pages)
        SELECT path, name, length FROM listing
        WHERE NOT (ends_with(name, '.html') OR regexp_matches(name, '^7.$') OR regexp_matches(name, '^[^0-6].[13]'))
              AND length <= 3000""",
)
def landing_file_filter(spark, sf_dir):
    kept = files.filter_listing(_page_listing(spark, sf_dir), ("*.html", "7?", "[!0-6]?[13]*"), 3000)
    return kept.select("path", "name", "length")


@query(
    "landing_unprocessed_files",
    "SELECT page_id || '#' || url AS path FROM pages WHERE url NOT LIKE 'https:%'",
)
def landing_unprocessed_files(spark, sf_dir):
    listing = _page_listing(spark, sf_dir)
    processed = listing.filter(F.col("path").like("%#https:%")).select("path")
    return files.unprocessed(listing, processed).select("path")


# A landing file is broken when an error event above this value was cut off while it was written.
BROKEN_ABOVE = 330


def _event_files(spark, sf_dir) -> tuple[str, files.LandingOptions]:
    path = scratch_path(spark, "events-json")
    events = table(spark, sf_dir, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    line = F.to_json(F.struct(*events.columns))
    broken = (F.col("event_type") == "error") & (F.col("value") > BROKEN_ABOVE)
    lines = events.select(
        F.floor(F.col("event_id") / fixtures.FILE_ROWS).alias("block"),
        F.when(broken, F.left(line, F.length(line) - 9)).otherwise(line).alias("value"),
    )
    fixtures.write_text(lines, path, "block")
    options = files.LandingOptions(
        fixtures.directories(spark, path), "json", fixtures.EVENT_SCHEMA
    )
    return path, options


_BLOCK_SQL = f"event_id // {fixtures.FILE_ROWS}"
_BROKEN_SQL = f"event_type = 'error' AND value > {BROKEN_ABOVE}"


@query(
    "landing_quarantine",
    f"SELECT ({_BLOCK_SQL})::BIGINT AS block, count(*) AS bad_records FROM events WHERE {_BROKEN_SQL} GROUP BY 1",
)
def landing_quarantine(spark, sf_dir):
    path, options = _event_files(spark, sf_dir)
    listed = files.filter_listing(files.list_directories(spark, options.paths))
    parsed = files.parse_files(spark, [row["path"] for row in listed.collect()], options)
    return files.bad_files(parsed).select(
        F.regexp_extract(files.SOURCE_FILE, r"block=(\d+)", 1).cast("bigint").alias("block"), "bad_records"
    )


@query(
    "landing_good_rows",
    f"SELECT * FROM events WHERE {_BLOCK_SQL} NOT IN (SELECT {_BLOCK_SQL} FROM events WHERE {_BROKEN_SQL})",
)
def landing_good_rows(spark, sf_dir):
    _, options = _event_files(spark, sf_dir)
    return fixtures.event_rows(files.read_landing(spark, options).rows)


@query("multi_path_union", "SELECT * FROM orders")
def multi_path_union(spark, sf_dir):
    """Several landing directories become one table in one scan."""
    path = scratch_path(spark, "multi")
    orders = table(spark, sf_dir, "orders")
    drops = [
        fixtures.write_drop(
            orders.filter(F.col("o_orderstatus") == status), f"{path}/{status}", "json", timestampFormat="yyyy-MM-dd HH:mm:ss"
        )
        for status in ("F", "O", "P")
    ]
    options = files.LandingOptions((*drops, f"{path}/missing"), "json", orders.schema, fail_fast=True)
    return files.read_landing(spark, options).rows


@query("rest_flatten", EVENTS)
def rest_flatten(spark, sf_dir):
    pages = fixtures.event_pages(spark, sf_dir)
    return fixtures.event_rows(rest.flatten_records(pages, fixtures.EVENT_SCHEMA, "data"))


@query("rest_cursor_chain", EVENTS)
def rest_cursor_chain(spark, sf_dir):
    """Endpoints side by side, the pages of each one after another along the cursor."""
    root = scratch_path(spark, "rest-cursor")
    pages = fixtures.event_pages(spark, sf_dir).withColumn("value", F.col("body"))
    first = F.col("page_no") == 1
    fixtures.write_text(pages.filter(first).select("endpoint", "value"), root, "endpoint")
    rest_of = pages.filter(~first).withColumn("cursor", F.concat(F.lit("c"), "page_no"))
    fixtures.write_text(rest_of.select("endpoint", "cursor", "value"), root, "endpoint", "cursor")
    uri = fixtures.as_uri(storage.qualified(spark, root))
    endpoints = pages.select(F.concat(F.lit(f"{uri}/endpoint="), "endpoint").alias("endpoint")).distinct()
    request = rest.RestOptions(uri, "data", "cursor", cursor_param="cursor", next_key="next")
    landed = scratch_path(spark, "rest-pages")
    rest.fetch_endpoints(endpoints, request, rest.folder_get, parallelism=8).write.parquet(landed)
    return fixtures.event_rows(
        rest.flatten_records(spark.read.parquet(landed), fixtures.EVENT_SCHEMA, "data")
    )


@query("rest_page_stop", "SELECT *, (event_id // 1000 + 1)::INTEGER AS page_no FROM events")
def rest_page_stop(spark, sf_dir):
    """Numbered pages fetched in parallel ranges that reach beyond the last page, where an empty page comes before others."""
    root = scratch_path(spark, "rest-page")
    pages = fixtures.event_pages(spark, sf_dir).select(
        (F.col("n") + 1).alias("page"), F.lit(fixtures.PAGE_ROWS).alias("page_size"), F.col("body").alias("value")
    )
    last = pages.agg(F.max("page")).first()[0]
    behind = pages.filter("page <= 2").withColumns({
        "value": F.when(F.col("page") == 1, '{"data":[]}').otherwise(F.col("value")), "page": F.col("page") + last
    })
    fixtures.write_text(pages.union(behind.select(*pages.columns)), root, "page", "page_size")
    uri = fixtures.as_uri(storage.qualified(spark, root))
    request = rest.RestOptions(
        uri, "data", "page", page_size=fixtures.PAGE_ROWS, max_pages=last + 20, parallelism=8
    )
    landed = scratch_path(spark, "rest-pages")
    rest.fetch_pages(spark, request, rest.folder_get).write.parquet(landed)
    kept = rest.before_first_empty(spark.read.parquet(landed), request.max_pages)
    return fixtures.event_rows(rest.flatten_records(kept, fixtures.EVENT_SCHEMA, "data", "page_no"))


@query("rest_offset_windows", EVENTS)
def rest_offset_windows(spark, sf_dir):
    """Offset pages at multiples of the page size stay valid up to the first short page of their endpoint."""
    landed = scratch_path(spark, "rest-pages")
    fixtures.with_pages_behind_the_end(fixtures.event_pages(spark, sf_dir)).write.parquet(landed)
    kept = rest.full_until_short(spark.read.parquet(landed), fixtures.PAGE_ROWS)
    return fixtures.event_rows(rest.flatten_records(kept, fixtures.EVENT_SCHEMA, "data"))


@query("custom_source", CUSTOMER)
def custom_source(spark, sf_dir):
    extensions.source("folder_table", lambda s, spec, ctx: table(s, spec.source_options["folder"], spec.query))
    spec = PipelineSpec("c", "bronze/c", query="customer", source="folder_table", source_options={"folder": sf_dir})
    return extensions.get_source(spec.source)(spark, spec, context())


@query("custom_parser", CUSTOMER)
def custom_parser(spark, sf_dir):
    """A user's byte parser, run over whole files in tasks."""
    customer = table(spark, sf_dir, "customer")
    lines = customer.select(F.concat_ws("|", *customer.columns).alias("value"))
    path = fixtures.write_drop(lines, scratch_path(spark, "pipes"), "text")

    def parse(data: bytes):
        for line in data.decode().splitlines():
            key, name, nation, balance, segment = line.split("|")
            yield int(key), name, int(nation), float(balance), segment

    extensions.parser("pipes", parse, fixtures.CUSTOMER_SCHEMA)
    return files.read_landing(spark, files.LandingOptions((path,), "pipes", fail_fast=True)).rows


DROPS = ("ts < '2024-01-16'", "ts >= '2024-01-16'")


def _drop_files(spark, sf_dir, part, folder) -> None:
    events = table(spark, sf_dir, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    events.filter(part).write.mode("append").json(folder)


def _two_drops(spark, sf_dir, pii_columns=None, rules=None):
    """Two drops of files, each landed by its own run of the same stream."""
    drop, target, checkpoint = (scratch_path(spark, f"stream-{part}") for part in ("drop", "target", "checkpoint"))
    source = StreamOptions(drop, "json", fixtures.EVENT_SCHEMA)
    for part in DROPS:
        _drop_files(spark, sf_dir, part, drop)
        land_stream(
            read_stream(spark, source), target, checkpoint, pii_columns=pii_columns, prepare=fixtures.event_rows, rules=rules
        ).awaitTermination()
    return read_landed(spark, target)


@query("landing_stream", EVENTS)
def landing_stream(spark, sf_dir):
    return _two_drops(spark, sf_dir)


@query(
    "landing_stream_masked",
    "SELECT event_id, ts, sha256(user_id::VARCHAR) AS user_id, event_type, value, NULL::VARCHAR AS props FROM events",
)
def landing_stream_masked(spark, sf_dir):
    return _two_drops(spark, sf_dir, {"user_id": "sha256", "props": "redact"})


@query(
    "landing_stream_ledger",
    f"""SELECT 0 AS batch, 'success' AS status, count(*) AS rows_read, count(*) AS rows_written, false AS schema_changed
        FROM events WHERE {DROPS[0]}
        UNION ALL SELECT 1, 'success', count(*), count(*), false FROM events WHERE {DROPS[1]}""",
)
def landing_stream_ledger(spark, sf_dir):
    """Every micro-batch is a run with one event."""
    rules = BatchRules(scratch_path(spark, "stream-ledger"), "events", min_rows_expected=1)
    _two_drops(spark, sf_dir, {"user_id": "sha256"}, rules)
    number = F.regexp_extract("job_id", r"-(\d+)$", 1).cast("int")
    return ledger.read(spark, rules.ledger_path).select(
        number.alias("batch"), "status", "rows_read", "rows_written", "schema_changed"
    )


@query("landing_stream_contract", EVENTS)
def landing_stream_contract(spark, sf_dir):
    """A batch that breaks the contract stops the stream, unseen; the same batch lands once the contract is mended."""
    drop, target, checkpoint = (scratch_path(spark, f"stream-{part}") for part in ("drop", "target", "checkpoint"))
    _drop_files(spark, sf_dir, "true", drop)
    source = StreamOptions(drop, "json", fixtures.EVENT_SCHEMA)
    good = descriptors(table(spark, sf_dir, "events").schema)
    bad = [*good, {"name": "session_id", "type": "string", "nullable": True}]
    ledger_path = scratch_path(spark, "stream-ledger")
    for expected in (bad, good):
        rules = BatchRules(ledger_path, "events", expected_schema=expected)
        stream = land_stream(read_stream(spark, source), target, checkpoint, prepare=fixtures.event_rows, rules=rules)
        try:
            stream.awaitTermination()
        except StreamingQueryException:
            if expected is good or next(storage.data_files(spark, target), None) is not None:
                raise
    states = [row.status for row in ledger.read(spark, ledger_path).orderBy("seq").collect()]
    if states != ["failed", "success"]:
        raise RuntimeError(f"batches ended as {states}")
    return read_landed(spark, target)
