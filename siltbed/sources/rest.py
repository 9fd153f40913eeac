"""Paged REST responses.

Fetching and flattening are separate: pages are fetched into rows ``(endpoint, page_no, n_records, body)`` and
should be landed once; stopping rules and record extraction then run as DataFrame operations over the landed pages,
so no page is requested twice.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import MISSING, dataclass, field, fields, replace
from typing import Any
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltbed.functions.guards import host_allowed
from siltbed.plans.spec import check_host
from siltbed.session import scratch_path

# Request defaults.
MAX_PAGES = 100
PAGE_SIZE = 100
TIMEOUT_SECONDS = 30
PAGE_SCHEMA = "endpoint string, page_no int, n_records int, body string"



class PageLimitError(RuntimeError):
    """The limit on pages was reached while the endpoint had more."""


Transport = Callable[[str, dict, dict], str]


@dataclass(frozen=True)
class RestOptions:
    url: str
    results_key: str | None = None
    pagination: str = "none"
    cursor_param: str = "cursor"
    next_key: str = "next_cursor"
    page_param: str = "page"
    offset_param: str = "offset"
    size_param: str | None = None
    page_size: int = PAGE_SIZE
    max_pages: int = MAX_PAGES
    page_delay: float = 0.0
    headers: dict = field(default_factory=dict)
    parallelism: int = 1
    auth_type: str = "none"
    auth: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.pagination not in ("none", "cursor", "page", "offset"):
            raise ValueError(f"unknown pagination {self.pagination!r}")


def http_get(url: str, params: dict, headers: dict) -> str:
    address = f"{url}{'&' if '?' in url else '?'}{urlencode(params)}" if params else url
    with urlopen(Request(address, headers=headers), timeout=TIMEOUT_SECONDS) as response:
        return response.read().decode("utf-8")


def folder_get(url: str, params: dict, headers: dict) -> str:
    """Replay landed pages: each query parameter is a ``name=value`` directory below the URL."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(url)
    folder = "/".join([root.rstrip("/"), *(f"{k}={v}" for k, v in params.items())])
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    pages = sorted(
        info.path for info in found if info.type == fs.FileType.File and not info.base_name.startswith(("_", "."))
    )
    if not pages:
        return "[]"
    with store.open_input_stream(pages[0]) as stream:
        return stream.read().decode("utf-8")


class Login:
    """Settings of one kind of login; the fields of a kind are the settings it needs."""

    def headers(self, fetch_token: Callable[[ClientCredentials], str]) -> dict:
        return {}


@dataclass(frozen=True)
class NoLogin(Login):
    pass


@dataclass(frozen=True)
class BearerToken(Login):
    token: str

    def headers(self, fetch_token) -> dict:
        return {"Authorization": f"Bearer {self.token}"}


@dataclass(frozen=True)
class ApiKey(Login):
    header: str
    key: str

    def headers(self, fetch_token) -> dict:
        return {self.header: self.key}


@dataclass(frozen=True)
class ClientCredentials(Login):
    token_url: str
    client_id: str
    client_secret: str
    scope: str = ""

    def headers(self, fetch_token) -> dict:
        return BearerToken(fetch_token(self)).headers(fetch_token)

    def form(self) -> bytes:
        """Body of the token request; the names are those of the protocol."""
        return urlencode({
            "grant_type": "client_credentials", "client_id": self.client_id, "client_secret": self.client_secret,
            "scope": self.scope,
        }).encode()


# Names of the kinds of login.
LOGINS = {"none": NoLogin, "bearer": BearerToken, "api_key": ApiKey, "oauth2_client_credentials": ClientCredentials}


def ask_token(login: ClientCredentials) -> str:
    request = Request(login.token_url, data=login.form(), method="POST")
    with urlopen(request, timeout=TIMEOUT_SECONDS) as reply:
        return json.load(reply)["access_token"]


def login_of(auth_type: str, settings: dict) -> Login:
    if auth_type not in LOGINS:
        raise ValueError(f"unknown auth type {auth_type!r}")
    kind = LOGINS[auth_type]
    known = {f.name: settings[f.name] for f in fields(kind) if f.name in settings}
    missing = [f.name for f in fields(kind) if f.name not in known and f.default is MISSING]
    if missing:
        raise ValueError(f"{auth_type} needs {missing}")
    return kind(**known)


def auth_headers(auth_type: str, config: dict, headers: dict | None = None, fetch_token=None,
                 allowed_hosts: tuple[str, ...] = ()) -> dict:
    """Request headers, built once on the driver. A client-credentials token is fetched here and only here."""
    login = login_of(auth_type, config)
    if isinstance(login, ClientCredentials):
        check_host(login.token_url, allowed_hosts)
    return {**(headers or {}), **login.headers(fetch_token or ask_token)}


def count_items(body: Any, results_key: str | None) -> int:
    """Records of a parsed body, counted as ``count_records`` does for landed text: a single object is one record."""
    if results_key and isinstance(body, dict):
        for name in results_key.split("."):
            body = body[name]
    return len(body) if isinstance(body, list) else 1


def iter_pages(
    options: RestOptions, transport: Transport, pages: range | None = None, offset: int = 0, whole: bool = False
) -> Iterator[tuple]:
    """Request pages one after another, in bounded memory, until an empty page or a missing cursor.

    Offsets count the records received, from ``offset`` on, or with ``whole`` go on as if every page were full.

    Servers may give fewer records a page than asked, so any records on the last page allowed mean that more may follow.
    """
    size_param = options.size_param or {"page": "page_size", "offset": "limit"}.get(options.pagination)
    params: dict = {}
    known = pages or range(1, (1 if options.pagination == "none" else options.max_pages) + 1)
    received = offset
    for page_no in known:
        if options.pagination == "page":
            params = {options.page_param: page_no, size_param: options.page_size}
        elif options.pagination == "offset":
            params = {options.offset_param: received, size_param: options.page_size}
        text = transport(options.url, params, options.headers)
        body = json.loads(text)
        n = count_items(body, options.results_key)
        if n == 0:
            return
        yield options.url, page_no, n, text
        received += options.page_size if whole else n
        if options.pagination == "none":
            return
        if options.pagination == "cursor":
            following = body.get(options.next_key) if isinstance(body, dict) else None
            if not following:
                return
            params = {options.cursor_param: following}
        if page_no == options.max_pages:
            raise PageLimitError(f"{options.url}: more may follow page {page_no}, but max_pages is {options.max_pages}")
        if options.page_delay > 0:
            time.sleep(options.page_delay)


@dataclass
class PageRange(InputPartition):
    first: int
    last: int
    offset: int = 0
    whole: bool = False


class RestReader(DataSourceReader):
    def __init__(self, options: RestOptions, transport: Transport, resume: PageRange | None = None) -> None:
        self.options = options
        self.transport = transport
        self.resume = resume

    def partitions(self) -> list[InputPartition]:
        """Page numbers, and the offsets of full pages, are known beforehand, so they can be split; a cursor, or what
        follows a short page, depends on earlier answers."""
        if self.resume:
            return [self.resume]
        last, size = self.options.max_pages, self.options.page_size
        if self.options.pagination not in ("page", "offset") or self.options.parallelism <= 1:
            return [PageRange(1, 1 if self.options.pagination == "none" else last)]
        width = -(-last // self.options.parallelism)
        return [PageRange(lo, min(lo + width - 1, last), (lo - 1) * size, True) for lo in range(1, last + 1, width)]

    def read(self, partition: PageRange) -> Iterator:
        """Every page as a batch of its own: Spark would gather tuples, with their bodies, into batches of 10,000."""
        import pyarrow as pa

        pages = range(partition.first, partition.last + 1)
        for endpoint, page_no, n, text in iter_pages(self.options, self.transport, pages, partition.offset, partition.whole):
            yield pa.RecordBatch.from_arrays(
                [pa.array([endpoint]), pa.array([page_no], pa.int32()), pa.array([n], pa.int32()), pa.array([text])],
                ["endpoint", "page_no", "n_records", "body"],
            )


def rest_source(transport: Transport) -> type[DataSource]:
    """Data source class bound to one way of fetching; its options are the JSON text of ``RestOptions``."""

    class RestSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "rest_pages"

        def schema(self) -> str:
            return PAGE_SCHEMA

        def reader(self, schema: T.StructType) -> DataSourceReader:
            resume = json.loads(self.options["resume"])
            return RestReader(
                RestOptions(**json.loads(self.options["request"])), transport, PageRange(*resume) if resume else None
            )

    return RestSource


def with_login(options: RestOptions, allowed_hosts: tuple[str, ...] = ()) -> RestOptions:
    headers = auth_headers(options.auth_type, options.auth, options.headers, allowed_hosts=allowed_hosts)
    return replace(options, headers=headers, auth_type="none", auth={})


def fetch_pages(
    spark: SparkSession,
    options: RestOptions,
    transport: Transport = http_get,
    allowed_hosts: tuple[str, ...] = (),
    resume: tuple[int, int, int] | None = None,
) -> DataFrame:
    """Pages of one endpoint. The login is turned into headers here, so tasks get those and no secrets to ask with.

    ``resume`` reads on one page after another, from a page number to another, the first at a given offset.
    """
    check_host(options.url, allowed_hosts)
    options = with_login(options, allowed_hosts)
    spark.dataSource.register(rest_source(transport))
    return (
        spark.read.format("rest_pages")
        .option("request", json.dumps(options.__dict__))
        .option("resume", json.dumps(resume))
        .load()
    )


def fetch_endpoints(
    endpoints: DataFrame,
    template: RestOptions,
    transport: Transport = http_get,
    parallelism: int = 64,
    allowed_hosts: tuple[str, ...] = (),
) -> DataFrame:
    """Pages of every endpoint in the ``endpoint`` column. An endpoint is sequential; endpoints run side by side."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for url in batch["endpoint"]:
                pages = iter_pages(RestOptions(**{**template.__dict__, "url": url}), transport)
                for page in pages:
                    yield pd.DataFrame([page], columns=["endpoint", "page_no", "n_records", "body"])

    template = with_login(template, allowed_hosts)
    wanted = endpoints.select("endpoint").distinct()
    if allowed_hosts:
        refused = F.raise_error(F.concat(F.lit("host is not on the allow list: "), "endpoint")).cast("boolean")
        wanted = wanted.filter(F.when(host_allowed(F.col("endpoint"), allowed_hosts), True).otherwise(refused))
    return wanted.repartition(parallelism, "endpoint").mapInPandas(run, PAGE_SCHEMA)


def before_first_empty(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Keep each endpoint's pages up to its first empty or missing page, and no more than the page cap if there is one.

    Pages fetched in parallel ranges may lie behind the end; those are dropped here. The per-endpoint end is a
    partially aggregated number, so an endpoint with very many pages is never gathered in one task.
    """
    filled = pages.filter((F.col("n_records") > 0) & (F.col("page_no") >= 1))
    if max_pages is not None:
        filled = filled.filter(F.col("page_no") <= max_pages)
    present = filled.select("endpoint", "page_no")
    wanted = present.select(
        "endpoint", F.explode(F.array(F.lit(1), F.col("page_no") + 1)).alias("page_no")
    ).distinct()
    ends = (
        wanted.join(present, ["endpoint", "page_no"], "left_anti")
        .groupBy("endpoint")
        .agg(F.min("page_no").alias("first_empty"))
    )
    return filled.join(ends, "endpoint").filter(F.col("page_no") < F.col("first_empty")).drop("first_empty")


def full_until_short(pages: DataFrame, page_size: int, max_pages: int | None = None) -> DataFrame:
    """Offset pages fetched at multiples of the page size are right up to and including the first short page.

    After a short page the true offset is no longer a multiple, so later pages must come from the sequential reader.
    """
    reached = before_first_empty(pages, max_pages)
    short = (
        reached.filter(F.col("n_records") < page_size)
        .groupBy("endpoint")
        .agg(F.min("page_no").alias("first_short"))
    )
    return (
        reached.join(short, "endpoint", "left")
        .filter(F.col("first_short").isNull() | (F.col("page_no") <= F.col("first_short")))
        .drop("first_short")
    )


def _list_text(results_key: str | None) -> Column:
    """The part of a body that holds the records; a body that is itself a list is taken whole."""
    body = F.col("body")
    if not results_key:
        return body
    return F.when(body.rlike(r"^\s*\["), body).otherwise(F.get_json_object(body, "$." + results_key))


def flatten_records(pages: DataFrame, record_schema: str, results_key: str | None, *keep: str) -> DataFrame:
    """One row per record of the page bodies, parsed with a declared schema."""
    body = _list_text(results_key)
    record = F.from_json(body, F.lit(f"array<struct<{_ddl_fields(record_schema)}>>"))
    return pages.select(*keep, F.explode(record).alias("record")).select(*keep, "record.*")


def infer_records(pages: DataFrame, results_key: str | None, scratch: list[str] | None = None) -> DataFrame:
    """Records of landed pages when no schema is declared: the union of all keys, typed by Spark's JSON reader."""
    spark = pages.sparkSession
    lines = flatten_texts(pages, results_key)
    path = scratch_path(spark, "rest-records")
    if scratch is not None:
        scratch.append(path)
    lines.write.text(path)
    return spark.read.json(path)


def flatten_texts(pages: DataFrame, results_key: str | None) -> DataFrame:
    """One JSON text per record."""
    body = _list_text(results_key)
    single = ~body.rlike(r"^\s*\[")
    texts = F.when(single, F.array(body)).otherwise(F.from_json(body, F.lit("array<string>")))
    return pages.select(F.explode(texts).alias("value"))


def check_page_limit(landed: DataFrame, options: RestOptions) -> None:
    """Refuse pages that reach the limit with any records: the endpoint may have more, however short its pages are."""
    last = landed.filter(F.col("page_no") == options.max_pages).agg(F.max("n_records")).first()[0]
    if last is not None and last > 0:
        raise PageLimitError(f"{options.url}: page {options.max_pages} has records; raise max_pages to read on")


def offset_pages(
    spark: SparkSession, options: RestOptions, transport: Transport, allowed_hosts: tuple[str, ...], raw: str
) -> DataFrame:
    """All pages of an endpoint read by offset, landed in ``raw``, in two phases.

    Windows at multiples of the page size are fetched side by side. They are right up to the first short page; behind
    it the true offset is no longer a multiple, so reading resumes there, one page after another, until an empty page.
    """
    fetch_pages(spark, options, transport, allowed_hosts).write.parquet(f"{raw}/windows")
    landed = spark.read.parquet(f"{raw}/windows")
    windows = full_until_short(landed, options.page_size, options.max_pages)
    ends = windows.agg(
        F.max("page_no").alias("last"), F.coalesce(F.sum("n_records"), F.lit(0)).alias("records"),
        F.count_if(F.col("n_records") < options.page_size).alias("short"),
    ).first()
    if not ends["short"]:
        check_page_limit(windows, options)
        return windows
    if ends["last"] == options.max_pages:
        raise PageLimitError(f"{options.url}: more may follow page {ends['last']}, but max_pages is {options.max_pages}")
    resume = (ends["last"] + 1, options.max_pages, ends["records"])
    fetch_pages(spark, options, transport, allowed_hosts, resume).write.parquet(f"{raw}/rest")
    return windows.unionByName(spark.read.parquet(f"{raw}/rest"))


def read_rest(
    spark: SparkSession,
    options: RestOptions,
    record_schema: str | None = None,
    transport: Transport = http_get,
    allowed_hosts: tuple[str, ...] = (),
    scratch: list[str] | None = None,
) -> DataFrame:
    """Records of one endpoint: fetch once, keep the raw pages, apply the stopping rule, flatten.

    Raw pages and records lie unmasked in scratch tables, whose paths are added to ``scratch`` for the caller to delete
    once the rows are used.
    """
    scratch = [] if scratch is None else scratch
    raw = scratch_path(spark, "rest-pages")
    scratch.append(raw)
    if options.pagination == "offset" and options.parallelism > 1:
        pages = offset_pages(spark, options, transport, allowed_hosts, raw)
    else:
        fetch_pages(spark, options, transport, allowed_hosts).write.parquet(raw)
        landed = spark.read.parquet(raw)
        if options.pagination in ("page", "offset"):
            check_page_limit(landed, options)
        pages = before_first_empty(landed, options.max_pages)
    if record_schema is None:
        return infer_records(pages, options.results_key, scratch)
    return flatten_records(pages, record_schema, options.results_key)


def _ddl_fields(schema: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)


def count_records(body: Column, results_key: str | None) -> Column:
    """Number of records in a landed body that was not counted while fetching."""
    listed = F.get_json_object(body, "$." + results_key) if results_key else body
    return F.coalesce(F.json_array_length(F.when(body.rlike(r"^\s*\["), body).otherwise(listed)), F.lit(1))
