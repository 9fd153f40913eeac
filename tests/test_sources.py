import json
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltbed import extensions, storage
from siltbed.operators.incremental import after_watermark, in_window, resolve_key
from siltbed.operators.preview import preview
from siltbed.plans.spec import BackfillWindow, RunContext, SpecError
from siltbed.queries.fixtures import CUSTOMER_SCHEMA, as_uri, write_avro_customers
from siltbed.sources import files, jdbc, rest
from siltbed.sources.sql import query_source


def put(spark, path, content):
    """Write one small file through the same file system the readers use."""
    data = content.encode("utf-8") if isinstance(content, str) else content
    fs, p = storage._open(spark, path)
    out = fs.create(p)
    if data:
        out.write(data)
    out.close()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- query source, incremental, preview


def test_query_source_resolves_and_strips(spark):
    ctx = RunContext(min_date="2000-01-02")
    assert query_source(spark, "SELECT @MIN_DATE AS d ; ", ctx).first()["d"] == "2000-01-02"


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_watermark_is_strict_and_window_half_open(spark, kind):
    df = spark.createDataFrame([(d,) for d in ("2024-01-01", "2024-01-02", "2024-01-03", None)], "t string").select(
        F.col("t").cast(kind).alias("t")
    )

    def days(found):
        return [str(r[0])[:10] for r in found.orderBy("t").collect()]

    assert days(after_watermark(df, "t", "2024-01-02T00:00:00+00:00")) == ["2024-01-03"]
    assert days(after_watermark(df, "q.t", "2024-01-01T22:00:00-03:00")) == ["2024-01-03"]
    assert after_watermark(df, "t", None).count() == 4
    assert days(in_window(df, "t", BackfillWindow("2024-01-01", "2024-01-03"))) == ["2024-01-01", "2024-01-02"]


def test_watermark_reaches_the_parquet_scan(spark, folder):
    spark.sql("SELECT id, TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(cast(id AS int)) AS t FROM range(10)").write.parquet(folder)
    plan = after_watermark(spark.read.parquet(folder), "t", "2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(t,2024-01-05" in plan


def test_key_must_exist_and_be_comparable(spark):
    df = spark.createDataFrame([(1, "x")], "id bigint, T string")
    assert resolve_key(df, "a.t").name == "T"
    for key in ("nope", "id; drop", "id"):
        with pytest.raises(SpecError):
            after_watermark(df, key, "2024-01-01")
    with pytest.raises(SpecError):
        after_watermark(df, "T", "not a date")


def test_preview(spark):
    result = preview(spark, "SELECT id FROM range(1000);", RunContext())
    assert (result.columns, result.row_count, len(result.rows)) == (["id"], 100, 100)
    assert preview(spark, "SELECT id FROM range(1000) LIMIT 3", RunContext()).row_count == 3


# ---- JDBC options (no database is started here)


def test_connect_timeout_only_for_postgres():
    assert jdbc.with_connect_timeout("jdbc:postgresql://h/db") == "jdbc:postgresql://h/db?connectTimeout=30"
    assert jdbc.with_connect_timeout("jdbc:postgresql://h/db?ssl=true") == "jdbc:postgresql://h/db?ssl=true&connectTimeout=30"
    assert jdbc.with_connect_timeout("postgresql://h/db") == "postgresql://h/db?connect_timeout=30"
    for url in ("jdbc:postgresql://h/db?connectTimeout=5", "postgres://h/db?connect_timeout=9", "jdbc:mysql://h/db", "jdbc:oracle:thin:@//h/s"):
        assert jdbc.with_connect_timeout(url) == url


def test_jdbc_options():
    source = jdbc.JdbcSource("jdbc:mysql://h/db", "SELECT 1", partition_on="id", partition_num=4, custom_schema="id bigint")
    options = jdbc.reader_options(source, "SELECT * FROM t;")
    assert options["dbtable"] == "(SELECT * FROM t) q"
    assert options["fetchsize"] == "50000" and options["customSchema"] == "id bigint"
    assert jdbc.range_options(source, (3, 3)) == {
        "partitionColumn": "id", "lowerBound": "3", "upperBound": "4", "numPartitions": "4",
    }


def test_oracle_numbers(spark):
    df = spark.sql("SELECT CAST(5 AS DECIMAL(38,0)) AS a, CAST(1.25 AS DECIMAL(10,2)) AS b, 'x' AS c")
    found = jdbc.plain_numbers(df)
    assert found.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")] and found.first() == (5, 1.25, "x")


def test_jdbc_host_guard(spark):
    with pytest.raises(SpecError):
        jdbc.read_jdbc(spark, jdbc.JdbcSource("jdbc:mysql://evil/db", "SELECT 1", allowed_hosts=("ok",)), RunContext())


# ---- landing directories


def test_listing_rules(spark, folder):
    for name, size in (("a/x.csv", 3), ("a/TMP_x.csv", 3), ("a/big.csv", 50), ("a/sub/y.csv", 3), ("b/z.csv", 3)):
        put(spark, f"{folder}/{name}", "1" * size)
    listing = files.list_directories(spark, (f"{folder}/b", f"{folder}/missing", f"{folder}/a"))
    assert sorted(r["name"] for r in listing.collect()) == ["TMP_x.csv", "big.csv", "x.csv", "z.csv"]
    names = [r["name"] for r in files.filter_listing(listing, max_file_bytes=10).collect()]
    assert names == ["z.csv", "x.csv"]
    assert [r["name"] for r in files.filter_listing(listing, max_files=1).collect()] == ["z.csv"]
    assert files.list_directories(spark, (f"{folder}/none",)).count() == 0


def test_listing_does_not_read_contents(spark, folder):
    put(spark, f"{folder}/a.csv", "x")
    plan = files.list_directories(spark, (folder,))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize(
    ("name", "skipped"),
    [("TMP_a", True), ("tmp_a", False), ("aTMP_", False), ("x1.csv", True), ("xa.csv", False), ("l\nTMP_", False)],
)
def test_skip_patterns(spark, name, skipped):
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(files.name_skipped(F.col("name"), ("TMP_*", "x[0-9].csv"))).first()[0] is skipped


def land(spark, folder, parser, schema=None, **more):
    return files.read_landing(spark, files.LandingOptions((folder,), parser, schema, **more))


def test_csv_inferred(spark, folder):
    put(spark, f"{folder}/a.csv", "id,name,score\n1,Alice,9.5\n2,,8.0\n")
    landed = land(spark, folder, "csv")
    assert rows(landed.rows) == [(1, "Alice", 9.5), (2, "", 8.0)]
    assert [f.dataType.simpleString() for f in landed.rows.schema.fields] == ["bigint", "string", "double"]
    assert landed.failed_files == []


def test_csv_delimiter_and_encoding(spark, folder):
    put(spark, f"{folder}/a.csv", "id;cidade\n1;São Paulo\n".encode("latin-1"))
    assert rows(land(spark, folder, "csv", parser_options={"delimiter": ";", "encoding": "latin-1"}).rows) == [(1, "São Paulo")]


@pytest.mark.parametrize("parser", ["csv", "json", "avro"])
def test_empty_file(spark, folder, parser):
    put(spark, f"{folder}/a.x", "")
    with pytest.raises(files.EmptySourceError):
        land(spark, folder, parser, "id bigint", fail_fast=True)
    landed = land(spark, folder, parser, "id bigint")
    assert landed.rows.count() == 0 and len(landed.failed_files) == 1


@pytest.mark.parametrize("content", [" \n ", "[]", " [ ] "])
def test_json_without_records(spark, folder, content):
    put(spark, f"{folder}/a.json", content)
    with pytest.raises(files.EmptySourceError):
        land(spark, folder, "json", "id bigint", fail_fast=True)
    put(spark, f"{folder}/b.json", '{"id": 1}')
    landed = land(spark, folder, "json", "id bigint")
    assert rows(landed.rows) == [(1,)] and len(landed.failed_files) == 1


def test_json_lines_and_arrays_together(spark, folder):
    put(spark, f"{folder}/a.json", ' \n[{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]')
    put(spark, f"{folder}/b.json", '{"id": 3, "name": "c"}\n{"id": 4}\n')
    for schema in ("id bigint, name string", None):
        assert sorted(r["id"] for r in land(spark, folder, "json", schema).rows.collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("parser", ["csv", "json"])
def test_one_bad_record_rejects_its_file(spark, folder, parser):
    good, bad = ("id,v\n1,2\n", "id,v\n3,4\nx,5\n") if parser == "csv" else ('{"id":1,"v":2}\n', '{"id":3,"v":4}\n{"id":"x","v":5}\n')
    put(spark, f"{folder}/good", good)
    put(spark, f"{folder}/bad", bad)
    landed = land(spark, folder, parser, "id bigint, v bigint")
    assert rows(landed.rows) == [(1, 2)]
    assert [p.rsplit("/", 1)[-1] for p in landed.failed_files] == ["bad"]
    with pytest.raises(Exception, match="(?i)malformed|parse|cannot"):
        land(spark, folder, parser, "id bigint, v bigint", fail_fast=True).rows.collect()


def test_all_files_bad(spark, folder):
    put(spark, f"{folder}/bad", "{oops\n")
    landed = land(spark, folder, "json", "id bigint")
    assert landed.rows.count() == 0 and landed.rows.columns == ["id"] and len(landed.failed_files) == 1


def test_map_columns_can_be_checked(spark, folder):
    put(spark, f"{folder}/a", '{"id": 1, "m": {"a": 2}}\n')
    assert land(spark, folder, "json", "id bigint, m map<string,bigint>").rows.first()["m"] == {"a": 2}


def test_avro(spark, folder):
    customers = spark.createDataFrame([(1, "a", 2, 1.5, "X"), (2**40, None, -3, -0.25, "é")], CUSTOMER_SCHEMA).coalesce(1)
    write_avro_customers(customers, folder)
    assert Counter(land(spark, folder, "avro", CUSTOMER_SCHEMA).rows.collect()) == Counter(customers.collect())
    assert dict(land(spark, folder, "avro").rows.dtypes)["c_custkey"] == "bigint"


def test_avro_file_that_is_none(spark, folder):
    customers = spark.createDataFrame([(1, "a", 2, 1.5, "X")], CUSTOMER_SCHEMA).coalesce(1)
    write_avro_customers(customers, folder)
    put(spark, f"{folder}/bad.avro", "not avro")
    landed = land(spark, folder, "avro", CUSTOMER_SCHEMA)
    assert landed.rows.count() == 1 and [p.rsplit("/", 1)[-1] for p in landed.failed_files] == ["bad.avro"]


def test_raw_bytes(spark, folder):
    put(spark, f"{folder}/a.bin", bytes(range(256)))
    landed = land(spark, folder, "binary")
    assert landed.rows.columns == ["raw"] and bytes(landed.rows.first()["raw"]) == bytes(range(256))


def test_processed_files_are_not_read_again(spark, folder):
    put(spark, f"{folder}/a.csv", "id\n1\n")
    done = files.list_directories(spark, (folder,)).select("path").collect()
    put(spark, f"{folder}/b.csv", "id\n2\n")
    manifest = spark.createDataFrame(done)
    landed = files.read_landing(spark, files.LandingOptions((folder,), "csv", "id bigint"), manifest)
    assert rows(landed.rows) == [(2,)]


# ---- extensions


def test_unknown_extension_names_the_available_ones():
    extensions.source("known", lambda *a: None)
    with pytest.raises(KeyError, match="known"):
        extensions.get_source("unknown")
    with pytest.raises(KeyError):
        extensions.get_sink("unknown")
    with pytest.raises(KeyError):
        extensions.get_parser("unknown")


def test_custom_parser_isolates_files(spark, folder):
    def parse(data):
        for line in data.decode().split():
            yield (int(line),)

    extensions.parser("numbers", parse, "n bigint")
    put(spark, f"{folder}/a", "1 2")
    put(spark, f"{folder}/b", "3 x")
    put(spark, f"{folder}/c", "4")
    landed = land(spark, folder, "numbers")
    assert rows(landed.rows) == [(1,), (2,), (4,)] and landed.rows.columns == ["n"]
    assert [p.rsplit("/", 1)[-1] for p in landed.failed_files] == ["b"]
    with pytest.raises(Exception, match="invalid literal"):
        land(spark, folder, "numbers", fail_fast=True).rows.collect()


def test_sink_registration(spark):
    got = []
    extensions.sink("memory", lambda df, path: got.append((path, df.count())))
    extensions.get_sink("memory")(spark.range(3), "x")
    assert got == [("x", 3)]


# ---- REST


class Served:
    """Answers from a list, recording what was asked; used in this process only."""

    def __init__(self, answers):
        self.answers, self.asked, self.lock = list(answers), [], threading.Lock()

    def __call__(self, url, params, headers):
        with self.lock:
            self.asked.append(dict(params))
            return json.dumps(self.answers.pop(0))


def fetched(options, answers):
    served = Served(answers)
    return [(no, n) for _, no, n, _ in rest.iter_pages(options, served)], served.asked


def test_single_response():
    assert fetched(rest.RestOptions("u"), [[{"id": 1}, {"id": 2}]]) == ([(1, 2)], [{}])
    assert fetched(rest.RestOptions("u", "data"), [{"data": [{"id": 1}]}])[0] == [(1, 1)]
    assert fetched(rest.RestOptions("u", "a.b"), [{"a": {"b": [1, 2, 3]}}])[0] == [(1, 3)]
    assert fetched(rest.RestOptions("u"), [{"id": 1}])[0] == [(1, 1)]
    assert fetched(rest.RestOptions("u", "items"), [{"items": []}])[0] == []


def test_cursor_pages():
    options = rest.RestOptions("u", "d", "cursor", cursor_param="after", next_key="next")
    pages = [{"d": [1], "next": "abc"}, {"d": [2], "next": "def"}, {"d": [], "next": "x"}]
    assert fetched(options, pages) == ([(1, 1), (2, 1)], [{}, {"after": "abc"}, {"after": "def"}])
    assert fetched(options, [{"d": [1], "next": None}])[0] == [(1, 1)]
    endless = rest.RestOptions("u", "d", "cursor", next_key="next", max_pages=2)
    with pytest.raises(rest.PageLimitError):  # more pages than allowed are no complete answer
        fetched(endless, [{"d": [1], "next": "n"}] * 9)


def test_numbered_pages():
    options = rest.RestOptions("u", pagination="page", page_size=2)
    got, asked = fetched(options, [[1, 2], [3], []])
    assert got == [(1, 2), (2, 1)]
    assert asked == [{"page": n, "page_size": 2} for n in (1, 2, 3)]


def test_offset_advances_by_records_received():
    options = rest.RestOptions("u", pagination="offset", page_size=2)
    got, asked = fetched(options, [[1, 2], [3], [4, 5], []])
    assert got == [(1, 2), (2, 1), (3, 2)]
    assert [a["offset"] for a in asked] == [0, 2, 3, 5]


def test_auth_headers():
    assert rest.auth_headers("none", {}, {"X": "1"}) == {"X": "1"}
    assert rest.auth_headers("bearer", {"token": "t"}) == {"Authorization": "Bearer t"}
    assert rest.auth_headers("api_key", {"header": "X-Key", "key": "k"}) == {"X-Key": "k"}
    oauth = {"token_url": "https://id.example.com/t", "client_id": "c", "client_secret": "s"}
    assert rest.auth_headers("oauth2_client_credentials", oauth, fetch_token=lambda c: "o") == {"Authorization": "Bearer o"}
    with pytest.raises(SpecError):
        rest.auth_headers("oauth2_client_credentials", oauth, fetch_token=lambda c: "o", allowed_hosts=("other.com",))
    with pytest.raises(ValueError):
        rest.auth_headers("basic", {})


def test_pages_behind_the_first_empty_one_are_dropped(spark):
    pages = spark.createDataFrame(
        [("a", 1, 2), ("a", 2, 2), ("a", 3, 0), ("a", 4, 2), ("b", 1, 1), ("b", 3, 1), ("c", 2, 1), ("d", 1, 1), ("d", 2, 1)],
        "endpoint string, page_no int, n_records int",
    )
    kept = rest.before_first_empty(pages, max_pages=100)
    assert rows(kept.select("endpoint", "page_no")) == [("a", 1), ("a", 2), ("b", 1), ("d", 1), ("d", 2)]
    assert rows(rest.before_first_empty(pages, 1).select("endpoint", "page_no")) == [("a", 1), ("b", 1), ("d", 1)]


def test_offset_pages_end_with_the_first_short_one(spark):
    pages = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("a", 3, 2)], "endpoint string, page_no int, n_records int")
    assert rows(rest.full_until_short(pages, 2).select("page_no")) == [(1,), (2,)]


def test_flatten(spark):
    pages = spark.createDataFrame([(1, '{"d": [{"id": 1, "v": "a"}, {"id": 2}]}'), (2, ' [{"id": 3}]'), (3, '{"d": []}')], "page_no int, body string")
    assert rows(rest.flatten_records(pages, "id bigint, v string", "d", "page_no").fillna("-")) == [(1, 1, "a"), (1, 2, "-"), (2, 3, "-")]
    single = spark.createDataFrame([('{"id": 9}',)], "body string")
    assert rows(rest.flatten_records(single, "id bigint", None)) == [(9,)]
    counted = pages.select(rest.count_records(F.col("body"), "d")).collect()
    assert [r[0] for r in counted] == [2, 1, 0]


def test_endpoints_outside_the_host_list_are_refused(spark):
    endpoints = spark.createDataFrame([("https://evil.org/a",)], "endpoint string")
    with pytest.raises(Exception, match="allow list"):
        rest.fetch_endpoints(endpoints, rest.RestOptions("x"), lambda *a: "[]", 1, ("example.com",)).collect()


def test_fetch_through_the_data_source(spark, folder):
    for page, ids in ((1, [1, 2]), (2, [3, 4]), (3, [5])):
        put(spark, f"{folder}/page={page}/page_size=2/p.json", json.dumps([{"id": i} for i in ids]))
    uri = as_uri(storage.qualified(spark, folder))
    for parallelism in (1, 3):
        options = rest.RestOptions(uri, None, "page", page_size=2, max_pages=7, parallelism=parallelism)
        pages = rest.fetch_pages(spark, options, rest.folder_get)
        kept = rest.before_first_empty(pages, 7)
        assert rows(rest.flatten_records(kept, "id bigint", None)) == [(1,), (2,), (3,), (4,), (5,)]


def test_a_task_hands_on_every_page_before_it_asks_for_the_next():
    served = Served([[{"id": 1}], [{"id": 2}, {"id": 3}], []])
    reader = rest.RestReader(rest.RestOptions("u", pagination="page", max_pages=3), served)
    asked = [(len(served.asked), batch.to_pylist()) for batch in reader.read(reader.partitions()[0])]
    assert [(n, [(r["page_no"], r["n_records"]) for r in batch]) for n, batch in asked] == [(1, [(1, 1)]), (2, [(2, 2)])]
    assert asked[1][1][0]["endpoint"] == "u" and json.loads(asked[1][1][0]["body"]) == [{"id": 2}, {"id": 3}]


def test_task_functions_load_without_the_package(tmp_path):
    """Executors may not have the package: what is sent to them must not import it."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    data = cloudpickle.dumps((rest.iter_pages, rest.folder_get, rest.rest_source(rest.http_get), rest.RestOptions("u")))
    code = "import sys; from pyspark import cloudpickle; print(len(cloudpickle.loads(sys.stdin.buffer.read())))"
    done = subprocess.run([sys.executable, "-c", code], input=data, capture_output=True, cwd=tmp_path, env={"PATH": "/usr/bin"})
    assert done.stdout.strip() == b"4", done.stderr.decode()[-500:]


def test_full_last_page_at_the_limit_is_refused(spark):
    options = rest.RestOptions("u", pagination="page", page_size=2, max_pages=3)
    pages = spark.createDataFrame([("u", i, 2, "[1, 2]") for i in (1, 2, 3)], rest.PAGE_SCHEMA)
    with pytest.raises(rest.PageLimitError):
        rest.check_page_limit(pages, options)
    rest.check_page_limit(pages.filter("page_no < 3"), options)


def test_short_pages_at_the_limit_are_refused(spark):
    """A server with a page size of its own gives short pages throughout."""
    def serve(url, params, headers):
        at = params.get("offset", 50 * (params.get("page", 1) - 1))
        return json.dumps([{"id": i} for i in range(at, min(at + 50, 230))])

    for pagination in ("page", "offset"):
        cut = rest.RestOptions("u", pagination=pagination, max_pages=3)
        with pytest.raises(rest.PageLimitError):
            list(rest.iter_pages(cut, serve))
        assert sum(p[2] for p in rest.iter_pages(rest.RestOptions("u", pagination=pagination, max_pages=6), serve)) == 230
    pages = spark.createDataFrame([("u", i, 50, "[]") for i in range(1, 4)], rest.PAGE_SCHEMA)
    with pytest.raises(rest.PageLimitError):
        rest.check_page_limit(pages, rest.RestOptions("u", pagination="page", max_pages=3))


def test_landed_pages_have_no_limit_of_their_own(spark):
    pages = spark.createDataFrame([("u", i, 2, "[1, 2]") for i in range(1, 131)], rest.PAGE_SCHEMA)
    assert rest.before_first_empty(pages).count() == rest.full_until_short(pages, 2).count() == 130


def test_login_becomes_headers_before_tasks_run():
    options = rest.RestOptions("http://h/x", auth_type="bearer", auth={"token": "t"}, headers={"X": "1"})
    ready = rest.with_login(options)
    assert ready.headers == {"X": "1", "Authorization": "Bearer t"} and ready.auth == {} and ready.auth_type == "none"


def test_a_broken_file_with_an_odd_name_is_kept_out(spark, folder):
    for name, text in (("a b.json", '{"id": 1}\n{"id"\n'), ("a%20c.json", '{"id": 2}\n{"id"\n'), ("d e.json", '{"id": 3}\n')):
        put(spark, f"{folder}/{name}", text)
    landed = files.read_landing(spark, files.LandingOptions((folder,), "json", "id bigint"))
    assert [r.id for r in landed.rows.collect()] == [3]
    assert sorted(p.rsplit("/", 1)[-1] for p in landed.failed_files) == ["a b.json", "a%20c.json"]
    assert [p.rsplit("/", 1)[-1] for p in landed.good_files] == ["d e.json"]


def test_files_are_parsed_once(spark, folder):
    """The rows come from the staged table, whatever was found broken."""
    for name, text in (("a.json", '{"id": 1}\n'), ("b.json", '{"id"\n')):
        put(spark, f"{folder}/{name}", text)
    landed = files.read_landing(spark, files.LandingOptions((folder,), "json", "id bigint"))
    plan = landed.rows._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "FileScan json" not in plan
    assert [r.id for r in landed.rows.collect()] == [1]


class Shelf:
    """A server by offset in this process, that gives fewer records than asked on some requests."""

    def __init__(self, total, short=()):
        self.total, self.short, self.asked = total, short, []

    def __call__(self, url, params, headers):
        offset, limit = params["offset"], params["limit"]
        if offset in self.short:
            limit = self.short[offset]
        return json.dumps({"d": [{"id": i} for i in range(offset, min(self.total, offset + limit))]})


@pytest.mark.parametrize("total, short", [
    (57, {}), (60, {}), (57, {20: 3}), (57, {0: 1}), (57, {20: 3, 23: 4, 37: 1}), (0, {}), (5, {}), (10, {}),
])
def test_offset_windows_resume_behind_a_short_page(spark, total, short):
    options = rest.RestOptions("http://h/x", "d", "offset", page_size=10, max_pages=40, parallelism=4)
    rows = rest.read_rest(spark, options, "id bigint", Shelf(total, short))
    assert sorted(r.id for r in rows.collect()) == list(range(total))


def test_offset_windows_refuse_at_the_page_limit(spark):
    options = rest.RestOptions("http://h/x", "d", "offset", page_size=10, max_pages=4, parallelism=2)
    for server in (Shelf(100), Shelf(100, {10: 5})):
        with pytest.raises(Exception, match="max_pages"):
            rest.read_rest(spark, options, "id bigint", server).collect()


def test_logins_name_what_they_lack():
    with pytest.raises(ValueError, match="token"):
        rest.auth_headers("bearer", {})
    form = rest.ClientCredentials("https://id.example.com/t", "c", "s").form()
    assert form == b"grant_type=client_credentials&client_id=c&client_secret=s&scope="
