"""Query source, date variables, incremental predicates, preview, guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltbed.functions.guards import destination_allowed, host_allowed, path_from_template
from siltbed.operators.incremental import after_watermark, in_window, window_predicate
from siltbed.operators.preview import preview_frame
from siltbed.plans.spec import BackfillWindow
from siltbed.queries.registry import query
from siltbed.queries.views import context, table
from siltbed.sources.jdbc import plain_numbers
from siltbed.sources.sql import lower_case_columns, query_source, register_tables

JOIN = """
    SELECT o.o_orderkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, c.c_name, c.c_mktsegment
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey"""


@query("query_source_join", JOIN)
def query_source_join(spark, sf_dir):
    register_tables(spark, sf_dir, ("orders", "customer"))
    return query_source(spark, JOIN + ";", context())


SUBTOTAL = """
    SELECT l.l_orderkey, l.l_linenumber, p.p_name, l.l_quantity, p.p_retailprice,
           l.l_quantity * p.p_retailprice AS subtotal
    FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey"""


@query("query_source_expr", SUBTOTAL)
def query_source_expr(spark, sf_dir):
    register_tables(spark, sf_dir, ("lineitem", "part"))
    return query_source(spark, SUBTOTAL, context())


@query("jdbc_lowercase_columns", "SELECT * FROM customer")
def jdbc_lowercase_columns(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return lower_case_columns(customer.toDF(*[name.upper() for name in customer.columns]))


@query(
    "jdbc_number_types",
    """SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS l_quantity, l_extendedprice FROM lineitem""",
)
def jdbc_number_types(spark, sf_dir):
    """Quantities and prices as a database with one decimal type would deliver them."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(38,0)"), F.col("l_extendedprice").cast("decimal(15,2)")
    )
    return plain_numbers(lines)


def _variable_query(name: str, condition: str, literal: str) -> None:
    @query(name, f"SELECT * FROM orders WHERE {literal}")
    def run(spark, sf_dir):
        register_tables(spark, sf_dir, ("orders",))
        return query_source(spark, f"SELECT * FROM orders WHERE {condition}", context())


_variable_query("var_today", "o_orderdate <= @TODAY", "o_orderdate <= TIMESTAMP '1998-03-25'")
_variable_query("var_min_date", "o_orderdate > @MIN_DATE", "o_orderdate > TIMESTAMP '1997-01-01'")
_variable_query("var_last_month", "o_orderdate >= @LAST_MONTH", "o_orderdate >= TIMESTAMP '1998-02-01'")
_variable_query("var_next_month", "o_orderdate < @NEXT_MONTH", "o_orderdate < TIMESTAMP '1998-04-01'")
_variable_query(
    "var_between",
    "o_orderdate BETWEEN @LAST_MONTH AND @TODAY",
    "o_orderdate BETWEEN TIMESTAMP '1998-02-01' AND TIMESTAMP '1998-03-25'",
)


@query("watermark_incremental", "SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def watermark_incremental(spark, sf_dir):
    return after_watermark(table(spark, sf_dir, "orders"), "o_orderdate", "1998-01-01T00:00:00+00:00")


@query("watermark_first_run", "SELECT * FROM orders")
def watermark_first_run(spark, sf_dir):
    return after_watermark(table(spark, sf_dir, "orders"), "o_orderdate", None)


@query("watermark_offset_literal", "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-16 00:00:00'")
def watermark_offset_literal(spark, sf_dir):
    return after_watermark(table(spark, sf_dir, "events"), "ts", "2024-01-15T21:00:00-03:00")


LATEST_ORDER = """
    WITH ranked AS (
        SELECT o.*, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
        FROM orders o)
    SELECT o_custkey, o_orderkey, o_orderdate FROM ranked WHERE rn = 1"""


@query("watermark_over_cte", f"SELECT * FROM ({LATEST_ORDER}) WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def watermark_over_cte(spark, sf_dir):
    register_tables(spark, sf_dir, ("orders",))
    return after_watermark(query_source(spark, LATEST_ORDER, context()), "o_orderdate", "1998-01-01T00:00:00+00:00")


@query(
    "backfill_window",
    "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-02-01' AND l_shipdate < TIMESTAMP '1998-03-01'",
)
def backfill_window(spark, sf_dir):
    window = BackfillWindow("1998-02-01T00:00:00+00:00", "1998-03-01T00:00:00+00:00")
    return in_window(table(spark, sf_dir, "lineitem"), "l_shipdate", window)


@query(
    "backfill_tiling",
    """SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS window_start, count(*) AS n_orders
       FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '2003-01-01'
       GROUP BY ALL""",
)
def backfill_tiling(spark, sf_dir):
    """Neighbouring quarterly windows over the whole table, counted in one scan: every row falls in exactly one."""
    orders = table(spark, sf_dir, "orders")
    starts = [f"{year}-{month:02d}-01" for year in range(1995, 2003) for month in (1, 4, 7, 10)] + ["2003-01-01"]
    windows = [BackfillWindow(start, end) for start, end in zip(starts, starts[1:], strict=False)]
    counts = orders.agg(
        *[F.count_if(window_predicate(orders, "o_orderdate", w)).alias(f"w{i}") for i, w in enumerate(windows)]
    )
    entries = [
        F.struct(F.lit(w.start).alias("window_start"), F.col(f"w{i}").alias("n_orders"))
        for i, w in enumerate(windows)
    ]
    return counts.select(F.inline(F.array(*entries))).filter("n_orders > 0")


ORDERED = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"


@query("preview_limit", f"{ORDERED} LIMIT 100")
def preview_limit(spark, sf_dir):
    register_tables(spark, sf_dir, ("orders",))
    return preview_frame(spark, f"{ORDERED};", context())


@query("preview_inner_limit", f"{ORDERED} LIMIT 30")
def preview_inner_limit(spark, sf_dir):
    register_tables(spark, sf_dir, ("orders",))
    return preview_frame(spark, f"{ORDERED} LIMIT 30", context())


@query(
    "dest_path_template",
    """SELECT o_orderkey, 'bronze/' || o_orderstatus || '/' || strftime(o_orderdate, '%Y-%m-%d') || '/' AS path
       FROM orders""",
)
def dest_path_template(spark, sf_dir):
    template = F.concat(F.lit("bronze/"), F.col("o_orderstatus"), F.lit("/{date}/"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", path_from_template(template, F.col("o_orderdate")).alias("path")
    )


@query(
    "path_guard",
    """SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang = 'en' ELSE false END AS allowed FROM documents""",
)
def path_guard(spark, sf_dir):
    lang = F.col("lang")
    head = (
        F.when(lang == "en", "s3://bronze/")
        .when(lang == "fr", "s3a://bronze/%2E%2e/")
        .when(lang == "de", "silver/")
        .otherwise("s3://bronze/../gold/")
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", destination_allowed(F.concat(head, "source", F.lit("/"), "doc_id")).alias("allowed")
    )


@query(
    "host_allowlist",
    r"""SELECT page_id,
               regexp_matches(url, '^https?://([^/]*\.)?example\.(com|net)(/|$|\?|#)') AS host_ok,
               (page_id % 24) = 10 OR (page_id % 24) BETWEEN 16 AND 23 AS address_ok
        FROM pages""",
)
def host_allowlist(spark, sf_dir):
    """Page addresses by name, and a derived IPv4 address of each page by network."""
    address = F.concat(F.lit("http://"), F.col("page_id") % 24, F.lit(".1.2.3:8080/x"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        host_allowed(F.col("url"), ("example.com", " example.net")).alias("host_ok"),
        host_allowed(address, ("10.0.0.0/8", "16.0.0.0/4")).alias("address_ok"),
    )
