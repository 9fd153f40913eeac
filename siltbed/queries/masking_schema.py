"""Masking, redaction, schema descriptors, contracts and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltbed.functions.masking import mask_columns, mask_uri, redact_json_secrets
from siltbed.functions.schema import contract_column, hash_column
from siltbed.operators import ledger
from siltbed.queries.registry import query
from siltbed.queries.views import DESCRIBED_SQL, GOOD_SQL, RUNS_SQL, delivered_schema, described_runs, runs, table


@query(
    "pii_sha256",
    """SELECT c_custkey, sha256(c_name) AS c_name, c_nationkey, sha256(c_acctbal::VARCHAR) AS c_acctbal,
              c_mktsegment FROM customer""",
)
def pii_sha256(spark, sf_dir):
    return mask_columns(table(spark, sf_dir, "customer"), {"c_name": "sha256", "c_acctbal": "sha256"})


@query(
    "pii_redact",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, NULL::VARCHAR AS c_mktsegment FROM customer",
)
def pii_redact(spark, sf_dir):
    return mask_columns(table(spark, sf_dir, "customer"), {"c_mktsegment": "redact"})


@query(
    "pii_partial",
    """SELECT doc_id, lang, CASE WHEN length(text) < 3 THEN repeat('*', length(text))
              ELSE left(text, 1) || repeat('*', length(text) - 2) || right(text, 1) END AS text
       FROM documents""",
)
def pii_partial(spark, sf_dir):
    return mask_columns(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), {"text": "partial"})


@query(
    "pii_multi",
    """SELECT l_orderkey, l_linenumber, sha256(l_partkey::VARCHAR) AS l_partkey, sha256(l_shipdate::VARCHAR) AS l_shipdate,
              NULL::DOUBLE AS l_extendedprice, l_returnflag FROM lineitem""",
)
def pii_multi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_returnflag"
    )
    methods = {"l_partkey": "sha256", "l_shipdate": "sha256", "l_extendedprice": "redact", "no_such_column": "sha256"}
    return mask_columns(lines, methods)


@query(
    "mask_uri",
    r"""SELECT c_custkey, regexp_replace('mysql://' || c_name || ':' || c_mktsegment || '@db' || c_nationkey || ':3306/x',
              '(://)[^:]+:[^@]+(@)', '\1***:***\2', 'g') AS uri FROM customer""",
)
def mask_uri_query(spark, sf_dir):
    uri = F.concat(
        F.lit("mysql://"), "c_name", F.lit(":"), "c_mktsegment", F.lit("@db"), "c_nationkey", F.lit(":3306/x")
    )
    return table(spark, sf_dir, "customer").select("c_custkey", mask_uri(uri).alias("uri"))


@query(
    "redact_json_secrets",
    r"""SELECT c_custkey, '{"user": "' || c_name || '", "Password": "***", "token" : "***", "note": "'
              || c_mktsegment || '"}' AS body FROM customer""",
)
def redact_json_secrets_query(spark, sf_dir):
    body = F.concat(
        F.lit('{"user": "'), "c_name", F.lit('", "Password": "'), "c_mktsegment", F.lit('", "token" : "t-'),
        "c_custkey", F.lit('", "note": "'), "c_mktsegment", F.lit('"}'),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", redact_json_secrets(body).alias("body"))


@query(
    "schema_hash",
    f"""WITH {DESCRIBED_SQL}
        SELECT seq, sha256('[' || array_to_string(
                 list_transform(last_schema, lambda d: '["' || d.name || '", "' || d.type || '"]'), ', ') || ']')
               AS schema_hash
        FROM described""",
)
def schema_hash_query(spark, sf_dir):
    return described_runs(spark, sf_dir).select("seq", hash_column(F.col("last_schema")).alias("schema_hash"))


@query(
    "schema_descriptor",
    f"""WITH {DESCRIBED_SQL}, numbered AS (
          SELECT seq, unnest(last_schema) AS d, generate_subscripts(last_schema, 1) AS position FROM described)
        SELECT seq, position::INTEGER AS position, d.name AS name, d.type AS type, d.nullable AS nullable
        FROM numbered""",
)
def schema_descriptor(spark, sf_dir):
    return (
        described_runs(spark, sf_dir)
        .select("seq", F.posexplode("last_schema").alias("position", "d"))
        .select("seq", (F.col("position") + 1).alias("position"), "d.name", "d.type", "d.nullable")
    )


@query(
    "schema_check",
    f"""WITH {DESCRIBED_SQL}, pairs AS (
          SELECT seq, e.name AS wanted, e.type AS wanted_type, NULL AS found, NULL AS found_type
          FROM (SELECT seq, unnest(expected_schema) AS e FROM described)
          UNION ALL
          SELECT seq, NULL, NULL, a.name, a.type FROM (SELECT seq, unnest(last_schema) AS a FROM described)),
        joined AS (
          SELECT seq, coalesce(wanted, found) AS name, max(wanted_type) AS wanted_type, max(found_type) AS found_type
          FROM pairs GROUP BY 1, 2),
        judged AS (
          SELECT seq,
                 coalesce(string_agg(name, ',' ORDER BY name) FILTER (found_type IS NULL), '') AS missing,
                 coalesce(string_agg(name, ',' ORDER BY name)
                          FILTER (found_type IS NOT NULL AND wanted_type <> found_type), '') AS mismatched,
                 coalesce(string_agg(name, ',' ORDER BY name) FILTER (wanted_type IS NULL), '') AS extra
          FROM joined GROUP BY seq)
        SELECT seq, CASE WHEN missing <> '' THEN 'missing' WHEN mismatched <> '' THEN 'mismatch'
                         WHEN extra <> '' THEN 'extra' ELSE 'ok' END AS status, missing, mismatched, extra
        FROM judged""",
)
def schema_check(spark, sf_dir):
    verdict = contract_column(F.col("last_schema"), F.col("expected_schema"))
    return (
        described_runs(spark, sf_dir)
        .select("seq", verdict.alias("v"))
        .select(
            "seq",
            F.col("v.status").alias("status"),
            *[F.array_join(F.array_sort(f"v.{part}"), ",").alias(part) for part in ("missing", "mismatched", "extra")],
        )
    )


@query(
    "schema_drift_history",
    f"""WITH {RUNS_SQL}, known AS (
          SELECT *, lag(schema_hash) OVER (PARTITION BY pipeline_id ORDER BY seq) AS previous_hash
          FROM runs WHERE {GOOD_SQL} AND triggered_by <> 'backfill')
        SELECT seq, pipeline_id, schema_hash, previous_hash,
               coalesce(schema_hash <> previous_hash, false) AS schema_changed
        FROM known""",
)
def schema_drift_history(spark, sf_dir):
    return ledger.schema_drift(runs(spark, sf_dir)).select(
        "seq", "pipeline_id", "schema_hash", "previous_hash", "schema_changed"
    )


@query(
    "schema_registry_latest",
    f"""WITH {RUNS_SQL}
        SELECT pipeline_id, arg_max(schema_hash, seq) AS last_schema_hash, arg_max(finished_at, seq) AS updated_at,
               arg_max(CASE event_type WHEN 'signup' THEN 2 ELSE 3 END, seq) AS n_columns
        FROM runs WHERE {GOOD_SQL} AND triggered_by <> 'backfill' GROUP BY pipeline_id""",
)
def schema_registry_latest(spark, sf_dir):
    recorded = runs(spark, sf_dir).withColumn("last_schema", delivered_schema())
    return ledger.schema_registry(recorded).select(
        "pipeline_id", "last_schema_hash", "updated_at", F.size("last_schema").alias("n_columns")
    )
