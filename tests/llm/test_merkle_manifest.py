import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from siltbed.llm import merkle_manifest, merkle_sql
from siltbed.llm.merkle_manifest import leaf_hash, manifest
from siltbed.llm.queries import MANIFEST_FIELDS, QUERIES
from tests.compare import oracle_connection

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    for nodes in tree[:-1]:
        run = nodes[i // 16 * 16:][:16]
        yield run[:i % 16], run[i % 16 + 1:]
        i //= 16


def brute(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for own in by_source.values():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {s: levels([leaf(r, r.text) for r in by_source[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, r in enumerate(by_source[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for left, right in steps:
                folded = digest(*left, folded, *right)
            proof = digest(*[h for left, right in steps for h in left + right])
            yield (str(r.doc_id), trees[s][0][i], trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0])


def result(frame):
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((str(r[0]), *r[1:]) for r in frame.select(*columns).collect())


def tampered(docs):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [lowered if f == "text" else F.col(f) for f in MANIFEST_FIELDS]
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf_hash(fields))
    return manifest(docs, MANIFEST_FIELDS, altered=altered).withColumnRenamed("place", "doc_id")


def test_registered_query_equals_brute_force_and_sql(spark):
    got = result(QUERIES["op11_merkle_manifest"](spark, SMALL))
    assert got == sorted(brute(spark.read.parquet(f"{SMALL}/documents.parquet").collect()))
    cursor = oracle_connection(SMALL).execute(merkle_sql.oracle())
    assert got == sorted((str(r[0]), *r[1:]) for r in cursor.fetchall())


def test_nulls_ties_hot_source_and_clashing_columns(spark):
    rnd = random.Random(3)
    rows = [(i, "hot", "de", 3, rnd.choice(["Abc", "", None, "ÄÖ x" * 9])) for i in range(700)]
    rows += [(i % 5, rnd.choice([None, "", "é", "a", "b"]), None, None, "Same") for i in range(60)]
    rows += [(None, "hot", "de", 1, "No id"), (7, "hot", "de", 3, "Abc"), (9, "alone", "en", 2, "X" * 100_000)]
    rows += [(1000 + i, f"s{i}", "en", 1, "t") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit(1)).withColumn("h", F.lit("clash")).repartition(5)
    assert result(tampered(docs)) == sorted(brute(docs.collect()))
    assert manifest(docs.filter("doc_id < -1"), MANIFEST_FIELDS).count() == 0


def test_more_than_one_round_of_blocks(spark, monkeypatch):
    """Blocks of two digits, so that 5000 leaves take two rounds and 300 sources two as well."""
    monkeypatch.setattr(merkle_manifest, "BLOCK_DIGITS", 2)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 256)
    rows = [(i, "hot" if i % 3 else f"s{i % 900}", "de", i, f"Text {i}") for i in range(7000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert result(tampered(docs)) == sorted(brute(docs.collect()))


def test_untampered_leaves_verify_and_a_single_row_is_its_own_root(spark):
    one = spark.createDataFrame([(1, "a", "de", 1, "x")], SCHEMA)
    row = manifest(one, MANIFEST_FIELDS).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.steps == []
    assert row.proof_sha256 == digest("")
