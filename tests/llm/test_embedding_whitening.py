import numpy as np
import pytest
from pyspark.sql import functions as F

from siltbed.llm.embedding_whitening import Centre, whitened
from siltbed.llm.queries import QUERIES
from siltbed.llm.symmetric_eigen import leading_eigenpairs

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("width", [1, 2, 3, 8, 65])
def test_eigenpairs_of_random_matrices(width):
    b = np.random.default_rng(width).normal(size=(width, width))
    check(b @ b.T)


def check(a, many=8):
    values, vectors = leading_eigenpairs(a, many)
    wanted = np.linalg.eigvalsh(a)[::-1][:many]
    scale = max(1e-300, np.abs(wanted).max())
    assert np.abs(values - wanted).max() < 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * scale


def test_equal_and_near_eigenvalues_have_orthogonal_vectors():
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(40, 40)))[0]
    check(q @ np.diag([9, 9, 9, 9 - 1e-9, 8.9999, 4, 4, 4, 4] + [1] * 31) @ q.T)
    check(np.eye(30))
    check(np.diag([5.0, 5, 5, 3, 3, 1, 1, 1, 0.5]))
    block = np.random.default_rng(2).normal(size=(5, 5))
    check(np.kron(np.eye(4), block @ block.T))
    check(np.ones((12, 12)))


def compare(frame, vectors):
    """``vectors``: (id, list) of those that count, ids distinct."""
    x = np.floor(1024 * np.array([v for _, v in vectors], np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    v = np.cov(x.T, bias=True)
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1][:8], directions[:, ::-1][:, :8]
    wanted = (x - sums / n) @ directions / np.sqrt(values)
    rows = {(r.vec_id, r.component): r for r in frame.collect()}
    assert len(rows) == n * len(values) == frame.count()
    assert len({r.identity_error for r in rows.values()}) == 1
    got = np.array([[rows[i, c + 1].whitened for c in range(len(values))] for i, _ in vectors])
    assert np.abs(got * np.sign((got * wanted).sum(0)) - wanted).max() < 1e-9
    for (i, _), deviation in zip(vectors, ((n * x - sums) ** 2).sum(1).tolist()):
        for c, e in enumerate(values, 1):
            r = rows[i, c]
            assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
            assert abs(r.explained - e / np.trace(v)) < 1e-12


def test_registered_query_equals_numpy(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    compare(QUERIES["op12_embedding_whitening"](spark, SMALL), [(r.vec_id, r.embedding) for r in rows])


def test_unusable_vectors_have_no_rows(spark):
    random = np.random.default_rng(5)
    good = [(i, random.normal(size=9).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0] * 8 + [None]), (103, [float("nan")] + [0.0] * 8),
           (104, [float("inf")] + [0.0] * 8), (105, [1.0, 2.0]), (106, [1e300] + [0.0] * 8)]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumn("component", F.lit("clash"))
    compare(whitened(frame.repartition(3)), good)


def test_repeated_rows_null_ids_and_lower_ranks(spark):
    schema = "vec_id string, embedding array<float>"
    frame = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("a", [1.0, 2.0, 3.0]), (None, [2.0, 4.0, 6.0])], schema)
    rows = whitened(frame).collect()
    assert [(r.component, r.n) for r in rows] == [(1, 3)] * 3 and {r.vec_id for r in rows} == {"a", None}
    assert rows[0].explained == pytest.approx(1.0) and rows[0].identity_error < 1e-9
    assert whitened(frame.filter("vec_id = 'a'")).count() == 0
    assert whitened(frame.filter("vec_id = 'b'")).schema.simpleString() == whitened(frame).schema.simpleString()


def test_deviations_stay_exact_or_become_null():
    x = np.array([[100_000, 100_001], [2**50, 100_003], [100_002, 100_000]])
    sums = tuple(int(v) for v in x.astype(object).sum(0))
    wanted = [sum((3 * int(e) - s) ** 2 for e, s in zip(v, sums)) for v in x.tolist()]
    assert Centre(3, sums).deviations(x) == [w if w < 2**63 else None for w in wanted] and None in Centre(3, sums).deviations(x)
    small = x - np.array([[0, 0], [2**50 - 99_000, 0], [0, 0]])
    sums = tuple(small.sum(0).tolist())
    assert Centre(3, sums).deviations(small) == ((3 * small - np.array(sums)) ** 2).sum(1).tolist()
