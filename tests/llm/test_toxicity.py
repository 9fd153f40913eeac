import zlib

import pytest

from siltbed.llm.queries import QUERIES
from siltbed.llm.toxicity import GRAMMAR, Lexicon, Model, clause_score, measures, scored, train

SF = "/root/testdata/sf0.01"


def test_clauses():
    lexicon = Lexicon({"idiot": 5.0, "lowei": 4.0})
    score = lambda s: clause_score(s.split(), lexicon)
    assert score("the sky is blue") == 0
    assert score("an idiot") == 5
    assert score("you idiot") == 6 == score("idiots like you")
    assert 0 < score("not an idiot") < 2
    assert 0 < score("he said idiot") < score("an idiot")
    assert score("kill the light") == 0 < score("kill you")
    assert score("never kill you") == 0
    assert score("loweizeug") == 4
    assert measures(None, lexicon) == measures("", lexicon) == measures("# 1 \n", lexicon) == (0, 0, 0)
    assert measures("Idiot. Sky. IDIOT!", lexicon)[2] > measures("idiot", lexicon)[2]
    assert all(set(a) == set("-IHTNR") for a in GRAMMAR.arcs)


def test_odd_rows(spark):
    model = Model({"idiot": 5.0}, (-3.0, 1.0, 0.5, 0.1))
    rows = [(1, None, "x"), (2, "", "x"), (None, "idiot", "x"), (4, "word " * 100_000 + "idiot", "x"), (4, "same", "x"), (4, "same", "x")]
    got = scored(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert got[0].score == got[1].score == min(r.score for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert scored(empty, model).count() == 0
    no_labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert train(empty, no_labels).stems == {}


@pytest.fixture(scope="module")
def result(spark):
    return {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, SF).collect()}


def test_held_out_accuracy(spark, result):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in result.items())
    held = [(labels[i], result[i]) for i in labels if result[i].held_out]
    assert len(held) > 100
    toxic = [r.predicted for y, r in held if y == 1]
    clean = [r.predicted for y, r in held if y == 0]
    print(sum(toxic), len(toxic), sum(clean), len(clean))
    assert sum(toxic) >= 0.75 * len(toxic)
    assert sum(clean) <= 0.02 * len(clean)
