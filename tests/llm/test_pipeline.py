from collections import Counter

import pytest

import corpus_pipeline
from siltbed.llm.quality_rules import judged
from siltbed.llm.toxicity import scored, train
from tests.llm.test_jaccard_join import shingles
from tests.llm.test_suffix_dedup import brute_force as repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    root = tmp_path_factory.mktemp("stages")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"file://{root}/{i}")
        docs = spark.read.parquet(f"file://{root}/{i}")
        out.append(docs)
    return out


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality rules", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    assert all(s.columns == stages[0].columns and dict(s.dtypes) == dict(stages[0].dtypes) for s in stages[:5])


def test_filters_take_effect(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id for r in scored(stages[0], train(stages[0], labels)).filter("predicted = 0").collect()}
    assert by_id(stages[1]).keys() == want and len(want) < stages[0].count()
    want = {r.doc_id for r in judged(stages[1], labels).filter("kept").collect()}
    assert by_id(stages[2]).keys() == want and len(want) < stages[1].count()


def test_one_of_each_group(stages):
    rows = sorted((r.doc_id, shingles(r.text, 5)) for r in stages[2].collect())
    group = {d: d for d, _ in rows}
    def root(d):
        return d if group[d] == d else root(group[d])
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1:]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and root(a) != root(b):
                group[max(root(a), root(b))] = min(root(a), root(b))
    assert by_id(stages[3]).keys() == {root(d) for d in group}


def test_repeats_are_cut(stages):
    before = sorted(by_id(stages[3]).items())
    want = repeats([r.text for _, r in before], corpus_pipeline.REPEATED_BYTES)
    after = by_id(stages[4])
    assert after.keys() == dict(before).keys()
    for (d, r), (_, kept) in zip(before, want):
        assert after[d].text == kept.decode("utf-8", "ignore") and after[d].n_chars == len(after[d].text)
        assert (after[d].lang, after[d].source) == (r.lang, r.source)


def test_everything_is_packed(stages):
    packed = stages[5].collect()
    assert {r.doc_id for r in packed} == by_id(stages[4]).keys()
    used = Counter()
    for r in packed:
        if r.bin_id is not None:
            used[r.bin_id, r.capacity] += r.n_tokens
    assert all(n <= capacity for (_, capacity), n in used.items())


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", 7, "x"), (1, text, "en", 7, "x"), (None, text, None, None, "x"), (2, None, "en", 0, None), (2, "", "en", 0, None),
            (3, text.replace("word3 ", "word "), "en", 7, "y")]
    names = "doc_id long, text string, lang string, n_chars long, kept string"
    docs = spark.createDataFrame(rows, names)
    assert corpus_pipeline.drop_toxic(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.drop_poor(spark, docs, SF).columns == docs.columns
    left = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.kept) for r in left if r.text) == [(1, "x")] and len(left) == 3
    assert [r.text for r in corpus_pipeline.cut_repeats(spark, docs, SF).orderBy("doc_id").collect() if r.doc_id == 1] == ["", ""]
    empty = docs.filter("doc_id > 9")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
