import re
from collections import Counter
from math import comb, exp, floor, lgamma, log

from pyspark.sql import functions as F

from siltbed.llm import quality_rules
from siltbed.llm.quality_rules import RULES, allowed_rejections, cutoffs, judged, labelled


def brute_force(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


TEXTS = [None, "", " \t\n", "a b c", "a b c a b c", "x # * x\nx # * x\n\n \n", "ä ö ü é", "w " * 30_000,
         " ".join(map(str, range(20_000))), "a b c d a b c d a b c\n" * 40, "same line\nsame line\n" * 3, "\x0b\x0cq\rq"]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_words string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: tuple(r)[1:7] for r in judged(docs, labels, ["doc_id"]).collect()}
    assert got == {i: brute_force(t) for i, t in enumerate(TEXTS)}
    assert all(r.kept != r.base_failed for r in judged(docs, labels).collect())


def test_exact_binomial_bound(spark):
    for n, alpha, delta in ((0, 0.1, 0.05), (20, 0.1, 0.05), (500, 0.02, 0.01), (3000, 0.005, 0.002)):
        frame = spark.range(1).select(F.lit(n).cast("long").alias("n"))
        got = frame.select(allowed_rejections(F.col("n"), alpha, F.lit(delta))).first()[0]
        below, want = 0.0, -1
        for k in range(n + 1):
            below += comb(n, k) * alpha**k * (1 - alpha) ** (n - k)
            if below > delta:
                break
            want = k
        assert got == want


def test_cutoffs_limit_false_rejection(spark):
    good = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"),
        F.concat(F.repeat(F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" ")), 1),
                 F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.hash("id", i).cast("string"))),
                 F.repeat(F.lit(" #"), (F.col("id") % 5).cast("int"))).alias("text"))
    bad = good.filter("doc_id < 300").select((F.col("doc_id") + 10_000).alias("doc_id"), "lang", F.concat("text", F.repeat(F.lit("#"), 60)).alias("text"))
    docs = good.unionByName(bad)
    labels = docs.select("doc_id", (F.col("doc_id") < 10_000).cast("int").alias("quality"))
    cut = cutoffs(docs, labels).first()
    assert cut.n_good == 4000 and cut.allowed >= 0 and cut.cut_symbol_share is not None
    assert cut.cut_capital_share is None  # catches nothing, so it has no part
    out = {r.base: (r.n, r.k) for r in judged(docs, labels, ["doc_id"]).groupBy((F.col("doc_id") < 10_000).alias("base")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()}
    assert out[False][1] == 0
    assert out[True][1] >= 0.97 * out[True][0]


def test_bound_of_large_holdouts(spark):
    """Where the first terms of the sum underflow."""
    for n, alpha, delta in ((400_000, 0.005, 0.002), (30_000_000, 0.005, 0.0001)):
        got = spark.range(1).select(allowed_rejections(F.lit(n).cast("long"), alpha, F.lit(delta))).first()[0]
        term = lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(alpha) + (n - i) * log(1 - alpha))  # noqa: E731, B023
        below = sum(term(i) for i in range(max(0, got - 8000), got + 1))
        assert below <= delta < below + term(got + 1)


def test_rare_stratum_among_many_labels(spark):
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.hash("id", i).cast("string")))
    docs = spark.range(62_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 60_000, "en").otherwise("fr").alias("lang"),
        F.concat(words, F.repeat(F.lit(" #"), F.pmod(F.hash("id"), F.lit(7)))).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    got = {r.stratum: r for r in cutoffs(docs, labels).collect()}
    assert {k: r.n_good for k, r in got.items()} == {"en": 60_000, "fr": 2_000}
    assert got["fr"].allowed >= 0
    for cut in got.values():
        assert cut.level is not None and any(cut[f"cut_{rule}"] is not None for rule in RULES)


def rejecting(rows, cut):
    """Rows that any rule rejects, by the first bins it rejects."""
    return [r for r in rows if any(cut[f"cut_{rule}"] is not None and bin_of(r[rule]) >= cut[f"cut_{rule}"] for rule in RULES)]


def bin_of(value):
    return floor(min(64.0, max(-64.0, value)) * 1024)


def brute_cutoffs(rows, strata):
    """The definition, one level after another: rows have role, measures by rule."""
    tune, hold, bad = ([r for r in rows if r["role"] == role] for role in ("tune", "hold", "bad"))
    bins = {rule: sorted((bin_of(r[rule]) for r in tune), reverse=True) for rule in RULES}

    def first_bin(rule, many):
        """The lowest bin such that at most ``many`` tuning texts lie in it or above."""
        return bins[rule][many] + 1 if many < len(bins[rule]) else None

    limit = floor(len(tune) * 0.03)
    lift = {}
    for rule in RULES:
        caught = sum(bin_of(r[rule]) >= first_bin(rule, limit) for r in bad)
        lift[rule] = max(0.0, caught / len(bad) - 0.03) if bad else 1.0
    weight = {rule: lift[rule] / sum(lift.values()) if sum(lift.values()) else 0.0 for rule in RULES}
    joining = sorted((rule for rule in RULES if weight[rule]), key=lambda rule: (-lift[rule], rule))
    allowed = -1
    while binom_below(len(hold), 0.03, allowed + 1) <= 0.05 / strata:
        allowed += 1
    best = (None, {rule: None for rule in RULES})
    for level in range(64 + len(joining)):
        more = max(0, level - len(joining) + 1)
        cut = {
            rule: first_bin(rule, floor(more * (weight[rule] * len(tune) * (0.06 / 64)) + 1e-9))
            if rule in joining[:level + 1] else None
            for rule in RULES
        }
        if len(rejecting(hold, {f"cut_{k}": v for k, v in cut.items()})) > allowed:
            break
        best = (level, cut)
    return (allowed, *best) if allowed >= 0 else (allowed, None, {rule: None for rule in RULES})


def binom_below(n, p, k):
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def noisy(spark, goods):
    """Good and bad texts of several languages; bad ones have many symbols, repeated lines or capitals."""
    parts = []
    for lang, good in goods.items():
        base = spark.range(good + good // 5).select(
            F.concat(F.lit(f"{lang}-"), "id").alias("name"), F.lit(lang).alias("lang"), (F.col("id") < good).cast("int").alias("quality"),
            F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.substring(F.md5(F.concat(F.lit(lang), "id", i.cast("string"))), 1, 3 + 5))).alias("words"),
            F.pmod(F.xxhash64("id", F.lit(lang)), F.lit(10)).cast("int").alias("k"))
        is_bad = F.col("quality") == 0
        parts.append(base.select("name", "lang", "quality", F.concat(
            "words", F.repeat(F.lit(" #"), F.when(is_bad & (F.col("k") < 6), 40).otherwise(F.col("k") % 4)),
            F.repeat(F.lit(" ÄÖX"), F.when(is_bad & (F.col("k") >= 6), 30).otherwise(F.col("k") % 3))).alias("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("doc_id", F.xxhash64("name"))


def test_cutoffs_equal_the_definition(spark):
    docs = noisy(spark, {"de": 900, "en": 2500, "fr": 260, "it": 100})
    labels = docs.select("doc_id", "quality")
    got = {r.stratum: r for r in cutoffs(docs, labels).collect()}
    rows = [r.asDict() for r in labelled(docs, labels, "lang").collect()]
    for lang, cut in got.items():
        allowed, level, bins = brute_cutoffs([r for r in rows if r["stratum"] == lang], len(got))
        assert (cut.allowed, cut.level) == (allowed, level), lang
        assert {rule: cut[f"cut_{rule}"] for rule in RULES} == bins, lang
    assert got["it"].level is None and got["fr"].level is not None


def test_rejection_of_new_good_texts_stays_within_the_limit(spark):
    docs = noisy(spark, {"de": 3000, "en": 3000})
    half = F.pmod(F.xxhash64("name", F.lit(5)), F.lit(2)) == 0
    labels = docs.filter(half).select("doc_id", "quality")
    out = judged(docs, labels, ["doc_id", "name", "lang", "quality"]).filter(~half)
    shares = out.filter("not base_failed").groupBy("lang", "quality").agg(F.avg((~F.col("kept")).cast("double")).alias("gone")).collect()
    gone = {(r.lang, r.quality): r.gone for r in shares}
    assert all(gone[lang, 1] <= 0.03 and gone[lang, 0] > 0.9 for lang in ("de", "en"))


def test_many_labels_move_measures_instead_of_texts(spark, monkeypatch):
    docs = noisy(spark, {"de": 900})
    labels = docs.select("doc_id", "quality")
    one = cutoffs(docs, labels).collect()
    monkeypatch.setattr(quality_rules, "MOST_BROADCAST_IDS", 10)
    assert cutoffs(docs, labels).collect() == one
