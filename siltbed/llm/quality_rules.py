"""Risk-controlled quality rules with DataFrame functions only.

Rules reject a text whose measure exceeds a cutoff. In each stratum (language) the labelled good texts are split by a hash of
their id. One part, with the bad texts, gives a family of joint cutoffs for all rules, from lax to strict. Rules join in the order of
the share of bad texts that they catch beyond their part of good ones, each rejecting no good text of this part at first; then, level
by level, each may reject more of them in proportion to that share. The other part is the holdout: levels are tested on it in that fixed order, and a level passes while the holdout texts that any rule
rejects are at most k, where k or fewer out of n has binomial probability at most DELTA if the true share of good texts
rejected were MAX_FALSE_REJECTION. Testing in a fixed order needs no division among levels or rules; the error is divided among
strata only. So all rules together reject at most MAX_FALSE_REJECTION of the good texts of any stratum with confidence
1 - ERROR, and some 150 holdout texts suffice for a first level. Where the holdout is smaller, no rule rejects anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.session import scratch_path

MAX_FALSE_REJECTION = 0.03
ERROR = 0.05
#: Cutoffs lie between bins: so many to one unit of a measure, up to the largest measure that is told from larger ones.
BINS, LARGEST = 1024, 64
#: Levels of the family, and the share of tuning texts that rules reject at the strictest, each counted for itself.
LEVELS, STRICTEST = 64, 2 * MAX_FALSE_REJECTION
#: Part of the good texts that the family is made from, of HASH_PARTS.
HASH_PARTS, TUNING_PARTS = 3, 1
#: Good ids up to this number are broadcast (16 bytes each), so that only labelled texts are measured for the cutoffs.
MOST_BROADCAST_IDS = 1_000_000
#: Fixed values of the base rules.
MIN_WORDS = 50
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

RULES = ("symbol_share", "dup_line_share", "repeat_share", "capital_share", "long_words", "short_words")


def share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def let(value: Column, body) -> Column:
    """``body`` of a value computed once, however often it is named and wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(hashes: Column) -> Column:
    """Words covered by windows of three that stand twice or more, given the words' hashes.

    Windows are hashed with their place and sorted, so equal ones meet; places of repeated ones are then walked in order.
    """
    windows = F.when(F.size(hashes) >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(hashes) - 3, F.lit(0))),
        lambda i: F.struct(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("i")),
    )).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))

    def repeated(own: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(own, j)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(own, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    return F.aggregate(
        F.sort_array(let(F.sort_array(windows), repeated)), F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["total"] + F.least(F.lit(3), i - a["last"])).alias("total"), i.alias("last")),
    )["total"]


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the counts and measures of each whole text. Rows don't move; arrays are per row only."""
    body = F.coalesce(F.col(text), F.lit(""))
    hashes = F.transform(F.filter(F.split(body, SPACE + "+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(NOT_SPACE))
    by_words = let(hashes, lambda h: F.struct(F.size(h).alias("n"), repeated_words(h).alias("repeated")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("equal")))
    out = docs.select(*keep, F.struct(
        by_words.alias("words"), by_lines.alias("lines"),
        F.length(F.regexp_replace(body, SPACE + "+", "")).alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOL)).alias("n_symbols"), F.regexp_count(body, F.lit(r"\p{Lu}")).alias("n_capitals"),
    ).alias("__m"))
    out = out.select(*keep, *[F.col(c).cast("long").alias(n) for n, c in (
        ("n_words", "__m.words.n"), ("word_chars", "__m.word_chars"), ("n_symbols", "__m.n_symbols"),
        ("n_dup_lines", "__m.lines.equal"), ("n_repeat_words", "__m.words.repeated"), ("n_lines", "__m.lines.n"),
        ("n_capitals", "__m.n_capitals"))])
    # Never null, and known to be so: else a filter on it would have the counts made once more to look for nulls.
    failed = F.coalesce((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")), F.lit(True))
    return out.withColumns({
        "base_failed": failed,
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "capital_share": share("n_capitals", "word_chars"),
        "long_words": share("word_chars", "n_words"),
        "short_words": -share("word_chars", "n_words"),
    })


def allowed_rejections(n: Column, alpha: float, delta: Column) -> Column:
    """Largest k with P(X <= k) <= delta for X binomial(n, alpha), summed term by term; -1 if there is none.

    Terms are relative to that of the mean, which neither underflow nor need more than some 12 standard errors on
    either side; what lies beyond is far below the rounding of the sum.
    """
    n = n.cast("long")
    middle = F.floor(n * F.lit(alpha))
    width = F.ceil(F.sqrt(n * F.lit(alpha * (1 - alpha))) * 12) + 12
    low, high = F.greatest(F.lit(0).cast("long"), middle - width), F.least(n, middle + width)
    odds = F.lit(alpha / (1.0 - alpha))
    down = F.when(middle > low, F.sequence(middle, low + 1, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
    least = F.aggregate(down, F.lit(1.0), lambda t, i: t * i / (n - i + 1) / odds)

    def summed(start: Column) -> Column:
        terms = F.sequence(low, high)
        total = F.aggregate(
            terms, F.struct(start.alias("term"), F.lit(0.0).alias("sum")),
            lambda a, i: F.struct((a["term"] * (n - i) / (i + 1) * odds).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        )["sum"]
        return let(total, lambda whole: F.aggregate(
            terms, F.struct(start.alias("term"), F.lit(0.0).alias("below"), F.lit(-1).cast("long").alias("k")),
            lambda a, i: F.struct(
                (a["term"] * (n - i) / (i + 1) * odds).alias("term"),
                (a["below"] + a["term"]).alias("below"),
                F.when(a["below"] + a["term"] <= delta * whole, i).otherwise(a["k"]).alias("k"),
            ),
        )["k"])

    return let(least, summed)


def measure_bin(value: Column) -> Column:
    return F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), value)) * BINS).cast("long")


def labelled(docs: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    """Measured labelled texts: doc_id, stratum, role (tune, hold or bad) and the measure of each rule.

    Repeated labels of one id count as bad if any of them is. Rows whose label or id is null are left out. Few labelled ids
    are broadcast, so that no other text is measured; beyond that all are, and measures move instead of texts.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("q"))
    path = scratch_path(docs.sparkSession, "quality")
    known.write.parquet(f"{path}/labels")
    known = docs.sparkSession.read.parquet(f"{path}/labels")
    held = docs.select("doc_id", "text", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"))
    if known.count() <= MOST_BROADCAST_IDS:
        rows = measured(held.join(F.broadcast(known), "doc_id"), ["doc_id", "stratum", "q"])
    else:
        rows = measured(held, ["doc_id", "stratum"]).join(known, "doc_id")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(HASH_PARTS))
    role = F.when(F.col("q") != 1, "bad").when(part < TUNING_PARTS, "tune").otherwise("hold")
    rows.select("doc_id", "stratum", role.alias("role"), *RULES).write.parquet(f"{path}/measures")
    return docs.sparkSession.read.parquet(f"{path}/measures")


def cutoffs(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per stratum with a good label: its name, n_good, n_hold, allowed, level (null: none passed) and the first bin
    that each rule rejects (null: none).

    All labelled rows count, as numbers in bins; rows of one text measure alike, so ties fall together. In a stratum without
    bad labels all rules have the same weight.
    """
    rows = labelled(docs, labels, stratum)
    of = {role: F.count_if(F.col("role") == role).alias(f"n_{role}") for role in ("tune", "hold", "bad")}
    strata = rows.groupBy("stratum").agg(*of.values()).filter("n_tune + n_hold > 0")
    several = strata.agg(F.count(F.lit(1)).alias("strata"))  # one row
    strata = strata.crossJoin(F.broadcast(several)).withColumn("allowed", allowed_rejections(
        F.col("n_hold"), MAX_FALSE_REJECTION, F.lit(ERROR) / F.col("strata"))).drop("strata")

    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), measure_bin(F.col(r)).alias("bin")) for r in RULES]))
    pairs = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "stratum", "role", pairs.alias("pair")).select(
        "row", "stratum", "role", "pair.rule", "pair.bin")
    counts = pairs.groupBy("stratum", "rule", "bin").agg(
        F.count_if(F.col("role") == "tune").alias("tune"), F.count_if(F.col("role") == "bad").alias("bad"))
    from_top = Window.partitionBy("stratum", "rule").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"above": F.sum("tune").over(from_top), "caught": F.sum("bad").over(from_top)})

    # What a rule catches of the bad texts while it rejects no more than its limit of good ones, beyond as many.
    within = counts.join(strata, "stratum")
    lift = F.max(F.when(F.col("above") <= F.floor(F.col("n_tune") * MAX_FALSE_REJECTION), F.col("caught")))
    rule = Window.partitionBy("stratum")
    weights = within.groupBy("stratum", "rule", "n_bad").agg(lift.alias("caught")).withColumn("lift", F.when(
        F.col("n_bad") == 0, 1.0).otherwise(F.greatest(
            F.lit(0.0), F.coalesce(F.col("caught"), F.lit(0)) / F.col("n_bad") - MAX_FALSE_REJECTION)))
    weights = weights.filter("lift > 0").select(
        "stratum", "rule", (F.col("lift") / F.sum("lift").over(rule)).alias("weight"),
        (F.row_number().over(rule.orderBy(F.desc("lift"), "rule")) - 1).alias("joins"), F.count(F.lit(1)).over(rule).alias("several"),
    )
    # The first level at which a rule rejects a bin: it has joined, and enough of its good texts may go.
    unit = F.col("weight") * F.col("n_tune") * F.lit(STRICTEST / LEVELS)
    more = F.ceil(F.col("above") / unit - 1e-9)
    first = F.when(F.col("above") == 0, F.col("joins")).when(more <= LEVELS, F.col("several") - 1 + more)
    levels = within.join(weights, ["stratum", "rule"]).select("stratum", "rule", "bin", "tune", first.cast("long").alias("level"))

    # The holdout by the first level that rejects a text, and the last level that passes.
    reached = pairs.filter("role = 'hold'").join(levels.filter("level is not null"), ["stratum", "rule", "bin"]).groupBy(
        "stratum", "row").agg(F.min("level").alias("level"))
    upto = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    rejected = reached.groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("m")).withColumn("rejected", F.sum("m").over(upto))
    failed = rejected.join(strata.select("stratum", "allowed"), "stratum").filter("rejected > allowed").groupBy("stratum").agg(
        F.min("level").alias("failed"))
    passed = F.when(F.col("allowed") >= 0, F.coalesce(F.col("failed") - 1, F.col("strictest")))
    strictest = weights.groupBy("stratum").agg((F.max("several") - 1 + LEVELS).alias("strictest"))
    chosen = strata.join(failed, "stratum", "left").join(strictest, "stratum", "left").withColumn("level", F.when(passed >= 0, passed))

    # A rule begins to reject above the largest bin of a tuning text that it may not reject yet.
    spared = levels.filter("tune > 0").join(chosen.select("stratum", F.col("level").alias("most")), "stratum").filter(
        "most is not null and (level is null or level > most)")
    spared = spared.join(weights.select("stratum", "rule", "joins"), ["stratum", "rule"]).filter("joins <= most")
    cuts = spared.groupBy("stratum").agg(
        *[(F.max(F.when(F.col("rule") == r, F.col("bin"))) + 1).alias(f"cut_{r}") for r in RULES])
    return chosen.select(
        "stratum", (F.col("n_tune") + F.col("n_hold")).alias("n_good"), "n_hold", "allowed", "level"
    ).join(cuts, "stratum", "left")


def judged(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, stratum: str = "lang") -> DataFrame:
    """``keep`` columns of ``docs`` (all if not given) with counts, base_failed, each rule's verdict and ``kept``.

    Columns of the same name are replaced. Null and empty texts have no words and fail the base rules; a null or unseen
    stratum has the empty name or no cutoffs and is judged by the base rules alone; repeated rows are judged each; with
    no labels only the base rules hold. Texts are read twice (labelled ones for the cutoffs, then all) and never shuffled.
    """
    keep = list(docs.columns if keep is None else keep)
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals",
            "base_failed", "rejected_by", "kept", *RULES}
    keep = [c for c in keep if c not in made]
    path = scratch_path(docs.sparkSession, "cutoffs")
    cutoffs(docs, labels, stratum).withColumnRenamed("stratum", "__stratum").write.parquet(path)
    limits = docs.sparkSession.read.parquet(path)  # one row per stratum; Spark knows its size
    frame = docs.withColumn("__stratum", F.coalesce(F.col(stratum), F.lit("")))
    out = measured(frame, [*keep, "__stratum"]).join(limits, "__stratum", "left")
    verdicts = [F.when(measure_bin(F.col(r)) >= F.col(f"cut_{r}"), F.lit(r)) for r in RULES]
    out = out.withColumn("rejected_by", F.array_compact(F.array(*verdicts)))
    return out.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by",
        # As one sum, so that a filter on it stays above the join and the counts are made once.
        ((F.size("rejected_by") + F.col("base_failed").cast("int")) == 0).alias("kept"),
    )
