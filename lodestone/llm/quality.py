"""Operator 1: quality rules whose cutoffs carry a risk guarantee.

Each rule rejects a text when a score exceeds a cutoff.  ``PATH`` is a sequence of
rules and cutoffs that is fixed in advance, from the mildest to the most severe;
the policy of a step rejects what any rule up to that step rejects.  For each
stratum (here: the language) the labelled good documents that a policy would
reject are counted.  A policy passes its test when the exact binomial tail
``P(Bin(n_good, alpha) <= n_false)`` is at most ``delta / n_strata``, and it is
certified when all policies up to it pass.

That corrects for multiple testing twice: the strata share ``delta`` (Bonferroni),
and within a stratum the steps are tested in a fixed sequence that ends at the
first failure, which needs no further share.  So with probability ``1 - delta``
every certified policy of every stratum rejects at most ``alpha`` of the good
documents of its stratum, with all its rules together, and any choice among them
is valid.  The one with the best ``share of bad rejected - penalty * share of good
rejected`` is taken, if that gain is positive; of equals the mildest.  A stratum
without one abstains: only the base rules act there.

Defined results: a null text is an empty text; ``n_words`` 0 fails the base
rules; a null language is a stratum of its own, apart from an empty one; labels
that contradict each other for one id, and null labels, are left out; rows that
repeat a labelled id in a stratum are one piece of evidence, rejected if any of
them is (a bad one: if all are); a repeated row is judged like any other; without
labels all rules abstain; an empty table gives an empty result.  Only ``doc_id``,
``text`` and the stratum column are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE, let, materialize, named, whole_row, word_array

#: Rule name -> (score expression over the base columns, its cutoffs from the mildest on).
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbol": ("n_symbols / greatest(word_chars, 1)", (0.2, 0.1, 0.05, 0.02)),
    "dup_line": ("n_dup_lines / greatest(n_lines, 1)", (0.5, 0.3, 0.1)),
    "repeat": ("n_repeat_words / greatest(n_words, 1)", (0.4, 0.3, 0.2, 0.1)),
    "mark": ("n_marks / greatest(n_words, 1)", (0.5, 0.2, 0.1, 0.05)),
}
#: (rule, cutoff) of each step: the mildest cutoff of every rule, then the next ones.
PATH: tuple[tuple[str, float], ...] = tuple((rule, grid[i]) for i in range(max(len(g) for _, g in RULES.values())) for rule, (_, grid) in RULES.items() if i < len(grid))

ALPHA = 0.05
DELTA = 0.05
PENALTY = 10.0


def _covered_words(words: Column, window_hashes: Column) -> Column:
    """Words in a 3-word window that the text has twice or more; windows are sorted by hash and compared by words."""
    window = lambda h, i: F.struct(h.alias("h"), *[F.get(words, i + k).alias(f"w{k}") for k in range(3)], i.alias("p"))
    same = lambda x, y: (x.h == y.h) & (x.w0 == y.w0) & (x.w1 == y.w1) & (x.w2 == y.w2)

    def covered(s: Column) -> Column:
        repeated = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return F.aggregate(
            F.sort_array(F.transform(repeated, lambda x: x.p)),
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc.n + F.least(F.lit(3), p - acc.last)).alias("n")),
            lambda acc: acc.n,
        )

    return let(F.sort_array(F.transform(window_hashes, window)), covered)


def base_features(docs: DataFrame, stratum: str = "lang", with_row: bool = False) -> DataFrame:
    """doc_id, stratum and the counts that the rules use; one row a document.

    With ``with_row`` the whole row comes along, as the struct ``row``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = ["row"] if with_row else []
    docs = docs.select(whole_row(docs), "doc_id", "text", named(stratum).alias(stratum)) if with_row else docs
    words = docs.select(*carried, "doc_id", F.col(stratum).cast("string").alias("stratum"), text.alias("text"), word_array(text).alias("w"))
    n = F.size("w")
    windows = F.when(
        n >= 4,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
    )
    counted = words.select(
        *carried,
        "doc_id",
        "stratum",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
        "w",
        windows.alias("h"),
    )
    repeats = F.when(F.size("h") > F.size(F.array_distinct("h")), _covered_words(F.col("w"), F.col("h"))).otherwise(F.lit(0).cast("long"))
    return counted.select(
        *carried,
        "doc_id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_marks",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeats, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 10, carried back; for x >= 1 to about 1e-12."""
    y = x + 10.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    back = x
    for i in range(1, 10):
        back = back * (x + float(i))
    return series - F.log(back)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k); 1 if k is not below n * p, as no test passes there.

    Terms are summed from that of k down.  Below n * p the i-th further term is
    less than exp(-i^2 / 2np) times the first, so those behind 10 sqrt(np) are less
    than what a double holds: the sum is exact at any size.
    """
    kd, nd = k.cast("double"), n.cast("double")
    odds = (1 - p) / p
    top = F.exp(
        _log_gamma(nd + 1) - _log_gamma(kd + 1) - _log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    )
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.least(k, F.ceil(10 * F.sqrt(nd * p)).cast("long") + 10)),
        F.struct(top.alias("term"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct(
            (acc.term * (kd - i) * F.lit(odds) / (nd - kd + i + 1)).alias("term"), (acc["sum"] + acc.term).alias("sum")
        ),
        lambda acc: acc["sum"],
    )
    return F.when(kd < nd * p, total).otherwise(1.0)


def first_step() -> Column:
    """The first step of PATH whose rule rejects a row of features; null if none does."""
    return F.least(*[F.when(F.expr(RULES[rule][0]) > cut, F.lit(t)) for t, (rule, cut) in enumerate(PATH)])


def policy_tests(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row a stratum and step: n_good, n_false, n_bad, n_caught, the binomial tail and whether the policy is certified."""
    agreed = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    labelled = features.select("doc_id", "stratum", F.coalesce(first_step(), F.lit(len(PATH))).alias("step")).join(agreed.select("doc_id", "hi"), "doc_id")
    each = labelled.groupBy("stratum", "doc_id", "hi").agg(F.min("step").alias("first"), F.max("step").alias("last"))
    good, bad = F.col("hi") == 1, F.col("hi") == 0
    counts = [c for t in range(len(PATH)) for c in (F.count(F.when(good & (F.col("first") <= t), 1)).alias(f"k_{t}"), F.count(F.when(bad & (F.col("last") <= t), 1)).alias(f"b_{t}"))]
    per_stratum = each.groupBy("stratum").agg(F.count(F.when(good, 1)).alias("n_good"), F.count(F.when(bad, 1)).alias("n_bad"), *counts)
    steps = F.array(*[F.struct(F.lit(t).alias("step"), F.col(f"k_{t}").alias("n_false"), F.col(f"b_{t}").alias("n_caught")) for t in range(len(PATH))])
    # Windows over a row for each stratum, and over the steps of one.
    strata = per_stratum.withColumn("n_strata", F.count("*").over(Window.partitionBy(F.lit(0))))
    tested = strata.select("stratum", "n_good", "n_bad", "n_strata", F.explode(steps).alias("s")).select("stratum", "n_good", "n_bad", "n_strata", "s.*")
    tested = tested.withColumn("tail", binomial_tail(F.col("n_false"), F.col("n_good"), alpha))
    so_far = Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tested.withColumn("certified", F.max("tail").over(so_far) <= F.lit(delta) / F.col("n_strata"))


def select_policies(tests: DataFrame) -> DataFrame:
    """(judged, policy): the step that is taken in each stratum that has one."""
    gain = F.col("n_caught") / F.greatest("n_bad", F.lit(1)) - F.lit(PENALTY) * F.col("n_false") / F.greatest("n_good", F.lit(1))
    best = tests.where("certified").withColumn("gain", gain).where("gain > 0").groupBy("stratum")
    return best.agg(F.max_by("step", F.struct("gain", -F.col("step"))).alias("policy")).select(F.col("stratum").alias("judged"), "policy")


def apply_policies(features: DataFrame, policies: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to the features."""
    joined = features.join(policies, features.stratum.eqNullSafe(policies.judged), "left")
    rejected = F.coalesce(first_step() <= F.col("policy"), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("judged")


def quality_policies(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The policies as a written table, so that its size is known when it is joined."""
    return materialize(select_policies(policy_tests(features, labels, alpha, delta)), "quality-policies")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row a document: the counts, ``base_failed``, ``policy`` (a step of PATH or null) and ``kept``."""
    features = materialize(base_features(docs, stratum), "quality-features")
    return apply_policies(features, quality_policies(features, labels, alpha, delta))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    Rows and counts are written once, as the policies need the counts of all rows
    before any row can be judged; no text is shuffled.
    """
    features = materialize(base_features(docs, stratum, with_row=True), "quality-rows")
    return apply_policies(features, quality_policies(features, labels, alpha, delta)).where("kept").select("row.*")
