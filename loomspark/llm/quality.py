"""Quality rules whose cutoffs carry a guarantee, in Spark expressions only.

Each text gets exact counts (``stats``).  From them each rule makes a whole-number
score, per mille; a document fails a rule if its score is over the rule's cutoff in
the document's stratum.  ``learn`` picks the cutoffs on a labelled holdout: for a
stratum with n good documents of which a cutoff rejects k, the exact binomial tail
P(Bin(n, risk) <= k) is the p-value of "the cutoff rejects more than ``risk`` of the
good ones".  A cutoff counts as safe only if its p-value is at most ``delta`` over the
number of all tests made (strata x rules x cutoffs, Bonferroni), so with probability
1 - delta no chosen cutoff in any stratum rejects more than ``risk`` of good documents,
however many were looked at.  ``risk`` is the total divided by the number of rules, so
the bound holds for all rules together.  Of the safe cutoffs that reject clearly more
bad than good documents, the lowest is taken; a stratum without one keeps everything.

The binomial tail is summed downwards from k in log space, with Stirling's series for
the factorials; after ``TERMS`` terms the rest is bounded by a geometric series, which
only makes the p-value larger.

Repeated windows are found exactly, on the words themselves: most texts have as many
distinct windows as windows and are done; the others sort (window, position) pairs.

Defined cases: null or empty text has no words and fails the base rule; repeated
documents are each judged; labels of a repeated id count once, as good only if all of
them are; null labels and labels of unknown documents are ignored; with no labels or
too few of them nothing but the base rule rejects; null strata are a stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW, MIN_WORDS, MAX_REPEAT = 5, 10, 20
RISK, DELTA, POWER, TERMS = 0.05, 0.05, 3.0, 20_000
#: Cutoffs that are tried, per mille.
CUTOFFS = (0, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 700, 1000, 1500, 2000)
_SPACE = " \t\n\x0b\f\r"


def scores() -> dict[str, Column]:
    """The rules: what each measures, per mille of words, lines or word characters."""

    def rate(a: str, b: str) -> Column:
        return F.coalesce(F.floor(F.col(a) * 1000 / F.when(F.col(b) > 0, F.col(b))), F.lit(0)).cast("long")

    return {
        "symbols": rate("n_symbols", "n_words"),
        "marks": rate("n_marks", "n_words"),
        "dup_lines": rate("n_dup_lines", "n_lines"),
        "repeats": rate("n_repeat_words", "n_words"),
    }


def stats(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every whole text."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), text.alias("_t"))
    trimmed = F.btrim("_t", F.lit(_SPACE))
    d = d.select("*", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")).alias("_w"))
    d = d.select("*", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "").alias("_lines"))
    n, at = F.size("_w"), F.col("_w")
    window = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.concat_ws(" ", *[F.get(at, i + k) for k in range(WINDOW)])
    )
    d = d.select(
        "doc_id",
        "stratum",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).cast("long").alias("n_marks"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, window).otherwise(F.array().cast("array<string>")).alias("_v"),
    )
    pairs = F.sort_array(F.transform("_v", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_v")) < F.size("_v"), pairs)).drop("_v")
    twice = F.filter(
        F.transform(
            "_s",
            lambda s, k: F.when((s["v"] == F.get("_s", k - 1)["v"]) | (s["v"] == F.get("_s", k + 1)["v"]), s["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.aggregate(
        F.array_sort(twice),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
    )["n"]
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_s")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _log_factorial(n: Column) -> Column:
    """log n!, by Stirling's series at n + 10."""
    x = n.cast("double") + 10.0
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    for k in range(10):
        series = series - F.log(x - float(k))
    return series


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), from above; 1 where k is not below the mean n * p."""
    n, k = n.cast("double"), k.cast("double")
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)

    def step(a: Column, j: Column) -> Column:
        at = k - j.cast("double")
        term = a["term"] * at * (1 - p) / ((n - at + 1) * p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    last = F.least(k.cast("int"), F.lit(TERMS))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    total = F.aggregate(F.filter(F.sequence(F.lit(0), last), lambda j: j < last), start, step)
    rest = (k - last) * (1 - p) / ((n - k + last + 1) * p)
    bound = total["sum"] + F.when(k > last, total["term"] * rest / (1 - rest)).otherwise(0.0)
    return F.when(k >= n * p, 1.0).otherwise(F.exp(top) * bound)


def learn(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the cutoffs chosen on the labelled documents.

    Counts per stratum and cutoff are summed before anything is shuffled.
    """
    rules = scores()
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    held = measured.where(~base_failed()).join(good, "doc_id")
    held = held.select("stratum", "_good", F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.array(*[(s > c).cast("long") for c in CUTOFFS]).alias("over")) for r, s in rules.items()
    ])))
    is_good, is_bad = (F.col("_good") == 1).cast("long"), (F.col("_good") == 0).cast("long")
    counts = held.groupBy("stratum", "rule").agg(
        F.sum(is_good).alias("n"),
        F.sum(is_bad).alias("n_bad"),
        *[F.sum(is_good * F.col("over")[i]).alias(f"k{i}") for i in range(len(CUTOFFS))],
        *[F.sum(is_bad * F.col("over")[i]).alias(f"b{i}") for i in range(len(CUTOFFS))],
    )
    strata = F.count_distinct(F.struct("stratum")).alias("_strata")
    tests = F.broadcast(counts.agg((strata * len(rules) * len(CUTOFFS)).alias("_tests")))  # one row
    tried = counts.join(tests).select("stratum", "rule", "n", "n_bad", "_tests", F.inline(F.array(*[
        F.struct(F.lit(c).cast("long").alias("cutoff"), F.col(f"k{i}").alias("k"), F.col(f"b{i}").alias("bad")) for i, c in enumerate(CUTOFFS)
    ])))
    each = risk / len(rules)
    safe = binomial_tail(F.col("n"), F.col("k"), each) <= delta / F.col("_tests")
    worth = (F.col("bad") > 0) & (F.col("bad") >= POWER * each * F.col("n_bad"))
    return tried.where(safe & worth).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with base_failed, kept and the names of the failed rules."""
    rules = scores()
    wide = cutoffs.groupBy("stratum").pivot("rule", list(rules)).agg(F.min("cutoff"))
    wide = wide.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_{r}") for r in rules])
    if wide.count() <= 100_000:  # a row for each stratum; more of them are joined by a shuffle
        wide = F.broadcast(wide)
    out = measured.join(wide, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(s > F.col(f"_{r}"), r) for r, s in rules.items()]))
    out = out.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return out.drop("_stratum", *[f"_{r}" for r in rules])


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **kw) -> DataFrame:
    """Measure once (the narrow counts are written), learn from them, judge all of them."""
    measured = materialize(stats(docs, stratum), "quality")
    return judge(measured, learn(measured, labels, **kw))
