"""Temperature mixing of sources, realised as budgeted block permutations.

With t_s the tokens of source s, its weight is t_s**x over the sum for an exponent x in
[0, 1]: 1 keeps the corpus' own shares, 0 makes all sources equal.  The exponent is
bisected: the largest one whose weights reach the target entropy (a fraction of the
logarithm of the number of sources), raised as far as the repetition limit asks, which
is hard.  A source's budget is its weight times the total; it is realised as whole
blocks, each one permutation of all documents of the source, and a last block that is
the longest beginning of its permutation that fits what is left of the budget.

The permutation of a block is the order of a hash of (seed, block, doc_id), which each
row carries as ``place``; rows themselves are not sorted.  The cut in
a last block is found in two steps, so that no source is ever sorted or gathered: sums
per source and hash range, combined before they are shuffled, give the range in which
the budget ends, and only that range's documents are accumulated.  Then each document
compares its own hash with its source's cut where it is read.

One number a source is gathered for the bisection.  The plan, one row a source, is
broadcast up to MAX_SOURCES; more are joined by a shuffle, each source dealt over SALTS.

Defined cases: a null source is a source; null or word-less texts have no tokens and
come with every whole block and with their place in the last one; a source without
tokens has weight 0 and each of its documents comes once; repeated ids stand and fall
together; an empty table gives an empty result; extra columns stay, whatever their
names, but for ones named as the two that ``realise`` adds, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lasting

ENTROPY, MAX_REPEATS, SEED, STEPS, MAX_SOURCES, PER_RANGE, SALTS = 0.98, 4.0, "mix", 50, 100_000, 5000, 16


def tokens(text: Column) -> Column:
    """Words of a text, the unit of the budget."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(block: Column, doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("/", F.lit(seed), block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def _range(h: Column, ranges: int) -> Column:
    """Which of so many equal ranges of hashes."""
    return F.floor(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * ranges / float(1 << 32)).cast("long")


def _powers(sizes: Column, x: Column) -> Column:
    return F.transform(sizes, lambda t: F.pow(t, x))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _entropy(sizes: Column, x: Column) -> Column:
    """Of the weights t**x / sum: log(sum) - sum(t**x * log(t**x)) / sum."""
    z = _sum(_powers(sizes, x))
    return F.log(z) - _sum(F.transform(sizes, lambda t: F.pow(t, x) * x * F.log(t))) / z


def _repeats(sizes: Column, x: Column, total: Column | None) -> Column:
    """How often the most repeated source comes; without a total, the largest comes once."""
    least, most = F.array_min(sizes), F.array_max(sizes)
    if total is None:
        return F.pow(most / least, 1 - x)
    return total * F.pow(least, x - 1) / _sum(_powers(sizes, x))


def _bisect(good_below, upper_is_answer: bool) -> Column:
    """``good_below(x)`` holds up to a point in [0, 1]; that point from below or above."""

    def step(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        ok = good_below(mid)
        return F.struct(F.when(ok, mid).otherwise(a["lo"]).alias("lo"), F.when(ok, a["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)
    return out["hi"] if upper_is_answer else out["lo"]


def weights(
    docs: DataFrame, total: int | str = "same", entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS
) -> DataFrame:
    """source, t, exponent, weight, budget: one row a source.

    ``total``: a number of tokens, "same" for as many as there are, or "cover" for as
    many as it takes for every source to come whole at least once.
    """
    shares = docs.groupBy("source").agg(F.sum(tokens(F.col("text"))).alias("t"), F.count("*").alias("n"))
    sizes = F.col("sizes")
    one = shares.where("t > 0").agg(F.sort_array(F.collect_list(F.col("t").cast("double"))).alias("sizes"))
    one = one.where(F.size("sizes") > 0).withColumn("all", _sum(sizes))
    asked = None if total == "cover" else F.col("all") if total == "same" else F.lit(float(total))
    goal = F.log(F.size(sizes).cast("double")) * entropy
    flat = F.when(_entropy(sizes, F.lit(1.0)) >= goal, 1.0).otherwise(_bisect(lambda x: _entropy(sizes, x) >= goal, False))
    within = lambda x: _repeats(sizes, x, asked) <= max_repeats
    limit = F.when(within(F.lit(0.0)), 0.0).when(~within(F.lit(1.0)), 1.0).otherwise(_bisect(lambda x: ~within(x), True))
    one = one.withColumn("exponent", F.greatest(flat, limit)).withColumn("z", _sum(_powers(sizes, F.col("exponent"))))
    if asked is None:
        most = F.array_max(sizes)
        budget = F.col("z") * F.pow(most, 1 - F.col("exponent"))
    else:
        budget = F.least(asked, F.col("all") * max_repeats)
    one = one.select("exponent", "z", budget.alias("total"))
    out = shares.join(F.broadcast(one), F.lit(True), "left")  # one row
    weight = F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.col("exponent")) / F.col("z")).otherwise(0.0)
    out = out.withColumn("weight", weight)
    # A millionth of a token forgives rounding where a budget is exactly a whole number of blocks.
    return out.select("source", "t", "n", "exponent", "weight", F.floor(F.col("weight") * F.col("total") + 1e-6).alias("budget"))


def realise(docs: DataFrame, weighted: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` as often as the budgets say, with ``block``, which permutation a row is from, and ``place``:
    the order of ``place`` and doc_id within a source's block is its permutation."""
    names, docs = docs.columns, docs.toDF(*(c if c in ("doc_id", "source", "text") else f"_c{k}" for k, c in enumerate(docs.columns)))
    plan = weighted.withColumn("blocks", F.when(F.col("t") > 0, F.floor(F.col("budget") / F.col("t"))).otherwise(1))
    plan = plan.select("source", "n", "blocks", (F.col("budget") - F.col("blocks") * F.col("t")).alias("left"))
    rows = plan.limit(MAX_SOURCES + 1).collect()
    spark = docs.sparkSession
    if few := len(rows) <= MAX_SOURCES:
        plan = spark.createDataFrame(rows, plan.schema)
        n = sum(r.n for r in rows)
    else:
        plan = lasting(plan, "mix-plan")
        n = plan.agg(F.sum("n")).first()[0]
    ranges = max(1, n // PER_RANGE)

    def joined(left: DataFrame, right: DataFrame, on: str, of: str, how: str = "inner") -> DataFrame:
        """``left`` with the row of its source; over the bound by a shuffle in which a source is dealt over SALTS."""
        equal = F.col(on).eqNullSafe(F.col(of))
        if few:
            return left.join(F.broadcast(right), equal, how)
        left = left.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        right = right.withColumn("_of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return left.join(right, equal & (F.col("_salt") == F.col("_of_salt")), how).drop("_salt", "_of_salt")

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    measured = docs.select(F.col("source").alias("_src"), "doc_id", tokens(F.col("text")).alias("_t"))
    measured = joined(measured, plan, "_src", "source").withColumn("_h", _draw(F.col("blocks"), F.col("doc_id"), seed))
    measured = measured.select("_src", "doc_id", "_t", "_h", "left", _range(F.col("_h"), ranges).alias("_range"))
    by_range = measured.groupBy("_src", "_range", "left").agg(F.sum("_t").alias("_t"))
    upto = F.sum("_t").over(Window.partitionBy("_src").orderBy("_range"))
    ends = by_range.withColumn("_upto", upto).where("_upto > left").groupBy("_src").agg(
        F.min(F.struct("_range", (F.col("left") - F.col("_upto") + F.col("_t")).alias("_rest"))).alias("_e")
    )
    ends = ends.select(F.col("_src").alias("_of"), F.col("_e._range").alias("_end"), F.col("_e._rest").alias("_rest"))
    inside = joined(measured, ends, "_src", "_of").where("_range = _end")
    run = F.sum("_t").over(Window.partitionBy("_src").orderBy("_h"))
    inside = inside.withColumn("_run", run).where("_run <= _rest").groupBy("_src").agg(F.max("_h").alias("_last"))
    inside = inside.select(F.col("_src").alias("_in"), "_last")
    sent = F.broadcast if few else lambda x: x
    ends = ends.join(sent(inside), same("_of", "_in"), "left").drop("_in")
    plan = plan.select(F.col("source").alias("_src"), "blocks", "left").join(sent(ends), same("_src", "_of"), "left")
    out = joined(docs, plan.select("_src", "blocks", "left", "_end", "_last"), "source", "_src")
    h = _draw(F.col("blocks"), F.col("doc_id"), seed)
    # Without a last document the budget ends before the first of its range.
    inside = (_range(h, ranges) < F.col("_end")) | ((_range(h, ranges) == F.col("_end")) & (h <= F.col("_last")))
    times = F.col("blocks") + (F.coalesce(inside, F.lit(False)) & (F.col("left") > 0)).cast("long")
    out = out.withColumn("_times", times.cast("int")).where("_times > 0")
    out = out.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    kept = [F.col(c).alias(name) for c, name in zip(docs.columns, names, strict=True) if name.lower() not in ("block", "place")]
    return out.select(*kept, "block", _draw(F.col("block"), F.col("doc_id"), seed).alias("place"))


def mix(docs: DataFrame, total: int | str = "same", **kw) -> DataFrame:
    """The mix itself, with the columns of ``docs`` and no others."""
    numbered = docs.toDF(*(c if c in ("doc_id", "source", "text") else f"_x{k}" for k, c in enumerate(docs.columns)))
    mixed = realise(numbered, weights(docs.select("source", "text"), total, **kw)).select(numbered.columns)
    return mixed.toDF(*docs.columns)
