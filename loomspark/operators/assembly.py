"""Assembly of training sets: union, upsampling, chat records, splits, weights, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws as R

# Copies of each source in the upsampled set, and of merged windows.
UPSAMPLE = {"expert": 8, "synthetic": 4, "cad": 4, "hecker": 8}
COPIES = {"expert": 14, "synthetic": 6, "synthetic_v24": 12, "akt": 14, "dergipark": 14, "michel": 14, "round4": 14}


def tagged(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows with ``source`` and ``priority``, the place of their source in the given order."""
    rows = [d.withColumns({"source": F.lit(s), "priority": F.lit(k)}) for k, (s, d) in enumerate(sources.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def upsample(rows: DataFrame, copies: dict[str, int], default: int = 1) -> DataFrame:
    """Each row as often as its source says, numbered by ``copy``."""
    n = F.lit(default)
    for source, k in copies.items():
        n = F.when(F.col("source") == source, k).otherwise(n)
    return rows.withColumn("_n", n).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")


def chat_record(t: Column, tr: Column, system: str) -> Column:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", t), turn("assistant", tr))


def distribution(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def length_statistics(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: count, and least, greatest and mean length of each column."""
    out = [F.count("*").alias("n")]
    for c in columns:
        n = F.char_length(c)
        out += [F.min(n).alias(f"min_{c}"), F.max(n).alias(f"max_{c}"), F.avg(n).alias(f"mean_{c}")]
    return rows.agg(*out)


def output_name(base: str, flags: dict[str, bool]) -> str:
    """A folder name with a suffix for each flag that is set, in order."""
    return "_".join([base, *[f for f, on in flags.items() if on]])


def grouped_split(rows: DataFrame, key: str, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, valid): whole groups of one key; max(1, share of groups) of them in hash order are valid."""
    groups = rows.select(key).distinct().withColumn("_h", R.order_key(seed, F.col(key)))
    # Counts by the beginnings of hashes say in which range the last valid group lies: only that range is ordered.
    counts = sorted((r[0], r[1]) for r in groups.groupBy(F.substring("_h", 1, 3)).count().collect())  # 4096 at most
    left = max(1, int(sum(n for _, n in counts) * share))
    at = 0
    while at < len(counts) - 1 and counts[at][1] < left:
        left -= counts[at][1]
        at += 1
    edge = counts[at][0] if counts else ""
    last = groups.where(F.substring("_h", 1, 3) == edge).orderBy("_h", key).limit(left)
    held = groups.where(F.substring("_h", 1, 3) < edge).unionByName(last).select(key)
    return rows.join(held, key, "left_anti").select(rows.columns), rows.join(held, key, "left_semi").select(rows.columns)


def full_fit_split(rows: DataFrame, share: float, seed: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(all rows, a hash sample of about that share of them)."""
    return rows, rows.where(R.uniform(seed, *[F.col(k) for k in keys]) < share)


def swapped(rows: DataFrame) -> DataFrame:
    """Preference rows and their mirror images: sides exchanged, picks flipped, EQUAL kept."""
    pick = F.when(F.col("pick") == "A", "B").when(F.col("pick") == "B", "A").otherwise(F.col("pick"))
    mirror = rows.withColumns({"a": F.col("b"), "b": F.col("a"), "pick": pick})
    return rows.withColumn("swapped", F.lit(False)).unionByName(mirror.withColumn("swapped", F.lit(True)))


def class_weights(rows: DataFrame, label: str = "pick") -> DataFrame:
    """label, n, weight: the largest class's count over each class's."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    top = F.broadcast(counts.agg(F.max("n").alias("_top")))  # one row
    return counts.join(top).select(label, "n", (F.col("_top") / F.col("n")).alias("weight"))


def weighted_sample(rows: DataFrame, weight: str, n: int, seed: int, key: str, ranges: int = 1024) -> DataFrame:
    """n draws with replacement, in proportion to ``weight``.

    Weights are accumulated inside hash ranges of the key and over the ranges' sums, so
    no task sorts all rows; a draw falls into a range first and into a row there.
    """
    rows = rows.withColumn("_r", R.integer(ranges, f"{seed}range", F.col(key)))
    sums = rows.groupBy("_r").agg(F.sum(weight).alias("_w"))
    upto = F.sum("_w").over(Window.orderBy("_r"))
    sums = sums.select("_r", (upto - F.col("_w")).alias("_from"), upto.alias("_to"))
    total = sums.agg(F.max("_to").alias("_total"))
    spark = rows.sparkSession
    at = spark.range(n).withColumnRenamed("id", "draw").join(F.broadcast(total))
    at = at.select("draw", (R.uniform(seed, F.col("draw")) * F.col("_total")).alias("_u"))
    at = at.join(F.broadcast(sums), (F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to")))
    inner = F.sum(weight).over(Window.partitionBy("_r").orderBy(key))
    inside = rows.withColumn("_b", inner).withColumn("_a", F.col("_b") - F.col(weight))
    hit = at.select("draw", "_r", (F.col("_u") - F.col("_from")).alias("_v")).join(inside, "_r").where("_v >= _a and _v < _b")
    return hit.select("draw", *[c for c in rows.columns if c != "_r"])


def packed(rows: DataFrame, order: str, length: str = "n_tokens", multiple: int = 8, bin_key: str = "bin") -> DataFrame:
    """bin, n, end offsets and padded length of sequences laid end to end; at least one pad is added.

    A bin is one training sequence, so its ends are one row; they are running sums, each made once.
    """
    upto = F.sum(length).over(Window.partitionBy(bin_key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    ended = rows.select(bin_key, order, upto.cast("long").alias("_e"))
    out = ended.groupBy(bin_key).agg(F.count("*").cast("int").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct(order, "_e"))), lambda x: x["_e"]).alias("ends"))
    total = F.element_at("ends", -1)
    return out.withColumn("padded", total + multiple - F.pmod(total, F.lit(multiple)))


def linkage_report(tablets: DataFrame, pairs: DataFrame) -> DataFrame:
    """kind, method, n: tablets and pairs by matching method, scores stripped from method names."""
    method = F.coalesce(F.regexp_replace("method", r"_[\d.]+$", ""), F.lit("none"))
    count = lambda rows, kind: rows.groupBy(F.lit(kind).alias("kind"), method.alias("method")).agg(F.count("*").alias("n"))
    return count(tablets, "tablet").unionByName(count(pairs, "pair"))
