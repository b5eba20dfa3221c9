"""Ordered grouping, segments, weighted window merges, chunks, running statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws as R
from ..functions import similarity as S
from ..functions import text as X

# Sizes of merged windows and their weights.
WINDOW_WEIGHTS = {2: 0.35, 3: 0.25, 4: 0.20, 5: 0.10, 6: 0.10}


def ordered_lines(lines: DataFrame, key: str, *order: str, fields: tuple[str, ...] = ("t", "tr")) -> DataFrame:
    """key, lines: an array of structs of ``fields`` in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *fields)))
    pick = F.transform(rows, lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    return lines.groupBy(key).agg(pick.alias("lines"))


def split_at_low(pairs: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """``pairs`` with ``segment``: each low-quality pair ends one; low and blank pairs go, blank ones without a split."""
    low = (F.lower(F.coalesce("quality", F.lit(""))) == "low").cast("int")
    number = F.sum(low).over(Window.partitionBy(key).orderBy(order)).alias("segment")
    out = pairs.select("*", number, low.alias("_low"))
    out = out.where((F.col("_low") == 0) & ~X.blank(F.col("t")) & ~X.blank(F.col("tr"))).drop("_low")
    dense = F.dense_rank().over(Window.partitionBy(key).orderBy("segment")) - 1
    return out.withColumn("segment", dense)


def merge_windows(segments: DataFrame, seed: int, max_bytes: int, copy: Column | int = 0, key: str = "id") -> DataFrame:
    """``segments`` (key, segment, lines) with ``merged``: its lines joined in windows of drawn sizes.

    From the left: of the sizes that fit what is left and whose joined sides both stay
    within ``max_bytes`` UTF-8 bytes, one is drawn by weight; where none fits, a line
    stands alone, whatever its size.  A fold over the lines, so a segment is one row.
    """
    copy = F.lit(copy) if isinstance(copy, int) else copy
    size, lines = F.size("lines"), F.col("lines")

    def span(i: Column, n: int, side: str) -> Column:
        return F.array_join(F.transform(F.slice(lines, i + 1, n), lambda x: x[side]), " ")

    def step(a: Column, i: Column) -> Column:
        fits = {
            n: (i + n <= size) & (F.octet_length(span(i, n, "t")) <= max_bytes) & (F.octet_length(span(i, n, "tr")) <= max_bytes)
            for n in WINDOW_WEIGHTS
        }
        weight = {n: F.when(f, WINDOW_WEIGHTS[n]).otherwise(0.0) for n, f in fits.items()}
        total = sum(weight.values(), F.lit(0.0))
        u = R.uniform(seed, F.col(key), F.col("segment"), copy, i) * total
        pick, upto = F.when(total == 0, 1), F.lit(0.0)
        for n in WINDOW_WEIGHTS:
            upto = upto + weight[n]
            pick = pick.when((u < upto) & (weight[n] > 0), n)
        pick = pick.otherwise(1)
        return F.when(i < a["next"], a).otherwise(F.struct((i + pick).alias("next"), F.concat(a["cuts"], F.array(F.struct(i.alias("i"), pick.alias("n")))).alias("cuts")))

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<i:int,n:int>>").alias("cuts"))
    cuts = F.aggregate(F.sequence(F.lit(0), size - 1), start, step)["cuts"]
    out = segments.where(size > 0).withColumn("_cuts", cuts)

    def joined(c: Column) -> Column:
        part = lambda side: F.array_join(F.transform(F.slice(lines, c["i"] + 1, c["n"]), lambda x: x[side]), " ")
        return F.struct(part("t").alias("t"), part("tr").alias("tr"), c["n"].alias("n_lines"))

    return out.withColumn("merged", F.transform("_cuts", joined)).drop("_cuts")


def window_copies(segments: DataFrame, n: int, seed: int, max_bytes: int, tag: str, norm_t=None, norm_tr=None, key: str = "id") -> DataFrame:
    """n differently drawn merges of every segment, normalised after merging, blank pairs dropped."""
    rows = segments.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))) if n else F.explode(F.array().cast("array<int>")))
    rows = merge_windows(rows, seed, max_bytes, F.col("copy"), key)
    rows = rows.select(key, "segment", "copy", F.posexplode("merged").alias("window", "_m")).select(key, "segment", "copy", "window", "_m.*")
    rows = rows.withColumns({"t": (norm_t or (lambda c: c))(F.col("t")), "tr": (norm_tr or (lambda c: c))(F.col("tr")), "source": F.lit(tag)})
    return rows.where(~X.blank(F.col("t")) & ~X.blank(F.col("tr")))


def chunks(documents: DataFrame, size: int, overlap: int, pages: str = "pages") -> DataFrame:
    """``documents`` with (start, end) of overlapped chunks; the last may lie inside the one before it."""
    n = F.col(pages)
    starts = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(size - overlap)))
    return documents.withColumn("start", F.explode(starts)).withColumn("end", F.least(F.col("start") + size, n))


def batches(rows: DataFrame, size: int, index: str = "batch_index") -> DataFrame:
    return rows.withColumn("batch", F.floor(F.col(index) / size))


def top_per_group(rows: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each group; Spark limits each task's groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    """A reproducible global shuffle: a sort by hash, in range partitions."""
    return rows.orderBy(R.order_key(seed, *[F.col(k) for k in keys]), *keys)


def running_mean(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_mean", F.avg(value).over(w))


def ema(rows: DataFrame, key: str, order: str, value: str, keep: float = 0.99) -> DataFrame:
    """key, ema: ``keep * before + (1 - keep) * value`` over the ordered values, from the first."""
    values = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(value).alias("v")))), lambda x: x["v"].cast("double"))
    step = lambda a, v: F.when(a.isNull(), v).otherwise(a * keep + v * (1 - keep))
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.aggregate(values, F.lit(None).cast("double"), step).alias("ema"))


def round_trip(records: DataFrame, parts: DataFrame, sides: tuple[str, ...] = ("t",), key: str = "id", threshold: float = 0.9) -> DataFrame:
    """key, a similarity for each side, valid: a record against its parts (key, pos, sides), joined in order.

    Empty parts are left out; null counts as empty; a record without parts is compared with nothing.
    """
    held = F.sort_array(F.collect_list(F.struct("pos", *sides))).alias("_p")
    rows = records.join(parts.groupBy(key).agg(held), key, "left")
    joined = lambda c: F.coalesce(F.array_join(F.filter(F.col(f"_p.{c}"), lambda x: x != ""), " "), F.lit(""))
    rows = rows.withColumns({f"{c}_similarity": S.ratio(F.coalesce(c, F.lit("")), joined(c)) for c in sides})
    valid = F.lit(True)
    for c in sides:
        valid = valid & (F.col(f"{c}_similarity") >= threshold)
    return rows.select(key, *[f"{c}_similarity" for c in sides], valid.alias("valid"))
