"""Exact, keyed and fuzzy deduplication; best of group; exclusion with reasons."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import similarity as S
from ..functions import text as X
from ..session import ship_package
from .linkage import first_by


def unique_pairs(pairs: DataFrame, order: str) -> DataFrame:
    """The first of each pair of lower-cased sides."""
    keyed = pairs.withColumns({"_a": F.lower("t"), "_b": F.lower("tr")})
    return first_by(keyed, ["_a", "_b"], order).select(pairs.columns)


def unique(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key; null is a key."""
    return first_by(rows, keys, order)


def n_high(pairs: Column) -> Column:
    return F.size(F.filter(pairs, lambda p: F.lower(p["quality"]) == "high"))


def keyed_fuzzy(records: DataFrame, threshold: float = 0.96) -> DataFrame:
    """Of records that share an id: the best (most high pairs, then first), and those unlike it.

    Columns id, ord, text, n_high.  Records without an id all stay.  Only pairs whose
    keys differ are compared by the slow measure.
    """
    rows = records.withColumn("_key", X.rough_key(F.col("text")))
    best = rows.where("id is not null").groupBy("id").agg(
        F.max_by(F.struct("ord", "_key"), F.struct(F.col("n_high"), -F.col("ord"))).alias("_best")
    )
    rows = rows.join(best, "id", "left")
    settled = F.col("id").isNull() | (F.col("ord") == F.col("_best.ord"))
    same = F.col("_key") == F.col("_best._key")
    kept = rows.where(settled).select(records.columns)
    open_ = rows.where(~settled & ~same)
    unlike = open_.where(S.ratio(F.col("_best._key"), F.col("_key")) <= threshold).select(records.columns)
    return kept.unionByName(unlike)


def exclude(records: DataFrame, sets: Sequence[tuple[str, DataFrame]], pairs: str = "sentence_pairs") -> DataFrame:
    """id, reason: records with a pair whose key is in a set; the first such pair names the set.

    ``records``: id and an array of pairs with field ``t``.  Sets have a column ``key``.
    """
    rows = records.select("id", F.posexplode(F.transform(pairs, lambda p: X.rough_key(p["t"]))).alias("pos", "key")).where("key != ''")
    reason = None
    for k, (name, table) in enumerate(sets):
        rows = rows.join(table.select(F.col("key").alias(f"_k{k}")).distinct(), F.col("key") == F.col(f"_k{k}"), "left")
        hit = F.col(f"_k{k}").isNotNull()
        reason = F.when(hit, name) if reason is None else reason.when(hit, name)
    rows = rows.withColumn("reason", reason).where("reason is not null")
    return rows.groupBy("id").agg(F.min_by("reason", "pos").alias("reason"))


def overlap(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """How many keys two sets share."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n"))


def quality_rank(quality: Column) -> Column:
    return F.when(quality == "high", 0).when(quality == "medium", 1).otherwise(2)


def within_chunk(lines: DataFrame) -> DataFrame:
    """The first of repeated lines of a chunk; lines without numbers are told apart by their text."""
    head = F.when((F.col("start") == 0) & (F.col("end") == 0), F.substring("t", 1, 50)).otherwise("")
    return first_by(lines.withColumn("_head", head), ["chunk", "id", "start", "end", "_head"], "ord").select(lines.columns)


def best_chunk(lines: DataFrame) -> DataFrame:
    """Of the chunks that have a tablet, the lines of the best one.

    Best: most lines, most of them real, lowest mean quality rank, most characters; the
    first chunk on a tie.
    """
    real = ~F.col("t").contains("MISSING") & ~F.col("tr").contains("MISSING")
    scored = lines.groupBy("id", "chunk").agg(
        F.count("*").alias("_n"), F.sum(real.cast("int")).alias("_real"), F.avg(-quality_rank(F.col("quality"))).alias("_q"),
        F.sum(F.char_length("t") + F.char_length("tr")).alias("_chars"), F.min("ord").alias("_ord"),
    )
    best = scored.groupBy("id").agg(F.max_by("chunk", F.struct("_n", "_real", "_q", "_chars", -F.col("_ord"))).alias("chunk"))
    return lines.join(best, ["id", "chunk"], "left_semi").select(lines.columns)


def better_of(a: Column, b: Column) -> Column:
    """Of two lines (t, tr, quality) the one that is not MISSING and of better quality; the left on a tie."""
    score = lambda x: F.struct((x["t"].contains("MISSING") | x["tr"].contains("MISSING")).cast("int"), quality_rank(x["quality"]))
    return F.when(score(b) < score(a), b).otherwise(a)


def attestations(rows: DataFrame) -> DataFrame:
    """One row for each source reference and beginning of text."""
    return first_by(rows.withColumn("_head", F.substring("t", 1, 50)), ["source_ref", "_head"], "ord").select(rows.columns)


def generated(draws: DataFrame, n: int) -> DataFrame:
    """The first n distinct pairs of numbered draws."""
    return first_by(draws, ["t", "tr"], "draw").orderBy("draw").limit(n)


def first_in_section(entries: DataFrame, n: int, seed_order: Column) -> DataFrame:
    """The first entry of each section, and a random n of those."""
    return first_by(entries, ["section"], "ord").orderBy(seed_order).limit(n)


def align_edges(left: Column, right: Column, edge: int = 5, least: float = 80.0) -> Column:
    """How many lines at the end of ``left`` repeat at the start of ``right`` (texts), at most ``edge``."""
    ship_package()

    @F.pandas_udf(T.IntegerType())
    def aligned(a: pd.Series, b: pd.Series) -> pd.Series:
        empty = lambda x: [] if x is None else list(x)
        return pd.Series([_aligned(empty(x), empty(y), edge, least) for x, y in zip(a, b, strict=True)])

    return aligned(left, right)


def _aligned(a: list[str], b: list[str], edge: int, least: float) -> int:
    tail, best = a[-edge:], (0, 0)
    for n in range(1, min(len(tail), len(b)) + 1):
        met = sum(S.indel(x, y) >= least for x, y in zip(tail[-n:], b[:n], strict=True))
        best = max(best, (met, n))
    return best[1] if best[0] else 0


def merge_edges(left: Column, right: Column, edge: int = 5, least: float = 80.0) -> Column:
    """The lines (t, tr, quality) of two chunks as one list, where the end of the first repeats at the start of the second.

    The offset with most matching lines wins, the first on a tie; matching lines become the
    better of the two, lines beside each other that differ both stay, the left one first.
    """
    ship_package()
    kind = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("t", "tr", "quality")]))

    @F.pandas_udf(kind)
    def merged(a: pd.Series, b: pd.Series) -> pd.Series:
        rows = lambda x: [] if x is None else [dict(r) for r in x]
        return pd.Series([_merged(rows(x), rows(y), edge, least) for x, y in zip(a, b, strict=True)])

    return merged(left, right)


def _merged(a: list[dict], b: list[dict], edge: int, least: float) -> list[dict]:
    start = max(0, len(a) - edge)
    alike = lambda x, y: bool(x["t"]) and bool(y["t"]) and S.indel(x["t"], y["t"]) >= least
    met = {k: sum(alike(x, y) for x, y in zip(a[k:], b[:edge], strict=False)) for k in range(start, len(a))}
    at = max(met, key=lambda k: (met[k], -k), default=None)
    if at is None or not met[at]:
        return a + b
    rank = lambda x: ("MISSING" in (x["t"] or "") or "MISSING" in (x["tr"] or ""), {"high": 0, "medium": 1}.get(x["quality"], 2))
    out, n = a[:at], min(len(a) - at, len(b), edge)
    for x, y in zip(a[at : at + n], b, strict=False):
        out += [min(x, y, key=rank)] if alike(x, y) else [x, y]
    return out + a[at + n :] + b[n:]


def rank_over(keys: Sequence[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
