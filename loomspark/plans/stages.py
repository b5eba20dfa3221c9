"""The whole curation as stages over tables: from raw records of each source to training sets.

Each stage is a function of DataFrames; ``run`` chains them and writes each one's result, so
that a stage that is there already is read instead of made again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assembly, dedup, filters, linkage, segments

Tables = dict[str, DataFrame]


def repair(expert: DataFrame, fixes: DataFrame, key: str = "id") -> DataFrame:
    """Expert records with their find/replace repairs applied to the target."""
    out = linkage.apply_repairs(expert, fixes, key)
    return out.withColumn("tr", F.col("corrected")).select(expert.columns)


def validate(records: DataFrame, parts: DataFrame, key: str = "id") -> DataFrame:
    """The parts of those records whose parts, joined, give both sides back."""
    good = segments.round_trip(records, parts, ("t", "tr"), key).where("valid").select(key)
    return parts.join(good, key, "left_semi").select(parts.columns)


def lines_of(sources: Tables) -> DataFrame:
    """source, priority, doc, pos, t, tr, segment of all usable lines; segments end at low-quality ones."""
    every = assembly.tagged({name: d.select("id", "pos", "t", "tr", "quality") for name, d in sources.items()})
    every = every.withColumn("doc", F.concat_ws("/", "source", F.col("id").cast("string")))
    usable = segments.split_at_low(every, "doc", "pos").where(~filters.is_repetitive(F.col("t")) & ~filters.is_repetitive(F.col("tr")))
    return usable.select("source", "priority", "id", "doc", "pos", "t", "tr", "segment")


def windows_of(lines: DataFrame, copies: dict[str, int], seed: int, max_bytes: int) -> DataFrame:
    """Differently merged windows of each segment, as many copies as its source has."""
    n = F.lit(0)
    for source, k in copies.items():
        n = F.when(F.col("source") == source, k).otherwise(n)
    keyed = lines.withColumn("key", F.concat_ws("#", "doc", F.col("segment").cast("string")))
    held = segments.ordered_lines(keyed, "key", "pos").join(keyed.select("key", "source", "priority", "id").distinct(), "key")
    rows = held.withColumn("_n", n).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("segment", F.lit(0))
    rows = segments.merge_windows(rows, seed, max_bytes, F.col("copy"), "key")
    return rows.select("source", "priority", "id", "key", "copy", F.posexplode("merged").alias("window", "_m")).select("source", "priority", "id", "key", "copy", "window", "_m.*")


def assemble(sources: Tables, holdout: DataFrame, seed: int, max_bytes: int, copies: dict[str, int] = assembly.COPIES, normalized: bool = True) -> Tables:
    """``train``, ``valid`` (source, id, t, tr, n_lines) and ``statistics`` from pairs (id, pos, t, tr, quality) of each source.

    Lines and merged windows; sides normalised and blank ones dropped; of equal pairs the
    first by source, lines before windows; documents of ``holdout`` (source, id) are valid.
    """
    lines = lines_of(sources)
    single = lines.select("source", "priority", "id", "t", "tr", F.lit(1).alias("n_lines"), F.struct("priority", F.lit(0).alias("w"), F.concat_ws("#", "doc", F.col("segment").cast("string")).alias("key"), F.lit(0).alias("copy"), F.col("pos").cast("int").alias("at")).alias("ord"))
    many = windows_of(lines, copies, seed, max_bytes)
    many = many.select("source", "priority", "id", "t", "tr", "n_lines", F.struct("priority", F.lit(1).alias("w"), "key", "copy", F.col("window").cast("int").alias("at")).alias("ord"))
    rows = single.unionByName(many)
    if normalized:
        rows = rows.withColumns({"t": X.normalize_source(F.col("t")), "tr": X.normalize_target(F.col("tr"))})
    rows = rows.where(~X.blank(F.col("t")) & ~X.blank(F.col("tr")))
    rows = dedup.unique_pairs(rows, "ord").select("source", "id", "t", "tr", "n_lines")
    held = holdout.select("source", "id").distinct()
    valid, train = rows.join(held, ["source", "id"], "left_semi").select(rows.columns), rows.join(held, ["source", "id"], "left_anti").select(rows.columns)
    both = train.withColumn("valid", F.lit(False)).unionByName(valid.withColumn("valid", F.lit(True)))
    return {"train": train, "valid": valid, "statistics": statistics(both)}


def statistics(rows: DataFrame) -> DataFrame:
    """source, valid: pairs, lines in them, least, greatest and mean length of both sides, different documents."""
    out = [F.count("*").alias("n"), F.sum("n_lines").alias("lines"), F.countDistinct("id").alias("documents")]
    for c in ("t", "tr"):
        n = F.char_length(c)
        out += [F.min(n).alias(f"min_{c}"), F.max(n).alias(f"max_{c}"), F.sum(n).alias(f"sum_{c}"), F.avg(n).alias(f"mean_{c}")]
    return rows.groupBy("source", "valid").agg(*out)


def run(spark: SparkSession, folder: str, stages: list[tuple[str, Callable[[Tables], DataFrame]]], tables: Tables, redo: bool = False) -> Tables:
    """``tables`` with each stage's result under its name, written to ``folder`` as Parquet.

    A stage sees what those before it have written.  With ``redo`` nothing found there is used.
    """
    tables = dict(tables)
    for name, stage in stages:
        path = f"{folder}/{name}"
        if redo or not _there(spark, path):
            stage(tables).write.mode("overwrite").parquet(path)
        tables[name] = spark.read.parquet(path)
    return tables


def _there(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def curation(seed: int, max_bytes: int) -> list[tuple[str, Callable[[Tables], DataFrame]]]:
    """Seven stages over the tables expert, fixes, splits, extracted, dictionary, articles, published, lookups, responses and holdout.

    Expert repair, split and dedup; extracted pairs, best chunk of each tablet; dictionary
    pairs normalised and filtered; articles' pairs; published texts by their identifiers;
    synthetic pairs that repeat no expert one; the training set.
    """

    def expert(t: Tables) -> DataFrame:
        parts = validate(repair(t["expert"], t["fixes"]), t["splits"])
        return dedup.unique_pairs(parts.withColumn("ord", F.struct("id", "pos")), "ord").drop("ord")

    def extracted(t: Tables) -> DataFrame:
        return filters.extracted_lines(dedup.best_chunk(dedup.within_chunk(t["extracted"]))).withColumn("pos", F.col("ord"))

    def dictionary(t: Tables) -> DataFrame:
        kept = filters.reasons(t["dictionary"], include_medium=True).where("reason = 'kept'")
        return kept.withColumns({"t": F.col("norm_t"), "tr": F.col("norm_tr")})

    def articles(t: Tables) -> DataFrame:
        return filters.extracted_lines(t["articles"], drop_foreign=True)

    def published(t: Tables) -> DataFrame:
        lookups = [(m, m, t["lookups"].where(F.col("method") == m).select("key", "matched")) for m in ("alias", "museum_no", "excavation_no")]
        return linkage.cascade(t["published"], lookups).where("matched is not null").withColumn("id", F.col("matched"))

    def synthetic(t: Tables) -> DataFrame:
        keys = t["expert_pairs"].select(X.rough_key(F.col("t")).alias("key")).distinct()
        new = t["responses"].withColumn("key", X.rough_key(F.col("t")))
        return new.join(keys, "key", "left_anti").drop("key")

    def training(t: Tables) -> DataFrame:
        names = {"expert": "expert_pairs", "akt": "extracted_pairs", "cad": "dictionary_pairs", "michel": "article_pairs", "hecker": "published_pairs", "synthetic": "synthetic_pairs"}
        made = assemble({s: t[name].select(F.col("id").cast("string").alias("id"), F.col("pos").cast("int").alias("pos"), "t", "tr", "quality") for s, name in names.items()}, t["holdout"], seed, max_bytes)
        return made["train"].withColumn("valid", F.lit(False)).unionByName(made["valid"].withColumn("valid", F.lit(True)))

    return [
        ("expert_pairs", expert), ("extracted_pairs", extracted), ("dictionary_pairs", dictionary), ("article_pairs", articles),
        ("published_pairs", published), ("synthetic_pairs", synthetic), ("training", training),
    ]
