"""Files: JSON lines, CSV, id lists, checkpoints, templates; reading and writing."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.linkage import last_by


def jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """JSON lines with a declared schema: absent fields are null, blank lines nothing."""
    return spark.read.schema(schema).json(path)


def optional_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """As ``jsonl``; a path that does not exist is an empty table."""
    try:
        return jsonl(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def tagged_jsonl(spark: SparkSession, paths: dict[str, str], schema: StructType | str) -> DataFrame:
    """Several files, each row with the tag of its file; files of one name in several folders are told apart."""
    tagged = [optional_jsonl(spark, path, schema).withColumn("mode", F.lit(name)) for name, path in paths.items()]
    return reduce(DataFrame.unionByName, tagged)


def quality_by_mode(rows: DataFrame, quality: str = "match_quality") -> DataFrame:
    """mode, quality, n of a tagged scan."""
    return rows.groupBy("mode", quality).agg(F.count("*").alias("n"))


def labelled_jsonl(spark: SparkSession, path: str, label: str, schema: StructType | str) -> DataFrame:
    """One file under one tag."""
    return tagged_jsonl(spark, {label: path}, schema)


def dictionary_pairs(spark: SparkSession, path: str, t: str = "mt_transliteration", tr: str = "mt_translation") -> DataFrame:
    """Pairs (t, tr) of a dictionary's rows, both sides trimmed; rows without one are left out."""
    side = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = optional_jsonl(spark, path, f"`{t}` string, `{tr}` string")
    return rows.select(side(t).alias("t"), side(tr).alias("tr")).where("t <> '' and tr <> ''")


def key_values(spark: SparkSession, path: str, key: str = "oare_id", value: str = "translation") -> DataFrame:
    """key, value of a CSV file: of rows that repeat a key the last in the file."""
    rows = csv(spark, path).select(F.col(key).alias("key"), F.col(value).alias("value"), F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("_at"))
    return last_by(rows.where("key is not null"), ["key"], "_at").select("key", "value")


def resumable(spark: SparkSession, path: str, schema: StructType | str, key: str = "batch_index") -> tuple[DataFrame, DataFrame]:
    """(rows, done keys) of a run so far; a file with a broken line counts as none, so that the run starts over."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = optional_jsonl(spark, path, StructType([*kind.fields, StructField("_corrupt_record", StringType())]))
    names = [f.name for f in kind.fields]
    broken = found.agg(F.sum(F.col("_corrupt_record").isNotNull().cast("int")), F.count(names[0])).first()[0]
    rows = spark.createDataFrame([], kind) if broken else found.select(names)
    return rows, rows.select(key).where(F.col(key).isNotNull()).distinct()


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line: trimmed, distinct, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id != ''").distinct()


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; every value is a string, as quoted and as long as it is."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def published_lookups(texts: DataFrame, order: str) -> dict[str, DataFrame]:
    """Lookups (key, matched) by alias, museum number - the first parenthesis of the label - and excavation number."""
    keys = {
        "alias": F.trim("aliases"), "museum_no": F.trim(F.regexp_extract("label", r"\(([^)]+)\)", 1)), "excavation_no": F.trim("excavation_no"),
    }
    return {
        name: last_by(texts.select(k.alias("key"), F.col("oare_id").alias("matched"), order).where("key != ''"), ["key"], order).drop(order)
        for name, k in keys.items()
    }


def grouped_sentences(rows: DataFrame, key: str, order: str, text: str = "translation") -> DataFrame:
    """key, sentences: non-blank texts in order."""
    held = rows.where(F.col(text).rlike(r"(?U)\S")).groupBy(key)
    return held.agg(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("sentences"))


def checkpoint(spark: SparkSession, path: str, schema: StructType | str, key: str = "chunk", order: str = "timestamp") -> DataFrame:
    """An append-only checkpoint: the last entry of each key."""
    return last_by(optional_jsonl(spark, path, schema), [key], order)


def append_checkpoint(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_sorted(rows: DataFrame, path: str, order: str) -> None:
    """Sorted output in range partitions: file after file in order, no single task."""
    rows.repartitionByRange(order).sortWithinPartitions(order).write.json(path)


def templates(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All template files of a folder, with the name of their file to sort by."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("header", True).option("escape", "\"").csv(path)
