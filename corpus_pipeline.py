"""The corpus pipeline: from ``documents`` to written token blocks.

Every stage works on all that its predecessor kept, and every stage but the last
returns the columns of ``documents``.  The mix is sized so that each source comes whole
at least once: it repeats small sources and loses no document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import decontaminate, language, minhash, mixing, token_blocks
from loomspark.llm.common import materialize, table
from loomspark.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word, or of which no language holds two fifths, go."""
    return language.reject(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought towards the target entropy by repeating small ones."""
    return mixing.mix(docs, "cover")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids are written in blocks and read back."""
    segments = token_blocks.write_segments(docs, tokenizer_path())
    return token_blocks.read_segments(segments, digest=True)


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_blocks", write_tokens),
]

#: Tokenisation and the language model are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
