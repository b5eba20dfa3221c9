"""Model responses: tolerant JSON, demultiplexed batches, nested entries.

Well-formed JSON stays in the JVM (``from_json``).  Only recovery from broken JSON runs
in Python, over Arrow batches, and only for responses that need it.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dedup
from ..session import ship_package

# The lines around a response's JSON, newer form first.
FRAMES = [
    ("------------------------PARSED CHUNKS------------------------", "------------------------End Of chunks------------------------"),
    ("------------------------PARSED LINES------------------------", "------------------------End Of lines------------------------"),
]
# The two lists of the split form and the kind each stands for.
LISTS = {"embedded_pairs": "embedded", "tablet_sentence_pairs": "tablet_sentence"}


def _body(text: str) -> str | None:
    for first, last in FRAMES:
        if first in text and last in text:
            found = text[text.index(first) + len(first) : text.index(last)].strip()
            break
    else:
        found = next((text[text.index(a) : text.rindex(b) + 1] for a, b in ("[]", "{}") if a in text and b in text[text.index(a) :]), None)
    return None if found is None else re.sub(r"^```(?:json)?\s*|\s*```\s*$", "", found)


def _leaves(text: str, depth: int):
    """Brace-balanced objects with at most ``depth`` levels inside, left to right."""
    at = 0
    while (start := text.find("{", at)) >= 0:
        level, deepest = 0, 0
        for end in range(start, len(text)):
            level += (text[end] == "{") - (text[end] == "}")
            deepest = max(deepest, level)
            if not level:
                break
        if level or deepest > depth:
            at = start + 1
            continue
        yield text[start : end + 1]
        at = end + 1


def _flat(value) -> list:
    if isinstance(value, dict) and LISTS.keys() & value.keys():
        out = []
        for name, kind in LISTS.items():
            for p in value.get(name) or []:
                lines = {"start_line": p.get("start_line", 0), "end_line": p.get("end_line", 0)} if kind == "embedded" else {}
                out.append({**p, **lines, "pair_type": kind})
        return out
    return value if isinstance(value, list) else [value]


def recover(text: str | None, required: tuple[str, ...], depth: int = 2) -> list:
    """Objects of a response: whole JSON, JSON with trailing text, or what single objects parse."""
    body = _body(text) if text else None
    if body is None:
        return []
    try:
        return _flat(json.JSONDecoder().raw_decode(body)[0])
    except ValueError:
        pass
    found = []
    for leaf in _leaves(body, depth):
        try:
            value = json.loads(leaf)
        except ValueError:
            continue
        if all(k in value for k in required):
            found.append(value)
    return found


def parse(responses: DataFrame, schema: str, required: tuple[str, ...], column: str = "response", depth: int = 2) -> DataFrame:
    """``responses`` with ``items``: an array of structs of ``schema``; unparsable ones have none."""
    ship_package(responses.sparkSession)
    kind = f"array<struct<{schema}>>"
    # What is one array, alone or in a frame or fence, is read here; the rest is recovered.
    fenced = r"(?:```(?:json)?\s*)?(\[.*\])(?:\s*```)?"
    whole = [rf"(?s)^\s*{fenced}\s*$", *[rf"(?s)^[^\[\{{]*\Q{a}\E\s*{fenced}\s*\Q{b}\E" for a, b in FRAMES]]
    text = F.col(column)
    direct = F.coalesce(*[F.from_json(F.regexp_extract(text, p, 1), kind, {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}) for p in whole])
    direct = F.when(F.forall(direct, lambda x: x.isNotNull()), direct)

    @F.pandas_udf(T.StringType())
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps([x for x in recover(t, required, depth) if isinstance(x, dict)], ensure_ascii=False))

    items = F.from_json(found(F.when(direct.isNull(), text)), kind)
    return responses.withColumn("items", F.coalesce(direct, items, F.array().cast(kind)))


def first_array(c: Column, schema: str) -> Column:
    """The widest JSON array of a text; null if it is none."""
    return F.from_json(F.regexp_extract(c, r"(?s)(\[.*\])", 1), f"array<struct<{schema}>>")


def distinct_attestations(entries: DataFrame) -> DataFrame:
    """The rows of ``attestations``, one for each source reference and beginning of text, the first in order."""
    rows = attestations(entries).withColumn("ord", F.struct("chunk", "entry_pos", "sense_pos", "pos"))
    return dedup.attestations(rows.withColumn("t", F.col("raw_transliteration"))).drop("ord", "t")


def demultiplex(parsed: DataFrame, expected: DataFrame, batch: str = "batch", key: str = "id") -> DataFrame:
    """Expected ids with their item, or null; the only id of a batch takes an item without one."""
    one = parsed.select(batch, F.explode("items").alias("item")).withColumn("_id", F.col(f"item.{key}"))
    alone = expected.groupBy(batch).agg(F.count("*").alias("_n"), F.min(key).alias("_only")).where("_n = 1")
    one = one.join(alone, batch, "left").withColumn("_id", F.coalesce("_id", "_only"))
    one = one.groupBy(batch, "_id").agg(F.first("item", ignorenulls=True).alias("item"))
    return expected.join(one.withColumnRenamed("_id", key), [batch, key], "left")


def valid_pairs(pairs: Column) -> Column:
    """Whether it is a list of which every element has both sides."""
    return F.coalesce(F.forall(pairs, lambda p: p["transliteration"].isNotNull() & p["translation"].isNotNull()), F.lit(False))


def attestations(entries: DataFrame) -> DataFrame:
    """One row an attestation of nested dictionary entries, in order."""
    one = entries.select("chunk", F.posexplode("entries").alias("entry_pos", "e"))
    two = one.select("chunk", "entry_pos", "e.headword", F.posexplode("e.senses").alias("sense_pos", "s"))
    three = two.select("chunk", "entry_pos", "headword", "sense_pos", "s.sense_id", "s.gloss", F.posexplode("s.oa_attestations").alias("pos", "a"))
    return three.select("chunk", "entry_pos", "sense_pos", "pos", "headword", "sense_id", "gloss", "a.*")


def count_attestations(entries: Column) -> Column:
    of = lambda e: F.aggregate(e["senses"], F.lit(0), lambda n, s: n + F.size(F.coalesce(s["oa_attestations"], F.array())))
    return F.aggregate(entries, F.lit(0), lambda n, e: n + F.coalesce(of(e), F.lit(0)))
