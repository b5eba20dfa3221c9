"""Operators on training rows: lexicon variants, name swaps, preference prompts, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws as R
from ..functions import text as X

# Names of target languages.
LANGUAGES = {"en": "English", "translated_en": "English", "augmented_en": "English", "de": "German", "tr": "Turkish", "fr": "French"}
LABELS = ("A", "B", "EQUAL")


def merge_lexicon(entries: DataFrame) -> DataFrame:
    """t, variants: keys lower-cased, probabilities of equal variants added, the likeliest variant first."""
    one = entries.withColumn("t", F.lower("t")).groupBy("t", "tr").agg(F.sum("prob").alias("prob"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("prob")).alias("o"), "tr", "prob"))), lambda v: F.struct(v["tr"].alias("tr"), v["prob"].alias("prob")))
    return one.groupBy("t").agg(ordered.alias("variants"))


def target_tokens(tr: Column) -> Column:
    """Words of a target without signs at their end, and without any run of ``'`` and ``s`` there."""
    bare = lambda w: F.regexp_replace(F.regexp_replace(w, r"""[.,;:!?"']+$""", ""), "['s]+$", "")
    return F.transform(X.words(tr), bare)


def pick_variant(variants: Column, tr: Column | None = None) -> Column:
    """The first variant that is a token of the target; without a target the likeliest."""
    if tr is None:
        return F.array_max(F.transform(variants, lambda v: F.struct(v["prob"], v["tr"])))["tr"]
    return F.get(F.filter(variants, lambda v: F.array_contains(target_tokens(tr), v["tr"])), F.lit(0))["tr"]


def swap_names(rows: DataFrame, swaps: DataFrame, key: str = "id") -> DataFrame:
    """Each swap (key, pos, old_t, old_tr, new_t, new_tr) in order: all such source tokens, the first target token."""
    lists = swaps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "old_t", "old_tr", "new_t", "new_tr"))).alias("_s"))

    def step(a: Column, s: Column) -> Column:
        t = F.transform(a["t"], lambda w: F.when(F.lower(w) == F.lower(s["old_t"]), s["new_t"]).otherwise(w))
        first = F.array_position(a["tr"], s["old_tr"])
        tr = F.transform(a["tr"], lambda w, i: F.when(i + 1 == first, s["new_tr"]).otherwise(w))
        return F.when(first > 0, F.struct(t.alias("t"), tr.alias("tr"))).otherwise(a)

    none = F.array().cast("array<struct<pos:int,old_t:string,old_tr:string,new_t:string,new_tr:string>>")
    out = rows.join(lists, key, "left")
    start = F.struct(X.words(F.col("t")).alias("t"), X.words(F.col("tr")).alias("tr"))
    out = out.withColumn("_d", F.aggregate(F.coalesce("_s", none), start, step))
    return out.withColumns({"t": F.array_join("_d.t", " "), "tr": F.array_join("_d.tr", " ")}).select(rows.columns)


def gate(rows: DataFrame, share: float, seed: int, *keys: str) -> DataFrame:
    """``rows`` with ``chosen``: a reproducible draw of that share."""
    return rows.withColumn("chosen", R.uniform(seed, *[F.col(k) for k in keys]) < share)


def translate_prompt(t: Column, language: Column) -> Column:
    name = F.lit("English")
    for code, full in LANGUAGES.items():
        name = F.when(language == code, full).otherwise(name)
    return F.concat(F.lit("Translate Akkadian to "), name, F.lit(": "), t)


def one_hot(pick: Column) -> Column:
    return F.array(*[(pick == y).cast("double") for y in LABELS])


def preference_prompt(template: str, t: Column, a: Column, b: Column) -> Column:
    """A judge's prompt from a template with {transliteration}, {translation_a} and {translation_b}."""
    out = F.lit(template)
    for name, c in (("transliteration", t), ("translation_a", a), ("translation_b", b)):
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
    return out
