"""Predicates, filters with reasons, shards and resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Publication abbreviations that a volume number follows.
PUBLICATIONS = "BIN CCT KTS KTH KTB ICK AKT TC ATHE OIP VS HUCA JCS AfO RA JAOS PBS YOS AASOR TTC EL".split()
# Beginnings of names translated word by word.
NAME_GLOSSES = r"(His-|My-|God-|The-god|The-God|\(the god)"
# Formulaic translations.
FORMULAIC = [r"^Seal of ", r"^Witness", r"^(From |To |Say to |Thus )", r"(eponym|Eponym)", r"<gap>.*<gap>.*<gap>"]
# Beginnings of finite verbs, and tokens that only look like one.
VERB_PREFIXES = ["i-", "ta-", "a-", "ni-", "u-", "tu-", "nu-", "li-", "lu-"]
NO_VERBS = ["a-šùr", "a-šur", "a-sur", "a-lim", "a-bi", "a-hi", "a-ha"]
# Letters that only texts of another language have.
FOREIGN = "ğĞşŞıİçÇöÖüÜ"


def usable(pairs: DataFrame, qualities: tuple[str, ...] = ("high",), source: str = "t", target: str = "tr") -> DataFrame:
    """Pairs of these qualities with both sides present."""
    keep = F.lower(F.coalesce("quality", F.lit(""))).isin(*qualities)
    return pairs.where(keep & ~X.blank(F.col(source)) & ~X.blank(F.col(target)))


def explode_pairs(records: DataFrame, pairs: str = "sentence_pairs") -> DataFrame:
    """One row a sentence pair with its position; records without pairs vanish."""
    return records.select("*", F.posexplode(pairs).alias("pos", "_p")).select(*[c for c in records.columns if c != pairs], "pos", "_p.*")


def is_repetitive(c: Column, threshold: int = 4) -> Column:
    return F.coalesce(c.rlike(rf"(\.\.\. ){{{threshold},}}"), F.lit(False))


def extracted_lines(lines: DataFrame, drop_foreign: bool = False) -> DataFrame:
    """Lines with both sides, not of low quality and without MISSING on either side."""
    ok = ~X.blank(F.col("t")) & ~X.blank(F.col("tr")) & (F.coalesce("quality", F.lit("")) != "low")
    ok &= ~F.col("t").contains("MISSING") & ~F.col("tr").contains("MISSING")
    if drop_foreign:
        ok &= ~F.col("t").rlike(f"[{FOREIGN}]") & ~F.col("tr").rlike(f"[{FOREIGN}]")
    return lines.where(ok)


def is_citation(c: Column) -> Column:
    return c.rlike(rf"\b({'|'.join(PUBLICATIONS)})\s+\d")


def is_name_gloss(c: Column) -> Column:
    return c.rlike(NAME_GLOSSES)


def is_echo(t: Column, tr: Column, share: float = 0.8) -> Column:
    """More than ``share`` of the translation's signs are signs of the source."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9 ]", "")
    # Bound once in a struct: the source must not be normalised again for every sign.
    both = F.array(F.struct(plain(t).alias("a"), plain(tr).alias("b")))

    def echo(x: Column) -> Column:
        met = F.size(F.filter(F.split(x["b"], ""), lambda ch: (ch != "") & F.contains(x["a"], ch)))
        return (x["a"] != "") & (x["b"] != "") & (met > F.char_length(x["b"]) * share)

    return F.get(F.transform(both, echo), F.lit(0))


def reasons(pairs: DataFrame, min_words: int = 4, include_medium: bool = False) -> DataFrame:
    """``pairs`` with both sides normalised and the first reason to drop each, or ``kept``."""
    t, tr = (X.normalize(F.col(c), r) for c, r in (("t", X.DICTIONARY_SOURCE), ("tr", X.DICTIONARY_TARGET)))
    out = pairs.withColumns({"norm_t": t, "norm_tr": tr})
    good = ("high", "medium") if include_medium else ("high",)
    lacks = lambda c: X.blank(F.col(c)) | (F.col(c) == "N/A")
    reason = (
        F.when(~F.coalesce("quality", F.lit("")).isin(*good), "quality")
        .when(lacks("t") | lacks("tr"), "empty")
        .when(X.blank(F.col("norm_t")) | X.blank(F.col("norm_tr")), "empty_normalized")
        .when(is_citation(F.col("norm_tr")), "citation")
        .when(is_name_gloss(F.col("norm_tr")), "etymological")
        .when(F.size(X.words(F.col("norm_tr"))) < min_words, "short")
        .when(is_echo(F.col("norm_t"), F.col("norm_tr")), "echo")
        .otherwise("kept")
    )
    return out.withColumn("reason", reason)


def length_ratio(pairs: DataFrame, low: float = 0.3, high: float = 2.0) -> DataFrame:
    """Few-shot pool: high quality, target length within bounds of the source's."""
    share = F.try_divide(F.char_length("tr"), F.char_length("t"))
    return pairs.where((F.col("quality") == "high") & share.between(low, high))


def has_verb(c: Column) -> Column:
    def verb(w: Column) -> Column:
        starts = F.lit(False)
        for p in VERB_PREFIXES:
            starts |= w.startswith(p)
        return starts & ~w.isin(*NO_VERBS) & ~w.startswith("i-na") & ~w.startswith("a-na")

    return F.exists(X.words(F.lower(c)), verb)


def not_formulaic(pairs: DataFrame, require_verb: bool = False, shortest: int = 20, longest: int = 200) -> DataFrame:
    """Pairs that make useful seeds; a null target is not formulaic, a null source is kept too."""
    out = F.lit(False)
    for p in FORMULAIC:
        out |= F.coalesce(F.col("tr").rlike(p), F.lit(False))
    n = F.char_length("t")
    out |= F.coalesce((n < shortest) | (n > longest), F.lit(False))
    if require_verb:
        out |= ~F.coalesce(has_verb(F.col("t")), F.lit(False))
    return pairs.where(~out)


def of_language(rows: DataFrame, language: str) -> DataFrame:
    if language == "all":
        return rows
    return rows.where(F.col("language").isin(*(["en", "translated_en"] if language == "en_all" else [language])))


def keep_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi").select(rows.columns)


def drop_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows without an id stay."""
    return rows.join(ids.select(key).distinct(), key, "left_anti").select(rows.columns)


def holdout_rows(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The held-out records, with the corrected translation where there is one."""
    return keep_ids(rows, ids, key).withColumn("tr", X.present(F.col("corrected"), F.col("tr")))


def index_range(rows: DataFrame, start: int, end: int | None, index: str = "batch_index") -> DataFrame:
    out = rows.where(F.col(index) >= start)
    return out if end is None else out.where(F.col(index) < end)


def shard(rows: DataFrame, n: int, k: int, index: str = "batch_index") -> DataFrame:
    """Every n-th row of a dense index."""
    return rows.where(F.pmod(F.col(index), F.lit(n)) == k)


def undone(rows: DataFrame, done: DataFrame, fill_gaps: bool = True, index: str = "batch_index") -> DataFrame:
    """What is left to do: all that is not done, or only what follows the last done."""
    if fill_gaps:
        return rows.join(done.select(index).distinct(), index, "left_anti").select(rows.columns)
    last = done.agg(F.coalesce(F.max(index), F.lit(-1)).alias("_last"))  # one row
    return rows.join(F.broadcast(last), F.col(index) > F.col("_last")).select(rows.columns)


def gaps(done: DataFrame, index: str = "batch_index") -> DataFrame:
    """Indices under the last done one that are not done, from each done one and its predecessor."""
    ends = done.select(F.col(index).alias("b")).where("b >= 0").distinct()
    # Blocks of the index keep the search for the previous one out of a single task.
    block = 1 << 20
    last = ends.groupBy(F.floor(F.col("b") / block).alias("k")).agg(F.collect_set("b").alias("done"), F.max("b").alias("top"))
    whole = last.agg(F.max("k").alias("top_k"), F.max("top").alias("end"))
    every = whole.where("end is not null").select(F.explode(F.sequence(F.lit(0), "top_k")).alias("k"), "end")
    have = every.join(last, "k", "left")
    want = F.sequence(F.col("k") * block, F.least((F.col("k") + 1) * block - 1, F.col("end")))
    missing = F.array_except(want, F.coalesce("done", F.array().cast("array<bigint>")))
    return have.select(F.explode(missing).alias(index))


def polysemous(senses: DataFrame, key: str = "headword", sense: str = "sense_id") -> DataFrame:
    several = senses.groupBy(key).agg(F.count_distinct(sense).alias("_n")).where("_n > 1").select(key)
    return senses.join(several, key, "left_semi").select(senses.columns)


def name_pool(names: DataFrame) -> DataFrame:
    """Names of three signs and more, without rows where only one side has a gap, without marks of sort."""
    mark = lambda c: F.regexp_replace(c, r"\{[^}]*\}", "")
    one_sided = F.col("t").contains("<gap>") != F.col("tr").contains("<gap>")
    return names.where((F.char_length("t") >= 3) & ~one_sided).withColumn("t", mark(F.col("t")))


def lexicon_keys(lexicon: DataFrame, key: str = "t") -> DataFrame:
    return lexicon.where((F.char_length(key) > 5) & ~F.col(key).startswith("-"))


def of_files(rows: DataFrame, file: str, part: str | None = None, stems: tuple[str, ...] = ()) -> DataFrame:
    """Rows of files whose name contains ``part``, or whose stem is listed."""
    stem = F.regexp_replace(F.element_at(F.split(F.col(file), "/"), -1), r"\.[^.]*$", "")
    out = rows if part is None else rows.where(F.col(file).contains(part))
    return out.where(stem.isin(*stems)) if stems else out


def by_prefix(c: Column, prefixes: dict[str, str], default: str) -> Column:
    """What the first matching prefix of a name stands for: a language, a prompt."""
    out = F.lit(default)
    for p, value in reversed(prefixes.items()):
        out = F.when(c.startswith(p), value).otherwise(out)
    return out
