"""What prompts of drills and grammar exercises are made of: senses, examples, grammar rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws as R
from ..functions import text as X
from . import linkage

# Prefixes of ids that stand for the same document.
ID_PREFIXES = ("translated_", "augmented_", "EXTERNAL-")
PLANNED, EXAMPLES, RULE_CHARS, RULE_EXAMPLES = 16, 3, 500, 3


def with_senses(units: DataFrame, senses: DataFrame, plan: DataFrame, examples: DataFrame) -> DataFrame:
    """``units`` (headword, sense_id) with their sense, entry, number to generate and examples.

    The entry's own fields come from the first sense of the headword (by ``ord``); a unit
    that is not planned asks for PLANNED; a headword without examples has none.
    """
    entry = linkage.first_by(senses.select("headword", "ord", "pos", "entry_overview"), ["headword"], "ord").drop("ord")
    own = linkage.first_by(senses.select("headword", "sense_id", "ord", "gloss", "domain"), ["headword", "sense_id"], "ord").drop("ord")
    wanted = linkage.first_by(plan.select("headword", "sense_id", "n_to_generate", "ord"), ["headword", "sense_id"], "ord").drop("ord")
    told = linkage.first_by(examples.select("headword", "examples", "ord"), ["headword"], "ord").drop("ord")
    out = units.join(own, ["headword", "sense_id"]).join(entry, "headword").join(wanted, ["headword", "sense_id"], "left").join(told, "headword", "left")
    return out.withColumns({"n_to_generate": F.coalesce("n_to_generate", F.lit(PLANNED)), "pos": F.coalesce("pos", F.lit("")), "entry_overview": F.coalesce("entry_overview", F.lit(""))})


def contrastive(senses: DataFrame, k: int) -> DataFrame:
    """headword, sense_id, other, n: for each sense the k other ones of its headword with most attestations.

    Only the k + 1 best of a headword can be among them, so no headword's pairs are made.
    """
    rank = F.row_number().over(Window.partitionBy("headword").orderBy(F.desc("n_att"), "ord"))
    best = senses.withColumn("_r", rank).where(F.col("_r") <= k + 1).groupBy("headword")
    best = best.agg(F.sort_array(F.collect_list(F.struct("_r", F.col("sense_id").alias("other"), "n_att"))).alias("_best"))
    rows = senses.select("headword", "sense_id").join(best, "headword")
    others = F.slice(F.filter("_best", lambda x: x["other"] != F.col("sense_id")), 1, k)
    return rows.select("headword", "sense_id", F.inline(F.transform(others, lambda x, i: F.struct(x["other"].alias("other"), x["n_att"].alias("n_att"), (i + 1).alias("place")))))


def annotated(rows: DataFrame, words: DataFrame, key: str = "oare_id") -> DataFrame:
    """``rows`` with ``words``, the word annotations (line_num, word, gloss) of their document in order of lines."""
    held = words.groupBy(F.col(key).alias("_doc")).agg(F.sort_array(F.collect_list(F.struct("line_num", "ord", "word", "gloss"))).alias("words"))
    return rows.join(held, X.base_id(F.col(key), ID_PREFIXES) == F.col("_doc"), "left").drop("_doc")


def lines_with(lines: DataFrame, forms: DataFrame, n: int, seed: int) -> DataFrame:
    """form, id: n of the lines that contain a form, in hash order."""
    found = linkage.contains_form(lines, forms)
    order = R.order_key(seed, F.col("form"), F.col("id"))
    return found.withColumn("_o", order).withColumn("_r", F.row_number().over(Window.partitionBy("form").orderBy("_o", "id"))).where(F.col("_r") <= n).drop("_o", "_r")


def grammar(asked: DataFrame, index: DataFrame, rules: DataFrame, n: int, seed: int) -> DataFrame:
    """category, text: for each category asked n of its sections in hash order, as Markdown.

    ``index``: category, section, title, summary, ord; ``rules``: section, rule, examples
    (t, tr, grammar).  A category that the index has not says so.
    """
    entries = linkage.first_by(index, ["category", "section"], "ord").join(rules, "section", "left")
    shown = F.least(F.col("_all"), F.lit(n))
    example = lambda x: F.concat(F.lit("  "), x["t"], F.lit(" → "), x["tr"], F.lit(" ["), F.coalesce(x["grammar"], F.lit("")), F.lit("]\n"))
    some = F.slice(F.coalesce("examples", F.array().cast("array<struct<t:string,tr:string,grammar:string>>")), 1, RULE_EXAMPLES)
    told = F.when(F.size(some) > 0, F.concat(F.lit("Examples:\n"), F.array_join(F.transform(some, example), ""))).otherwise("")
    rule = F.substring(F.coalesce("rule", "summary", F.lit("")), 1, RULE_CHARS)
    part = F.concat(F.lit("### "), F.col("title"), F.lit("\n"), rule, F.lit("\n"), told, F.lit("\n"))
    order = R.order_key(seed, F.col("category"), F.col("section"))
    ranked = entries.withColumns({"_part": part, "_o": order}).withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy("_o", "section")))
    totals = entries.groupBy("category").agg(F.count("*").alias("_all"))
    parts = ranked.where(F.col("_r") <= n).groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_part"))), lambda x: x["_part"]), "").alias("_text"))
    out = asked.select("category").distinct().join(totals.join(parts, "category"), "category", "left")
    head = F.concat(F.lit("## Grammar: "), F.col("category"), F.lit(" ("), F.col("_all").cast("string"), F.lit(" rules, showing "), shown.cast("string"), F.lit(")\n\n"))
    return out.select("category", F.coalesce(F.concat(head, F.col("_text")), F.concat(F.lit("Unknown category '"), F.col("category"), F.lit("'."))).alias("text"))


def bullets(items: Column, line) -> Column:
    """An array as lines of a list; ``line`` makes the text of one element."""
    return F.array_join(F.transform(F.coalesce(items, F.array()), lambda x: F.concat(F.lit("- "), line(x))), "\n")


def drill_prompt(units: DataFrame, senses: DataFrame, k: int, chars: int, template: str) -> DataFrame:
    """headword, sense_id, prompt of ``with_senses`` rows that have ``raw_entry_text``; ``template`` has {name} places."""
    from .generation import prompt

    near = contrastive(senses, k).groupBy("headword", "sense_id").agg(F.sort_array(F.collect_list(F.struct("place", "other", "n_att"))).alias("_near"))
    rows = units.join(near, ["headword", "sense_id"], "left")
    raw = F.when(F.coalesce("raw_entry_text", F.lit("")).isin("", "N/A"), "").otherwise(X.excerpt(F.col("raw_entry_text"), chars, "\n[... truncated]"))
    near_list = bullets(F.coalesce("_near", F.array().cast("array<struct<place:int,other:string,n_att:int>>")), lambda x: F.concat(x["other"], F.lit(" ("), x["n_att"].cast("string"), F.lit(")")))
    made = prompt(template, headword=F.col("headword"), sense=F.col("sense_id"), gloss=F.col("gloss"), n=F.col("n_to_generate"), contrast=near_list, entry=raw)
    return rows.select("headword", "sense_id", made.alias("prompt"))


def grammar_prompt(seeds: DataFrame, words: DataFrame, rules: Column, template: str, key: str = "oare_id") -> DataFrame:
    """``seeds`` (key, t, tr, genre) with a prompt of their words' annotations and of grammar rules."""
    from .generation import prompt

    rows = annotated(seeds, words, key)
    listed = bullets(F.coalesce("words", F.array().cast("array<struct<line_num:double,ord:int,word:string,gloss:string>>")), lambda w: F.concat_ws(": ", w["word"], w["gloss"]))
    made = prompt(template, t=F.col("t"), tr=F.col("tr"), genre=F.coalesce("genre", F.lit("unknown")), words=listed, rules=rules)
    return rows.select(key, made.alias("prompt"))


def distinct_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: how many different values each column has."""
    return rows.agg(*[F.countDistinct(c).alias(c) for c in columns])
