"""Record linkage: lookup cascades, shared-token candidates, fuzzy verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X


FORM_BLOCK = 10_000


def blocks(rows: DataFrame, size: int) -> list[DataFrame]:
    """A table in hash blocks of about ``size`` rows: what is sent at once does not grow with it."""
    n = max(1, -(-rows.count() // size))
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(n)) == k) for k in range(n)]


def last_by(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of each key, by a maximum that is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    top = F.max_by(F.struct(*rest), F.col(order)).alias("_r")
    return rows.groupBy(*key).agg(top).select(*key, "_r.*").select(rows.columns)


def first_by(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    top = F.min_by(F.struct(*rest), F.col(order)).alias("_r")
    return rows.groupBy(*key).agg(top).select(*key, "_r.*").select(rows.columns)


def cascade(rows: DataFrame, lookups: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """``rows`` with ``matched`` and ``method`` of the first lookup that has the key.

    A lookup is (method, key column of rows, DataFrame of key and matched), one row a key.
    """
    out, cols, hits = rows, rows.columns, []
    for k, (method, key, table) in enumerate(lookups):
        table = table.select(F.col("key").alias(f"_k{k}"), F.col("matched").alias(f"_m{k}"))
        out = out.join(table, F.col(key) == F.col(f"_k{k}"), "left")
        hits.append((f"_m{k}", method))
    label = None
    for m, method in hits:
        label = F.when(F.col(m).isNotNull(), method) if label is None else label.when(F.col(m).isNotNull(), method)
    return out.select(*cols, F.coalesce(*[F.col(m) for m, _ in hits]).alias("matched"), label.alias("method"))


def by_priority(ids: DataFrame, key: str, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Each id's text from the first source that has it; the first source wins even if its text is blank."""
    out = ids
    for k, (_, table) in enumerate(sources):
        table = table.select(F.col(key).alias(f"_k{k}"), F.col("text").alias(f"_t{k}"))
        out = out.join(table, F.col(key) == F.col(f"_k{k}"), "left")
    text, name = None, None
    for k, (source, _) in enumerate(sources):
        has = F.col(f"_k{k}").isNotNull() if k == 0 else ~X.blank(F.col(f"_t{k}"))
        got = F.coalesce(f"_t{k}", F.lit(""))
        text = F.when(has, got) if text is None else text.when(has, got)
        name = F.when(has, source) if name is None else name.when(has, source)
    return out.select(*ids.columns, text.alias("text"), name.alias("text_source"))


def candidates(queries: DataFrame, indexed: DataFrame, top_k: int = 20) -> DataFrame:
    """query_id, id, hits: for each query the texts that share most of its tokens.

    A query's token counts as often as it occurs in it.  Ties go to the smaller id.
    Postings are counted per query and token before they meet the index, and the count
    per pair is combined before it is shuffled.
    """
    asked = queries.select("query_id", F.explode(X.tokens(F.col("text"))).alias("token"))
    asked = asked.groupBy("query_id", "token").agg(F.count("*").alias("n"))
    held = indexed.select("id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))
    met = asked.join(held, "token").groupBy("query_id", "id").agg(F.sum("n").alias("hits"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "id"))
    return met.withColumn("_rank", rank).where(F.col("_rank") <= top_k).drop("_rank")


def fuzzy_match(queries: DataFrame, indexed: DataFrame, threshold: float = 75.0, top_k: int = 20) -> DataFrame:
    """query_id, id, score: the best candidate at or over the threshold; ties as in ``candidates``."""
    found = candidates(queries, indexed, top_k)
    found = found.join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    found = found.join(indexed.select("id", F.col("text").alias("_t")), "id")
    found = found.withColumn("score", S.indel_ratio(F.col("_q"), F.col("_t"))).where(F.col("score") >= threshold)
    best = F.max_by(F.struct("id", "score"), F.struct(F.col("score"), F.col("hits"), -F.col("id"))).alias("_b")
    return found.groupBy("query_id").agg(best).select("query_id", "_b.*")


def reassemble(parts: DataFrame, id_col: str = "part_id", text: str = "text") -> DataFrame:
    """id, text: the texts of ``<id>_part<n>`` rows in order of n."""
    n = F.coalesce(F.regexp_extract(id_col, r"_part(\d+)$", 1).try_cast("int"), F.lit(0))
    rows = parts.select(X.normalize(F.col(id_col), X.TABLET_ID).alias("id"), n.alias("n"), F.col(text).alias("t"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda p: p["t"]), " ")
    return rows.groupBy("id").agg(whole.alias("text"))


def match_tablets(tablets: DataFrame, lookups, indexed: DataFrame, min_chars: int = 30, **kw) -> DataFrame:
    """Identifiers first; only what they leave open and is long enough is matched by its text."""
    known = cascade(tablets, lookups)
    left = known.where(F.col("matched").isNull() & (F.char_length("text") > min_chars))
    fuzzy = fuzzy_match(left.select(F.col("id").alias("query_id"), "text"), indexed, **kw)
    fuzzy = fuzzy.select(F.col("query_id").alias("_q"), F.col("id").alias("_id"), F.col("score").alias("_score"))
    out = known.join(fuzzy, F.col("id") == F.col("_q"), "left")
    label = F.coalesce("method", F.when(F.col("_id").isNotNull(), F.concat(F.lit("fuzzy_"), F.round("_score", 1).cast("string"))))
    return out.select(*tablets.columns, F.coalesce("matched", "_id").alias("matched"), label.alias("method"))


def with_any(ids: DataFrame, key: str, sources: Sequence[DataFrame]) -> DataFrame:
    """The ids that occur in one of the sources."""
    have = sources[0].select(key)
    for s in sources[1:]:
        have = have.unionByName(s.select(key))
    return ids.join(have.distinct(), key, "left_semi").select(ids.columns)


def expert_union(train: DataFrame, sentences: DataFrame, key: str, order: str) -> DataFrame:
    """All training rows, and the first sentence row of each id that is not among them."""
    extra = first_by(sentences.join(train.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti"), [key], order)
    return train.unionByName(extra, allowMissingColumns=True)


def apply_repairs(rows: DataFrame, fixes: DataFrame, key: str, text: str = "tr") -> DataFrame:
    """Find/replace repairs in order; each only where it occurs exactly once in the text so far.

    Adds ``corrected``, ``edits`` and ``warnings``.
    """
    steps = fixes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "find", "replace"))).alias("_fixes"))
    out = rows.join(steps, key, "left")

    def step(a: Column, f: Column) -> Column:
        times = F.try_divide(F.char_length(a["text"]) - F.char_length(F.replace(a["text"], f["find"], F.lit(""))), F.char_length(f["find"]))
        once = F.coalesce(times == 1, F.lit(False))
        return F.struct(
            F.when(once, F.replace(a["text"], f["find"], f["replace"])).otherwise(a["text"]).alias("text"),
            (a["edits"] + once.cast("int")).alias("edits"),
            (a["warnings"] + (~once).cast("int")).alias("warnings"),
        )

    start = F.struct(F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(0).alias("edits"), F.lit(0).alias("warnings"))
    none = F.array().cast("array<struct<ord:int,find:string,replace:string>>")
    out = out.withColumn("_done", F.aggregate(F.coalesce(F.col("_fixes"), none), start, step))
    return out.select(*rows.columns, F.col("_done.text").alias("corrected"), F.col("_done.edits").alias("edits"), F.col("_done.warnings").alias("warnings"))


def probe_lexicon(lines: DataFrame, lexicon: DataFrame, key: str = "id") -> DataFrame:
    """id, pos, token, entry: each token's lexicon entry, without the enclitic ``-ma`` where only that is known."""
    rows = lines.select(key, F.posexplode(X.words(F.col("text"))).alias("pos", "token"))
    low = F.lower("token")
    bare = F.when((F.char_length("token") > 6) & low.endswith("-ma"), F.substr(low, F.lit(1), F.char_length("token") - 3))
    rows = rows.withColumns({"_a": low, "_b": bare})
    a, b = lexicon.select(F.col("t").alias("_a"), F.col("entry").alias("_x")), lexicon.select(F.col("t").alias("_b"), F.col("entry").alias("_y"))
    out = rows.join(a, "_a", "left").join(b, "_b", "left")
    return out.select(key, "pos", "token", F.coalesce("_x", "_y").alias("entry")).where("entry is not null")


def contains_form(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """form, id: lines that contain the form, the form's own sign of end included.

    Containment has no key to join on: forms, a stated query set, meet all lines in blocks of FORM_BLOCK.
    """
    hit = F.contains(F.concat(F.lower("text"), F.lit(" ")), F.concat(F.lower("form"), F.lit(" ")))
    found = None
    for part in blocks(forms.select("form"), FORM_BLOCK):
        got = lines.join(F.broadcast(part), hit).select("form", "id")
        found = got if found is None else found.unionByName(got)
    return found


def has_token(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """form, id: lines with the form as a token, punctuation and marks folded."""
    fold = lambda c: F.lower(S.strip_marks(c))
    rows = lines.withColumn("_f", fold(F.col("text"))).select("id", F.explode(F.array_distinct(X.words(F.regexp_replace("_f", r"[.,;:?!()\[\]]", "")))).alias("_t"))
    return rows.join(forms.withColumn("_t", fold(F.col("form"))), "_t").select("form", "id")


def best_by_agreement(options: DataFrame, utility: Column, group: str = "group_id") -> DataFrame:
    """For each group the option of highest mean utility against all others, the first on a tie.

    ``utility`` is over columns ``text`` and ``other``.  Options are a model's few
    samples for one input; a group of one has utility 0.
    """
    other = options.select(F.col(group).alias("_g"), F.col("option").alias("_o"), F.col("text").alias("other"))
    met = options.join(other, (F.col(group) == F.col("_g")) & (F.col("option") != F.col("_o")), "left")
    score = F.coalesce(F.avg(F.when(F.col("_o").isNotNull(), utility)), F.lit(0.0)).alias("score")
    scored = met.groupBy(group, "option").agg(score)
    best = F.max_by(F.struct("option", "score"), F.struct(F.col("score"), -F.col("option"))).alias("_b")
    return scored.groupBy(group).agg(best).select(group, "_b.*")


def map_ids(rows: DataFrame, mapping: DataFrame, holdout: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with ``mapped``, their id in another corpus (``mapping``: id, mapped); those whose mapped id is held out go.

    A row without a mapping stays, with its own id.
    """
    one = mapping.groupBy(F.col(key).alias("_m")).agg(F.min("mapped").alias("mapped"))
    out = rows.join(one, F.col(key) == F.col("_m"), "left").drop("_m").withColumn("mapped", F.coalesce("mapped", F.col(key)))
    return out.join(holdout.select(F.col(key).alias("mapped")).where("mapped is not null").distinct(), "mapped", "left_anti").select(*rows.columns, "mapped")


def merge_predictions(rows: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("oare_id", "sentence_id"), suffixes: tuple[str, str] = ("", "_pred")) -> DataFrame:
    """``rows`` with the columns of their prediction, or nulls; columns that both have get the suffixes."""
    both = {c for c in rows.columns if c in predictions.columns} - set(keys)
    named = lambda frame, end: frame.select([F.col(c).alias(c + end if c in both else c) for c in frame.columns])
    return named(rows, suffixes[0]).join(named(predictions, suffixes[1]), list(keys), "left")
