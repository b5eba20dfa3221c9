"""Queries over the driver's tables, one or more for each operator, with SQL that checks them.

Conversations stand for tablets: a user turn and the assistant turn after it are the two
sides of a pair, its quality a function of its numbers.  Documents are records, the
benchmark an exclusion set, pages scraped markup, events and orders generic rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws as R
from ..functions import rules
from ..functions import similarity as S
from ..functions import text as X
from ..operators import assembly, dedup, drills, evaluation, filters, generation, linkage, nearest, pools, segments, slots, training
from ..sources import markup, responses
from ..streaming import resume
from . import fixtures, oracles, stages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_QUALITY = "CASE (conv_id * 7 + turn) % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN '' ELSE 'high' END"
_PAIRS = f"""pairs AS (SELECT u.conv_id, u.turn, u.text AS t, a.text AS tr, {_QUALITY.replace("conv_id", "u.conv_id").replace("turn", "u.turn")} AS quality
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("t"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tr"))
    return users.join(answers, ["conv_id", "turn"]).withColumn("quality", F.expr(_QUALITY))


# -- filters ---------------------------------------------------------------------


@query("quality_histogram", f"WITH {_PAIRS} SELECT quality, count(*) AS n FROM pairs GROUP BY quality")
def _(spark, d):
    return assembly.distribution(pairs(spark, d), "quality")


@query("usable_pairs", f"WITH {_PAIRS} SELECT conv_id, turn, quality FROM pairs WHERE quality IN ('high', 'medium') AND trim(t) <> '' AND trim(tr) <> ''")
def _(spark, d):
    return filters.usable(pairs(spark, d), ("high", "medium")).select("conv_id", "turn", "quality")


@query("extracted_lines", f"""WITH {_PAIRS} SELECT conv_id, turn FROM pairs WHERE quality <> 'low' AND trim(t) <> '' AND trim(tr) <> ''
  AND NOT contains(t, 'MISSING') AND NOT contains(tr, 'MISSING') AND NOT regexp_matches(t || tr, '[ğĞşŞıİçÇöÖüÜ]')""")  # fmt: skip
def _(spark, d):
    return filters.extracted_lines(pairs(spark, d), drop_foreign=True).select("conv_id", "turn")


_N_T, _N_TR = rules.to_sql("t", X.DICTIONARY_SOURCE), rules.to_sql("tr", X.DICTIONARY_TARGET)


@query("filter_reasons", rf"""WITH {_PAIRS}, n AS (SELECT *, {_N_T} AS nt, {_N_TR} AS ntr FROM pairs),
e AS (SELECT *, regexp_replace(lower(nt), '[^a-z0-9 ]', '', 'g') AS a, regexp_replace(lower(ntr), '[^a-z0-9 ]', '', 'g') AS b FROM n),
r AS (SELECT *, CASE WHEN quality NOT IN ('high', 'medium') THEN 'quality' WHEN trim(t) IN ('', 'N/A') OR trim(tr) IN ('', 'N/A') THEN 'empty'
  WHEN nt = '' OR ntr = '' THEN 'empty_normalized' WHEN regexp_matches(ntr, '\b({"|".join(filters.PUBLICATIONS)})\s+\d') THEN 'citation'
  WHEN regexp_matches(ntr, '{filters.NAME_GLOSSES}') THEN 'etymological' WHEN len(string_split_regex(ntr, '\s+')) < 4 THEN 'short'
  WHEN a <> '' AND b <> '' AND len(list_filter(string_split(b, ''), lambda c: contains(a, c))) > 0.8 * length(b) THEN 'echo' ELSE 'kept' END AS reason FROM e)
SELECT conv_id, turn, reason, nt AS norm_t, ntr AS norm_tr FROM r""")  # fmt: skip
def _(spark, d):
    return filters.reasons(pairs(spark, d), include_medium=True).select("conv_id", "turn", "reason", "norm_t", "norm_tr")


@query("length_ratio", f"WITH {_PAIRS} SELECT conv_id, turn FROM pairs WHERE quality = 'high' AND length(tr) / nullif(length(t), 0) BETWEEN 0.3 AND 2.0")
def _(spark, d):
    return filters.length_ratio(pairs(spark, d)).select("conv_id", "turn")


@query("not_formulaic", f"""WITH {_PAIRS} SELECT conv_id, turn FROM pairs WHERE NOT regexp_matches(tr, '^Seal of |^Witness|^(From |To |Say to |Thus )|eponym|Eponym|<gap>.*<gap>.*<gap>')
  AND length(t) BETWEEN 20 AND 200""")  # fmt: skip
def _(spark, d):
    return filters.not_formulaic(pairs(spark, d)).select("conv_id", "turn")


@query("text_flags", r"""SELECT doc_id, regexp_matches(text, '(\.\.\. ){4,}') AS repetitive, regexp_matches(text, '(His-|My-|God-|The-god|The-God|\(the god)') AS gloss,
  len(list_filter(string_split_regex(lower(text), '[\s\-=/:]+'), lambda w: length(w) > 1)) AS n_tokens FROM documents""")  # fmt: skip
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", filters.is_repetitive(F.col("text")).alias("repetitive"), filters.is_name_gloss(F.col("text")).alias("gloss"), F.size(X.tokens(F.col("text"))).alias("n_tokens"))


@query("keep_and_drop_ids", """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")  # fmt: skip
def _(spark, d):
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    kept = filters.keep_ids(orders, customers.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.drop_ids(kept, returned, "o_orderkey").select("o_orderkey")


@query("resume_undone", "SELECT o_orderkey AS batch_index FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("batch_index"))
    done = table(spark, d, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("batch_index"))
    return filters.undone(rows, done)


@query("resume_gaps", """SELECT i AS batch_index FROM (SELECT unnest(range(0, (SELECT max(l_orderkey) FROM lineitem WHERE l_linenumber = 6))) AS i)
  WHERE i NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 6)""")  # fmt: skip
def _(spark, d):
    return filters.gaps(table(spark, d, "lineitem").where("l_linenumber = 6").select(F.col("l_orderkey").alias("batch_index")))


@query("shard_rows", "SELECT doc_id FROM documents WHERE doc_id % 4 = 1 AND doc_id >= 100")
def _(spark, d):
    docs = table(spark, d, "documents")
    return filters.index_range(filters.shard(docs, 4, 1, "doc_id"), 100, None, "doc_id").select("doc_id")


@query("polysemous", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1)")
def _(spark, d):
    return filters.polysemous(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey").select("l_orderkey", "l_linenumber")


# -- text ------------------------------------------------------------------------

_LEAD, _TAIL = "[x x] 5/6 (d)utu₄ ḫa “a” x-kam 1.33334 ma-na (pl.) … ⸢a⸣ x (x) <gap> <gap>[be] ", " , end .. § 2 / 3 û 0.5 – <big_gap>x s. A sic (sic) ᵈ y -"
_MARKED = f"('{_LEAD}' || coalesce(text, '') || '{_TAIL}')"
_CHAINS = {
    "normalize_source": X.source_rules(), "normalize_target": X.target_rules(), "normalize_basic": X.BASIC, "rough_key": X.ROUGH, "postprocess": X.POSTPROCESS,
    "normalize_v2": X.V2, "dictionary_source": X.DICTIONARY_SOURCE, "dictionary_target": X.DICTIONARY_TARGET, "ascii_to_signs": X.ASCII_TO_SIGNS,
    "signs_to_decimal": X.SIGNS_TO_DECIMAL, "broken_brackets": X.BROKEN_BRACKETS, "small_rules": [*X.SON_OF, *X.SHEQEL, *X.SIC],
}


def _chain(name: str, chain: list[rules.Rule]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        marked = F.concat(F.lit(_LEAD), F.coalesce("text", F.lit("")), F.lit(_TAIL))
        return table(spark, d, "conversations").select("conv_id", "turn", X.normalize(marked, chain).alias("out"))

    query(f"text_{name}", f"SELECT conv_id, turn, {rules.to_sql(_MARKED, chain)} AS out FROM conversations")(run)


for _name, _rules in _CHAINS.items():
    _chain(_name, _rules)


@query("text_fixtures", fixtures.sql())
def _(spark, d):
    """Rules against outputs written by hand."""
    cases = F.inline(F.array(*[F.struct(F.lit(k).alias("n"), F.lit(rule).alias("rule"), F.lit(text).alias("text")) for k, (rule, text, _) in enumerate(fixtures.CASES)]))
    rows, out = spark.range(1).select(cases), None
    for name, chain in fixtures.CHAINS.items():
        done = X.normalize(F.col("text"), chain)
        out = F.when(F.col("rule") == name, done) if out is None else out.when(F.col("rule") == name, done)
    return rows.select("n", "rule", out.alias("out"))


@query("text_ocr")
def _(spark, d):
    lead = "¹/₂ ma-na 1 2/3 GÍN dEN-líl Pu-šu=ke lu!? *a-na <<x>> <ma> a / b "
    return table(spark, d, "conversations").select("conv_id", "turn", X.normalize_ocr(F.concat(F.lit(lead), "text")).alias("out"))


@query("text_excerpt", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS out FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.excerpt(F.col("text"), 80).alias("out"))


@query("indel_ratio")
def _(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.round(S.indel_ratio(F.col("t"), F.col("tr")), 6).alias("ratio"))


# -- linkage ---------------------------------------------------------------------


@query("link_cascade", """SELECT c_custkey, coalesce(a.s_name, b.p_name, n.n_name) AS matched,
  CASE WHEN a.s_name IS NOT NULL THEN 'alias' WHEN b.p_name IS NOT NULL THEN 'museum_no' WHEN n.n_name IS NOT NULL THEN 'excavation_no' END AS method
  FROM customer LEFT JOIN supplier a ON a.s_suppkey = c_custkey LEFT JOIN part b ON b.p_partkey * 2 = c_custkey LEFT JOIN nation n ON n.n_nationkey = c_nationkey""")  # fmt: skip
def _(spark, d):
    def lookup(name, key, value):
        return table(spark, d, name).select(F.expr(key).alias("key"), F.col(value).alias("matched"))

    found = linkage.cascade(table(spark, d, "customer").select("c_custkey", "c_nationkey"), [
        ("alias", "c_custkey", lookup("supplier", "s_suppkey", "s_name")), ("museum_no", "c_custkey", lookup("part", "p_partkey * 2", "p_name")),
        ("excavation_no", "c_nationkey", lookup("nation", "n_nationkey", "n_name")),
    ])
    return found.select("c_custkey", "matched", "method")


@query("text_by_priority", """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN '' || l.quality WHEN b.text IS NOT NULL AND trim(b.text) <> '' THEN b.text
    WHEN d.doc_id % 3 = 0 AND trim(d.lang) <> '' THEN d.lang END AS text,
  CASE WHEN l.doc_id IS NOT NULL THEN 'labels' WHEN b.text IS NOT NULL AND trim(b.text) <> '' THEN 'benchmark' WHEN d.doc_id % 3 = 0 AND trim(d.lang) <> '' THEN 'lang' END AS text_source
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id""")  # fmt: skip
def _(spark, d):
    docs = table(spark, d, "documents")
    return linkage.by_priority(docs.select("doc_id"), "doc_id", [
        ("labels", table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("text"))),
        ("benchmark", table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")),
        ("lang", docs.where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("text"))),
    ])


@query("shared_token_candidates", r"""WITH q AS (SELECT item_id AS query_id, w, count(*) AS n FROM (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[\s\-=/:]+'), lambda x: length(x) > 1)) AS w FROM benchmark) GROUP BY ALL),
i AS (SELECT DISTINCT doc_id AS id, w FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[\s\-=/:]+'), lambda x: length(x) > 1)) AS w FROM documents)),
m AS (SELECT query_id, id, sum(n)::BIGINT AS hits FROM q JOIN i USING (w) GROUP BY ALL)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) <= 20""")  # fmt: skip
def _(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return linkage.candidates(queries, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("fuzzy_match")
def _(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return linkage.fuzzy_match(queries, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), threshold=30.0)


@query("reassemble_parts", "SELECT 'tab ' || conv_id AS id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def _(spark, d):
    parts = table(spark, d, "conversations").select(F.concat(F.lit("tab,  "), F.col("conv_id").cast("string"), F.lit("_part"), F.col("turn").cast("string")).alias("part_id"), "text")
    return linkage.reassemble(parts)


@query("expert_union", """SELECT c_custkey AS id, c_name AS tr FROM customer WHERE c_custkey % 2 = 0 UNION ALL
  SELECT o_custkey, min_by(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1""")  # fmt: skip
def _(spark, d):
    train = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("tr"))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("tr"), "o_orderkey")
    return linkage.expert_union(train, rows, "id", "o_orderkey").select("id", "tr")


_ONCE = "(length({x}) - length(replace({x}, '{f}', ''))) = length('{f}')"
_R1 = f"CASE WHEN {_ONCE.format(x='text', f=' the ')} THEN replace(text, ' the ', ' a ') ELSE text END"
_R2 = f"CASE WHEN {_ONCE.format(x='x', f=' a ')} THEN replace(x, ' a ', ' one ') ELSE x END"


@query("apply_repairs", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS (SELECT doc_id, {_R1} AS x, ({_ONCE.format(x="text", f=" the ")})::INT AS e FROM d),
  b AS (SELECT doc_id, {_R2} AS corrected, e + ({_ONCE.format(x="x", f=" a ")})::INT AS edits FROM a) SELECT doc_id, corrected, edits, 2 - edits AS warnings FROM b""")  # fmt: skip
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("tr"))
    steps = F.inline(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(a).alias("find"), F.lit(b).alias("replace")) for k, (a, b) in enumerate([(" the ", " a "), (" a ", " one ")])]))
    return linkage.apply_repairs(docs, docs.select("doc_id", steps), "doc_id").select("doc_id", "corrected", "edits", "warnings")


@query("nearest_examples", """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, vec_id FROM q, embeddings WHERE vec_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]) DESC, vec_id) <= 5""")  # fmt: skip
def _(spark, d):
    rows = table(spark, d, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest.nearest(rows, queries, 5).select("query_id", "vec_id")


# -- dedup -----------------------------------------------------------------------


@query("unique_pairs", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(text), lower(lang)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("t"), F.col("lang").alias("tr"))
    return dedup.unique_pairs(docs, "doc_id").select("doc_id")


@query("keyed_fuzzy")
def _(spark, d):
    turns = table(spark, d, "conversations")
    rows = turns.select(F.col("conv_id").alias("id"), F.col("turn").alias("ord"), "text", F.pmod("turn", F.lit(3)).cast("int").alias("n_high"))
    return dedup.keyed_fuzzy(rows).select("id", "ord")


_KEY = rules.to_sql("coalesce(text, '')", X.ROUGH)


@query("exclude_with_reason", f"""WITH k AS (SELECT conv_id, turn, {_KEY} AS key FROM conversations), e AS (SELECT DISTINCT key FROM k WHERE conv_id % 5 = 0), s AS (SELECT DISTINCT key FROM k WHERE conv_id % 7 = 0),
h AS (SELECT conv_id, turn, CASE WHEN k.key IN (SELECT key FROM e) THEN 'expert' WHEN k.key IN (SELECT key FROM s) THEN 'akt' END AS reason FROM k WHERE k.key <> '')
SELECT conv_id AS id, min_by(reason, turn) AS reason FROM h WHERE reason IS NOT NULL GROUP BY conv_id""")  # fmt: skip
def _(spark, d):
    turns = table(spark, d, "conversations")
    records = segments.ordered_lines(turns.select(F.col("conv_id").alias("id"), "turn", F.col("text").alias("t")), "id", "turn", fields=("t",))
    keys = turns.select("conv_id", X.rough_key(F.col("text")).alias("key"))
    sets = [("expert", keys.where("conv_id % 5 = 0")), ("akt", keys.where("conv_id % 7 = 0"))]
    return dedup.exclude(records, sets, "lines")


@query("key_overlap", "SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'N')")
def _(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), "l_returnflag")
    return dedup.overlap(items.where("l_returnflag = 'R'"), items.where("l_returnflag = 'N'"))


_LINES = f"""lines AS (SELECT conv_id % 40 AS id, conv_id % 3 AS chunk, turn AS ord, conv_id, turn % 2 AS start, turn % 2 AS "end", coalesce(text, '') AS t, coalesce(role, '') AS tr, {_QUALITY} AS quality FROM conversations)"""


def _lines(spark, d):
    turns = table(spark, d, "conversations")
    half = F.pmod("turn", F.lit(2))
    return turns.select(
        (F.col("conv_id") % 40).alias("id"), (F.col("conv_id") % 3).alias("chunk"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), half.alias("start"),
        half.alias("end"), F.coalesce("text", F.lit("")).alias("t"), F.coalesce("role", F.lit("")).alias("tr"), F.expr(_QUALITY).alias("quality"),
    )


@query("within_chunk", f"""WITH {_LINES} SELECT chunk, id, min(conv_id * 100 + ord) AS ord FROM lines GROUP BY chunk, id, start, "end", CASE WHEN start = 0 AND "end" = 0 THEN substr(t, 1, 50) ELSE '' END""")
def _(spark, d):
    return dedup.within_chunk(_lines(spark, d)).select("chunk", "id", "ord")


@query("best_chunk", f"""WITH {_LINES}, s AS (SELECT id, chunk, count(*) AS n, sum((NOT contains(t, 'MISSING'))::INT) AS r,
  avg(-(CASE quality WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END)) AS q, sum(length(t) + length(tr)) AS c, min(conv_id * 100 + ord) AS o FROM lines GROUP BY id, chunk),
b AS (SELECT id, chunk FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, r DESC, q DESC, c DESC, o) = 1)
SELECT l.id, l.chunk, conv_id * 100 + ord AS ord FROM lines l JOIN b ON l.id = b.id AND l.chunk = b.chunk""")  # fmt: skip
def _(spark, d):
    return dedup.best_chunk(_lines(spark, d)).select("id", "chunk", "ord")


# -- segments --------------------------------------------------------------------


@query("ordered_lines", "SELECT conv_id, string_agg(coalesce(role, '') || ':' || length(text), ' ' ORDER BY turn) AS out FROM conversations GROUP BY conv_id")
def _(spark, d):
    rows = segments.ordered_lines(table(spark, d, "conversations"), "conv_id", "turn", fields=("role", "text"))
    each = F.transform("lines", lambda x: F.concat_ws(":", F.coalesce(x["role"], F.lit("")), F.char_length(x["text"]).cast("string")))
    return rows.select("conv_id", F.array_join(each, " ").alias("out"))


@query("split_at_low", f"""WITH q AS (SELECT conv_id AS id, turn AS pos, {_QUALITY} AS quality, text FROM conversations),
s AS (SELECT *, sum((quality = 'low')::INT) OVER (PARTITION BY id ORDER BY pos) AS g FROM q)
SELECT id, pos, (dense_rank() OVER (PARTITION BY id ORDER BY g) - 1)::INT AS segment FROM s WHERE quality <> 'low' AND trim(text) <> ''""")  # fmt: skip
def _(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.expr(_QUALITY).alias("quality"), F.col("text").alias("t"), F.col("text").alias("tr"))
    return segments.split_at_low(rows).select("id", "pos", "segment")


@query("window_copies", f"""WITH RECURSIVE {_PAIRS}, lines AS (SELECT conv_id AS id, list(t ORDER BY turn) AS ts, list(tr ORDER BY turn) AS trs FROM pairs GROUP BY conv_id), {oracles.windows("lines", 3, 7, 900)}
SELECT id, 0 AS segment, copy::INT AS copy, win AS "window", n_lines FROM merged WHERE trim(t) <> '' AND trim(tr) <> ''""")
def _(spark, d):
    rows = pairs(spark, d).select(F.col("conv_id").alias("id"), F.lit(0).alias("segment"), "turn", "t", "tr")
    lines = segments.ordered_lines(rows, "id", "turn").withColumn("segment", F.lit(0))
    return segments.window_copies(lines, 3, 7, 900, "expert").select("id", "segment", "copy", "window", "n_lines")


@query("overlapped_chunks", "SELECT doc_id, s AS start, least(s + 10, p) AS \"end\" FROM (SELECT doc_id, p, unnest(range(0, p, 8)) AS s FROM (SELECT doc_id, n_chars // 100 AS p FROM documents))")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 100).alias("pages"))
    return segments.chunks(docs, 10, 2).select("doc_id", F.col("start").cast("long").alias("start"), "end")


@query("top_per_group", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 2")
def _(spark, d):
    return segments.top_per_group(table(spark, d, "lineitem"), ["l_orderkey"], 2, F.desc("l_extendedprice"), "l_linenumber").select("l_orderkey", "l_linenumber")


@query("batches", "SELECT o_orderkey // 8 AS batch, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    return assembly.distribution(segments.batches(table(spark, d, "orders"), 8, "o_orderkey"), "batch")


@query("shuffled", f"SELECT c_custkey, {R.sql_order_key(3, 'c_custkey')} AS place FROM customer")
def _(spark, d):
    rows = segments.shuffled(table(spark, d, "customer").select("c_custkey"), 3, "c_custkey")
    return rows.withColumn("place", R.order_key(3, F.col("c_custkey")))


@query("running_mean", "SELECT event_id, floor(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) * 100 + 1e-6)::BIGINT AS hundredths FROM events")
def _(spark, d):
    rows = segments.running_mean(table(spark, d, "events"), "user_id", "event_id", "value")
    return rows.select("event_id", F.floor(F.col("running_mean") * 100 + 1e-6).alias("hundredths"))


@query("ema", """SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda a, v: a * 0.99 + v * (1 - 0.99)), 6) AS ema FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def _(spark, d):
    return segments.ema(table(spark, d, "events"), "user_id", "event_id", "value").select("user_id", F.round("ema", 6).alias("ema"))


# -- assembly --------------------------------------------------------------------


@query("upsample", f"WITH {_PAIRS} SELECT conv_id, turn, source, unnest(range(0, CASE source WHEN 'expert' THEN 8 ELSE 4 END))::INT AS copy FROM (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'expert' ELSE 'cad' END AS source FROM pairs)")
def _(spark, d):
    p = pairs(spark, d)
    rows = assembly.tagged({"expert": p.where("conv_id % 2 = 0"), "cad": p.where("conv_id % 2 = 1")})
    return assembly.upsample(rows, assembly.UPSAMPLE).select("conv_id", "turn", "source", "copy")


SYSTEM = "Translate the source to English."


@query("chat_records", f"WITH {_PAIRS} SELECT conv_id, turn, md5('system{SYSTEM}user' || t || 'assistant' || tr) AS digest FROM pairs")
def _(spark, d):
    p = pairs(spark, d).withColumn("messages", assembly.chat_record(F.col("t"), F.col("tr"), SYSTEM))
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], m["content"])), "")
    return p.select("conv_id", "turn", F.md5(flat.cast("binary")).alias("digest"))


@query("length_statistics", f"WITH {_PAIRS} SELECT count(*) AS n, min(length(t)) AS min_t, max(length(t)) AS max_t, avg(length(t)) AS mean_t, min(length(tr)) AS min_tr, max(length(tr)) AS max_tr, avg(length(tr)) AS mean_tr FROM pairs")
def _(spark, d):
    return assembly.length_statistics(pairs(spark, d), "t", "tr")


@query("grouped_split", f"""WITH g AS (SELECT DISTINCT o_custkey FROM orders), v AS (SELECT o_custkey FROM g ORDER BY {R.sql_order_key(5, "o_custkey")}, o_custkey LIMIT (SELECT greatest(1, (count(*) * 0.1)::DECIMAL(18, 1)::DOUBLE // 1)::BIGINT FROM g))
SELECT o_orderkey, o_custkey IN (SELECT o_custkey FROM v) AS valid FROM orders""")  # fmt: skip
def _(spark, d):
    train, valid = assembly.grouped_split(table(spark, d, "orders"), "o_custkey", 0.1, 5)
    return train.withColumn("valid", F.lit(False)).union(valid.withColumn("valid", F.lit(True))).select("o_orderkey", "valid")


@query("full_fit_split", f"SELECT o_orderkey FROM orders WHERE {R.sql_uniform(9, 'o_orderkey')} < 0.02")
def _(spark, d):
    return assembly.full_fit_split(table(spark, d, "orders"), 0.02, 9, "o_orderkey")[1].select("o_orderkey")


_PREFERENCES = "prefs AS (SELECT o_orderkey AS id, o_orderpriority AS a, o_orderstatus AS b, CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'EQUAL' END AS pick FROM orders)"


def _preferences(spark, d):
    pick = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'EQUAL' END")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"), pick.alias("pick"))


@query("swap_sides", f"WITH {_PREFERENCES} SELECT id, a, b, pick, false AS swapped FROM prefs UNION ALL SELECT id, b, a, CASE pick WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE pick END, true FROM prefs")
def _(spark, d):
    return assembly.swapped(_preferences(spark, d))


@query("class_weights", f"WITH {_PREFERENCES}, c AS (SELECT pick, count(*) AS n FROM prefs GROUP BY pick) SELECT pick, n, max(n) OVER () / n AS weight FROM c")
def _(spark, d):
    return assembly.class_weights(_preferences(spark, d))


@query("weighted_sample", oracles.weighted("orders", "o_orderkey", "o_totalprice", 500, 11, 1024))
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return assembly.weighted_sample(rows, "o_totalprice", 500, 11, "o_orderkey").select("draw", "o_orderkey")


@query("pack_sequences", """SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS total, (sum(n_chars) + 8 - sum(n_chars) % 8)::BIGINT AS padded FROM documents GROUP BY source""")
def _(spark, d):
    rows = assembly.packed(table(spark, d, "documents"), "doc_id", "n_chars", 8, "source")
    return rows.select("source", F.col("n").cast("long").alias("n"), F.element_at("ends", -1).alias("total"), "padded")


_FLAGSHIP_SQL = f"""WITH {_PAIRS}, k AS (SELECT *, {rules.to_sql("t", X.source_rules())} AS nt, {rules.to_sql("tr", X.target_rules())} AS ntr FROM pairs
  WHERE quality = 'high' AND trim(t) <> '' AND trim(tr) <> '' QUALIFY row_number() OVER (PARTITION BY lower(t), lower(tr) ORDER BY conv_id * 100 + turn) = 1),
f AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'expert' ELSE 'hecker' END AS source, unnest(range(0, 8))::INT AS copy, nt, ntr FROM k
  WHERE NOT regexp_matches(t, '(\\.\\.\\. ){{4,}}') AND NOT regexp_matches(tr, '(\\.\\.\\. ){{4,}}') AND nt <> '' AND ntr <> '')
SELECT conv_id, turn, source, copy, md5('system{SYSTEM}user' || nt || 'assistant' || ntr) AS digest FROM f"""


@query("assemble", _FLAGSHIP_SQL)
def assemble(spark, d):
    """The end of the pipeline: filter, dedup, normalise, tag, upsample, format."""
    p = filters.usable(pairs(spark, d)).withColumn("ord", F.col("conv_id") * 100 + F.col("turn"))
    p = dedup.unique_pairs(p, "ord").where(~filters.is_repetitive(F.col("t")) & ~filters.is_repetitive(F.col("tr")))
    p = p.withColumns({"t": X.normalize_source(F.col("t")), "tr": X.normalize_target(F.col("tr"))}).where("t != '' and tr != ''")
    rows = p.withColumn("source", F.when(F.col("conv_id") % 2 == 0, "expert").otherwise("hecker"))
    rows = assembly.upsample(rows, assembly.UPSAMPLE).withColumn("messages", assembly.chat_record(F.col("t"), F.col("tr"), SYSTEM))
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], m["content"])), "")
    return rows.select("conv_id", "turn", "source", "copy", F.md5(flat.cast("binary")).alias("digest"))


FLAGSHIP = assemble

# -- generation ------------------------------------------------------------------


@query("stratum_targets", """WITH c AS (SELECT lang, count(*) AS available FROM documents GROUP BY lang), w AS (SELECT *, least(300, sum(available) OVER ()) AS n, sum(available) OVER () AS a, count(*) OVER () AS g FROM c),
f AS (SELECT lang, available, n, least(available, greatest(greatest(1, n // (g * 3)), floor(n * available / a)))::BIGINT AS t FROM w),
x AS (SELECT *, greatest(0, n - sum(t) OVER ()) AS lft, coalesce(sum(available - t) OVER (ORDER BY available DESC, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f)
SELECT lang, available, (t + least(available - t, greatest(0, lft - b)))::INT AS target FROM x""")  # fmt: skip
def _(spark, d):
    return generation.targets(table(spark, d, "documents"), "lang", 300)


@query("stratified_seeds", oracles.stratified(ORACLE_SQL["stratum_targets"], "lang", "source", "doc_id", "documents", 4))
def _(spark, d):
    return generation.stratified(table(spark, d, "documents"), "lang", "source", "doc_id", 300, 4).select("lang", "doc_id")


@query("draw_amounts", f"""WITH draws AS (SELECT c_custkey AS draw, ['silver', 'tin', 'copper', 'textiles', 'barley'][c_custkey % 5 + 1] AS commodity FROM customer), {oracles.amounts("draws", 21)}""")
def _(spark, d):
    names = F.array(*[F.lit(c) for c in ("silver", "tin", "copper", "textiles", "barley")])
    draws = table(spark, d, "customer").select(F.col("c_custkey").alias("draw"), F.get(names, F.pmod("c_custkey", F.lit(5)).cast("int")).alias("commodity"))
    return generation.amounts(draws, 21, generation.units(spark)).select("draw", "commodity", "t", "tr")


@query("draw_from_pool", f"""WITH p AS (SELECT n_name AS t, n_name AS tr, n_nationkey + 1 AS w FROM nation), s AS (SELECT t, tr, sum(w) OVER (ORDER BY t, tr) AS b, sum(w) OVER (ORDER BY t, tr) - w AS a, sum(w) OVER () AS z FROM p)
SELECT c_custkey AS draw, t FROM customer JOIN s ON {R.sql_uniform(8, "c_custkey")} * z >= a AND {R.sql_uniform(8, "c_custkey")} * z < b""")  # fmt: skip
def _(spark, d):
    pool = table(spark, d, "nation").select(F.col("n_name").alias("t"), F.col("n_name").alias("tr"), (F.col("n_nationkey") + 1).alias("weight"))
    draws = table(spark, d, "customer").select(F.col("c_custkey").alias("draw"))
    return generation.from_pool(draws, pool, 8).select("draw", "t")


@query("fill_templates", "SELECT c_custkey AS draw, c_name || '-ma a-na ' || n_name AS t, 'To ' || n_name || ' thus ' || c_name AS tr FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(spark, d):
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    templates = rows.select(F.col("c_custkey").alias("draw"), F.lit("{sender_TL}-ma a-na {to_TL}").alias("t"), F.lit("To {to_TR} thus {sender_TR}").alias("tr"))
    values = rows.select(F.col("c_custkey").alias("draw"), F.inline(F.array(
        F.struct(F.lit("sender").alias("name"), F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, "-ma").otherwise("")).alias("t"), F.col("c_name").alias("tr")),
        F.struct(F.lit("to").alias("name"), F.col("n_name").alias("t"), F.col("n_name").alias("tr")),
    )))
    return generation.fill(templates, values).select("draw", "t", "tr")


@query("resolve_slots")
def _(spark, d):
    pools = table(spark, d, "nation").select(F.explode(F.array(*[F.lit(x) for x in slots.POOLED])).alias("type"), F.col("n_name").alias("t"), F.col("n_name").alias("tr"))
    types = F.array(*[F.lit(x) for x in (*slots.POOLED, "amount", "commodity", "deadline", "rate")])
    signs = F.array(*[F.lit(x) for x in ("KÙ.BABBAR", "GUŠKIN", "", "TÚG")])
    asked = table(spark, d, "customer").select(
        F.col("c_custkey").alias("draw"), F.lit("X").alias("name"), F.get(types, F.pmod("c_custkey", F.size(types)).cast("int")).alias("type"),
        F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("unit"), F.lit("weeks"), F.lit("commodity"), F.lit("tin"))).alias("options"),
        F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("a-lim/City"), F.lit("Kà-ni-iš/Kanesh"))).alias("values"),
        F.concat(F.lit("{X_TL} "), F.get(signs, F.pmod("c_custkey", F.lit(4)).cast("int"))).alias("template"), F.array().cast("array<string>").alias("types"),
    )
    return slots.resolve(asked, pools, generation.units(spark), 17)


@query("embedded_commodity", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'donkeys' WHEN 1 THEN 'wool' WHEN 2 THEN 'gold' END AS commodity FROM part")
def _(spark, d):
    texts = F.array(*[F.lit(x) for x in ("10 ANŠE {URUDU_TL} ṣa-lá-mu", "{AMT_TL} síg.hi.a ù TÚG", "GUŠKIN {URUDU_TL}", "{AMT_TL} ší-im")])
    names = list(dict.fromkeys((u[0], u[1]) for u in generation.UNITS))
    said = F.get(texts, F.pmod("p_partkey", F.lit(4)).cast("int"))
    return table(spark, d, "part").select("p_partkey", slots.detected(slots.plain(said), names).alias("commodity"))


# -- evaluation and training -----------------------------------------------------


@query("corpus_score", f"""WITH {_PAIRS}, rows_ AS (SELECT conv_id || '/' || turn AS id, t AS hyp, tr AS ref FROM pairs), {oracles.scores("rows_", "0")}
SELECT round(bleu, 6) AS bleu, round(chrf, 6) AS chrf, round(sqrt(bleu * chrf), 6) AS score FROM scored""")
def _(spark, d):
    rows = pairs(spark, d).select(F.col("t").alias("hyp"), F.col("tr").alias("ref"))
    return evaluation.corpus_score(rows).select(*[F.round(c, 6).alias(c) for c in ("bleu", "chrf", "score")])


@query("length_summary", "SELECT avg(length(text)) AS mean, median(length(text)) AS median FROM documents")
def _(spark, d):
    return evaluation.length_summary(table(spark, d, "documents"), "text")


@query("round_trip")
def _(spark, d):
    p = pairs(spark, d).select(F.concat_ws("/", "conv_id", "turn").alias("id"), "conv_id", "t", "tr")
    split = p.select("id", "conv_id", F.posexplode(F.split("t", " ")).alias("pos", "t"), F.get(F.split("tr", " "), F.col("pos")).alias("tr"))
    kept = split.where("conv_id % 3 <> 0 or pos % 4 <> 1")
    return segments.round_trip(p, kept, ("t", "tr"))


@query("select_by_agreement", f"""WITH rows_ AS MATERIALIZED (SELECT row_number() OVER () AS id, a.conv_id AS g, a.turn AS x, a.text AS hyp, b.text AS ref FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn),
{oracles.scores("rows_", "id")}, mean AS (SELECT g, x, avg(bleu * chrf) AS s FROM scored JOIN rows_ USING (id) GROUP BY ALL),
every AS (SELECT conv_id AS group_id, turn AS option, coalesce(s, 0) AS score FROM conversations LEFT JOIN mean ON g = conv_id AND x = turn)
SELECT group_id, option, round(score, 6) AS score FROM every QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, option) = 1""")
def _(spark, d):
    options = table(spark, d, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("option"), "text")
    return evaluation.select_by_agreement(options).select("group_id", "option", F.round("score", 6).alias("score"))


@query("accuracy", f"SELECT avg((quality = g)::INT) AS accuracy, avg((quality = g)::INT) FILTER (quality = 0) AS recall_0, avg((quality = g)::INT) FILTER (quality = 1) AS recall_1 FROM (SELECT *, ({R.sql_uniform(2, 'doc_id')} < 0.8)::INT AS g FROM labels)")
def _(spark, d):
    rows = table(spark, d, "labels").withColumn("guess", (R.uniform(2, F.col("doc_id")) < 0.8).cast("int"))
    return evaluation.accuracy(rows, "quality", "guess", ["0", "1"])


@query("at_thresholds", f"""WITH s AS (SELECT toxic = 1 AS p, {R.sql_uniform(6, "doc_id")} AS x FROM labels), t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold)
SELECT threshold, sum((x >= threshold)::INT)::BIGINT AS n, sum((x >= threshold AND p)::INT)::BIGINT AS tp, sum((x >= threshold AND p)::INT) / nullif(sum((x >= threshold)::INT), 0) AS precision,
  sum((x >= threshold AND p)::INT) / nullif(sum(p::INT), 0) AS recall FROM s, t GROUP BY threshold""")  # fmt: skip
def _(spark, d):
    rows = table(spark, d, "labels").withColumn("x", R.uniform(6, F.col("doc_id")))
    return evaluation.at_thresholds(rows, F.col("toxic") == 1, "x", [0.1, 0.3, 0.5, 0.7, 0.9])


@query("merge_lexicon", """WITH e AS (SELECT lower(p_brand) AS t, p_type AS tr, sum(p_size)::BIGINT AS prob FROM part GROUP BY 1, 2) SELECT t, count(*) AS n_variants, max(prob) AS top FROM e GROUP BY t""")
def _(spark, d):
    entries = table(spark, d, "part").select(F.col("p_brand").alias("t"), F.col("p_type").alias("tr"), F.col("p_size").alias("prob"))
    rows = training.merge_lexicon(entries)
    return rows.select("t", F.size("variants").cast("long").alias("n_variants"), F.get("variants", F.lit(0))["prob"].alias("top"))


@query("swap_names", f"""WITH {_PAIRS}, w AS (SELECT conv_id || '/' || turn AS id, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS a, list_filter(string_split_regex(tr, '\\s+'), lambda x: x <> '') AS b FROM pairs)
SELECT id, array_to_string(CASE WHEN len(b) > 0 THEN list_transform(a, lambda x: CASE WHEN lower(x) = lower(a[1]) THEN 'a-šùr' ELSE x END) ELSE a END, ' ') AS t,
  array_to_string(CASE WHEN len(b) > 0 THEN list_prepend('Aššur', b[2:]) ELSE b END, ' ') AS tr FROM w""")
def _(spark, d):
    p = pairs(spark, d).select(F.concat_ws("/", "conv_id", "turn").alias("id"), "t", "tr")
    first = lambda c: F.get(X.words(F.col(c)), F.lit(0))
    swaps = p.select("id", F.lit(0).alias("pos"), first("t").alias("old_t"), first("tr").alias("old_tr"), F.lit("a-šùr").alias("new_t"), F.lit("Aššur").alias("new_tr"))
    return training.swap_names(p, swaps)


@query("translate_prompts", "SELECT doc_id, 'Translate Akkadian to ' || CASE lang WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'English' END || ': ' || text AS prompt FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", training.translate_prompt(F.col("text"), F.col("lang")).alias("prompt"))


# -- sources and streaming -------------------------------------------------------


@query("page_blocks", r"""SELECT page_id, len(regexp_extract_all(html, '(?s)<p\b[^>]*>(.*?)</p>', 1)) AS n_blocks, len(list_filter(regexp_extract_all(html, '<a\s[^>]*href=[''"]([^''"]+)[''"]', 1), lambda x: ends_with(x, '.html') AND NOT regexp_matches(lower(x), 'liste|altass|gesamt|anfang|hethiter'))) AS n_links FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(markup.blocks(F.col("html"), "p")).cast("long").alias("n_blocks"), F.size(markup.links(F.col("html"))).cast("long").alias("n_links"))


@query("parse_responses", """SELECT event_id, (props->>'n')::INT AS n FROM events WHERE props IS NOT NULL""".replace("'n'", "'k'"))
def _(spark, d):
    events = table(spark, d, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here: ```json ["), "props", F.lit("] ```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("[ broken "), "props", F.lit(", ]")))
    rows = events.select("event_id", said.otherwise(F.concat(F.lit("[[bad "), "props")).alias("response"))
    return responses.parse(rows, "k int", ("k",)).select("event_id", F.inline("items")).select("event_id", F.col("k").alias("n"))


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return resume.windowed_counts(table(spark, d, "events"), "ts", "1 day", "1 hour", "event_type").select("start", "event_type", "n")


# -- joins of drills, whole runs ---------------------------------------------------


@query("mapped_ids", """SELECT o_orderkey AS id, coalesce(l.m, o_orderkey) AS mapped FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l.l_orderkey = o_orderkey
WHERE coalesce(l.m, o_orderkey) NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)""")  # fmt: skip
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    mapping = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("mapped"))
    return linkage.map_ids(rows, mapping, table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("id")))


@query("merged_predictions", """SELECT d.doc_id, d.source, d.lang AS text, l.quality::VARCHAR AS text_pred FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.col("lang").alias("text"))
    said = table(spark, d, "labels").join(rows.select("doc_id", "source"), "doc_id").select("doc_id", "source", F.col("quality").cast("string").alias("text"))
    return linkage.merge_predictions(rows, said, ("doc_id", "source"))


def _senses(spark, d):
    return table(spark, d, "part").select(
        F.col("p_brand").alias("headword"), F.col("p_partkey").cast("string").alias("sense_id"), F.col("p_partkey").alias("ord"), F.col("p_size").alias("n_att"),
        F.col("p_type").alias("gloss"), F.col("p_name").alias("domain"), F.col("p_type").alias("pos"), F.col("p_name").alias("entry_overview"),
    )


@query("contrastive_senses", """SELECT a.p_brand AS headword, a.p_partkey::VARCHAR AS sense_id, b.p_partkey::VARCHAR AS other FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey
QUALIFY row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_size DESC, b.p_partkey) <= 3""")  # fmt: skip
def _(spark, d):
    return drills.contrastive(_senses(spark, d), 3).select("headword", "sense_id", "other")


@query("sense_units", """WITH e AS (SELECT p_brand, min_by(p_type, p_partkey) AS pos FROM part GROUP BY 1), x AS (SELECT 'Brand#' || (c_custkey % 60) AS b, min_by(c_name, c_custkey) AS examples FROM customer GROUP BY 1)
SELECT p.p_brand AS headword, p_partkey::VARCHAR AS sense_id, p_type AS gloss, e.pos, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 16 END AS n_to_generate, x.examples
FROM part p JOIN e USING (p_brand) LEFT JOIN x ON x.b = p.p_brand WHERE p_partkey % 2 = 0""")  # fmt: skip
def _(spark, d):
    senses = _senses(spark, d)
    plan = senses.where("ord % 3 = 0").select("headword", "sense_id", F.col("n_att").alias("n_to_generate"), "ord")
    told = table(spark, d, "customer").select(F.concat(F.lit("Brand#"), F.col("c_custkey") % 60).alias("headword"), F.col("c_name").alias("examples"), F.col("c_custkey").alias("ord"))
    out = drills.with_senses(senses.where("ord % 2 = 0").select("headword", "sense_id"), senses, plan, told)
    return out.select("headword", "sense_id", "gloss", "pos", "n_to_generate", "examples")


@query("drill_prompts", """WITH b AS (SELECT a.p_partkey AS k, string_agg('- ' || b.p_partkey || ' (' || b.p_size || ')', chr(10) ORDER BY b.p_size DESC, b.p_partkey) AS near FROM part a JOIN
  (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey
  WHERE b.r - (SELECT count(*) FROM part c WHERE c.p_partkey = a.p_partkey AND (c.p_size > b.p_size OR c.p_size = b.p_size AND c.p_partkey < b.p_partkey)) <= 3 GROUP BY 1)
SELECT p_brand AS headword, p_partkey::VARCHAR AS sense_id, md5('Write 16 uses of ' || p_brand || ' ' || p_partkey || ' (' || p_type || ').' || chr(10) || coalesce(near, '') || chr(10) ||
  CASE WHEN length(p_name) <= 20 THEN p_name ELSE substr(p_name, 1, 20) || chr(10) || '[... truncated]' END) AS digest FROM part LEFT JOIN b ON k = p_partkey""")  # fmt: skip
def _(spark, d):
    senses = _senses(spark, d)
    units = senses.select("headword", "sense_id", "gloss", F.lit(16).alias("n_to_generate"), F.col("domain").alias("raw_entry_text"))
    made = drills.drill_prompt(units, senses, 3, 20, "Write {n} uses of {headword} {sense} ({gloss}).\n{contrast}\n{entry}")
    return made.select("headword", "sense_id", F.md5(F.col("prompt").cast("binary")).alias("digest"))


@query("grammar_prompts", """WITH w AS (SELECT l_orderkey, string_agg('- ' || l_returnflag || ': ' || l_linestatus, chr(10) ORDER BY l_linenumber, l_returnflag, l_linestatus) AS s FROM lineitem GROUP BY 1)
SELECT 'translated_' || o_orderkey AS oare_id, o_orderpriority || '|' || coalesce(s, '') || '|rules' AS prompt FROM orders LEFT JOIN w ON l_orderkey = o_orderkey""")  # fmt: skip
def _(spark, d):
    seeds = table(spark, d, "orders").select(F.concat(F.lit("translated_"), "o_orderkey").alias("oare_id"), F.col("o_orderpriority").alias("t"), F.lit("").alias("tr"), F.lit(None).cast("string").alias("genre"))
    words = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("oare_id"), F.col("l_linenumber").cast("double").alias("line_num"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("word"), F.col("l_linestatus").alias("gloss"),
    )
    return drills.grammar_prompt(seeds, words, F.lit("rules"), "{t}|{words}|{rules}")


@query("grammar_rules", f"""WITH s AS (SELECT c_mktsegment AS category, c_nationkey::VARCHAR AS section, min_by(c_name, c_custkey) AS title FROM customer GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY {R.sql_order_key(3, "category", "section")}, section) AS i FROM s),
t AS (SELECT category, string_agg('### ' || title || chr(10) || n_name || chr(10) || CASE WHEN n_nationkey % 2 = 0 THEN 'Examples:' || chr(10) || '  ' || n_name || ' → x []' || chr(10) ELSE '' END || chr(10), '' ORDER BY i) AS x, max(n) AS n
  FROM r JOIN nation ON n_nationkey::VARCHAR = section WHERE i <= 5 GROUP BY category)
SELECT category, '## Grammar: ' || category || ' (' || n || ' rules, showing ' || least(n, 5) || ')' || chr(10) || chr(10) || x AS text FROM t UNION ALL SELECT 'none', 'Unknown category ''none''.'""")  # fmt: skip
def _(spark, d):
    index = table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("category"), F.col("c_nationkey").cast("string").alias("section"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("summary"), F.col("c_custkey").alias("ord"),
    )
    said = F.array(F.struct(F.col("n_name").alias("t"), F.lit("x").alias("tr"), F.lit(None).cast("string").alias("grammar")))
    rules_ = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("section"), F.col("n_name").alias("rule"), F.when(F.col("n_nationkey") % 2 == 0, said).alias("examples"))
    asked = index.select("category").union(spark.range(1).select(F.lit("none")))
    return drills.grammar(asked, index, rules_, 5, 3)


@query("lines_with_forms", f"""WITH f AS (SELECT DISTINCT string_split(text, ' ')[1] AS form FROM benchmark), m AS (SELECT form, doc_id AS id FROM documents JOIN f ON contains(lower(text) || ' ', lower(form) || ' '))
SELECT form, id FROM m QUALIFY row_number() OVER (PARTITION BY form ORDER BY {R.sql_order_key(5, "form", "id")}, id) <= 3""")  # fmt: skip
def _(spark, d):
    forms = table(spark, d, "benchmark").select(F.get(F.split("text", " "), F.lit(0)).alias("form")).distinct()
    return drills.lines_with(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), forms, 3, 5)


@query("distinct_counts", "SELECT count(DISTINCT source) AS source, count(DISTINCT lang) AS lang, count(DISTINCT doc_id) AS doc_id FROM documents")
def _(spark, d):
    return drills.distinct_counts(table(spark, d, "documents"), "source", "lang", "doc_id")


def _sql_pick(rows, seed: str, key: str, side: int) -> str:
    return "[" + ", ".join("'" + r[side].replace("'", "''") + "'" for r in rows) + f"][floor({R.sql_uniform(seed, key)} * {len(rows)})::INT + 1]"


_KINDS = list(pools.POOLS)


@query("pool_draws", "SELECT c_custkey AS draw, kind, t, tr FROM (" + " UNION ALL ".join(
    f"SELECT c_custkey, '{k}' AS kind, {_sql_pick(rows, f'7{k}', 'c_custkey', 0)} AS t, {_sql_pick(rows, f'7{k}', 'c_custkey', 1)} AS tr FROM customer" for k, rows in pools.POOLS.items()) + ")")
def _(spark, d):
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), pools.pick(k, 7, F.col("c_custkey")).alias("v")) for k in _KINDS]))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("draw"), each).select("draw", "kind", "v.t", "v.tr")


@query("constrained_draws")
def _(spark, d):
    """Containers by contents, taxes by commodity, places by institution, rates and time limits."""
    goods = F.get(F.array(*[F.lit(x) for x in ("silver", "barley", "textiles", "wood", "copper", "tin", "gold")]), F.pmod("c_custkey", F.lit(7)).cast("int"))
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("draw"), goods.alias("commodity"), pools.container(goods, 3, k)["tr"].alias("container"), pools.tax(goods, 3, k)["tr"].alias("tax"), pools.institution(3, k)["tr"].alias("institution"),
        pools.institution(3, k)["place_tr"].alias("place"), pools.interest(3, k)["tr"].alias("interest"), pools.exchange(goods, 3, k)["tr"].alias("exchange"), pools.deadline(3, k)["tr"].alias("deadline"),
        pools.small_h(pools.pick("month", 3, k)["tr"]).alias("month"),
    )


_TEMPLATES = [("t1", "loan", "{N_TL} ma-na", "{N_TR} minas"), ("t2", "loan", "{N_TL} GÍN", "{N_TR} shekels"), ("t3", "seal", "KIŠIB {N_TL}", "seal {N_TR}")]


@query("generate_templates", f"""WITH t AS (SELECT * FROM (VALUES {", ".join(str(x) for x in _TEMPLATES)}) AS t(id, category, t, tr)),
d AS (SELECT range AS draw, CASE WHEN {R.sql_uniform("5category", "range")} < 0.75 THEN 'loan' ELSE 'seal' END AS category FROM range(0, 90)),
p AS (SELECT draw, d.category, list(id ORDER BY id) AS ids FROM d JOIN t USING (category) GROUP BY ALL),
f AS (SELECT draw, category, ids[floor({R.sql_uniform("5template", "draw")} * len(ids))::INT + 1] AS id, floor({R.sql_uniform("5n", "draw || '/N'")} * 12)::INT + 1 AS n FROM p),
g AS (SELECT draw, f.id AS template_id, f.category, replace(t, '{{N_TL}}', n::VARCHAR) AS t, replace(tr, '{{N_TR}}', n::VARCHAR) AS tr FROM f JOIN t USING (id)),
u AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY t, tr ORDER BY draw) = 1) SELECT * FROM u ORDER BY draw LIMIT 30""")  # fmt: skip
def _(spark, d):
    slot = "array(named_struct('name', 'N', 'type', 'amount', 'options', cast(null as map<string,string>), 'values', cast(null as array<string>))) as slots"
    templates = spark.createDataFrame(_TEMPLATES, "id string, category string, t string, tr string").selectExpr("*", slot)
    return pools.generate(templates, 30, 5, pools.table(spark), generation.units(spark), {"loan": 3.0, "seal": 1.0})


_RAW = f"raw AS (SELECT CASE conv_id % 3 WHEN 0 THEN 'expert' WHEN 1 THEN 'akt' ELSE 'cad' END AS source, CASE conv_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS priority, conv_id AS id, turn AS pos, t, tr, quality FROM pairs)"


@query("assemble_all", f"""WITH RECURSIVE {_PAIRS}, {_RAW}, {oracles.assembled("raw", 13, 1500)}
SELECT source, id % 10 = 0 AS valid, count(*) AS n, sum(n_lines)::BIGINT AS lines, count(DISTINCT id) AS documents, sum(length(t))::BIGINT AS sum_t, max(length(tr)) AS max_tr FROM unique_ GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    p = pairs(spark, d).select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), "t", "tr", "quality")
    sources = {name: p.where(f"id % 3 = {k}") for k, name in enumerate(("expert", "akt", "cad"))}
    source = F.when(F.col("id") % 3 == 0, "expert").when(F.col("id") % 3 == 1, "akt").otherwise("cad")
    made = stages.assemble(sources, p.where("id % 10 = 0").select(source.alias("source"), "id"), 13, 1500, normalized=False)
    return made["statistics"].select("source", "valid", "n", "lines", "documents", "sum_t", "max_tr")
