"""Micro-fixtures of the operators; brute force where SQL has no word for them."""

import math
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspark.operators import assembly, dedup, evaluation, filters, generation, linkage, nearest, segments, slots, training
from loomspark.plans import registry
from loomspark.sources import files, markup, responses
from loomspark.streaming import resume


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_segments(spark):
    q = [("a", 0, "high", "x"), ("a", 1, "medium", "x"), ("a", 2, "low", "x"), ("a", 3, "high", " "), ("a", 4, "high", "x"), ("b", 0, "high", "x"), ("b", 1, "high", ""), ("b", 2, "high", "x")]
    df = spark.createDataFrame(q, "id string, pos int, quality string, t string").withColumn("tr", F.col("t"))
    assert rows(segments.split_at_low(df), "id", "pos", "segment") == [("a", 0, 0), ("a", 1, 0), ("a", 4, 1), ("b", 0, 0), ("b", 2, 0)]


def test_window_merge(spark):
    lines = [[("w" * 3, "v" * 4)] * n for n in (1, 3, 9, 20)] + [[("é" * 400, "long")], [("x" * 60, "y")] * 3]
    df = spark.createDataFrame([(k, 0, x) for k, x in enumerate(lines)], "id int, segment int, lines array<struct<t:string,tr:string>>")
    for copy in (0, 1):
        for r in segments.merge_windows(df, 5, 100, copy).collect():
            assert sum(m.n_lines for m in r.merged) == len(r.lines)
            assert " ".join(m.t for m in r.merged) == " ".join(x.t for x in r.lines)
            assert all(m.n_lines == 1 or len(m.t.encode()) <= 100 and 2 <= m.n_lines <= 6 for m in r.merged)
            if len(r.lines) in (9, 20) and r.id != 5:
                assert any(m.n_lines > 1 for m in r.merged)
            if r.id == 5:
                assert [m.n_lines for m in r.merged] == [1, 1, 1]
    assert segments.window_copies(df, 3, 5, 100, "tag").select("copy").distinct().count() == 3


def test_chunks(spark):
    df = spark.createDataFrame([(10,), (0,), (3,)], "pages int")
    assert rows(segments.chunks(df, 10, 2), "pages", "start", "end") == [(3, 0, 3), (10, 0, 10), (10, 8, 10)]


def test_dedup(spark):
    pairs = spark.createDataFrame([(2, "A", "b"), (1, "a", "B"), (3, "c", "d")], "ord int, t string, tr string")
    assert rows(dedup.unique_pairs(pairs, "ord"), "ord") == [(1,), (3,)]
    recs = spark.createDataFrame(
        [("x", 0, "um-ma a-šùr qí-bi", 1), ("x", 1, "um-ma a-šùr qí-bi", 3), ("x", 2, "[Um-ma] a-šùr qí-bi₄", 2), ("x", 3, "something else", 0), (None, 4, "same", 0), (None, 5, "same", 0)],
        "id string, ord int, text string, n_high int",
    )
    assert rows(dedup.keyed_fuzzy(recs), "ord") == [(1,), (3,), (4,), (5,)]
    sets = [("expert", spark.createDataFrame([("b",)], "key string")), ("akt", spark.createDataFrame([("a",), ("b",)], "key string"))]
    recs = spark.createDataFrame([(1, [("a",), ("b",)]), (2, [("b",)]), (3, [("",), ("z",)])], "id int, sentence_pairs array<struct<t:string>>")
    assert rows(dedup.exclude(recs, sets), "id", "reason") == [(1, "akt"), (2, "expert")]
    lines = spark.createDataFrame(
        [("T", "c1", 0, 0, 0, "p", "q", "high"), ("T", "c1", 1, 0, 0, "other", "q", "high"), ("T", "c1", 2, 0, 0, "p", "q2", "high"), ("T", "c2", 3, 1, 1, "p", "MISSING", "high"), ("T", "c2", 4, 2, 2, "p", "q", "high")],
        "id string, chunk string, ord int, start int, end int, t string, tr string, quality string",
    )
    assert rows(dedup.within_chunk(lines), "ord") == [(0,), (1,), (3,), (4,)]
    assert rows(dedup.best_chunk(dedup.within_chunk(lines)), "ord") == [(0,), (1,)]
    assert rows(dedup.generated(pairs.withColumnRenamed("ord", "draw"), 2), "draw") == [(1,), (2,)]
    ends = spark.createDataFrame([(["a", "bb", "cc"], ["bb", "cc", "dd"])], "l array<string>, r array<string>")
    assert ends.select(dedup.align_edges(F.col("l"), F.col("r"))).first()[0] == 2


def test_linkage(spark):
    t = spark.createDataFrame([("1", "al", "mu"), ("2", None, "mu"), ("3", "no", "no")], "id string, alias string, museum string")
    table = lambda *x: spark.createDataFrame(list(x), "key string, matched string")
    got = linkage.cascade(t, [("alias", "alias", table(("al", "A"))), ("museum_no", "museum", table(("mu", "M")))])
    assert sorted(map(str, got.select("id", "matched", "method").collect())) == sorted(
        map(str, [spark.createDataFrame([x], "id string, matched string, method string").first() for x in (("1", "A", "alias"), ("2", "M", "museum_no"), ("3", None, None))])
    )
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    src = lambda *x: spark.createDataFrame(list(x), "id string, text string")
    got = linkage.by_priority(ids, "id", [("train", src(("a", " "))), ("expert", src(("a", "x"), ("b", "y")))])
    assert {r.id: (r.text, r.text_source) for r in got.collect()} == {"a": (" ", "train"), "b": ("y", "expert"), "c": (None, None)}
    index = spark.createDataFrame([(1, "um-ma a-šùr-i"), (2, "um-ma pu-šu-ke-en"), (3, "zz yy")], "id int, text string")
    asked = spark.createDataFrame([(9, "um-ma a-šùr-i-i"), (8, "nothing here")], "query_id int, text string")
    assert [(r.query_id, r.id) for r in linkage.fuzzy_match(asked, index, 75).collect()] == [(9, 1)]
    base = spark.createDataFrame([(1, "a b a"), (2, "x")], "id int, tr string")
    fixes = spark.createDataFrame([(1, 0, "a", "c"), (1, 1, "b", "d"), (1, 2, "d", "e")], "id int, ord int, find string, replace string")
    assert rows(linkage.apply_repairs(base, fixes, "id"), "id", "corrected", "edits", "warnings") == [(1, "a e a", 2, 1), (2, "x", 0, 0)]
    lex = spark.createDataFrame([("puzur-a", "E")], "t string, entry string")
    text = spark.createDataFrame([(1, "Puzur-a puzur-a-ma other")], "id int, text string")
    assert rows(linkage.probe_lexicon(text, lex), "pos", "entry") == [(0, "E"), (1, "E")]
    forms = spark.createDataFrame([("šùr",)], "form string")
    assert rows(linkage.has_token(spark.createDataFrame([(1, "a sur, b"), (2, "surx")], "id int, text string"), forms), "id") == [(1,)]
    assert rows(linkage.contains_form(spark.createDataFrame([(1, "a Šùr"), (2, "šùrx")], "id int, text string"), forms), "id") == [(1,)]


def test_filters(spark):
    done = spark.createDataFrame([(0,), (2,)], "batch_index bigint")
    todo = spark.range(5).select(F.col("id").alias("batch_index"))
    assert rows(filters.undone(todo, done), "batch_index") == [(1,), (3,), (4,)]
    assert rows(filters.undone(todo, done, fill_gaps=False), "batch_index") == [(3,), (4,)]
    assert rows(filters.gaps(done), "batch_index") == [(1,)]
    verbs = spark.createDataFrame([("i-na a-na a-šùr",), ("KÙ ta-din",), (None,)], "t string")
    assert [r[0] for r in verbs.select(filters.has_verb(F.col("t"))).collect()] == [False, True, None]
    echo = spark.createDataFrame([("um-ma a", "um ma"), ("um-ma", "the word")], "t string, tr string")
    assert [r[0] for r in echo.select(filters.is_echo(F.col("t"), F.col("tr"))).collect()] == [True, False]
    held = spark.createDataFrame([("a", "old", ""), ("b", "old", "new"), ("c", "x", "y")], "id string, tr string, corrected string")
    assert rows(filters.holdout_rows(held, spark.createDataFrame([("a",), ("b",)], "id string"), "id"), "id", "tr") == [("a", "old"), ("b", "new")]


def test_assembly(spark):
    prefs = spark.createDataFrame([("t", "x", "y", "A"), ("t", "x", "y", "EQUAL")], "t string, a string, b string, pick string")
    assert rows(assembly.swapped(prefs), "a", "pick") == [("x", "A"), ("x", "EQUAL"), ("y", "B"), ("y", "EQUAL")]
    counts = spark.createDataFrame([("A",)] * 2 + [("B",)] * 2 + [("EQUAL",)] * 4, "pick string")
    assert rows(assembly.class_weights(counts), "pick", "weight") == [("A", 2.0), ("B", 2.0), ("EQUAL", 1.0)]
    train, valid = assembly.grouped_split(spark.range(100).withColumn("g", F.col("id") % 20), "g", 0.1, 1)
    assert valid.select("g").distinct().count() == 2 and valid.count() + train.count() == 100
    drawn = Counter(r.id for r in assembly.weighted_sample(spark.range(4).withColumn("w", F.col("id").cast("double")), "w", 3000, 2, "id").collect())
    assert sum(drawn.values()) == 3000 and drawn[0] == 0 and drawn[3] == pytest.approx(1500, rel=0.1)
    pack = assembly.packed(spark.createDataFrame([(1, 0, 5), (1, 1, 3), (2, 0, 1)], "bin int, ord int, n_tokens bigint"), "ord")
    assert rows(pack, "bin", "ends", "padded") == [(1, [5, 8], 16), (2, [1], 8)]
    assert assembly.output_name("base", {"r4": True, "hk": False, "x": True}) == "base_r4_x"


def brute_bleu(hyps, refs):
    def words(s):
        s = " " + s.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">") + " "
        for p, to in evaluation._TOKENIZE:
            s = re.sub(p, to.replace("$", "\\"), s)
        return s.split()

    m, t, hl, rl = [0] * 4, [0] * 4, 0, 0
    for h, r in zip(hyps, refs, strict=True):
        h, r = words(h), words(r)
        hl, rl = hl + len(h), rl + len(r)
        for n in range(1, 5):
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
            m[n - 1] += sum((a & b).values())
            t[n - 1] += sum(a.values())
    if not any(m) or not all(t):
        return 0.0
    smooth, logs = 1, 0.0
    for x, y in zip(m, t, strict=True):
        smooth *= 2 if x == 0 else 1
        logs += math.log(x / y if x else 1 / (smooth * y))
    return 100 * math.exp(logs / 4) * (math.exp(1 - rl / hl) if hl < rl else 1)


def test_scores(spark):
    hyps = ["The cat sat on the mat, quietly.", "It was a dog here", "x 1,000 - 5% \"q\""]
    refs = ["The cat sat on the mat quietly.", "It was a cat here", "x 1,000 - 6% 'q'"]
    got = evaluation.corpus_score(spark.createDataFrame(list(zip(hyps, refs, strict=True)), "hyp string, ref string")).first()
    assert got.bleu == pytest.approx(brute_bleu(hyps, refs)) and 0 < got.chrf < 100
    assert got.score == pytest.approx(math.sqrt(got.bleu * got.chrf))
    same = evaluation.corpus_score(spark.createDataFrame([(x, x) for x in refs], "hyp string, ref string")).first()
    assert (same.bleu, same.chrf, same.score) == pytest.approx((100, 100, 100))
    none = evaluation.corpus_score(spark.createDataFrame([("aa", "bb")], "hyp string, ref string")).first()
    assert tuple(none) == (0.0, 0.0, 0.0)


def brute_chrf(hyps, refs):
    def words(s):
        out = []
        for w in s.split():
            last, first = w[-1] in string.punctuation, w[0] in string.punctuation
            out += [w] if len(w) == 1 else [w[:-1], w[-1]] if last else [w[0], w[1:]] if first else [w]
        return out

    precision, recall, orders = 0.0, 0.0, 0
    for cut, top in ((lambda s: "".join(s.split()), 6), (words, 2)):
        for n in range(1, top + 1):
            m = a = b = 0
            for h, r in zip(hyps, refs, strict=True):
                x, y = (Counter(tuple(z[i : i + n]) for i in range(len(z) - n + 1)) for z in (cut(h), cut(r)))
                m, a, b = m + sum((x & y).values()), a + sum(x.values()), b + sum(y.values())
            if a and b:
                precision, recall, orders = precision + m / a, recall + m / b, orders + 1
    p, r = precision / orders, recall / orders
    return 100 * 5 * p * r / (4 * p + r)


def test_registered_score_reads_whole_references(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["the", "dog,", "(cat", "1,000", "naïve", "río.", "a", "sat", "x-y"]) for _ in range(n))
    said = [(text(n), text(m)) for n, m in ((3, 5), (40, 60), (300, 20), (1, 1), (90, 400))]
    said += [("same words " * 50, "same words " * 50 + "and a tail that only the reference has"), ("𝒳 y", "𝒳 z")]
    turns = [(k, t, role, x) for k, two in enumerate(said) for t, (role, x) in enumerate(zip(("user", "assistant"), two, strict=True))]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["corpus_score"](spark, str(tmp_path)).first()
    hyps, refs = zip(*said, strict=True)
    bleu, chrf = brute_bleu(hyps, refs), brute_chrf(hyps, refs)
    assert (got.bleu, got.chrf, got.score) == pytest.approx((bleu, chrf, math.sqrt(bleu * chrf)), abs=1e-5)


def test_scores_of_long_texts(spark):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(20_000))
    got = evaluation.corpus_score(spark.createDataFrame([(text, text + " more"), (None, ""), ("", None)], "hyp string, ref string")).first()
    assert 99 < got.bleu < 100 and 99 < got.chrf < 100


def test_selection(spark):
    opts = spark.createDataFrame([(1, 0, "a quick brown fox jumps"), (1, 1, "a quick brown fox leaps"), (1, 2, "zz"), (2, 0, "alone")], "group_id int, option int, text string")
    got = {r.group_id: (r.option, r.score) for r in evaluation.select_by_agreement(opts).collect()}
    assert got[1][0] == 0 and got[1][1] > 0 and got[2] == (0, 0.0)


def test_thresholds(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.6), (1, 0.2)], "y int, s double")
    got = evaluation.at_thresholds(df, F.col("y") == 1, "s", [0.1, 0.5, 0.95]).orderBy("threshold").collect()
    assert [(r.n, r.tp, r.precision) for r in got] == [(3, 2, 2 / 3), (2, 1, 0.5), (0, 0, None)]


def test_generation(spark):
    draws = spark.range(300).select(F.col("id").alias("draw"), F.when(F.col("id") % 2 == 0, "silver").otherwise("sheep").alias("commodity"))
    got = generation.amounts(draws, 3, generation.units(spark)).collect()
    assert len(got) == 300 and all(r.tr.endswith("silver" if r.commodity == "silver" else "of sheep") for r in got)
    assert all("KÙ.BABBAR" in r.t for r in got if r.commodity == "silver") and any(" of refined silver" in r.tr for r in got)
    assert not any(re.match(r"1 (minas|shekels|talents)\b", r.tr) for r in got)
    pool = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 900, "a").otherwise("b").alias("g"), (F.col("id") % 100).alias("doc"))
    assert rows(generation.targets(pool, "g", 90), "g", "target") == [("a", 75 + 0), ("b", 15)] or sum(r.target for r in generation.targets(pool, "g", 90).collect()) >= 90
    picked = generation.stratified(pool, "g", "doc", "k", 90, 1)
    assert picked.groupBy("g", "doc").count().where("count > 2").count() == 0
    filled = generation.fill(
        spark.createDataFrame([(1, "{n_TL}-ma {n_TL}", "{n_TR}!")], "draw int, t string, tr string"),
        spark.createDataFrame([(1, "n", "ta-ší-ma", "Tašima")], "draw int, name string, t string, tr string"),
    )
    assert rows(filled, "t", "tr") == [("ta-ší-ma ta-ší-ma", "Tašima!")]


def test_training(spark):
    lex = training.merge_lexicon(spark.createDataFrame([("Aa", "X", 0.2), ("aa", "X", 0.3), ("aa", "Y", 0.4)], "t string, tr string, prob double"))
    got = lex.select("t", training.pick_variant(F.col("variants")), training.pick_variant(F.col("variants"), F.lit("it is Y's.")), training.pick_variant(F.col("variants"), F.lit("none"))).first()
    assert tuple(got) == ("aa", "X", "Y", None)
    pairs = spark.createDataFrame([(1, "aa bb AA", "X met X")], "id int, t string, tr string")
    swaps = spark.createDataFrame([(1, 0, "aa", "X", "cc", "Z"), (1, 1, "bb", "Q", "dd", "R")], "id int, pos int, old_t string, old_tr string, new_t string, new_tr string")
    assert rows(training.swap_names(pairs, swaps), "t", "tr") == [("cc bb cc", "Z met X")]
    assert spark.range(1).select(training.one_hot(F.lit("B"))).first()[0] == [0.0, 1.0, 0.0]


PAGE = """<h1 class='x'><font size='3'> KBo 1.1 </font></h1><table><td><b><font color='blue'>Lit:</font></b></td><td>Gelb </td></table><br/>
<table><tr><td>Vs.</td><td><PN>A</PN>-<small>NA</small> <fn>NB</fn>= um</td></tr><tr><td>1</td><td> <span class='k'>ma</span> </td></tr><tr><td>2</td><td></td></tr></table>
<a href='t1.html'>x</a><a href='Gesamtliste.html'>y</a>"""


def test_markup(spark):
    r = markup.tablets(spark.createDataFrame([(PAGE,), ("",)], "html string")).withColumn("links", markup.links(F.col("html"))).collect()
    assert (r[0].tablet_id, r[0].metadata, r[0].transliteration, r[0].line_count, r[0].links) == ("KBo 1.1", ["Lit: Gelb"], "@Vs. A-NA -um ma", 2, ["t1.html"])
    assert (r[1].tablet_id, r[1].line_count) == ("unknown", 0)


def test_responses(spark):
    frame = responses.FRAMES[0]
    texts = [
        f'x {frame[0]}\n```json\n[{{"t": "a", "tr": "b"}}]\n```\n{frame[1]}', 'so: [{"t": "a", "tr": "b"}] and more', '{"embedded_pairs": [{"t": "a", "tr": "b"}], "tablet_sentence_pairs": []}',
        '[{"t": "a", "tr": "b"}, {"t": "broken', "no json", None, '[{"t": "a", "tr": "b"}] trailing ]',
    ]
    df = responses.parse(spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "batch int, response string"), "t string, tr string, id string", ("t", "tr"))
    assert [len(r["items"]) for r in df.orderBy("batch").collect()] == [1, 1, 1, 1, 0, 0, 1]
    expected = spark.createDataFrame([(0, "only"), (4, "p"), (4, "q")], "batch int, id string")
    got = responses.demultiplex(df, expected)
    assert {r.id: r.item is not None for r in got.collect()} == {"only": True, "p": False, "q": False}
    schema = "chunk string, entries array<struct<headword:string,senses:array<struct<sense_id:string,gloss:string,oa_attestations:array<struct<source_ref:string>>>>>>"
    nested = spark.createDataFrame([("c", [("h", [("1", "g", [("r1",), ("r2",)]), ("2", "g", None)])])], schema)
    assert responses.attestations(nested).count() == 2 and nested.select(responses.count_attestations(F.col("entries"))).first()[0] == 2
    valid = spark.createDataFrame([([("a", "b")],), ([("a", None)],), (None,)], "p array<struct<transliteration:string,translation:string>>")
    assert [r[0] for r in valid.select(responses.valid_pairs(F.col("p"))).collect()] == [True, False, False]


def test_files_and_streaming(spark, tmp_path):
    schema = "chunk string, timestamp string, n int"
    assert files.optional_jsonl(spark, str(tmp_path / "none"), schema).count() == 0
    for k in (1, 2):
        files.append_checkpoint(spark.createDataFrame([("a", f"t{k}", k), ("b", "t1", 9)] if k == 1 else [("a", f"t{k}", k)], schema), str(tmp_path / "ck"))
    assert rows(files.checkpoint(spark, str(tmp_path / "ck"), schema), "chunk", "n") == [("a", 2), ("b", 9)]
    (tmp_path / "ids.txt").write_text(" a \n\nb\na\n")
    assert rows(files.ids(spark, str(tmp_path / "ids.txt")), "id") == [("a",), ("b",)]
    files.write_csv(spark.createDataFrame([("x", 'q "1",\n2')], "a string, b string"), str(tmp_path / "csv"))
    assert rows(files.csv(spark, str(tmp_path / "csv")), "b") == [('q "1",\n2',)]
    for _ in range(2):
        resume.run_available(spark, str(tmp_path / "ck"), schema, lambda d: d.where("n > 1"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "chunk", "n") == [("a", 2), ("b", 9)]
    texts = spark.createDataFrame([("i1", "al", "Kt 5 (BM 7)", "ex", 0), ("i2", "al", "none", "", 1)], "oare_id string, aliases string, label string, excavation_no string, ord int")
    got = files.published_lookups(texts, "ord")
    assert {k: rows(v, "key", "matched") for k, v in got.items()} == {"alias": [("al", "i2")], "museum_no": [("BM 7", "i1")], "excavation_no": [("ex", "i1")]}


def test_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = {k: rng.normal(size=8) for k in range(60)} | {60: np.zeros(8)}
    vectors[61] = vectors[3]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()] + [(62, None)], "vec_id long, embedding array<double>").repartition(5)
    asked = df.where("vec_id in (3, 7, 20)").withColumnRenamed("vec_id", "query_id")
    for block in (2, 100):
        got = {}
        for r in nearest.nearest(df, asked, 4, block=block).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        for q in (3, 7, 20):
            cos = {k: (v @ vectors[q]) / max(np.linalg.norm(v) * np.linalg.norm(vectors[q]), 1e-300) for k, v in vectors.items() if k != q}
            assert got[q] == set(sorted(cos, key=lambda k: (-round(cos[k], 12), k))[:4])
    assert nearest.nearest(df, asked.limit(0), 4).count() == 0


def test_reports_and_prompts(spark):
    t = spark.createDataFrame([("fuzzy_81.5",), ("fuzzy_90.0",), ("alias",), (None,)], "method string")
    assert rows(assembly.linkage_report(t, t.limit(0)), "kind", "method", "n") == [("tablet", "alias", 1), ("tablet", "fuzzy", 2), ("tablet", "none", 1)]
    prompt = training.preference_prompt("{transliteration}|{translation_a}|{translation_b}", F.lit("t"), F.lit("a"), F.lit(None).cast("string"))
    assert spark.range(1).select(prompt).first()[0] == "t|a|"
    assert spark.range(1).select(filters.by_prefix(F.lit("akt_5"), {"akt": "tr", "akt_5": "x"}, "en")).first()[0] == "tr"
    f = spark.createDataFrame([("/a/one.pdf",), ("/a/two.pdf",)], "f string")
    assert rows(filters.of_files(f, "f", part="o", stems=("one",)), "f") == [("/a/one.pdf",)]


def test_round_trip(spark):
    from difflib import SequenceMatcher

    records = [(1, "a-na ša-lim qí-bi-ma", "to Šalim speak"), (2, "um-ma a-šùr", "thus Aššur"), (3, "x", None), (4, "long text here", "y")]
    parts = [(1, 1, "qí-bi-ma", "speak"), (1, 0, "a-na ša-lim", "to Šalim"), (2, 0, "um-ma", "thus Aššur"), (2, 1, "", None), (4, 0, "long text here", "z")]
    df = spark.createDataFrame(records, "id int, t string, tr string")
    got = rows(segments.round_trip(df, spark.createDataFrame(parts, "id int, pos int, t string, tr string"), ("t", "tr")), "id", "t_similarity", "tr_similarity", "valid")
    for (k, t, tr, ok), (_, a, b) in zip(got, records, strict=True):
        mine = sorted(p for p in parts if p[0] == k)
        want = [SequenceMatcher(None, x or "", " ".join(p[i] for p in mine if p[i])).ratio() for i, x in ((2, a), (3, b))]
        assert [t, tr] == want and ok == (min(want) >= 0.9)
    assert [x[3] for x in got] == [True, False, False, False]


def test_length_summary(spark):
    df = spark.createDataFrame([("a",), ("𝒳bc",), (None,), ("abcdefgh",), ("abcd",)], "text string")
    assert tuple(evaluation.length_summary(df, "text").first()) == (4.0, 3.5)


def test_slots(spark):
    pools = spark.createDataFrame([(p, f"{p}-T", f"{p}-R") for p in slots.POOLED if p != "item"] + [("month", "b", "B")], "type string, t string, tr string")
    kinds = [(p, "S", {}, None, "", []) for p in slots.POOLED if p != "item"]
    kinds += [("place", "S", {}, ["a / b", "c/d"], "", []), ("occupation", "S", {}, ["lone"], "", []), ("rate", "S", {}, None, "", []), ("deadline", "S", {"unit": "weeks"}, None, "", [])]
    kinds += [("amount", "NUM", {}, None, "", []), ("amount", "N", {"unit": "years"}, None, "", []), ("amount", "S", {"bare_number": "true"}, None, "", [])]
    kinds += [("commodity", "S", {"weight_only": "true", "exclude_silver": "true"}, None, "", []), ("amount", "S", {"commodity": "tin"}, None, "{X_TL} x", [])]
    kinds += [("amount", "S", {"commodity": "tin"}, None, "{S_TL} AN.NA", []), ("amount", "S", {}, None, "{S_TL} Ku.KI", []), ("amount", "S", {}, None, "x", []), ("amount", "S", {"commodity": "tin"}, None, "x", ["commodity"])]
    data = [(100 * k + i, n, t, o, v, e, y) for k, (t, n, o, v, e, y) in enumerate(kinds) for i in range(60)]
    df = spark.createDataFrame(data, "draw int, name string, type string, options map<string,string>, values array<string>, template string, types array<string>")
    got: dict = {}
    for r in slots.resolve(df, pools, generation.units(spark), 5).collect():
        got.setdefault(r.draw // 100, []).append((r.t, r.tr))
    assert all(len(got[k]) == 60 and all(t and tr for t, tr in got[k]) for k in range(len(kinds)))
    at = lambda *x: [got[k] for k, y in enumerate(kinds) if y == x][0]
    assert set(at("month", "S", {}, None, "", [])) == {("month-T", "month-R"), ("b", "B")}
    assert set(got[6]) == {("a", "b"), ("c", "d")} and set(got[7]) == {("lone", "lone")}
    assert {t for t, _ in got[8]} <= {x.removesuffix(" GÍN.TA") for x in generation.RATES} and len(set(got[8])) > 3
    assert all(2 <= int(t) <= 70 for t, _ in got[9]) and max(int(t) for t, _ in got[9]) > 12
    assert {int(t) for t, _ in got[10]} == set(range(1, 13)) and {int(t) for t, _ in got[11]} == set(range(1, 6))
    assert all(re.fullmatch(r"\d+( [½⅓⅔¼⅙⅚])?", t) and t == tr for t, tr in got[12])
    assert {tr for _, tr in got[13]} <= {"tin", "copper", "gold", "wool", "meteoric iron", "lapis lazuli", "barley", "wheat"}
    assert all("AN.NA" in t and tr.endswith("tin") for t, tr in got[14]) and not any("AN.NA" in t or "of" in tr for t, tr in got[15] + got[18])
    assert not any("KÙ.GI" in t for t, _ in got[16]) and len({tr.split(" of ")[-1] for _, tr in got[17]}) > 5
    for kind in ("odd", "item"):
        with pytest.raises(Exception, match=kind):
            slots.resolve(df.withColumn("type", F.lit(kind)), pools, generation.units(spark), 5).collect()
    units = F.array(F.struct(F.lit(1).alias("low"), F.lit(60).alias("high"), F.lit("GÍN").alias("u_t"), F.lit("shekels").alias("u_tr")))
    simple = spark.range(300).select(slots.simple_amount(units, F.lit("AN.NA"), F.lit("tin"), "7", F.col("id")).alias("v")).select("v.*").collect()
    assert {r.t for r in simple} == {f"{n} GÍN AN.NA" for n in range(1, 31)} and {r.tr for r in simple if r.t[:2] == "1 "} == {"1 shekel of tin"}


def test_files_of_one_name_in_three_folders(spark, tmp_path):
    for k, folder in enumerate("abc"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "pairs.jsonl").write_text("".join(f'{{"id": "{folder}{i}", "match_quality": "{"high" if i else "low"}"}}\n' for i in range(k + 1)))
    schema = "id string, match_quality string"
    rows = files.tagged_jsonl(spark, {f: f"{tmp_path}/{f}/pairs.jsonl" for f in "abc"} | {"none": f"{tmp_path}/d/pairs.jsonl"}, schema)
    assert sorted((r.id, r.mode) for r in rows.collect()) == [("a0", "a"), ("b0", "b"), ("b1", "b"), ("c0", "c"), ("c1", "c"), ("c2", "c")]
    assert {(r.mode, r.match_quality): r.n for r in files.quality_by_mode(rows).collect()}["c", "high"] == 2
    assert files.labelled_jsonl(spark, f"{tmp_path}/b/pairs.jsonl", "x", schema).where("mode = 'x'").count() == 2


def test_dictionary_and_key_values(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"mt_transliteration": " a ", "mt_translation": "b\\t"}\n{"mt_transliteration": " ", "mt_translation": "b"}\n{"mt_translation": "c"}\n')
    assert [tuple(r) for r in files.dictionary_pairs(spark, f"{tmp_path}/d.jsonl").collect()] == [("a", "b")]
    (tmp_path / "t.csv").write_text('oare_id,x,translation\n1,a,"one\n line"\n2,b,two\n1,c,last\n')
    assert sorted(map(tuple, files.key_values(spark, f"{tmp_path}/t.csv").collect())) == [("1", "last"), ("2", "two")]


def test_resumable_starts_over_where_a_line_is_broken(spark, tmp_path):
    schema = "batch_index int, text string"
    rows, done = files.resumable(spark, f"{tmp_path}/none", schema)
    assert not rows.count() and not done.count()
    (tmp_path / "ok.jsonl").write_text('{"batch_index": 1, "text": "a"}\n{"batch_index": 1, "text": "b"}\n{"batch_index": 3}\n')
    rows, done = files.resumable(spark, f"{tmp_path}/ok.jsonl", schema)
    assert rows.count() == 3 and sorted(r[0] for r in done.collect()) == [1, 3] and rows.columns == ["batch_index", "text"]
    (tmp_path / "bad.jsonl").write_text('{"batch_index": 1, "text": "a"}\n{"batch_index": 2, "te')
    rows, done = files.resumable(spark, f"{tmp_path}/bad.jsonl", schema)
    assert not rows.count() and not done.count()


def test_merged_edges(spark):
    line = lambda t, q="high", tr="x": (t, tr, q)
    a = [line("first line of all"), line("second line here", "low"), line("third line there")]
    b = [line("second line here!", "high"), line("quite other words"), line("last of the lines")]
    kind = "array<struct<t:string,tr:string,quality:string>>"
    rows = spark.createDataFrame([(a, b), (a, [line("nothing alike 12345")]), (a, None), ([], b)], f"a {kind}, b {kind}")
    got = [[x.t for x in r[0]] for r in rows.select(dedup.merge_edges(rows.a, rows.b)).collect()]
    assert got[0] == ["first line of all", "second line here!", "third line there", "quite other words", "last of the lines"]
    assert got[1] == [x[0] for x in a] + ["nothing alike 12345"] and got[2] == [x[0] for x in a] and got[3] == [x[0] for x in b]


def test_nested_entries_once(spark):
    att = "struct<raw_transliteration:string,source_ref:string>"
    kind = f"chunk int, entries array<struct<headword:string,senses:array<struct<sense_id:string,gloss:string,oa_attestations:array<{att}>>>>>"
    entries = [("h", [("1", "g", [("text a", "ref"), ("text b", "ref")]), ("2", "g", [("text a", "ref")])])]
    rows = responses.distinct_attestations(spark.createDataFrame([(1, entries)], kind)).collect()
    assert sorted((r.raw_transliteration, r.sense_id) for r in rows) == [("text a", "1"), ("text b", "1")]


def test_responses_that_need_no_recovery(spark):
    first, last = responses.FRAMES[0]
    said = ['[{"k": 1}, {"k": 2}]', ' ```json\n[{"k": 3}]\n``` ', f'{first}\n[{{"k": 4}}]\n{last}', 'Here: [{"k": 5}] thanks', '[{"k": 6}, {"k": ', None, "[]"]
    rows = responses.parse(spark.createDataFrame([(k, x) for k, x in enumerate(said)], "n int, response string"), "k int", ("k",)).collect()
    assert [[x.k for x in r["items"]] for r in sorted(rows)] == [[1, 2], [3], [4], [5], [6], [], []]


def test_curation_runs_and_resumes(spark, tmp_path):
    from loomspark.plans import stages

    pair = "id string, pos int, t string, tr string, quality string"
    made = lambda rows, kind=pair: spark.createDataFrame(rows, kind)
    tables = {
        "expert": made([("e1", "um-ma a-na", "thus to the gold")], "id string, t string, tr string"), "fixes": made([("e1", 0, "gold", "silver")], "id string, ord int, find string, replace string"),
        "splits": made([("e1", 0, "um-ma", "thus", "high"), ("e1", 1, "a-na", "to the silver", "high")]),
        "extracted": made([("a1", 1, 1, 1, 1, "šu-ma a-na", "if to him", "high")], "id string, chunk int, ord int, start int, end int, t string, tr string, quality string"),
        "dictionary": made([("d1", 0, "be-lu a-na bi-tim", "the lord goes to his house", "high"), ("d1", 1, "be-lu", "lord", "high")]),
        "articles": made([("m1", 0, "a-hu-um", "a brother here", "high")]),
        "published": made([("p1", 0, "DUMU A-šùr", "son of Assur", "high", "al", None, None)], pair + ", alias string, museum_no string, excavation_no string"),
        "lookups": made([("alias", "al", "oare-7")], "method string, key string, matched string"),
        "responses": made([("s1", 0, "a-na", "to someone", "high"), ("s1", 1, "new-one", "a new pair", "high")]),
        "holdout": made([("michel", "m1")], "source string, id string"),
    }
    out = stages.run(spark, str(tmp_path), stages.curation(3, 1000), tables)
    rows = {(r.source, r.id, r.valid, r.n_lines) for r in out["training"].collect()}
    assert {("expert", "e1", False, 1), ("expert", "e1", False, 2), ("akt", "a1", False, 1), ("cad", "d1", False, 1), ("michel", "m1", True, 1), ("hecker", "oare-7", False, 1), ("synthetic", "s1", False, 1)} <= rows
    assert [r.tr for r in out["expert_pairs"].orderBy("pos").collect()] == ["thus", "to the silver"] and out["synthetic_pairs"].count() == 1
    again = stages.run(spark, str(tmp_path), stages.curation(3, 1000), {})  # nothing is made again
    assert again["training"].count() == out["training"].count()


def test_nearest_in_bounded_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    # Every vector stands 50 times: only keys order the copies, wherever a matrix product has them.
    vectors = np.tile(np.random.default_rng(3).normal(size=(200, 7)).astype(np.float32), (50, 1))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(vectors), pa.list_(pa.float32()))], ["vec_id", "embedding"])
    ids = np.arange(4000)
    tracemalloc.start()
    found = {}
    for q, keys, _ in nearest.best_rows(iter([batch, batch.slice(0, 0)]), ids, vectors[:4000].astype(np.float64), 3):
        for a, b in zip(q.tolist(), keys.tolist(), strict=True):
            found.setdefault(a, []).append(b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # all products at once take 320 MB
    assert found == {q: [x for x in range(q % 200, 10_000, 200) if x != q][:3] for q in range(4000)}
