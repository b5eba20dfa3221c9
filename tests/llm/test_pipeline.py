import corpus_pipeline as P
from loomspark.llm import language
from loomspark.llm.queries import tokenizer_path

from . import test_decontaminate, test_minhash, test_token_blocks


def write(spark, folder, rows, items):
    docs = [(k, t, lang, source, None if t is None else len(t)) for k, (t, lang, source) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_equal_brute_force(spark, tmp_path):
    items = [(1, "one two three four five six seven eight"), (2, "nine ten eleven twelve thirteen fourteen fifteen sixteen")]
    rows = [(f"baba dodo lumi basta doma number{k} " * 3, "xx", "a") for k in range(60)]
    rows += [(f"kräx trüz zkorn xylt prüm zahl{k} " * 3, "yy", "b") for k in range(12)]
    rows += [rows[0], rows[61], (None, "xx", "a"), ("12 34", "yy", "a"), ("baba " + items[0][1] + " " + items[1][1], "xx", "a"), ("dodo " + items[0][1], "xx", "b")]
    docs = write(spark, tmp_path, rows, items)
    by_id, now = {d[0]: d for d in docs}, list(range(len(docs)))
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        got = sorted(r.doc_id for r in frame.collect())
        if name == "language_id":
            now = [k for k in now if language.words_of(by_id[k][1])]
        elif name == "minhash_dedup":
            now = [int(i) for i, _, c in test_minhash.brute([by_id[k] for k in now]) if int(i) == c]
        elif name == "decontaminate":
            now = [k for k in now if not test_decontaminate.brute(by_id[k][1], items)[2]]
        if name == "mix_sources":
            assert set(got) == set(now) and len(got) > len(now)
        else:
            assert got == sorted(now)
    rows = [(r.doc_id, r.text, None) for r in frame.collect()]
    last = P.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
    assert sorted(map(tuple, last), key=lambda r: r[1]) == test_token_blocks.brute(rows)
    assert P.run(spark, str(tmp_path)).count() == len(rows)
    assert tokenizer_path()


def test_extra_columns_and_repeated_ids(spark, tmp_path):
    """Extra columns, with names that stages use themselves, stay; rows that repeat an id are one document."""
    item = "one two three four five six seven eight"
    rows = [(k, f"baba dodo lumi basta doma zahl{k} " * 3, "xx", "a", len(str(k))) for k in range(40)]
    rows += [(7, rows[7][1], "xx", "a", 9), (41, "lumi " + item, "xx", "a", 1)]
    names = ("lang_pred", "score", "block", "place", "_hits")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", *[f"concat('{c}', doc_id) as {c}" for c in names])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = docs.collect()
    assert {r.doc_id for r in got} == set(range(40)) and len([r for r in got if r.doc_id == 7]) == len([r for r in got if r.doc_id == 8])
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)


def test_empty_documents(spark, tmp_path):
    write(spark, tmp_path, [(None, None, None)], [(1, "a")])
    assert P.run(spark, str(tmp_path)).count() == 0
