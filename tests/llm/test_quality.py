import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspark.llm import quality as Q

DOCS = "doc_id long, text string, lang string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    views = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(views)
    covered = {k for i, v in enumerate(views) if seen[v] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


TEXTS = [
    None, "", " \t\n\x0b\f\r", "one", "a b c d e", "a b c d e a b c d e", "x " * 100, "é😀 b\xa0c\n\nd # $ % & | < > *",
    "l one\nl one\n \nl one\r\nl\tone\n", "a b c d e f a b c d e g b c d e f a", "p q r s t " * 3 + "u v w " + "q r s t u",
    "same same same same same same", "word " * 20_000 + "end", "\x85 a b", "trail  two   \n",
]


def test_counts(spark):
    rows = [(i, t, "en", "clash") for i, t in enumerate(TEXTS)] + [(0, TEXTS[5], None, "clash"), (None, "z", "en", None)]
    got = Q.stats(spark.createDataFrame(rows, DOCS)).collect()
    want = sorted((str(i), *brute(t)) for i, t, _, _ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


@pytest.mark.parametrize("n,k,p", [(0, 0, 0.1), (10, 0, 0.1), (500, 3, 0.0125), (5000, 40, 0.0125), (100_000, 1100, 0.0125), (50, 20, 0.1)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(Q.binomial_tail(F.lit(n), F.lit(k), p)).first()[0]
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
    want = 1.0 if k >= n * p else sum(map(math.exp, logs))
    assert got == pytest.approx(want, rel=1e-8)


def test_cutoffs_hold_on_the_holdout(spark):
    clean = " ".join(f"w{i}" for i in range(40))
    rows = [(i, clean + " *" * (i % 100 == 0) * 8, "en", "") for i in range(2000)]
    rows += [(10_000 + i, clean.replace("w", "*w"), "en", "") for i in range(300)] + [(20_000, clean.replace("w", "*w"), None, "")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[0] < 10_000), 0) for r in rows if r[0] != 20_000] + [(3, None, 0), (77_777, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in Q.apply_rules(docs, labels).collect()}
    good = [out[i].kept for i in range(2000)]
    assert len(out) == len(rows) and 1 - sum(good) / 2000 <= Q.RISK
    assert not any(out[10_000 + i].kept for i in range(300))
    assert out[20_000].kept  # no labels in its stratum
    few = Q.apply_rules(docs, labels.limit(20)).where("kept").count()
    assert few == len(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", "en", "")], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in Q.apply_rules(docs, labels).collect()] == [True]
    assert Q.apply_rules(docs.limit(0), labels).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a", "en", "")], DOCS)
    assert "Python" not in Q.stats(docs)._jdf.queryExecution().toString()
