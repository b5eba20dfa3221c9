import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, window=8):
    w, hit, found = plain_words(text), set(), set()
    for item_id, t in items:
        b = plain_words(t)
        n = min(window, len(b))
        pats = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in pats:
                hit.update(range(i, i + n))
                found.add(str(item_id))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text("aB é-9\n", max_size=60), st.lists(st.text("aB é-9\n", max_size=12), max_size=4))
def test_scan_equals_brute_force(text, items):
    a = D.build(next(D.pattern_blocks(enumerate(items), 3, 1 << 20), {}))
    hits = D.scan(a, D.words(text))
    covered = {k for i, j, _ in hits for k in range(i, j + 1)}
    n, n_hit, n_items, _ = brute(text, list(enumerate(items)), 3)
    assert (len(D.words(text)), len(covered), len({i for h in hits for i in h[2]})) == (n, n_hit, n_items)


ITEMS = [(1, "One two THREE four five six seven eight nine"), (10, "short answer"), (2, "one two three four five six seven eight"), (None, "zzz"), (3, ""), (3, None)]
DOCS = [
    (1, "x, one two-three four five six seven EIGHT nine! y", "k"), (1, "x, one two-three four five six seven EIGHT nine! y", "k"),
    (2, None, None), (3, "", "k"), (4, "a short answer. Short Answer", "k"), (None, "Ünot é one", "k"), (5, "w " * 50_000 + "short answer", "k"),
]


def frames(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string, items string"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_report(spark):
    docs, bench = frames(spark)
    for block in (1 << 20, 1):  # in one automaton, and in one for each item
        got = D.report(docs, bench, block_bytes=block).collect()
        items = [x for x in ITEMS if x[0] is not None]
        want = sorted((str(d), *brute(t, items)) for d, t, _ in DOCS)
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want
        for r in got:
            if r.doc_id == 1:
                text = DOCS[0][1]
                assert [text[s.start : s.end] for s in r.spans] == ["one two-three four five six seven EIGHT nine"]
                assert r.contaminated


def test_filter_keeps_rows_and_columns(spark):
    docs, bench = frames(spark)
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "5", "None"]
    clash = D.decontaminate(docs.withColumn("_HITS", docs.doc_id), bench)
    assert clash.columns == [*docs.columns, "_HITS"] and all(r._HITS == r.doc_id for r in clash.collect()) and clash.count() == 5


def test_empty_tables(spark):
    docs, bench = frames(spark)
    assert D.report(docs.limit(0), bench).count() == 0
    assert {r.n_items for r in D.report(docs, bench.limit(0)).collect()} == {0}
