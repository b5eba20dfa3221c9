import random
import re

import numpy as np

from loomspark.llm import minhash as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, plain(t)) for i, t, *_ in rows]
    comp = {i: i for i, _ in sets if i is not None}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if None not in (a, b) and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return sorted(((str(i), len(s), None if i is None else find(i)) for i, s in sets), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def corpus(seed):
    rng, rows = random.Random(seed), []
    for g in range(6):
        base = [f"w{g}x{rng.randrange(400)}" for _ in range(rng.randrange(20, 200))]
        rows += [edited(rng, base, rng.randrange(0, 1 + len(base) // 20)) for _ in range(rng.randrange(1, 40))]
    rows += [rows[0], rows[0].upper(), rows[1] + " ", "short", "SHORT", "a b c d", "a  b\tc d", "", None, " \n", "é É", "É é", "é é"]
    rng.shuffle(rows)
    return [(k, t, "x", "clash") for k, t in enumerate(rows)] + [(None, "short", None, "clash"), (0, rows[0], "x", "clash")]


SCHEMA = "doc_id long, text string, node string, kept string"


def test_groups_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = M.find_groups(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
        assert sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
        assert all(r.kept == (r.doc_id in (None, r.component_id)) for r in got)


def test_deduplicate_keeps_columns(spark):
    docs = spark.createDataFrame([(2, "same text here", "a", "b"), (1, "Same text here", "a", "b"), (3, None, None, None)], SCHEMA)
    out = M.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_repeated_ids_are_one_document(spark):
    """An id of two texts links what is like either; of its rows one stays, and others' unique texts stay."""
    near = " ".join(f"n{k}" for k in range(40))
    rows = [(5, near, "a", "b"), (5, "entirely other words that stand here", "c", "d"), (1, "entirely other words that stand here", "e", "f")]
    rows += [(7, near + " more", "g", "h"), (8, "quite unique words of one document", "i", "j"), (8, "quite unique words of one document", "i", "j"), (9, None, "k", "l"), (9, None, "k", "l")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {(r.doc_id, r.component_id) for r in M.find_groups(docs).collect()}
    assert found == {(1, 1), (5, 1), (7, 1), (8, 8), (9, 9)}
    assert sorted(r.doc_id for r in M.deduplicate(docs).collect()) == [1, 8, 9, 9]


def test_empty(spark):
    assert M.find_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in M.components(edges).collect()}
    assert {got[k] for k in range(1, 61)} == {1} and got[101] == 100


def test_long_text_and_bayes_bounds():
    s = M.shingles("lorem ipsum " * 3 + " ".join(f"t{k}" for k in range(30_000)))
    assert len(M.signature(s)) == M.HASHES and len(s) > 30_000
    least = M.least_agreements(0.75, 1e-6)
    assert all(0 <= least[m] < 0.75 * m for m in range(M.BATCH, M.HASHES + 1, M.BATCH))
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, (2000, M.HASHES), dtype=np.uint64).astype(np.uint32)
    b = np.where(rng.random(a.shape) < 0.75, a, a + np.uint32(1))
    assert M.survives(a, b).all() and not M.survives(a, a + np.uint32(1)).any()


def test_blocks_find_every_link_across_components(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    rng = random.Random(4)
    base = [rng.randrange(1, 1 << 62) for _ in range(60)]
    sets = {k: sorted({*rng.sample(base, 55), *(rng.randrange(1, 1 << 62) for _ in range(rng.randrange(12)))}) for k in range(30)}
    comp = {k: 0 if k < 12 else k for k in sets}
    apart = spark.createDataFrame([(7, k, comp[k]) for k in sets] + [(8, 0, 0), (8, 1, 0)], "key long, node long, comp long")
    full = spark.createDataFrame([(k, bytearray(np.array(s, "<u8").tobytes())) for k, s in sets.items()], "node long, set binary")
    got = {tuple(sorted((r.a, r.b))) for r in M._across(apart, full).collect()}
    link = lambda a, b: 100 * len({*sets[a]} & {*sets[b]}) >= 75 * len({*sets[a]} | {*sets[b]})
    want = {(a, b) for a in sets for b in sets if a < b and comp[a] != comp[b] and link(a, b)}
    assert got == want and want
