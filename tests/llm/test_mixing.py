import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomspark.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, block string, t string"


def corpus(seed, shares):
    rng, rows = random.Random(seed), []
    for s, n in shares.items():
        rows += [(0, "w " * rng.randrange(1, 9), s) for _ in range(n)]
    rng.shuffle(rows)
    rows = [(k, t, s, "clash", "clash") for k, (_, t, s) in enumerate(rows)]
    return [*rows, (len(rows), None, "a", None, None), (rows[0][0], *rows[0][1:])]


def brute(rows, total, entropy, max_repeats):
    t = defaultdict(int)
    for r in rows:
        t[r[2]] += len(WORD.findall(r[1] or ""))
    pos = {s: n for s, n in t.items() if n}

    def shares(x):
        z = sum(n**x for n in pos.values())
        return {s: n**x / z for s, n in pos.items()}

    def h(x):
        return -sum(w * math.log(w) for w in shares(x).values())

    def repeats(x):
        if total == "cover":
            return (max(pos.values()) / min(pos.values())) ** (1 - x)
        return max(w * sum(pos.values()) / pos[s] for s, w in shares(x).items())

    x = 1.0
    if h(1) < entropy * math.log(len(pos)):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if h(mid) >= entropy * math.log(len(pos)) else (lo, mid)
        x = lo
    if repeats(x) > max_repeats:
        lo, hi = x, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if repeats(mid) > max_repeats else (lo, mid)
        x = hi
    w = shares(x)
    all_ = sum(pos.values()) if total == "same" else max(pos[s] / w[s] for s in pos)
    out = []
    for s in t:
        mine = [r for r in rows if r[2] == s]
        budget = math.floor(w.get(s, 0) * all_ + 1e-6)
        blocks, left = divmod(budget, t[s]) if t[s] else (1, 0)
        key = lambda r: hashlib.md5(f"mix/{blocks}/{'null' if r[0] is None else r[0]}".encode()).hexdigest()  # noqa: B023, E731
        run = 0
        groups = defaultdict(list)
        for r in mine:
            groups[key(r)].append(r)
            out += [(r[0], s, b) for b in range(blocks)]
        for k in sorted(groups):
            run += sum(len(WORD.findall(r[1] or "")) for r in groups[k])
            if left and run <= left:
                out += [(r[0], s, blocks) for r in groups[k]]
    return sorted(map(str, out))


@pytest.mark.parametrize("total", ["same", "cover"])
@pytest.mark.parametrize("shares", [{"a": 900, "b": 60, "c": 50, "d": 12, None: 40}, {"a": 100, "b": 90}, {"a": 5}])
def test_rows_equal_brute_force(spark, monkeypatch, total, shares):
    monkeypatch.setattr(M, "PER_RANGE", 40)
    rows = corpus(len(shares), shares) + [(10_000, "", "empty", None, None), (10_001, " ", "empty", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weighted = M.weights(docs, total)
    got = M.realise(docs, weighted).collect()
    assert sorted(str((r.doc_id, r.source, r.block)) for r in got) == brute(rows, total, M.ENTROPY, M.MAX_REPEATS)
    w = {r.source: r for r in weighted.collect()}
    assert sum(r.weight for r in w.values()) == pytest.approx(1)
    taken = Counter()
    for r in got:
        taken[r.source] += len(WORD.findall(r.text or ""))
    biggest = 8
    assert all(w[s].budget - 2 * biggest <= taken[s] <= w[s].budget for s in w if w[s].t)
    assert all(w[s].budget <= M.MAX_REPEATS * w[s].t for s in w if w[s].t)
    assert got[0].__fields__ == ["doc_id", "text", "source", "t", "block", "place"]  # the table's own block is replaced
    mixed = M.mix(docs, total)
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in got)
    assert {r.block for r in mixed.collect()} <= {"clash", None}
    if total == "cover":
        assert {r[0] for r in rows} == {r.doc_id for r in got}


def test_entropy_is_met(spark):
    docs = spark.createDataFrame(corpus(1, {"a": 500, "b": 200, "c": 150}), SCHEMA)
    w = [r.weight for r in M.weights(docs).collect()]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(M.ENTROPY * math.log(3), abs=1e-9)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA).drop("block")
    assert M.realise(docs, M.weights(docs)).count() == 0
    bare = spark.createDataFrame([(1, None, "a", None, None)], SCHEMA).drop("block")
    assert [r.block for r in M.realise(bare, M.weights(bare)).collect()] == [0]


def test_every_block_is_a_permutation_of_its_own(spark):
    docs = spark.createDataFrame([(k, "s", "a b") for k in range(40)], "doc_id long, source string, text string")
    weighted = M.weights(docs).withColumn("budget", F.lit(40 * 2 * 3 + 24).cast("long"))
    blocks: dict = {}
    for r in M.realise(docs, weighted).collect():
        blocks.setdefault(r.block, []).append((r.place, r.doc_id))
    whole = [[d for _, d in sorted(blocks[b])] for b in (0, 1, 2)]
    assert all(sorted(x) == list(range(40)) for x in whole) and len({tuple(x) for x in whole}) == 3
    want = sorted(range(40), key=lambda d: hashlib.md5(f"mix/3/{d}".encode()).hexdigest())[:12]
    assert [d for _, d in sorted(blocks[3])] == want


@pytest.mark.parametrize("total", ["same", "cover"])
def test_more_sources_than_are_broadcast(spark, monkeypatch, total):
    rows = corpus(3, {"a": 300, "b": 60, "c": 50, "d": 12, None: 40}) + [(10_000, "", "empty", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(M, "PER_RANGE", 40)
    want = sorted(map(str, M.realise(docs, M.weights(docs, total)).collect()))
    monkeypatch.setattr(M, "MAX_SOURCES", 3)
    got = M.realise(docs, M.weights(docs, total))
    assert sorted(map(str, got.collect())) == want
    assert sorted(str((r.doc_id, r.source, r.block)) for r in got.collect()) == brute(rows, total, M.ENTROPY, M.MAX_REPEATS)
