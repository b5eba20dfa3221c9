import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import suffix_dedup as S


def brute(rows, length, keep="none"):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    out, met = {}, set()
    for k in order:
        d = data[k]
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            w = d[i : i + length]
            if seen[w] > 1 and (keep == "none" or w in met):
                gone[i : i + length] = True
            met.add(w)
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        n = len(S._ranges(gone)) // 2
        out[k] = (rows[k][0], len(d), int(gone.sum()), n, hashlib.sha256(kept).hexdigest())
    return sorted(map(str, out.values()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=4), st.integers(8, 30))
def test_factors_equal_brute_force(texts, cap):
    data = "\0".join(texts)
    text = np.array([0 if c == "\0" else ord(c) + 1 for c in data])
    starts = np.flatnonzero(text)
    earlier, later = S.longest_factors(text, starts, cap)

    def lcp(i, j):
        n = 0
        while n < cap and max(i, j) + n < len(data) and data[i + n] == data[j + n] != "\0":
            n += 1
        return n

    for k, i in enumerate(starts):
        assert earlier[k] == max([lcp(i, j) for j in starts[:k]], default=0)
        assert later[k] == max([lcp(i, j) for j in starts[k + 1 :]], default=0)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=400), st.integers(0, 120))
def test_equal_windows_have_equal_anchors(data, at):
    length = 64
    text = data + data[at : at + 150] + b"x" * 70 + data
    place = {}
    for key, first, count, off in zip(*(x.tolist() for x in S.anchors(text, length)), strict=True):
        for w in range(count):
            place[first + w] = (key, off - w)
    assert sorted(place) == list(range(max(0, len(text) - length + 1)))
    by = {}
    for i, p in place.items():
        assert by.setdefault(text[i : i + length], p) == p


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared, base, rows = [text(30) for _ in range(4)], text(80), []
    for k in range(n):
        kind = rng.randrange(6)
        t = text(rng.randrange(0, 40))
        if kind == 0:
            t += rng.choice(shared) + text(rng.randrange(0, 20)) + rng.choice(shared)[rng.randrange(60) :]
        elif kind == 1:
            cut = rng.randrange(len(base))
            t = base[:cut] + word() + base[cut + 3 :]
        elif kind == 2:
            t = word() * rng.randrange(1, 100)
        elif kind == 3 and rows:
            t = rng.choice(rows)[1]
        rows.append((k, t, "x"))
    return [*rows, (n, None, "x"), (n + 1, "", "x"), (3, rows[3][1], "y"), (None, rows[4][1], "y"), (n + 2, text(6000) + base, None)]


SCHEMA = "doc_id long, text string, key string"


@pytest.mark.parametrize("group", [256, 3])
def test_removal_equals_brute_force(spark, group):
    rows = corpus(group, 60)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = S.remove_copies(docs, 80, group=group).collect()
    assert sorted(str(tuple(r)[:5]) for r in out) == brute(rows, 80)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


@pytest.mark.parametrize("group", [256, 3])
def test_first_is_kept(spark, group):
    rows = [r for r in corpus(5, 50) if r[0] is not None and r[2] != "y"]
    out = S.remove_copies(spark.createDataFrame(rows, SCHEMA), 80, keep="first", group=group).collect()
    assert sorted(str(tuple(r)[:5]) for r in out) == brute(rows, 80, "first")


@pytest.mark.parametrize("group", [256, 3])
def test_first_of_repeated_rows_is_kept(spark, group):
    rows = corpus(6, 50)
    rows += [(rows[k][0], rows[k][1], "z") for k in (3, 8, 8, 20, 21, 22)] + [rows[-2], rows[-1]]
    docs = spark.createDataFrame(rows, SCHEMA)
    for parts in (1, 5):
        out = S.remove_copies(docs.repartition(parts), 80, keep="first", group=group).collect()
        assert sorted(str(tuple(r)[:5]) for r in out) == brute(rows, 80, "first")


@pytest.mark.parametrize("times", [2, 3])
def test_one_repeated_row_stays_whole(spark, times):
    text = corpus(7, 10)[-1][1]
    other = "x" + text[:200] + "y" + text[150:400]
    rows = [(1, text, "")] * times + [(2, other, "")] * times
    out = S.remove_copies(spark.createDataFrame(rows, SCHEMA), 80, keep="first").collect()
    assert sum(r.n_removed == 0 for r in out if r.doc_id == 1) == 1
    assert sorted(str(tuple(r)[:5]) for r in out) == brute(rows, 80, "first")


def test_empty(spark):
    assert S.remove_copies(spark.createDataFrame([], SCHEMA)).count() == 0
