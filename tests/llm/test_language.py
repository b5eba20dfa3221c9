import itertools
import random
import zlib

import numpy as np

from loomspark.llm import language as L

WORDS = {"xx": ["baba", "dodo", "lumi", "basta", "doma"], "yy": ["kräx", "trüz", "zkorn", "xylt", "prüm"]}


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choices(WORDS[y := rng.choice(["xx", "yy"])], k=rng.randrange(3, 60))) + ".", y, "s") for k in range(n)]
    return [*rows, (n, None, "xx", "s"), (n + 1, " 12 -!", "yy", "s"), (None, "baba", "xx", "s"), (n + 2, "lumi " * 20_000, None, "s"), (1, rows[1][1], None, None)]


SCHEMA = "doc_id long, text string, lang string, score string"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    length = np.array([1, 3, 5])
    emit, trans = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3))
    post, moves, log_z = L.marginals(emit, trans, length)
    want, want_moves, want_z = np.zeros_like(post), np.zeros((3, 3)), 0.0
    for n, steps in enumerate(length):
        total, p, m = 0.0, np.zeros((steps, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(steps)):
            v = np.exp(sum(emit[n, k, y] for k, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += v
            for k, y in enumerate(path):
                p[k, y] += v
            for a, b in zip(path, path[1:], strict=False):
                m[a, b] += v
        want[n, :steps], want_moves, want_z = p / total, want_moves + m / total, want_z + np.log(total)
    assert np.allclose(post, want) and np.allclose(moves, want_moves)
    assert np.isclose(log_z - 3 * np.log(1 / 3), want_z)  # the first word's uniform prior


def test_features_do_not_depend_on_neighbours():
    ids, at = L.features(["ab", "über", "ab"])
    parts = np.split(ids, at[1:])
    assert np.array_equal(parts[0], parts[2]) and np.array_equal(L.features(["über"])[0], parts[1])


def test_code_switched_text():
    m = L.train([(t, y) for _, t, y, _ in corpus(80) if t and y])
    text = "Baba dodo lumi basta doma. KRÄX trüz zkorn xylt prüm"
    assert [(text[a:b], y) for a, b, y in L.segments(text, m)] == [("Baba dodo lumi basta doma", "xx"), ("KRÄX trüz zkorn xylt prüm", "yy")]


def test_words_are_runs_of_letters():
    m = L.train([(t, y) for _, t, y, _ in corpus(80) if t and y])
    assert L.predict(["½ ² Ⅷ", "12 ३ _", "", None], m) == (["und"] * 4, [0.0] * 4)
    assert L.words_of("a²b ½x Ⅷ") == ["a", "b", "x"] and L.words_of("ÉTÉ İİ") == ["été", "i̇i̇"]
    text = "İstanbul İİ baba"
    assert [(text[a:b]) for a, b in L.spans_of(text)] == ["İstanbul", "İİ", "baba"]
    assert all(0 <= a < b <= len(text) for a, b, _ in L.segments(text, m)) and L.segments(text, m)[-1][1] == len(text)


def test_prediction_equals_enumeration():
    """The label and score of short texts against a sum over all label paths."""
    m = L.train([(t, y) for _, t, y, _ in corpus(80) if t and y])
    for text in ("baba", "baba kräx", "dodo trüz prüm lumi", "neu worte baba xylt"):
        emit = m.emissions(L.words_of(text)).astype(float)
        mass, total = np.zeros(len(m.labels)), 0.0
        for path in itertools.product(range(len(m.labels)), repeat=len(emit)):
            v = np.exp(sum(emit[k, y] for k, y in enumerate(path)) + sum(m.trans[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += v
            for y in path:
                mass[y] += v / len(emit)
        (label,), (score,) = L.predict([text], m)
        assert label == m.labels[int(mass.argmax())] and np.isclose(score, mass.max() / total)


def test_documents(spark):
    """A column that has the name of an added one is replaced by ``identify`` and kept by ``reject``."""
    rows = corpus(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = L.identify(docs, L.fit(docs, per_label=50)).collect()
    assert out[0].__fields__ == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert len(out) == len(rows)
    told = {r.doc_id: r for r in out}
    held = [r for r in out if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50 and all(r.lang_pred == r.lang for r in held if r.lang) and all(0 <= r.score <= 1 for r in out)
    assert told[300].lang_pred == told[301].lang_pred == "und" and told[302].lang_pred == "xx"
    kept = L.reject(docs, L.fit(docs, per_label=50))
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2 and {r.score for r in kept.collect()} == {"s", None}
    bounded = L.fit(docs, label_chars=200)
    assert len(bounded.labels) <= 2


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None, "s")], SCHEMA).withColumnRenamed("score", "other")
    assert [r.lang_pred for r in L.identify(docs, L.fit(docs)).collect()] == ["und"]
    assert L.identify(docs.limit(0), L.fit(docs.limit(0))).count() == 0
