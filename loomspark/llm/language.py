"""Language identification by a linear-chain conditional random field.

Every word of a text is labelled with a language.  A word's emission score is the sum
of learned weights of its character n-grams (1 to 4, over the word between boundary
signs, so the n-grams at its ends are its affixes) and of its lexicon entry; learned
transitions tie neighbours together.  Forward-backward gives each word's posterior; the
text's language is the one with the largest share of the posterior mass and the share
is its score.  Chains cover CHAIN consecutive words each and together the whole text.

Training (``fit``) reads at most ``per_label`` documents of each label - a documented
bound - chosen by a hash of their id, and fewer where they are long: ``label_chars``
bounds the characters expected of a label.  Half of the chains are spliced from two
documents of different languages, so that the transitions learn to switch.  Weights
start from smoothed log frequencies and follow the exact gradient of the conditional
likelihood (AdaGrad).  Labels come from the training rows alone; a prediction reads
nothing but the text.

Defined cases: null text or a text without letters is ``und`` with score 0; a tie goes
to the first label by name; a model without labels calls everything ``und``; a null id
is held out; repeated rows are each labelled; extra columns are carried through, but for
ones named as the two that ``identify`` adds, which it replaces.  Words are runs of
letters: number signs and combining marks belong to none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_batches, release_others

CHAIN, DIMS, GRAMS, PER_LABEL, STEPS, RATE, BLOCK_WORDS, CACHE = 64, 1 << 17, 4, 200, 25, 0.15, 1 << 16, 250_000
LABEL_CHARS = 2_000_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
BLOCK_TYPES, BLOCK_CHAINS = 10_000, 2048
_EMISSIONS: dict[int, tuple[dict[str, int], np.ndarray]] = {}


def spans_of(text: str) -> list[tuple[int, int]]:
    """[start, end) of the words of a text."""
    found = [m.span() for m in _WORD.finditer(text)]
    if all(text[a:b].isalpha() for a, b in found):
        return found
    return [(a + x, a + y) for a, b in found for x, y in _letters(text[a:b])]


def _letters(word: str) -> list[tuple[int, int]]:
    """The runs of letters of a word that may hold number signs."""
    edge = np.flatnonzero(np.diff([0, *(c.isalpha() for c in word), 0])).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


def words_of(text: str | None) -> list[str]:
    """The lower-case words of a text, one for each of ``spans_of``."""
    found = _WORD.findall(text) if text else []
    if not found:
        return []
    if not "".join(found).isalpha():
        found = [w[a:b] for w in found for a, b in _letters(w)]
    whole = "\n".join(found)
    return whole.lower().split("\n") if whole else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, laid end to end, and where each word's begin."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    base = np.cumsum(size) - size
    left = np.repeat(base + size, size) - np.arange(len(codes))  # signs from here to the word's end
    found, owner = [], []
    whose = np.repeat(np.arange(len(words)), size)
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, GRAMS + 1):
        h = (h[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        ok = np.flatnonzero(left[: len(h)] >= n)
        found.append(h[ok])
        owner.append(whose[ok])
    whole = np.zeros(len(words), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):  # the lexicon entry: all signs in order
        ok = size > k
        whole[ok] = (whole[ok] + codes[base[ok] + k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        whole[ok] ^= whole[ok] >> np.uint64(29)
    found.append(whole)
    owner.append(np.arange(len(words)))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    ids = (np.concatenate(found)[order] % np.uint64(DIMS)).astype(np.int64)
    return ids, np.searchsorted(owner[order], np.arange(len(words)))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (DIMS, labels)
    trans: np.ndarray  # (labels, labels), log scores
    key: int = 0

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        ids, at = features(words)
        return np.add.reduceat(self.weights[ids], at, axis=0)


def marginals(emit: np.ndarray, trans: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over padded chains (n, CHAIN, labels), each of ``length`` words.

    The posterior of each word's label, the expected transitions, the log likelihood's
    normaliser, summed.
    """
    n, steps, labels = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e, t = np.exp(emit - top), np.exp(trans - trans.max())
    inside = np.arange(steps)[None, :] < length[:, None]
    forward, scale = np.empty_like(e), np.ones((n, steps))
    a = e[:, 0] / labels
    for k in range(steps):
        if k:
            a = (a @ t) * e[:, k]
        scale[:, k] = a.sum(axis=1)
        a = a / scale[:, k : k + 1]
        forward[:, k] = a
    backward = np.ones((n, labels))
    post, moves = np.empty_like(e), np.zeros((labels, labels))
    for k in range(steps - 1, -1, -1):
        backward = np.where(inside[:, k : k + 1], backward, 1.0)
        p = forward[:, k] * backward
        post[:, k] = p / p.sum(axis=1, keepdims=True) * inside[:, k : k + 1]
        if k:
            later = e[:, k] * backward * inside[:, k : k + 1]
            moves += ((forward[:, k - 1] / scale[:, k : k + 1]).T @ later) * t
            backward = np.where(inside[:, k : k + 1], (later @ t.T) / scale[:, k : k + 1], 1.0)
    log_z = float(((np.log(scale) + top[:, :, 0]) * inside).sum() + (length - 1).clip(0).sum() * trans.max())
    return post, moves, log_z


def _chains(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids cut into padded chains."""
    count = -(-len(ids) // CHAIN)
    grid = np.zeros(count * CHAIN, np.int64)
    grid[: len(ids)] = ids
    length = np.full(count, CHAIN)
    if count:
        length[-1] = len(ids) - (count - 1) * CHAIN
    return grid.reshape(count, CHAIN), length


def train(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 1) -> Model:
    """A model from (text, label) rows."""
    texts = [(w, y) for t, y in rows if (w := words_of(t))]
    labels = sorted({y for _, y in texts})
    n_labels, index = len(labels), {y: k for k, y in enumerate(labels)}
    if not labels:
        return Model([], np.zeros((DIMS, 0), np.float32), np.zeros((0, 0)))
    types = {w: k for k, w in enumerate(sorted({w for ws, _ in texts for w in ws}))}
    rng, seqs = np.random.default_rng(seed), []
    coded = [(np.array([types[w] for w in ws]), index[y]) for ws, y in texts]
    for ids, y in coded:
        seqs += [(ids[k : k + CHAIN], np.full(len(ids[k : k + CHAIN]), y)) for k in range(0, len(ids), CHAIN)]
    for _ in range(len(seqs) if n_labels > 1 else 0):
        (a, x), (b, y) = (coded[k] for k in rng.integers(0, len(coded), 2))
        if x != y:
            i, j = rng.integers(1, CHAIN // 2, 2)
            p, q = rng.integers(0, max(1, len(a) - i)), rng.integers(0, max(1, len(b) - j))
            a, b = a[p : p + i], b[q : q + j]
            seqs.append((np.concatenate([a, b]), np.repeat([x, y], [len(a), len(b)])))
    length = np.array([len(s) for s, _ in seqs])
    grid, gold = np.zeros((len(seqs), CHAIN), np.int64), np.zeros((len(seqs), CHAIN), np.int64)
    for k, (s, y) in enumerate(seqs):
        grid[k, : len(s)], gold[k, : len(s)] = s, y
    inside = np.arange(CHAIN)[None, :] < length[:, None]
    ids, at = features(list(types))
    of_type = np.repeat(np.arange(len(types)), np.diff(np.append(at, len(ids))))

    parts = [(k, min(k + BLOCK_TYPES, len(types))) for k in range(0, len(types), BLOCK_TYPES)]
    upto = np.append(at, len(ids))

    def by_feature(per_type: np.ndarray) -> np.ndarray:
        out = np.zeros((DIMS, n_labels))
        for a, b in parts:
            own, whose = ids[upto[a] : upto[b]], of_type[upto[a] : upto[b]]
            for y in range(n_labels):
                out[:, y] += np.bincount(own, per_type[whose, y], DIMS)
        return out

    def by_type() -> np.ndarray:
        return np.concatenate([np.add.reduceat(weights[ids[upto[a] : upto[b]]], at[a:b] - at[a], axis=0) for a, b in parts])

    one_hot = np.eye(n_labels)
    seen = np.stack([np.bincount(grid[inside], gold[inside] == y, len(types)) for y in range(n_labels)], axis=1)
    counts = by_feature(seen) + 0.5
    weights = np.log(counts / counts.sum(axis=0))
    weights = (weights - weights.mean(axis=1, keepdims=True)) * 0.2
    moves_gold = np.zeros((n_labels, n_labels))
    pair = inside[:, 1:]
    np.add.at(moves_gold, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
    trans = np.log(moves_gold + 1.0) - np.log((moves_gold + 1.0).sum(axis=1, keepdims=True))
    total, sum_w, sum_t = inside.sum(), np.full(weights.shape, 1e-8), np.full(trans.shape, 1e-8)
    for _ in range(steps):
        emit, moves, per_type = by_type(), np.zeros_like(trans), np.zeros((len(types), n_labels))
        for k in range(0, len(grid), BLOCK_CHAINS):
            g, within = grid[k : k + BLOCK_CHAINS], inside[k : k + BLOCK_CHAINS]
            post, moved, _ = marginals(emit[g], trans, length[k : k + BLOCK_CHAINS])
            diff = (one_hot[gold[k : k + BLOCK_CHAINS]] - post)[within]
            moves += moved
            for y in range(n_labels):
                per_type[:, y] += np.bincount(g[within], diff[:, y], len(types))
        grad = by_feature(per_type) / total - 1e-7 * weights
        grad_t = (moves_gold - moves) / total
        sum_w += grad * grad
        sum_t += grad_t * grad_t
        weights += RATE * grad / np.sqrt(sum_w)
        trans += RATE * grad_t / np.sqrt(sum_t)
    return Model(labels, weights.astype(np.float32), trans, int(rng.integers(1 << 62)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, label: str = "lang", per_label: int = PER_LABEL, label_chars: int = LABEL_CHARS) -> Model:
    """A model from at most about ``per_label`` training documents and ``label_chars`` characters of each label.

    Labels are counted over all training rows; each is then thinned by a hash of the id,
    in its tasks, so that no label is gathered before it is small.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy(label).agg(F.count("*"), F.sum(F.char_length("text"))).collect()
    share = F.lit(0.0)
    for y, n, chars in counts:
        share = F.when(F.col(label) == y, min(1.0, per_label / n, label_chars / max(1, chars))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(draw < share).select("text", F.col(label).alias("label")).collect()
    return train(sorted((r.text, r.label) for r in picked))


def _posteriors(model: Model, texts: list[list[str]]) -> list[np.ndarray]:
    """For each text the posteriors (words, labels)."""
    release_others("language", _EMISSIONS.clear)
    if model.key not in _EMISSIONS:
        _EMISSIONS.clear()
        _EMISSIONS[model.key] = ({}, np.zeros((0, len(model.labels)), np.float32))
    known, table = _EMISSIONS[model.key]
    if len(known) > CACHE:
        known, table = {}, table[:0]
    new = list({w for ws in texts for w in ws}.difference(known))
    if new:
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        table = np.concatenate([table, model.emissions(new)])
    _EMISSIONS[model.key] = known, table
    cut = [_chains(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))) for ws in texts]
    post, _, _ = marginals(table[np.concatenate([c[0] for c in cut])].astype(np.float64), model.trans, np.concatenate([c[1] for c in cut]))
    out, at = [], 0
    for ws, (grid, _) in zip(texts, cut, strict=True):
        out.append(post[at : at + len(grid)].reshape(-1, post.shape[2])[: len(ws)])
        at += len(grid)
    return out


def _blocks(texts: list[str | None]):
    """(places, words) of consecutive texts with words, of about BLOCK_WORDS words."""
    places, held, size = [], [], 0
    for k, t in enumerate(texts):
        if w := words_of(t):
            places.append(k)
            held.append(w)
            size += len(w)
        if size > BLOCK_WORDS:
            yield places, held
            places, held, size = [], [], 0
    if held:
        yield places, held


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    for places, held in _blocks(texts) if model.labels else ():
        for k, p in zip(places, _posteriors(model, held), strict=True):
            share = p.sum(axis=0) / len(p)
            labels[k], scores[k] = model.labels[int(share.argmax())], float(min(1.0, share.max()))
    return labels, scores


def segments(text: str | None, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, label) of the runs of words of one language in a code-switched text."""
    if not (w := words_of(text)) or not model.labels:
        return []
    at = spans_of(text)
    best = _posteriors(model, [w])[0].argmax(axis=1)
    edge = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
    return [(at[a][0], at[b - 1][1], model.labels[best[a]]) for a, b in zip(edge, edge[1:], strict=False)]


def identify(docs: DataFrame, model: Model, added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with lang_pred and score; all other columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select([c for c in docs.columns if c.lower() not in added])
    at, names = docs.columns.index("text"), [*docs.columns, *added]

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        labels, scores = predict(batch.column(at).to_pylist(), sent.value)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, label, f"{schema}, `{added[0]}` string, `{added[1]}` double")


def reject(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The documents with a language that holds at least ``least`` of the text."""
    added = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    kept = identify(docs, model, added).where((F.col(added[0]) != UNKNOWN) & (F.col(added[1]) >= least))
    return kept.select(docs.columns)
