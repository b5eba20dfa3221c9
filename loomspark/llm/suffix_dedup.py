"""Suffix-array dedup of passages that repeat anywhere in a corpus.

A window is ``length`` bytes of a text.  Every window has an anchor, the place of its
smallest GRAM-byte hash, so equal windows have equal anchors; windows next to each
other share one, and such a run is one row (key, span hash, place).  The rows are what
is shuffled, about a sixth of the text, and each (key, span) is counted on the map side
first: exact copies of a run, however many, are settled by their count.

Runs of one key with different spans are laid out in one text in order of their first
occurrence.  There the suffix array is built by prefix doubling up to ``length``, and
the previous and next smaller positions in suffix order give the longest previous
factor of each window, their mirror images the longest next factor.  A window whose
longest previous factor reaches ``length`` is a later copy; ``keep="first"`` removes
those only, ``keep="none"`` also the first one of each.

A key with more than GROUP spans would make a task grow.  Its runs are cut into blocks
of windows at fixed offsets from the anchor, whose new key is a hash of the bytes that
all windows of a block contain, and what is left of such a key is cut into single
windows, which need counting only.  Blocks go through the same suffix arrays; nothing
is dropped or sampled.

All hashes are 64 or 128 bits; keys only bring rows together, and a span's hash of 64
bits is compared within a key of 64 bits.

Defined cases: null is an empty text; texts under ``length`` bytes are never changed;
repeated rows are copies of each other, and ``keep="first"`` keeps one of them; matches never cross texts; extra columns are
not read; removing bytes may leave bytes that are no UTF-8, so ``kept`` is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_session, lasting, map_batches, materialize, scratch

LENGTH, GRAM, GROUP, CUTS, BATCH_BYTES = 400, 128, 256, (16, 1), 1 << 20
_C = np.random.default_rng(7).integers(0, 1 << 63, GRAM // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FIRST = 7


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a text: (key, first window, windows, offset of the anchor from it)."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    gram = min(GRAM, length // 16 * 8)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).astype(np.uint64)
    eight ^= eight >> np.uint64(29)
    key = np.zeros(len(data) - gram + 1, np.uint64)
    for k in range(gram // 8):
        key += eight[8 * k : 8 * k + len(key)] * _C[k]
    key = _mix(key)
    value = (key & ~np.uint64((1 << 32) - 1)) | np.arange(len(key), dtype=np.uint64)
    w = length - gram + 1
    pad = -len(value) % w
    grid = np.concatenate([value, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    before = np.minimum.accumulate(grid, axis=1).reshape(-1)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    at = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & np.uint64((1 << 32) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return key[at[first]].view(np.int64), first, np.diff(np.append(first, n)), at[first] - first


class SuffixRanks:
    """Ranks of all suffixes by their first ``cap`` symbols; texts end at zero symbols."""

    def __init__(self, text: np.ndarray, cap: int):
        """``text``: symbols 1 .. 256, and 0 between texts."""
        self.cap, n = cap, len(text)
        padded = np.concatenate([text.astype(np.int64), np.zeros(_FIRST, np.int64)])
        packed = np.zeros(n, np.int64)
        for k in range(_FIRST):
            packed = (packed << 9) | padded[k : k + n]
        self.packed, self.levels, h = packed, [], _FIRST
        rank = self._rank(packed)
        while h < cap:
            self.levels.append((h, rank))
            step = min(h, cap - h)
            rank = self._rank(rank * np.int64(n + 1) + np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])[:n])
            h += step
        self.rank = rank
        ends = np.append(np.flatnonzero(text == 0), n)
        self.rest = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)

    @staticmethod
    def _rank(value: np.ndarray) -> np.ndarray:
        order = np.argsort(value)
        ordered = value[order]
        out = np.empty(len(value), np.int64)
        out[order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]])) if len(value) else 0
        return out

    def lcp(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes of suffixes i and j, up to ``cap``."""
        n, out = len(self.rank), np.zeros(len(i), np.int64)
        at = lambda a, k: np.where(k < n, a[np.minimum(k, n - 1)], 0)
        for h, rank in reversed(self.levels):
            out += h * (at(rank, i + out) == at(rank, j + out))
        differ = at(self.packed, i + out) ^ at(self.packed, j + out)
        for k in range(1, _FIRST):
            out += differ < np.int64(1) << np.int64(9 * (_FIRST - k))
        out = np.where(self.rank[i] == self.rank[j], self.cap, np.minimum(out, self.cap))
        return np.minimum(out, self.rest[i])  # a match that passes the end of one passes it of both


def _smaller_before(a: np.ndarray) -> np.ndarray:
    """For each element the nearest one before it that is smaller, or -1."""
    found = np.arange(-1, len(a) - 1)
    open_ = np.flatnonzero((found >= 0) & (a[found] > a))
    while len(open_):
        found[open_] = found[found[open_]]
        open_ = open_[(found[open_] >= 0) & (a[found[open_]] > a[open_])]
    return found


def longest_factors(text: np.ndarray, starts: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``starts`` (ascending) the longest match, up to ``cap``, that begins
    at an earlier one of them, and at a later one."""
    ranks = SuffixRanks(text, cap)
    m = len(starts)
    order = np.argsort(ranks.rank[starts] * np.int64(m) + np.arange(m))
    best = []
    for place in (order, m - 1 - order):  # earlier positions; mirrored, later ones
        out = np.zeros(m, np.int64)
        for way in (1, -1):
            near = _smaller_before(place[::way])
            has = np.flatnonzero(near >= 0)
            mine, other = order[::way][has], order[::way][near[has]]
            out[mine] = np.maximum(out[mine], ranks.lcp(starts[mine], starts[other]))
        best.append(out)
    return best[0], best[1]


def _ranges(flags: np.ndarray) -> list[int]:
    """[from, to, from, to ...] of the runs of true values."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).tolist()


def _resolve(spans: list[bytes], counts: list[int], length: int) -> list[tuple[list[int], list[int]]]:
    """For each span the ranges of windows with an earlier copy, and with any copy."""
    text = np.frombuffer(b"".join(spans), np.uint8).astype(np.int64) + 1
    sizes = np.array([len(s) for s in spans])
    base = np.cumsum(sizes) - sizes
    text = np.insert(text, base[1:], 0)
    base = base + np.arange(len(spans))
    n = np.array(counts)
    upto = np.cumsum(n)
    starts = np.repeat(base - (upto - n), n) + np.arange(upto[-1])
    earlier, later = longest_factors(text, starts, length)
    out = []
    for a, b in zip(upto - n, upto, strict=True):
        out.append((_ranges(earlier[a:b] >= length), _ranges(np.maximum(earlier[a:b], later[a:b]) >= length)))
    return out


def _by_suffix_array(groups: DataFrame, length: int) -> DataFrame:
    """key, span, earlier, later over rows (key, span, ord, count, text), whole keys at a time."""
    arrow_session(groups)
    rows = groups.repartition("key").sortWithinPartitions("key", "ord").select("key", "span", "count", "text")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(upto: int) -> pa.RecordBatch:
            found = _resolve([r[3] for r in held[:upto]], [r[2] for r in held[:upto]], length)
            ints = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in held[:upto]], pa.int64()), pa.array([r[1] for r in held[:upto]], pa.int64()),
                    pa.array([f[0] for f in found], ints), pa.array([f[1] for f in found], ints),
                ],
                ["key", "span", "earlier", "any"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BATCH_BYTES and held[-1][0] != row[0]:
                    yield flush(len(held))
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(len(held))

    return rows.mapInArrow(resolve, "key long, span long, earlier array<int>, any array<int>")


def runs(docs: DataFrame, length: int) -> DataFrame:
    """One row a run: key, span, doc_id, rid, first, count, off."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, spans, rows = [], [], []
        for k, text in enumerate(batch.column(2)):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            found = anchors(data, length)
            parts.append(found)
            rows += [k] * len(found[0])
            spans += [
                xxhash.xxh3_64_intdigest(data[s : s + c + length - 1], o)
                for s, c, o in zip(*(x.tolist() for x in found[1:]), strict=True)
            ]
        key, first, count, off = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in list(zip(*parts, strict=True)) or [()] * 4)
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key), pa.array(np.array(spans, np.uint64).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at),
                pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(off.astype(np.int32)),
            ],
            ["key", "span", "doc_id", "rid", "first", "count", "off"],
        )

    rows = docs.select("doc_id", "rid", "text").where(F.octet_length("text") >= length)
    return map_batches(rows, cut, f"key long, span long, doc_id {kind}, rid long, first int, count int, off int")


def _classed(pieces: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Each (key, span) once with its number and first of occurrences, and how many spans its key has."""
    cols = [c for c in pieces.columns if c not in ("key", "span", "n")]
    first = F.min(F.struct(*order, *[c for c in cols if c not in order])).alias("_f")
    classes = materialize(pieces.groupBy("key", "span").agg(F.sum("n").alias("n"), first), "classes")
    keys = classes.groupBy("key").agg(F.count("*").alias("spans"), F.sum("n").alias("total")).where("total > 1")
    return classes, materialize(keys, "keys")


def copies(docs: DataFrame, length: int = LENGTH, keep: str = "none", group: int = GROUP) -> DataFrame:
    """doc_id, rid, ranges: for each text with repeated windows, their ranges [from, to).

    ``docs``: doc_id, rid (a hash of the row), text.
    """
    found = materialize(runs(docs, length), "runs")
    classes, keys = _classed(found.withColumn("n", F.lit(1).cast("long")), ["doc_id", "rid", "first"])
    known = materialize(classes.join(keys, "key").select("key", "span", "n", "_f.*", "spans"), "repeated")
    # The spans' bytes, for keys with several: one shuffle of the texts.
    wanted = known.where("spans > 1").groupBy("doc_id", "rid").agg(
        F.collect_list(F.struct("key", "span", "n", "first", "count", "off", "spans")).alias("_runs")
    )
    texts = docs.alias("d").join(wanted.alias("w"), (F.col("d.rid") == F.col("w.rid")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def bytes_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(8)]
        rows = []
        for k, (text, each) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            data = text.as_py().encode("utf-8", "surrogatepass")
            for r in each.as_py():
                rows.append(k)
                end = r["first"] + r["count"] + length - 1
                for c, v in zip(cols, (r["key"], r["span"], r["n"], r["first"], r["count"], r["off"], r["spans"], data[r["first"] : end]), strict=True):
                    c.append(v)
        kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.int64(), pa.binary()]
        at = pa.array(rows, pa.int64())
        names = ["key", "span", "n", "first", "count", "off", "spans", "text", "doc_id", "rid"]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), batch.column(0).take(at), batch.column(1).take(at)], names
        )

    spans = map_batches(
        texts.select("d.doc_id", "d.rid", "d.text", "w._runs"),
        bytes_of,
        f"key long, span long, n long, first int, count int, off int, spans long, text binary, doc_id {kind}, rid long",
    )
    # A repeated row gives its spans more than once: they are the same.
    spans = materialize(spans, "spans")
    order = F.struct("doc_id", "rid", "first").alias("ord")
    answers = _by_suffix_array(spans.where(F.col("spans") <= group).select("key", "span", order, "count", "text"), length)
    hot = spans.where(F.col("spans") > group).select(
        F.col("key").alias("key0"), F.col("span").alias("span0"), F.lit(0).alias("at"), order, "n", "count", "off", "text"
    )
    parts = answers.select("key", "span", "earlier", "any")
    for cut in CUTS:
        if not hot.limit(1).count():
            break
        done, hot = _cut_finer(hot, cut, length, group)
        parts = parts.unionByName(done)
    lists = parts.groupBy("key", "span").agg(F.flatten(F.collect_list("earlier")).alias("earlier"), F.flatten(F.collect_list("any")).alias("any"))
    whole = F.array(F.lit(0), F.col("count"))
    known = known.join(lists, ["key", "span"], "left")
    # Of a run that occurs more than once, the first keeps what has no earlier copy elsewhere.
    part = F.coalesce("earlier" if keep == "first" else "any", F.array().cast("array<int>"))
    own = F.when((F.col("n") > 1) & F.lit(keep != "first"), whole).otherwise(part)
    rest = F.when(F.col("n") > 1, whole).otherwise(part)
    decided = known.select("key", "span", F.col("doc_id").alias("_d"), F.col("rid").alias("_r"), F.col("first").alias("_s"), own.alias("_own"), rest.alias("_rest"))
    decided = materialize(decided.where("size(_own) > 0 or size(_rest) > 0"), "decided")
    hit = found.join(decided, ["key", "span"])
    is_own = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("rid") == F.col("_r")) & (F.col("first") == F.col("_s"))
    mine = F.when(is_own, F.col("_own")).otherwise(F.col("_rest"))
    hit = hit.select("doc_id", "rid", F.transform(mine, lambda x: x + F.col("first")).alias("_w"))
    return hit.groupBy("doc_id", "rid").agg(F.flatten(F.collect_list("_w")).alias("ranges"))


def _cut_finer(hot: DataFrame, cut: int, length: int, group: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``cut`` windows of hot runs: what suffix arrays or counts settle, and the rest.

    Rows: key0, span0 (the run), at (its window with which the piece begins), ord, n,
    count, off (of the anchor from the piece), text.
    """
    ints = pa.int32()

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, cols = [], [[] for _ in range(6)]
        at, counts, offs, texts = (batch.column(k).to_pylist() for k in (2, 5, 6, 7))
        for k, (a, c, o, text) in enumerate(zip(at, counts, offs, texts, strict=True)):
            s = 0
            while s < c:  # blocks of windows whose anchor is at the same offsets // cut
                block = (o - s) // cut
                e = min(c, o - block * cut + 1)
                low, high = o - block * cut, o - block * cut - cut + 1 + length  # in every window of a full block
                rows.append(k)
                piece = text[s : e + length - 1]
                core = xxhash.xxh3_64_intdigest(text[max(low, 0) : high], block)
                span = xxhash.xxh3_64_intdigest(piece, o - s)
                for col, v in zip(cols, (core, span, a + s, e - s, o - s, piece), strict=True):
                    col.append(v)
                s = e
        take = pa.array(rows, pa.int64())
        words = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[:2]]
        return pa.RecordBatch.from_arrays(
            [*words, batch.column(0).take(take), batch.column(1).take(take), pa.array(cols[2], ints), batch.column(3).take(take),
             batch.column(4).take(take), pa.array(cols[3], ints), pa.array(cols[4], ints), pa.array(cols[5], pa.binary())],
            ["key", "span", "key0", "span0", "at", "ord", "n", "count", "off", "text"],
        )

    kind = hot.schema["ord"].dataType.simpleString()
    schema = f"key long, span long, key0 long, span0 long, at int, ord {kind}, n long, count int, off int, text binary"
    cutted = materialize(map_batches(hot.select("key0", "span0", "at", "ord", "n", "count", "off", "text"), pieces, schema), "pieces")
    classes, keys = _classed(cutted.select("key", "span", "n", "ord", "key0", "span0", "at", "count"), ["ord", "at"])
    classes = materialize(classes.join(keys, "key").select("key", "span", F.col("n").alias("_n"), "_f.key0", "_f.span0", "_f.at", "spans"), "classes")
    first = cutted.join(classes.where("spans > 1"), ["key", "span", "key0", "span0", "at"])
    answers = _by_suffix_array(
        first.where(F.col("spans") <= group).select("key", "span", F.struct("ord", "at").alias("ord"), "count", "text"), length
    )
    whole = F.array(F.lit(0), F.col("count"))
    own = cutted.join(classes.drop("spans").toDF("key", "span", "_n", "_k", "_s", "_a"), ["key", "span"])
    own = own.join(materialize(answers, "answers").toDF("key", "span", "_e", "_y"), ["key", "span"], "left")
    is_first = (F.col("key0") == F.col("_k")) & (F.col("span0") == F.col("_s")) & (F.col("at") == F.col("_a"))
    none = F.array().cast("array<int>")
    earlier = F.when(~is_first, whole).otherwise(F.coalesce("_e", none))
    any_ = F.when(F.col("_n") > 1, whole).otherwise(F.coalesce("_y", none))
    shift = lambda c: F.transform(c, lambda x: x + F.col("at"))
    done = own.select(F.col("key0").alias("key"), F.col("span0").alias("span"), shift(earlier).alias("earlier"), shift(any_).alias("any"))
    left = first.where(F.col("spans") > group).select("key0", "span0", "at", "ord", "n", "count", "off", "text")
    return materialize(done.where("size(earlier) > 0 or size(any) > 0"), "done"), left


def _told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``rid`` of its own for each of the rows that repeat an id and a text, so that one of them is the first."""
    counts = docs.groupBy("doc_id", "rid").agg(F.count("*").alias("_m")).where("_m > 1").drop("_m")
    repeated = lasting(counts, "repeats")
    if not repeated.limit(1).count():
        return docs
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.rid") == F.col("w.rid"))
    join = lambda how: docs.alias("d").join(repeated.alias("w"), same, how).select("d.doc_id", "d.text", "d.rid")
    rows = join("left_semi").withColumn("rid", F.xxhash64("rid", F.monotonically_increasing_id()))
    return join("left_anti").unionByName(lasting(rows, "numbered"))  # written, so that the numbers stay


def remove_copies(docs: DataFrame, length: int = LENGTH, keep: str = "none", group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, kept (bytes), spans (removed byte ranges) and counts of every row."""
    docs = docs.select("doc_id", "text").withColumn("rid", F.xxhash64("doc_id", "text"))
    if keep == "first":
        docs = _told_apart(docs)
    with scratch(docs.sparkSession):
        found = lasting(copies(docs, length, keep, group), "copies")
    both = docs.alias("d").join(found.alias("w"), (F.col("d.rid") == F.col("w.rid")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            spans, kept = [], data
            if ranges.is_valid:
                edge = np.array(ranges.as_py(), np.int64).reshape(-1, 2)
                change = np.zeros(len(data) + 1, np.int32)
                np.add.at(change, edge[:, 0], 1)
                np.add.at(change, edge[:, 1] + length - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                spans = np.array(_ranges(gone)).reshape(-1, 2).tolist()
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            values = (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in spans])
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), span]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return map_batches(
        both.select("d.doc_id", "d.text", "w.ranges"),
        strip,
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:int,end:int>>",
    )
