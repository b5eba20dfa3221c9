"""MinHash near-duplicates with sequential Bayesian verification.

A text's set is its distinct ``width``-word shingles (A-Z lower-cased, words split at
ASCII white space), each a 64-bit hash of its words.  Texts of equal sets are one node
from the start, by a map-side combined minimum, so groups of exact copies never grow
a bucket.  Signatures of ``BANDS * ROWS`` minima are cut into bands; a pair of
similarity 0.75 shares no band with probability (1 - 0.75**5)**40 = 2e-5.

Verification compares a candidate pair's signatures batch after batch.  After m
comparisons with s agreements the posterior of the similarity, from a uniform prior,
is Beta(s + 1, m - s + 1); the pair is pruned as soon as the chance that it reaches
the threshold is below ``miss``.  Survivors are verified on their full sets, so every
link returned is exact: 100 * intersection >= 75 * union.

All pairs of a bucket are never emitted.  A bucket is represented by hubs; its members
are compared with hubs (``BANDS`` random orders, so a large group of near copies meets
several), then components are formed, and only nodes of one bucket that still are in
different components are compared with each other, block by block inside tasks - the
exact way for what the hubs leave open.  Before that, nodes are set aside that have too few shingles
in common with all other components together, so most heavily edited copies do not
meet their whole group.
A link inside a component changes no result, so none that matters is lost.

Components: minimum label with pointer jumping over tables in the shared folder.

Defined cases: null texts and texts without words have the empty set and link with
nothing; a shorter text's only shingle is all its words; a null doc_id is linked with
nothing and its component is null; rows that repeat an id are one document, whose sets
are linked with each other where they differ, and ``deduplicate`` keeps one of them;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_session, lasting, map_batches, materialize, release_others, scratch

WIDTH, ROWS, BANDS, NEED, OF, MISS, BATCH, BLOCK = 5, 5, 40, 75, 100, 1e-6, 25, 256
HASHES = ROWS * BANDS
_RANDOM = np.random.default_rng(20240229)
_MUL = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    release_others("minhash", _WORDS.clear)
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > 500_000:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    total = np.full(n, np.uint64(min(width, len(h))))
    for k in range(min(width, len(h))):
        total += _mix(h[k : k + n] + _PLACE[k]) * _PLACE[k]
    return np.unique(_mix(total))


def signature(s: np.ndarray) -> np.ndarray:
    """The high half of the minimum of each hash function."""
    low = np.full(HASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 512):
        part = s[at : at + 512, None]
        for k in range(0, HASHES, 50):
            np.minimum(low[k : k + 50], ((part ^ _XOR[k : k + 50]) * _MUL[k : k + 50]).min(axis=0), out=low[k : k + 50])
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of (n, HASHES) signatures; the band's number is part of it."""
    grid = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), grid.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix(key * _PLACE[r] + grid[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash, sig, bands of every row."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, hashes, sigs = [], [], []
        for text in batch.column(1):
            s = shingles(text.as_py())
            n.append(len(s))
            hashes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s) if len(s) else None)
        full = np.array([x for x in sigs if x is not None], np.uint32).reshape(-1, HASHES)
        keys = iter(band_keys(full).tolist())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()),
                pa.array([None if x is None else x.astype("<u4").tobytes() for x in sigs], pa.binary()),
                pa.array([None if x is None else next(keys) for x in sigs], pa.list_(pa.int64())),
            ],
            ["doc_id", "n_shingles", "set_hash", "sig", "bands"],
        )

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
        sign,
        "doc_id long, n_shingles long, set_hash binary, sig binary, bands array<long>",
    )


@functools.cache
def least_agreements(need: float, miss: float) -> np.ndarray:
    """For 0 .. HASHES comparisons, the fewest agreements with which a pair goes on.

    The tail of Beta(s + 1, m - s + 1) over ``need`` is that of a binomial: the chance
    of at most s agreements in m + 1 trials.
    """
    least = np.zeros(HASHES + 1, np.int32)
    for m in range(BATCH, HASHES + 1, BATCH):
        term, below = (1 - need) ** (m + 1), 0.0
        for s in range(m + 1):
            below += term
            if below >= miss:
                break
            term *= (m + 1 - s) / (s + 1) * need / (1 - need)
        least[m] = s
    return least


def survives(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two (n, HASHES) signature arrays no batch prunes."""
    least, alive = least_agreements(NEED / OF, MISS), np.arange(len(a))
    agree = np.zeros(len(a), np.int32)
    for m in range(BATCH, HASHES + 1, BATCH):
        agree[alive] += (a[alive, m - BATCH : m] == b[alive, m - BATCH : m]).sum(axis=1, dtype=np.int32)
        alive = alive[agree[alive] >= least[m]]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact rule on two full sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= NEED * (len(a) + len(b) - both)


def _pruned(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of those pairs whose sizes and signatures leave a link possible."""
    side = nodes.select("node", "n_shingles", "sig")
    for x in "ab":
        pairs = pairs.join(side.toDF(x, f"n{x}", f"sig{x}"), x)
    pairs = pairs.where(f"{OF} * least(na, nb) >= {NEED} * greatest(na, nb)").select("a", "b", "siga", "sigb")

    def prune(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not len(batch):
            return None
        sig = [np.frombuffer(b"".join(c.to_pylist()), "<u4").reshape(-1, HASHES) for c in batch.columns[2:]]
        return pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(survives(*sig)))

    return map_batches(pairs, prune, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of those pairs that are linked on their full sets."""
    for x in "ab":
        pairs = pairs.join(sets.toDF(x, f"s{x}"), x)

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, other = batch.columns[2:]
        keep = [linked(*(np.frombuffer(x.as_py(), "<u8") for x in p)) for p in zip(one, other, strict=True)]
        return pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(pairs.select("a", "b", "sa", "sb"), verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node that each node of an edge table can reach."""
    both = materialize(edges.union(edges.select("b", "a")).distinct().toDF("node", "to"), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("comp")), "labels")
    while True:
        near = both.join(labels.toDF("to", "_c"), "to").groupBy("node").agg(F.min("_c").alias("_near"))
        hooked = labels.join(near, "node").select("node", "comp", F.least("comp", "_near").alias("_next"))
        jump = labels.toDF("_next", "_far")
        new = materialize(
            hooked.join(jump, "_next").select("node", F.least("_next", "_far").alias("comp"), (F.least("_next", "_far") != F.col("comp")).alias("_moved")),
            "labels",
        )
        labels = new.drop("_moved")
        if not new.where("_moved").limit(1).count():
            return labels


def _hub(order: Column) -> Column:
    return F.min_by("node", order)


def find_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row, written; scratch tables are gone."""
    with scratch(docs.sparkSession):
        return lasting(_groups(docs), "groups")


def _groups(docs: DataFrame) -> DataFrame:
    signed = materialize(signatures(docs), "signatures")
    full = signed.where("set_hash is not null and doc_id is not null")
    nodes = materialize(
        full.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.min(F.struct("n_shingles", "sig", "bands")).alias("_s"))
        .select("set_hash", "node", "_s.*"), "nodes",
    )
    # Different sets of one repeated id are one document: what links to either is linked.
    several = materialize(full.groupBy("doc_id").agg(F.min("set_hash").alias("_a"), F.max("set_hash").alias("_b")).where("_a < _b").select("doc_id"), "several")
    own = full.join(several, "doc_id", "left_semi").select("doc_id", "set_hash").join(nodes.select("set_hash", "node"), "set_hash")
    own = own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a < node")
    own = materialize(own.select("a", F.col("node").alias("b")).distinct(), "own") if several.limit(1).count() else None
    bands = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    hubs = materialize(
        bands.groupBy("key").agg(F.count("*").alias("n"), _hub(F.xxhash64("node", F.col("band") % 4)).alias("hub")).where("n > 1"),
        "hubs",
    )
    met = materialize(bands.join(hubs, "key").select("key", "node", "hub"), "buckets")
    pairs = met.where("node != hub").groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).agg(F.count("*").alias("shared"))
    pairs = materialize(pairs, "pairs")
    sets = _sets(docs, nodes, met)
    # First each node with the hub it shares most bands with.
    best = pairs.select(F.col("b").alias("node"), "a", "b", "shared").union(pairs.select(F.col("a").alias("node"), "a", "b", "shared"))
    first = best.groupBy("node").agg(F.max_by(F.struct("a", "b"), "shared").alias("_p")).select("_p.*").distinct()
    edges = materialize(_verified(_pruned(first, nodes), sets), "edges")
    edges = edges if own is None else edges.union(own)
    comp = components(edges)
    # Then its other hubs, and in buckets still apart the node that meets most others.
    apart = _open(met, comp)
    weight = apart.groupBy("node").agg(F.sum("_n").alias("_w"))
    centre = apart.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("_w", "node")).alias("hub"))
    more = apart.join(materialize(centre, "centres"), "key").where("node != hub")
    more = more.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    rest = materialize(_apart(pairs.select("a", "b").union(more).distinct(), comp), "pairs")
    edges = edges.union(materialize(_verified(_pruned(rest, nodes), sets), "edges"))
    comp = components(edges)
    # Then whatever can be linked at all with a node of its buckets in another component.
    apart = _open(met, comp)
    for _ in range(2):
        able = _linkable(apart, nodes, sets)
        apart = _open(apart.join(able.select("node"), "node", "left_semi"), comp)
    edges = edges.union(materialize(_across(apart.join(able, "node").select("key", "node", "comp"), sets), "edges"))
    comp = components(edges)
    known = nodes.join(comp, "node", "left").select("set_hash", F.coalesce("comp", "node").alias("_comp"))
    out = signed.select("doc_id", "n_shingles", "set_hash").join(materialize(known, "components"), "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_comp", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _open(met: DataFrame, comp: DataFrame) -> DataFrame:
    """key, node, comp, _n: the buckets whose nodes are not all in one component."""
    named = met.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y"), F.count("*").alias("_n"))
    return materialize(named.join(materialize(mixed.where("_x < _y").select("key", "_n"), "mixed"), "key"), "open")


def _linkable(apart: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Those nodes of ``apart`` that may be linked with one of another component, their
    sizes and how many of their shingles occur in other components.

    A link of sets of n and m shingles needs NEED * (n + m) / (NEED + OF) common ones.
    So many shingles of a node must occur in other components, with m the smallest size
    in its buckets that is not under NEED * n / OF.  The rule loses no link.
    """
    sized = apart.join(nodes.select("node", "n_shingles"), "node")
    least = materialize(sized.groupBy("key").agg(F.min("n_shingles").alias("_m")), "sizes")
    sized = sized.join(least, "key").groupBy("node", "comp", "n_shingles").agg(F.min("_m").alias("_m"))
    smallest = F.greatest(F.col("_m").cast("double"), F.col("n_shingles") * (NEED / OF))
    sized = materialize(sized.select("node", "comp", "n_shingles", ((F.col("n_shingles") + smallest) * (NEED / (NEED + OF)) - 1e-6).alias("_need")), "sized")

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = [np.frombuffer(x.as_py(), "<i8") for x in batch.column(1)]
        rows = np.repeat(np.arange(len(each)), [len(x) for x in each])
        node = batch.column(0).take(pa.array(rows))
        return pa.RecordBatch.from_arrays([node, pa.array(np.concatenate(each) if each else [], pa.int64())], ["node", "shingle"])

    spread_out = map_batches(sets.join(sized.select("node"), "node", "left_semi").select("node", "set"), spread, "node long, shingle long")
    held = materialize(spread_out.join(sized.select("node", "comp"), "node"), "held")
    common = held.groupBy("shingle").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y")).where("_x < _y").select("shingle")
    found = held.join(materialize(common, "common"), "shingle").groupBy("node").agg(F.count("*").alias("_found"))
    return materialize(sized.join(found, "node").where("_found >= _need").select("node", "n_shingles", "_found"), "able")


def _across(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """The links between different components in each bucket, on full sets.

    The nodes outside a bucket's largest component meet all of the bucket in blocks of
    BLOCK by BLOCK nodes.  A task holds two blocks; only links leave it.
    """
    arrow_session(apart)
    sizes = apart.groupBy("key", "comp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("_top"), F.sum("n").alias("_all"), F.max("n").alias("_most"))
    sizes = materialize(sizes.where("_all > _most").select("key", "_top", F.ceil(F.col("_all") / BLOCK).cast("int").alias("_in"), F.ceil((F.col("_all") - F.col("_most")) / BLOCK).cast("int").alias("_out")), "blocks")
    rows = apart.join(sizes, "key")
    place = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    inner = rows.select("key", place("_in").alias("i"), every("_out").alias("o"), F.lit(0).alias("side"), "node", "comp")
    outer = rows.where("comp != _top").select("key", every("_in").alias("i"), place("_out").alias("o"), F.lit(1).alias("side"), "node", "comp")
    rows = inner.union(outer).join(sets, "node").repartition("key", "i", "o").sortWithinPartitions("key", "i", "o", "side")

    def meet(held: list[list]) -> pa.RecordBatch:
        one, two = ([r for r in held if r[3] == side] for side in (0, 1))
        _, ids = np.unique(np.concatenate([np.frombuffer(r[6], "<u8") for r in one + two]), return_inverse=True)
        n = np.array([len(r[6]) // 8 for r in one + two])
        upto = np.cumsum(n)
        flat, mark = ids[: upto[len(one) - 1]], np.zeros(len(ids), bool)
        comp, found = np.array([r[5] for r in one]), []
        for k, r in enumerate(two, len(one)):
            mine = ids[upto[k] - n[k] : upto[k]]
            mark[mine] = True
            both = np.add.reduceat(mark[flat].astype(np.int64), upto[: len(one)] - n[: len(one)])
            mark[mine] = False
            hit = (OF * both >= NEED * (n[: len(one)] + n[k] - both)) & (comp != r[5])
            found += [(one[i][4], r[4]) for i in np.flatnonzero(hit)]
        return pa.RecordBatch.from_arrays([pa.array([f[s] for f in found], pa.int64()) for s in (0, 1)], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    if held[-1][3]:  # an outer node, and so always an inner one
                        yield meet(held)
                    held = []
                held.append(row)
        if held and held[-1][3]:
            yield meet(held)

    return rows.select("key", "i", "o", "side", "node", "comp", "set").mapInArrow(each, "a long, b long")


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    for x in "ab":
        pairs = pairs.join(comp.toDF(x, f"comp_{x}"), x, "left")
    return pairs.where("coalesce(comp_a, a) != coalesce(comp_b, b)").select("a", "b")


def _sets(docs: DataFrame, nodes: DataFrame, met: DataFrame) -> DataFrame:
    """node, set: the full sets of the nodes that share a bucket with another."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("text is not null")
    texts = texts.join(met.select("node").distinct(), "node", "left_semi")

    def full(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), found], ["node", "set"])

    return materialize(map_batches(texts, full, "node long, set binary"), "sets")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each group, the one of the smallest id; all columns kept.

    Of rows with words that repeat an id one stays, the one of the smallest hash of its text.
    """
    groups = find_groups(docs)
    gone = groups.where("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    again = groups.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1")
    again = lasting(again.select(F.col("doc_id").alias("_again")), "again")
    if not again.limit(1).count():
        return kept
    marked = kept.join(again, worded & (F.col("doc_id") == F.col("_again")), "left")
    one = marked.where("_again is not null").groupBy("_again").agg(F.min_by(F.struct(docs.columns), F.xxhash64("text")).alias("_r"))
    return marked.where("_again is null").select(docs.columns).unionByName(one.select("_r.*"))
