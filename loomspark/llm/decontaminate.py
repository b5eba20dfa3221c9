"""Benchmark decontamination: one Aho-Corasick automaton over the test items.

Normalisation works on UTF-8 bytes: A-Z become lower case, every other ASCII byte
that is not a letter or digit separates words, bytes over 0x7F belong to words.  A
normalised text is its words, each between single spaces, so a pattern found in it
always covers whole words.  A pattern is a window of ``window`` consecutive words of
an item (all its words where it has fewer).  The text is scanned once; the position
of a match gives its words by counting spaces, and the n-th word of the normalised
text is the n-th word of the original, which maps hits to original offsets.

Defined cases: a null or word-less text has no words and no hits; items without
words or without an id are ignored; two rows of one id are one item; an empty
benchmark hits nothing; repeated documents are each reported; ``decontaminate`` carries
all columns through untouched, whatever their names.

The automaton is broadcast in blocks of at most ``block_bytes`` of pattern text, so
what is sent never grows with the documents and its size is checked: a larger
benchmark is scanned block after block, with the hits so far written in between.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_batches, materialize, release_others

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_BUILT: dict[int, ahocorasick.Automaton] = {}

HITS = "array<struct<first:int,last:int,items:array<string>>>"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def item_windows(text: str | None, window: int) -> set[bytes]:
    """The patterns of one item, each with a space before and after."""
    w = words(text)
    return {b" %b " % b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


def pattern_blocks(items: Iterable, window: int, block_bytes: int) -> Iterator[dict[bytes, list[str]]]:
    """Patterns with the ids of their items, in blocks of bounded size."""
    block: dict[bytes, list[str]] = {}
    held = 0
    for item_id, text in items:
        for p in item_windows(text, window):
            held += len(p) + len(str(item_id)) + 64
            block.setdefault(p, []).append(str(item_id))
        if held > block_bytes:
            yield block
            block, held = {}, 0
    if block:
        yield block


def build(patterns: dict[bytes, list[str]]) -> ahocorasick.Automaton:
    """The automaton; a pattern's value is its number of words and its items."""
    a = ahocorasick.Automaton()
    for p, ids in patterns.items():
        a.add_word(p.decode("latin-1"), (p.count(b" ") - 1, tuple(sorted(set(ids)))))
    if patterns:
        a.make_automaton()
    return a


def scan(a: ahocorasick.Automaton, w: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
    """(first word, last word, items) of every occurrence, in order of its end."""
    if not len(a) or not w:
        return []
    text = (b" %b " % b" ".join(w)).decode("latin-1")
    found = list(a.iter(text))
    if not found:
        return []
    spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, [end for end, _ in found]) - 1
    return [(int(k) - n + 1, int(k), ids) for k, (_, (n, ids)) in zip(last, found, strict=True)]


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 8, block_bytes: int = 32 << 20, into: str = "_hits") -> DataFrame:
    """``docs`` with a column ``into``: every occurrence of a window, as word numbers and items."""
    rows = (
        (r[0], r[1])
        for r in benchmark.select("item_id", "text").where("item_id is not null").toLocalIterator()
    )
    spark, out = docs.sparkSession, docs.withColumn(into, F.lit(None).cast(HITS))
    first = True
    for block in pattern_blocks(rows, window, block_bytes):
        if not first:
            out = materialize(out, "hits")
        out, first = _pass(out, spark.sparkContext.broadcast(block), into), False
    return out


def _pass(docs: DataFrame, sent, name: str) -> DataFrame:
    key = sent._jbroadcast.id() if sent._jbroadcast is not None else id(sent)
    at, into = docs.columns.index("text"), docs.columns.index(name)
    hits = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("items", pa.list_(pa.string()))]))

    def hit(batch: pa.RecordBatch) -> pa.RecordBatch:
        release_others("decontaminate", _BUILT.clear)
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = build(sent.value)
        a = _BUILT[key]
        found = []
        for text, before in zip(batch.column(at), batch.column(into), strict=True):
            now = [{"first": i, "last": j, "items": list(ids)} for i, j, ids in scan(a, words(text.as_py()))]
            found.append((before.as_py() or []) + now if now or before.is_valid else None)
        return batch.set_column(into, name, pa.array(found, hits))

    return map_batches(docs, hit, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def report(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, **kw) -> DataFrame:
    """One row a document: counts, the items found and the hit spans of the original text.

    ``spans`` are code point offsets [start, end) into the original text, of maximal
    runs of hit words.  ``contaminated`` asks for ``min_items`` different items.
    """
    found = find_hits(docs.select("doc_id", "text"), benchmark, window, **kw)

    def tell(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for text, hits in zip(batch.column(1), batch.column(2), strict=True):
            text = text.as_py()
            n, hits, spans, items, n_hit = len(words(text)), hits.as_py(), [], [], 0
            if hits:
                items = sorted({i for h in hits for i in h["items"]})
                flag = np.zeros(n + 1, np.int32)
                for h in hits:
                    flag[h["first"]] += 1
                    flag[h["last"] + 1] -= 1
                on = np.cumsum(flag) > 0
                n_hit, at = int(on.sum()), [m.span() for m in _WORD.finditer(text)]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8)))))
                spans = [{"start": at[i][0], "end": at[j - 1][1]} for i, j in zip(edge[::2], edge[1::2], strict=True)]
            digest = hashlib.sha256(",".join(items).encode()).hexdigest()
            for c, v in zip(cols, (n, n_hit, len(items), digest, items, spans), strict=True):
                c.append(v)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), span)
        names = ("n_words", "n_hit", "n_items", "items_sha256", "items", "spans")
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_batches(
        found,
        tell,
        f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, "
        "spans array<struct<start:int,end:int>>",
    )
    return out.withColumn("contaminated", F.col("n_items") >= min_items)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, **kw) -> DataFrame:
    """The documents in which fewer than ``min_items`` items occur, all columns kept.

    No join: each row is judged where it is read, so repeated ids are no matter.
    """
    hits = fresh("_hits", docs.columns)
    items = F.array_distinct(F.flatten(F.col(f"{hits}.items")))
    out = find_hits(docs, benchmark, window, into=hits, **kw)
    return out.where(F.col(hits).isNull() | (F.size(items) < min_items)).select(docs.columns)
