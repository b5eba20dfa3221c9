"""Token-ID output in patched frame-of-reference (PFOR) segments.

A segment is one self-contained binary image:

    magic b"PFR1" | block size u32 | blocks u32 | ids u64
    index of block starts: u32 for each block, from the start of the data area
    block: minimum u32 | width u8 | pad u8 | exceptions u16
           | width * block / 64 packed u64 words | positions u16 * n | values u32 * n

A block stores ``id - minimum`` in ``width`` bits, the width that holds ``percentile``
per cent of its ids; ids that need more bits stand, whole, in the exception list and
their low bits in the packed area are ignored.  The last block is padded with its own
minimum.  The index lets a reader decode any block without those before it.

Segments are rows of a Parquet table in the shared folder (shard, seg, first, n_ids,
doc_ids, lengths, payload): Spark's own commit keeps the files whole when an executor
is lost, and any store Spark can reach will do.  Shards are ranges of doc_id, sorted
inside, so (shard, seg) order is ascending doc_id order, nulls first.

Defined cases: a null or empty text is the end id alone; equal doc_ids follow each
other in order of their text; an empty table gives no rows; no text is cut.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_session, materialize, release_others

BLOCK, PERCENTILE, SEGMENT_IDS, CACHE = 1024, 95, 1 << 18, 300_000
_HEAD, _BLOCK_HEAD = struct.Struct("<4sIIQ"), struct.Struct("<IBBH")
#: The pieces of a byte-level splitter (a fixed pattern), and the same where letters and
#: digits are those of Latin scripts: ranges are looked up faster than properties.
_PIECES = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+")
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_COMMON_PIECES = re.compile(
    rf" ?[{_LATIN}]++|'(?:[sdmt]|ll|ve|re)| ?[0-9]++| ?[^\s{_LATIN}0-9]++|\s+(?!\S)|\s+"
)
#: What is not plain Latin: among it numbers that are no digits, and separators that are
#: white space to Python alone.
_UNCOMMON = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u20ac]")
_DISPUTED = re.compile("[\x1c-\x1f\u1680-\u1fff\u2c00-\U0010ffff]")
_ENCODERS: dict[str, Encoder] = {}


class _Pieces(dict):
    """Ids of pieces, made when first asked for; when full, all goes but what is met again before it is full once more."""

    def __init__(self, make: Callable[[str], bytes], bound: int):
        super().__init__()
        self.make, self.bound, self.before = make, bound, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.bound:
            self.before = dict(self)
            self.clear()
        ids = self[piece] = self.before.get(piece) or self.make(piece)
        return ids


class Encoder:
    """Ids of whole texts, by the tokenizers library's model, each distinct piece encoded once.

    A text is cut into the pieces of the byte-level splitter.  For common scripts a
    simpler pattern of equal meaning does that; texts with characters of which the
    library and Python's patterns may think differently, or with a special token's
    text, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.special = self.tokenizer.model, [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = _Pieces(self._piece, CACHE)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.signs = {**{b: b for b in plain}, **{b: 256 + k for k, b in enumerate(other)}}
        self.space = chr(self.signs[32])

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _piece(self, piece: str) -> bytes:
        if piece[0] == " " and piece.isascii() and piece[1:].isalpha():
            signs = self.space + piece[1:]
        else:
            signs = piece.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian u32 ids."""
        if any(s in text for s in self.special):
            return self.whole([text])[0]
        if text.isascii() and not _DISPUTED.search(text) or not _UNCOMMON.search(text):
            return b"".join(map(self.pieces.__getitem__, _COMMON_PIECES.findall(text)))
        if _DISPUTED.search(text):
            return self.whole([text])[0]
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))


def encoder(path: str) -> Encoder:
    release_others("token_blocks", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 64 * k) values to (n, width * k) words: each 64 values fill ``width`` words."""
    lanes = values.reshape(-1, 64).astype(np.uint64)
    if width < 32:
        lanes &= np.uint64((1 << width) - 1)
    out = np.zeros((len(lanes), width), np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out.reshape(len(values), -1)


def unpack(packed: np.ndarray, width: int, block: int) -> np.ndarray:
    n = len(packed)
    if not width:
        return np.zeros((n, block), np.uint32)
    words, mask = packed.reshape(-1, width), np.uint64((1 << width) - 1)
    out = np.empty((len(words), 64), np.uint32)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = v & mask
    return out.reshape(n, block)


def encode_segment(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """A segment of u32 ids."""
    n, count = len(ids), -(-len(ids) // block)
    grid = np.zeros(count * block, np.uint32)
    grid[:n] = ids
    if n % block:
        grid[n:] = ids[(count - 1) * block :].min()
    grid = grid.reshape(count, block)
    low = grid.min(axis=1) if count else np.zeros(0, np.uint32)
    over = grid - low[:, None]
    at = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    widest = np.partition(over, at, axis=1)[:, at] if count else low
    width = np.frompyfunc(int.bit_length, 1, 1)(widest.astype(object)).astype(np.int64) if count else low
    image: list[bytes] = [b""] * count
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        packed = pack(over[rows], w)
        late = over[rows].astype(np.uint64) >> np.uint64(w) != 0
        for k, r in enumerate(rows.tolist()):
            where = np.flatnonzero(late[k])
            image[r] = b"".join((
                _BLOCK_HEAD.pack(int(low[r]), w, 0, len(where)), packed[k].astype("<u8").tobytes(),
                where.astype("<u2").tobytes(), over[r][where].astype("<u4").tobytes(),
            ))
    starts = np.cumsum([0, *map(len, image[:-1])]).astype("<u4") if count else np.zeros(0, "<u4")
    return b"".join([_HEAD.pack(b"PFR1", block, count, n), starts.tobytes(), *image])


def decode_segment(image: bytes, blocks: range | None = None) -> np.ndarray:
    """The ids of a segment, or of some of its blocks (through the index of starts)."""
    magic, block, count, n = _HEAD.unpack_from(image)
    if magic != b"PFR1":
        raise ValueError("not a PFR1 segment")
    starts = np.frombuffer(image, "<u4", count, _HEAD.size).astype(np.int64) + _HEAD.size + 4 * count
    wanted = range(count) if blocks is None else blocks
    heads = [_BLOCK_HEAD.unpack_from(image, starts[b]) for b in wanted]
    out, by_width = np.empty((len(wanted), block), np.uint32), {}
    for k, (_, w, _, _) in enumerate(heads):
        by_width.setdefault(w, []).append(k)
    for w, rows in by_width.items():
        words = w * block // 64
        packed = [np.frombuffer(image, "<u8", words, starts[wanted[k]] + _BLOCK_HEAD.size) for k in rows]
        out[rows] = unpack(np.array(packed).reshape(len(rows), words), w, block)
    for k, (low, w, _, late) in enumerate(heads):
        if late:
            at = starts[wanted[k]] + _BLOCK_HEAD.size + w * block // 8
            out[k, np.frombuffer(image, "<u2", late, at)] = np.frombuffer(image, "<u4", late, at + 2 * late)
        out[k] += np.uint32(low)
    last = n - (wanted[-1] * block) if len(wanted) and wanted[-1] == count - 1 else block
    return out.reshape(-1)[: max(0, (len(wanted) - 1) * block + last)] if len(wanted) else out.reshape(-1)


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode ``text`` in ascending doc_id order and write the segments; the written table."""
    arrow_session(docs)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    end, kind = struct.pack("<I", end_id), docs.schema["doc_id"].dataType.simpleString()
    names = ["shard", "seg", "first", "n_ids", "doc_ids", "lengths", "payload"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer_path), TaskContext.get().partitionId()
        doc_ids, held, size, seg, first = [], [], 0, 0, 0

        def flush(id_type):
            ids = np.frombuffer(b"".join(held), "<u4")
            row = ([shard], [seg], [first], [len(ids)], [doc_ids], [[len(x) // 4 for x in held]], [encode_segment(ids)])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                held.append(enc.encode(text.as_py() or "") + end)
                size += len(held[-1]) // 4
                if size >= segment_ids:
                    yield flush(id_type)
                    doc_ids, held, seg, first, size = [], [], seg + 1, first + size, 0
        if held:
            yield flush(id_type)

    out = ordered.mapInArrow(
        encode,
        f"shard int, seg int, first long, n_ids long, doc_ids array<{kind}>, lengths array<long>, payload binary",
    )
    return materialize(out, "segments", "zstd")


def read_segments(segments: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian u32 bytes) of every written document.

    With ``digest``, ids_crc32, the unsigned crc32 of those bytes, in place of them.

    The ids before a shard are summed over shards: one row a shard, of which there are
    as many as write tasks, so that table alone is broadcast.
    """
    base = segments.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = base.select("shard", F.coalesce(before, F.lit(0)).alias("_base"))
    rows = segments.join(F.broadcast(base), "shard").select(
        (F.col("_base") + F.col("first")).alias("start"), "doc_ids", "lengths", "payload"
    )
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    name, of = ("ids_crc32", "long") if digest else ("ids", "binary")

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, counts, found = [], [], []
        for start, lengths, image in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
            n = np.asarray(lengths.as_py(), np.int64)
            upto = np.cumsum(n)
            raw = decode_segment(image.as_py()).astype("<u4").tobytes()
            found += [raw[4 * (e - k) : 4 * e] for e, k in zip(upto.tolist(), n.tolist(), strict=True)]
            starts.append(start.as_py() + upto - n)
            counts.append(n)
        ids = batch.column(1).flatten()
        cat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (starts, counts)]
        last = pa.array(map(zlib.crc32, found), pa.int64()) if digest else pa.array(found, pa.binary())
        return pa.RecordBatch.from_arrays([ids, *cat, last], ["doc_id", "start", "n_tokens", name])

    arrow_session(rows)

    def one_by_one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                yield decode(batch.slice(k, 1))

    return rows.mapInArrow(one_by_one, f"doc_id {kind}, start long, n_tokens long, {name} {of}")

