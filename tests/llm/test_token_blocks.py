import struct
import zlib

import numpy as np
import pytest

from loomspark.llm import token_blocks as T
from loomspark.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, text_2 string"


@pytest.mark.parametrize("n", [0, 1, 63, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 1 << 16, 1 << 32])
def test_segment_round_trip(n, top):
    ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    image = T.encode_segment(ids)
    assert np.array_equal(T.decode_segment(image), ids)
    if n > 1024:
        assert np.array_equal(T.decode_segment(image, range(1, 2)), ids[1024:2048])


def test_outliers_go_to_the_exception_list():
    ids = np.full(1024, 7, np.uint32)
    ids[[3, 900]] = 50_000, 4_000_000_000
    image = T.encode_segment(ids)
    assert len(image) < 100
    assert np.array_equal(T.decode_segment(image), ids)


@pytest.mark.parametrize(
    "text",
    ["", " ", "  ", "a  b", "a   b", "a \n b", "a\n b \n", " lead", "trail ", "x  y   z", "it's 12 o'clock!!\n\n\n  ok",
     "tab\t \tq", "a \n\n  \t b   ", "<|endoftext|> x <|endoftext|>", "é ñ  ß😀 😀  ", "ⅻ ²x x² 12½ ـا הא\x1c\x1d \x1f a", "we're I'll 'tis don't's", " a", "x\u3000y\u2028 z \u1680", "日本 語 ひ\u200b"],
)
def test_cut_texts_have_the_ids_of_whole_texts(text):
    e = T.encoder(tokenizer_path())
    assert [e.encode(text)] == e.whole([text])


def test_both_patterns_cut_alike_round_every_common_character():
    for c in map(chr, range(0x2100)):
        if not T._UNCOMMON.search(c):
            text = f"a{c}b {c}{c} {c}1{c} '{c}s{c}'s  {c}\n {c}"
            assert T._COMMON_PIECES.findall(text) == T._PIECES.findall(text), hex(ord(c))


def test_forgetting_changes_nothing():
    e = T.Encoder(tokenizer_path())
    e.pieces.bound = 3
    text = "a few words, then a few more words and words again"
    assert [e.encode(text)] * 3 == e.whole([text] * 3)


def brute(rows):
    e, start, out = T.encoder(tokenizer_path()), 0, []
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_documents(spark):
    rows = [(k * 7 % 101, f"word{k} " * (k % 13), "x") for k in range(100)]
    rows += [(5, None, None), (5, "twice", None), (5, "twice", None), (None, "no id", None), (7, "long text " * 30_000, None)]
    seg = T.write_segments(spark.createDataFrame(rows, DOCS).repartition(7), tokenizer_path(), segment_ids=500)
    assert seg.count() > 2
    got = T.read_segments(seg, digest=True).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)
    whole = T.read_segments(seg).collect()
    assert sorted((r.start, r.n_tokens, zlib.crc32(r.ids)) for r in whole) == sorted(tuple(r)[1:] for r in got)
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole)


def test_empty_table(spark):
    assert T.read_segments(T.write_segments(spark.createDataFrame([], DOCS), tokenizer_path())).count() == 0
