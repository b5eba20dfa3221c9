"""Golden cases of the normalisers."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import draws as R
from loomspark.functions import similarity as S
from loomspark.functions import text as X

CASES = [
    (X.WHITESPACE, "text  with   spaces", "text with spaces"), (X.WHITESPACE, "- leading dash", "leading dash"), (X.WHITESPACE, "trailing dash -", "trailing dash"),
    (X.BRACKETS, "its excise [added]", "its excise added"), (X.INSERTIONS, "release (them) to", "release to"), (X.INSERTIONS, "the (message) came", "the came"),
    (X.INSERTIONS, "you (fem. plur.) have (?)", "you have"), (X.PUNCTUATION, "the end ..", "the end."), (X.PUNCTUATION, "he said , that", "he said, that"),
    (X.HALF_BRACKETS, "{⸢d⸣}UTU", "{d}UTU"), (X.BROKEN_BRACKETS, "a-[na]", "a-<gap>"), (X.MACRONS, "bêlu", "bēlu"), (X.DECIMAL_TO_FRACTIONS, "1.3333 mina", "1 ⅓ mina"),
    (X.DECIMAL_TO_FRACTIONS, "1.3333300000000001", "1 ⅓"), (X.DECIMAL_TO_FRACTIONS, "0.75 mina", "0.75 mina"), (X.DECIMAL_TO_FRACTIONS, "0.5 of 2.25", "½ of 2 ¼"),
    (X.GAP_MARKS, "<gap> <gap>", "<big_gap>"), (X.GAP_MARKS, "[x x]", "[<big_gap>]"), (X.GAP_MARKS, "x-kam", "<gap>-kam"), (X.GAP_MARKS, "a … b [...] c", "a <big_gap> b <big_gap> c"),
    (X.LINE_DIVIDERS, "text / more text", "text   more text"), (X.SLASH_FRACTIONS, "1 / 4 and 2/3", "¼ and ⅔"), (X.SUBSCRIPTS, "bi₄ₓ", "bi4"), (X.SUBSCRIPTS_KEEP_X, "biₓ", "bix"),
    (X.DETERMINATIVES, "(TÚG)ṣú (determined)", "{TÚG}ṣú (determined)"), (X.SPECIAL_CHARS, "*wawālu* “a”—b", 'wawālu "a"-b'), (X.ASCII_TO_SIGNS, "sza2 t,u3 en6 h", "šá ṭù en6 ḫ"),
    (X.V2, "<big_gap>-<gap> <gap> a₂", "<gap> a2"), (X.ROUGH, " [A]  <gap> <gap> <big_gap> Ḫa₂ ", "a <gap> ha2"), (X.POSTPROCESS, '"a" (b) c\'s<gap>d <gap>-e <big_gap>', "a b cs <gap> d <gap>-e <gap>"),
    (X.SIGNS_TO_DECIMAL, "1 ⅓ ½", "1.33333 0.5"), (X.SIC, "a (sic) b sic", "a b"), (X.TABLET_ID, "Kt n/k 1,2_part3", "Kt n/k 12"), (X.SON_OF, "A s. B", "A son of B"),
]


@pytest.mark.parametrize("chain,given,want", CASES)
def test_golden(spark, chain, given, want):
    assert spark.range(1).select(X.normalize(F.lit(given), chain)).first()[0] == want


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_ocr(spark):
    given = "¹/₂ ma-na 1 2/3 GÍN dEN-líl Pu-šu=ke lu!? *a-na <<x>> <ma> a / b 3/8"
    assert one(spark, X.normalize_ocr(F.lit(given))) == "0.5 ma-na 1.66666 GÍN {d}EN-líl pu-šu-ke lu a-na ma a b 0.375".replace("{d}EN-líl", "{d}en-líl")


def test_nulls_and_empty(spark):
    for chain, _, _ in CASES:
        assert one(spark, X.normalize(F.lit(None).cast("string"), chain)) is None
        assert one(spark, X.normalize(F.lit(""), chain)) == ""
    assert one(spark, X.rough_key(F.lit(None).cast("string"))) == ""


def test_names_words_and_blank(spark):
    assert one(spark, X.name_case(F.lit("En-nam-A-šùr"))) == "en-nam-a-šùr"
    assert one(spark, X.tokens(F.lit("Um-ma A-šùr=i x/a:bb"))) == ["um", "ma", "šùr", "bb"]
    assert one(spark, X.present(F.lit(" "), F.lit(None).cast("string"), F.lit("b"))) == "b"
    assert one(spark, X.excerpt(F.lit("abcdef"), 3)) == "abc..."


def test_similarities(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices("abcé", k=rng.randrange(12))), "".join(rng.choices("abcé", k=rng.randrange(12)))) for _ in range(60)]
    rows += [("tide", "diet"), ("", ""), ("a", "")]

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.ratio(F.col("a"), F.col("b")).alias("r"), S.indel_ratio(F.col("a"), F.col("b")).alias("i"))
    for r in got.collect():
        assert r.r == pytest.approx(difflib.SequenceMatcher(None, r.a, r.b).ratio())
        assert r.i == pytest.approx(200 * lcs(r.a, r.b) / (len(r.a) + len(r.b)) if r.a or r.b else 100)
    assert one(spark, S.strip_marks(F.lit("šùr é"))) == "sur e"


def test_draws_do_not_depend_on_partitions(spark):
    a, b = (spark.range(500).repartition(n).select("id", R.uniform(3, F.col("id")).alias("u")) for n in (1, 7))
    assert sorted(a.collect()) == sorted(b.collect())
    u = [r.u for r in a.collect()]
    assert 0 <= min(u) and max(u) < 1 and 0.4 < sum(u) / len(u) < 0.6
