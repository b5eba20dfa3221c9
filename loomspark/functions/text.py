"""Normalisation of transliterations and translations, as rule tables.

A public function here is ``Column -> Column``.  The order of rules inside a table and
of tables inside a composite is part of the meaning: earlier passes make or destroy what
later ones look for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import Chars, Compose, Lower, Rule, Sub, Text, apply

# Fraction signs and the decimal texts that stand for them.
FRACTIONS = {
    "½": "0.5", "⅓": "0.33333", "⅔": "0.66666", "¼": "0.25", "¾": "0.75", "⅕": "0.2", "⅖": "0.4", "⅗": "0.6",
    "⅘": "0.8", "⅙": "0.16666", "⅚": "0.83333", "⅛": "0.125", "⅜": "0.375", "⅝": "0.625", "⅞": "0.875",
}
# Slash fractions that have a sign.
SLASHED = {"5/6": "⅚", "1/6": "⅙", "2/3": "⅔", "1/3": "⅓", "1/4": "¼", "1/2": "½"}
# Decimals, with the float noise they may carry, that go back to a sign; in this order.
DECIMALS = [
    (r"8333[340]*[14]?", "⅚"), (r"1666[670]*[17]?", "⅙"), (r"6666[670]*[137]?", "⅔"),
    (r"3333[340]*[14]?", "⅓"), (r"5", "½"), (r"25", "¼"),
]
# Gap patterns, in this order.
GAPS = [
    (r"\bx(?:[\s-]+x)+\b", "<big_gap>", False), (r"\bxx+\b", "<big_gap>", False), (r"\[\.+\]", "<big_gap>", False),
    (r"\[…+\]", "<big_gap>", False), (r"\.{3,}", "<big_gap>", False), (r"…+", "<big_gap>", False),
    (r"\[x\]", "<gap>", True), (r"\(x\)", "<gap>", True), (r"\bx\b", "<gap>", False),
    (r"<gap>\s*<gap>", "<big_gap>", False), (r"<big_gap>\s*<big_gap>", "<big_gap>", False),
    (r"<gap>\s*<big_gap>", "<big_gap>", False), (r"<big_gap>\s*<gap>", "<big_gap>", False),
]
# Annotations of modern editors.
ANNOTATIONS = [
    (r"\s*\((?:fem|plur|pl|sing|singular|plural|masc|m|f)\.?\s*\w*\.?\)", True), (r"\s*\(\?\)", False), (r"\s*\(!\)", False),
    (r"\s*\((?:them|and|here|sent|i\.e\.|e\.g\.)\)", True),
]
# Consonants and vowel indices of the ASCII transliteration, in this order.
ASCII_SIGNS = [
    ("sz", "š"), ("SZ", "Š"), ("s,", "ṣ"), ("S,", "Ṣ"), ("t,", "ṭ"), ("T,", "Ṭ"), ("a2", "á"), ("A2", "Á"), ("e2", "é"), ("E2", "É"),
    ("i2", "í"), ("I2", "Í"), ("u2", "ú"), ("U2", "Ú"), ("a3", "à"), ("A3", "À"), ("e3", "è"), ("E3", "È"), ("i3", "ì"), ("I3", "Ì"),
    ("u3", "ù"), ("U3", "Ù"), ("h", "ḫ"), ("H", "Ḫ"),
]
# Letters outside the alphabet of the sources, and what replaces them, before and after gaps are merged.
SOURCE_LETTERS = [("āīēūĀĪĒŪâûîêḥḤś'*?()˹˺⸢⸣", "aieuAIEUauiehHšʾ"), ("×ÜüțȚ«»ⁱˢ¹\u0329", "xUutT")]
# Letters outside the alphabet of the targets, likewise.
TARGET_LETTERS = [("ĀĒĪŪÍÁÚḥḤüŞİȘᵖˡᵘʳ", "AEIUIAUhHuŠIṢ"), ("ÌÉʿěȟ⁄\u030c\u0304\u0329#*", "IEʾeh/")]

SUBSCRIPTS: list[Rule] = [Chars("₀₁₂₃₄₅₆₇₈₉ₓ", "0123456789")]
SUBSCRIPTS_KEEP_X: list[Rule] = [Chars("₀₁₂₃₄₅₆₇₈₉ₓ", "0123456789x")]
H_DOT: list[Rule] = [Chars("ḫḪ", "hH")]
FRACTIONS_TO_DECIMAL: list[Rule] = [Text(sign, decimal) for sign, decimal in FRACTIONS.items()]
DECIMAL_TO_FRACTIONS: list[Rule] = [
    rule for tail, sign in DECIMALS for rule in (Sub(rf"\b0\.{tail}\b", sign), Sub(rf"(\d+)\.{tail}\b", f"$1 {sign}"))
]
SLASH_FRACTIONS: list[Rule] = [Sub(rf"\b{f[0]}\s*/\s*{f[2]}\b", sign) for f, sign in SLASHED.items()]
GAP_MARKS: list[Rule] = [Sub(p, to, case) for p, to, case in GAPS]
DETERMINATIVES: list[Rule] = [Sub(r"\(([a-zA-ZÀ-ÿ]{1,5})\)", "{$1}")]
BRACKETS: list[Rule] = [Sub(r"\[([^\]]*)\]", "$1")]
UNMATCHED_BRACKETS: list[Rule] = [Chars("[]")]
HALF_BRACKETS: list[Rule] = [Chars("⸢⸣")]
CEILING_BRACKETS: list[Rule] = [Chars("⌈⌉")]
BROKEN_BRACKETS: list[Rule] = [Sub(r"\[[^\]]*\]", "<gap>")]
LINE_DIVIDERS: list[Rule] = [Text("/", " "), Text("§")]
INSERTIONS: list[Rule] = [Sub(p, "", case) for p, case in ANNOTATIONS]
SPECIAL_CHARS: list[Rule] = [Chars("—–‘’“”", "--''\"\""), Sub(r"\*([^*]+)\*", "$1")]
FIGURE_DASH: list[Rule] = [Chars("‒", "-")]
PUNCTUATION: list[Rule] = [Sub(r"\s+([.,;:?!])", "$1"), *[Sub(f"[{p}]{{2,}}", p) for p in ".,;:?!"]]
WHITESPACE: list[Rule] = [Sub(r"\s+", " "), Sub(r"^ | $", ""), Sub(r"^-+|-+$", ""), Sub(r"^ | $", "")]
MACRONS: list[Rule] = [Chars("ûîêÛÎÊ", "ūīēŪĪĒ")]
ASCII_TO_SIGNS: list[Rule] = [Text(a, b) for a, b in ASCII_SIGNS]
GAPS_ONE: list[Rule] = [Text("<big_gap>", "<gap>"), Sub(r"(?:<gap>\s*)+<gap>", "<gap>")]
GAPS_ONE_SPACED: list[Rule] = [Text("<big_gap>", "<gap>"), Sub(r"<gap>(?: <gap>)+", "<gap>")]
GAPS_ONE_HYPHEN: list[Rule] = [Text("<big_gap>", "<gap>"), Sub(r"<gap>(?:(?:\s*|-)<gap>)+", "<gap>")]
GAP_SPACING: list[Rule] = [Sub(r"(^|[^\s-])<gap>", "$1 <gap>"), Sub(r"<gap>([^\s-]|$)", "<gap> $1")]
QUOTES: list[Rule] = [Chars('"')]
PARENTHESES: list[Rule] = [Chars("()")]
APOSTROPHES: list[Rule] = [Chars("'")]
SIGNS_TO_DECIMAL: list[Rule] = [
    *[Sub(rf"(\d+)\s+{sign}", f"$1{decimal[1:]}") for sign, decimal in FRACTIONS.items()], *FRACTIONS_TO_DECIMAL
]
ROUGH: list[Rule] = [
    *SUBSCRIPTS, *H_DOT, *GAPS_ONE_SPACED, Chars("[](){}⸢⸣⌈⌉˹˺"), Sub(r"\s+", " "), Sub(r"^ | $", ""), Lower()
]
SON_OF: list[Rule] = [Sub(r"\bs\.\s", "son of ")]
SHEQEL: list[Rule] = [Sub("sheqel", "shekel", True)]
SIC: list[Rule] = [Sub(r"\s*\{sic\}\s*", " "), Sub(r"\s*\(sic\)\s*", " "), Sub(r"\bsic\b", ""), *WHITESPACE]
TABLET_ID: list[Rule] = [Sub(r"_part\d+$", ""), Text(","), Sub(r"\s+", " "), Sub(r"^ | $", "")]

COMMON: list[Rule] = [
    *CEILING_BRACKETS, *FRACTIONS_TO_DECIMAL, *SLASH_FRACTIONS, *SUBSCRIPTS_KEEP_X, *H_DOT, *GAP_MARKS
]
FINAL: list[Rule] = [*BRACKETS, *UNMATCHED_BRACKETS, *LINE_DIVIDERS, *INSERTIONS, *SPECIAL_CHARS, *FIGURE_DASH]
TIDY: list[Rule] = [*DECIMAL_TO_FRACTIONS, *SLASH_FRACTIONS, *PUNCTUATION, *WHITESPACE]
BASIC: list[Rule] = [*FRACTIONS_TO_DECIMAL, *SUBSCRIPTS, *H_DOT, *GAP_MARKS]
POSTPROCESS: list[Rule] = [*QUOTES, *PARENTHESES, *APOSTROPHES, *GAPS_ONE, *GAP_SPACING, *PUNCTUATION, *WHITESPACE]
V2: list[Rule] = [*SUBSCRIPTS, *GAPS_ONE_HYPHEN]
SOURCE_CHARS: list[Rule] = [Compose(), Chars(*SOURCE_LETTERS[0]), Text("ᵈ", "{d}"), *GAPS_ONE_SPACED, Chars(*SOURCE_LETTERS[1])]
TARGET_CHARS: list[Rule] = [Compose(), Chars(*TARGET_LETTERS[0]), *GAPS_ONE_SPACED, Chars(*TARGET_LETTERS[1])]


def source_rules(keep_half_brackets: bool = False) -> list[Rule]:
    half = [] if keep_half_brackets else HALF_BRACKETS
    return [*half, *COMMON, *DETERMINATIVES, *FINAL, *TIDY]


def target_rules(keep_half_brackets: bool = False) -> list[Rule]:
    half = [] if keep_half_brackets else HALF_BRACKETS
    return [*half, *COMMON, *FINAL, *MACRONS, *TIDY]


DICTIONARY_SOURCE: list[Rule] = [*source_rules(), *SOURCE_CHARS]
DICTIONARY_TARGET: list[Rule] = [*target_rules(), *TARGET_CHARS, *POSTPROCESS, *SIC]


def normalize(c: Column, rules: list[Rule]) -> Column:
    return apply(c, rules)


def rough_key(c: Column) -> Column:
    """The loose key under which two transliterations count as the same; never null."""
    return F.coalesce(apply(c, ROUGH), F.lit(""))


def normalize_source(c: Column, keep_half_brackets: bool = False) -> Column:
    return apply(c, source_rules(keep_half_brackets))


def normalize_target(c: Column, keep_half_brackets: bool = False) -> Column:
    return apply(c, target_rules(keep_half_brackets))


def postprocess(c: Column, fractions_to_decimal: bool = False) -> Column:
    """Model output in the form of the labels."""
    if not fractions_to_decimal:
        return apply(c, POSTPROCESS)
    head = [*QUOTES, *PARENTHESES, *APOSTROPHES, *GAPS_ONE, *GAP_SPACING]
    return apply(c, [*head, *SIGNS_TO_DECIMAL, *PUNCTUATION, *WHITESPACE])


def words(c: Column) -> Column:
    """Words at white space, as Python's split() has them."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-case tokens at white space, hyphens and ``= / :``, of two signs or more."""
    return F.filter(F.split(F.lower(c), r"(?U)[\s\-=/:]+"), lambda w: F.char_length(w) > 1)


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def present(*columns: Column) -> Column:
    """The first that is not blank, else an empty string."""
    return F.coalesce(*[F.when(~blank(c), c) for c in columns], F.lit(""))


def excerpt(c: Column, n: int, marker: str = "...") -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit(marker))).otherwise(c)


def base_id(c: Column, prefixes: tuple[str, ...] = ()) -> Column:
    for p in prefixes:
        c = F.replace(c, F.lit(p), F.lit(""))
    return c


# Decimal texts of slash fractions in dictionary-like sources.
_EXACT = {(1, 2): "0.5", (1, 3): "0.33333", (2, 3): "0.66666", (1, 4): "0.25", (3, 4): "0.75", (1, 6): "0.16666", (5, 6): "0.83333"}
_DIGITS = ("¹²³⁴⁵⁶⁷⁸⁹⁰₁₂₃₄₅₆₇₈₉₀", "12345678901234567890")
_CAPITALS = "A-ZÈÉÊÀÁÂÌÍÎÙÚÛŠṢṬ"


def fraction_decimal(num: Column, den: Column) -> Column:
    """A fraction's decimal text: seven fixed ones, else five places without trailing zeros."""
    n, d = num.cast("bigint"), den.cast("bigint")
    plain = F.regexp_replace(F.format_string("%.5f", n.cast("double") / d), r"\.?0+$", "")
    out = F.when(d == 0, F.concat(num, F.lit("/"), den))
    for (a, b), text in _EXACT.items():
        out = out.when((n == a) & (d == b), text)
    return out.otherwise(plain)


def normalize_ocr(c: Column) -> Column:
    """OCR transliterations brought to the form of published ones.

    The patterns are fixed values, in this order.
    """
    digits = "[" + _DIGITS[0] + r"\d]+"
    parts = F.regexp_extract_all(c, F.lit(f"(?s){digits}/{digits}|(?:(?!{digits}/{digits}).)"), 0)

    def decimal(p: Column) -> Column:
        plain = F.translate(p, *_DIGITS)
        return F.when(p.rlike(f"^{digits}/{digits}$"), fraction_decimal(F.split(plain, "/")[0], F.split(plain, "/")[1])).otherwise(p)

    c = F.when(c.rlike(f"{digits}/{digits}"), F.array_join(F.transform(parts, decimal), "")).otherwise(c)
    c = apply(c, [Sub(r"(\d+)\s+0\.(\d+)", "$1.$2"), *SUBSCRIPTS])
    c = apply(c, [Sub(rf"(?<![a-zA-ZÀ-ÿ{{]){m}([{_CAPITALS}])", f"{{{m}}}$1") for m in "dmf"])

    def lowered(token: Column) -> Column:
        letters = F.regexp_replace(token, "[^a-zA-ZÀ-ÿ]", "")
        mark = F.regexp_extract(token, r"^(\{[dmf]\})", 1)
        rest = F.concat(mark, F.lower(F.substr(token, F.char_length(mark) + 1)))
        return F.when((letters == "") | (letters == F.upper(letters)), token).otherwise(rest)

    pieces = F.regexp_extract_all(c, F.lit(r"(?U)\s+|\S+"), 0)
    c = F.when(c.isNotNull(), F.array_join(F.transform(pieces, lowered), ""))
    return apply(c, [
        Text("=", "-"), Sub(r"([a-zA-ZÀ-ÿ₀-₉])[!?]+", "$1"), Sub(r"\*([a-zA-ZÀ-ÿ])", "$1"), Sub("<<[^>]*>>", ""),
        Sub("<([^>]+)>", "$1"), Sub(r"\s*/\s*", " "), Sub(r"\s+", " "), Sub(r"^ | $", ""),
    ])


def name_case(c: Column) -> Column:
    """Each hyphen element of a name: all-capitals of two letters and more and marked ones stay, others are lower-cased."""

    def each(e: Column) -> Column:
        letters = F.regexp_replace(e, r"(?U)[^\p{L}]", "")
        return F.when((F.char_length(letters) > 1) & (letters == F.upper(letters)) | e.startswith("{"), e).otherwise(F.lower(e))

    return F.array_join(F.transform(F.split(c, "-"), each), "-")
