"""Texts with what the normalisation rules make of them, written out by hand."""

from __future__ import annotations

from ..functions import text as X

#: Rule table, input, output.  They are not made from the tables that they check.
CASES = [
    ("whitespace", "text  with   spaces", "text with spaces"), ("whitespace", "- leading dash", "leading dash"), ("whitespace", "a  b\t", "a b"),
    ("brackets", "its excise [added]", "its excise added"), ("half_brackets", "{⸢d⸣}UTU", "{d}UTU"), ("broken_brackets", "a-[na]", "a-<gap>"),
    ("insertions", "release (them) to", "release to"), ("insertions", "the (message) came", "the came"), ("insertions", "a king (pl.) b", "a king b"),
    ("punctuation", "the end ..", "the end."), ("punctuation", "one , two ;; three", "one, two; three"), ("macrons", "bêlu", "bēlu"),
    ("decimals", "1.3333 mina", "1 ⅓ mina"), ("decimals", "1.3333300000000001", "1 ⅓"), ("decimals", "0.75 mina", "0.75 mina"), ("decimals", "0.5 mina", "½ mina"),
    ("decimals", "0.5½", "0.5½"), ("decimals", "0.5₂", "0.5₂"), ("decimals", "0.5́", "½́"), ("decimals", "2.5é", "2.5é"),
    ("gaps", "<gap> <gap>", "<big_gap>"), ("gaps", "[x x]", "[<big_gap>]"), ("gaps", "x-kam", "<gap>-kam"), ("gaps", "½x a", "½x a"), ("gaps", "x₂", "x₂"),
    ("gaps", "x́", "<gap>́"), ("gaps", "éx x", "éx <gap>"), ("gaps", "… ...", "<big_gap>"), ("gaps", "x x", "<big_gap>"),
    ("slashes", "1/2 and 11/2", "½ and 11/2"), ("slashes", "½1/2", "½1/2"), ("dividers", "text / more text", "text   more text"),
    ("son_of", "Ali s. Veli", "Ali son of Veli"), ("son_of", "Ali s.\tVeli", "Ali son of Veli"), ("son_of", "Ali s. Veli", "Ali son of Veli"), ("son_of", "days. A", "days. A"),
    ("sic", "a sic b", "a b"), ("sic", "a (sic) b", "a b"), ("sic", "basic", "basic"), ("determinatives", "(d)UTU (river)", "{d}UTU {river}"),
    ("dictionary_source", "bêlu", "belu"), ("dictionary_source", "bêlu", "belu"), ("dictionary_source", "šarru", "šarru"), ("dictionary_source", "ma-ha-ā", "ma-ha-a"),
    ("dictionary_target", "the Ínu land", "the Inu land"), ("dictionary_target", "a \"son\" (of) it", "a son of it"),
    ("rough", "[A]-na  ₄ <gap> <gap>", "a-na 4 <gap>"), ("ascii", "sza2-ar-H,t,", "šá-ar-Ḫ,ṭ"), ("to_decimal", "1 ½ and ¼", "1.5 and 0.25"),
]

CHAINS = {
    "whitespace": X.WHITESPACE, "brackets": X.BRACKETS, "half_brackets": X.HALF_BRACKETS, "broken_brackets": X.BROKEN_BRACKETS, "insertions": X.INSERTIONS,
    "punctuation": X.PUNCTUATION, "macrons": X.MACRONS, "decimals": X.DECIMAL_TO_FRACTIONS, "gaps": X.GAP_MARKS, "slashes": X.SLASH_FRACTIONS, "dividers": X.LINE_DIVIDERS,
    "son_of": X.SON_OF, "sic": X.SIC, "determinatives": X.DETERMINATIVES, "dictionary_source": X.DICTIONARY_SOURCE, "dictionary_target": X.DICTIONARY_TARGET,
    "rough": X.ROUGH, "ascii": X.ASCII_TO_SIGNS, "to_decimal": X.SIGNS_TO_DECIMAL,
}


def sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}, {quoted(c)}, {quoted(out)})" for k, (c, _, out) in enumerate(CASES)) + ") AS f(n, rule, out)"
