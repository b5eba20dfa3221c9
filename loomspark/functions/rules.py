"""Ordered rewriting rules as data: one table gives a Spark expression and, for checks, DuckDB SQL.

Patterns are written with ``\\b``, ``\\w``, ``\\s`` and ``\\d`` and mean by them what Python
does: word signs are letters, numbers of any kind and ``_``, but no combining marks, and a
boundary lies between these and all others.  Java's own classes differ beside fraction
signs, subscripts and marks, so ``java`` spells them out.  Every rule maps a string to a
string and null to null, so a chain is one projection that Catalyst keeps inside code
generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import similarity


_WORD = r"\p{L}\p{N}_"
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CLASSES = {"w": _WORD, "s": _SPACE, "d": r"\p{Nd}"}


def java(pattern: str) -> str:
    """A pattern in Java's spelling, with Python's word signs, white space, digits and boundaries."""
    out, k, inside = [], 0, False
    while k < len(pattern):
        c, two = pattern[k], pattern[k : k + 2]
        if c == "\\":
            k += 2
            name = two[1]
            if name == "b" and not inside:
                two = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
            elif name in _CLASSES:
                two = _CLASSES[name] if inside else f"[{_CLASSES[name]}]"
            elif name.lower() in _CLASSES and not inside:
                two = f"[^{_CLASSES[name.lower()]}]"
            out.append(two)
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        k += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    def column(self, c: Column) -> Column:
        raise NotImplementedError

    def sql(self, x: str) -> str:
        raise NotImplementedError


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@dataclass(frozen=True)
class Sub(Rule):
    """Replace every match; groups are written $1."""

    pattern: str
    to: str = ""
    ignore_case: bool = False

    def column(self, c: Column) -> Column:
        return F.regexp_replace(c, ("(?iu)" if self.ignore_case else "") + java(self.pattern), self.to)

    def sql(self, x: str) -> str:
        to = self.to.replace("\\", "\\\\").replace("$", "\\")
        return f"regexp_replace({x}, {_quoted(self.pattern)}, {_quoted(to)}, '{'gi' if self.ignore_case else 'g'}')"


@dataclass(frozen=True)
class Text(Rule):
    """Replace every occurrence of a plain string."""

    find: str
    to: str = ""

    def column(self, c: Column) -> Column:
        return F.replace(c, F.lit(self.find), F.lit(self.to))

    def sql(self, x: str) -> str:
        return f"replace({x}, {_quoted(self.find)}, {_quoted(self.to)})"


@dataclass(frozen=True)
class Chars(Rule):
    """Map single characters; those without a counterpart are dropped."""

    find: str
    to: str = ""

    def column(self, c: Column) -> Column:
        return F.translate(c, self.find, self.to)

    def sql(self, x: str) -> str:
        return f"translate({x}, {_quoted(self.find)}, {_quoted(self.to)})"


@dataclass(frozen=True)
class Lower(Rule):
    def column(self, c: Column) -> Column:
        return F.lower(c)

    def sql(self, x: str) -> str:
        return f"lower({x})"


@dataclass(frozen=True)
class Compose(Rule):
    """Letters and their marks as single signs (NFC)."""

    def column(self, c: Column) -> Column:
        return similarity.nfc(c)

    def sql(self, x: str) -> str:
        return f"nfc_normalize({x})"


def apply(c: Column, rules: Sequence[Rule]) -> Column:
    for rule in rules:
        c = rule.column(c)
    return c


def to_sql(x: str, rules: Sequence[Rule]) -> str:
    for rule in rules:
        x = rule.sql(x)
    return x
