"""Tablet pages: title, metadata, numbered lines, links, plain text - all by Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of the sides of a tablet, and words of navigation links.
SIDES = ("Vs.", "Rs.", "u.K.", "o.K.", "l.S.", "l.Rd.", "r.Rd.")
NAVIGATION = ("liste", "altass", "gesamt", "anfang", "hethiter")
# What a label of the head carries, and what stands before the table of the text.
LABEL, TEXT_TABLE = "color='blue'", r"<br/>\s*<table>"


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def elements(c: Column, tag: str) -> Column:
    """The insides of all elements of a tag that does not nest, up to their end or the end of the text."""
    parts = F.filter(F.split(c, rf"(?i)<{tag}\b[^>]*>"), lambda x, i: i > 0)
    return F.transform(parts, lambda x: F.get(F.split(x, f"(?i)</{tag}>", 2), F.lit(0)))


def bare(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "<[^>]*>", " "))


def cells(page: Column) -> Column:
    """The rows of all tables, each an array of its cells' insides."""
    return F.transform(elements(page, "tr"), lambda row: elements(row, "td"))


def links(page: Column) -> Column:
    """Targets of links to pages, without navigation."""
    anchors = F.filter(F.split(page, r"(?i)<a\s"), lambda x, i: i > 0)
    targets = F.transform(anchors, lambda x: F.regexp_extract(x, r"(?i)^[^>]*?href=(['\"])([^'\"]+)\1", 2))
    return F.filter(targets, lambda x: x.endswith(".html") & ~F.lower(x).rlike("|".join(NAVIGATION)))


def plain(c: Column) -> Column:
    """Text without markup; a sign join at a line end becomes a hyphen."""
    return F.replace(squeeze(F.regexp_replace(c, r"<[^>]+>", "")), F.lit("= "), F.lit("-"))


def title(page: Column) -> Column:
    """The text of the first heading."""
    head = bare(F.get(elements(page, "h1"), F.lit(0)))
    return F.coalesce(F.when(head != "", head), F.lit("unknown"))


def metadata(page: Column) -> Column:
    """``label value`` of the head: each cell with a marked label and the text of the next cell, up to any markup."""
    every = elements(page, "td")
    pairs = F.arrays_zip(every.alias("a"), F.slice(every, F.lit(2), F.size(every)).alias("b"))
    named = F.filter(pairs, lambda p: p["b"].isNotNull() & F.coalesce(p["a"].contains(LABEL), F.lit(False)))
    label = lambda p: bare(F.get(elements(p["a"], "font"), F.lit(0)))
    return F.transform(named, lambda p: F.concat_ws(" ", label(p), squeeze(F.get(F.split(p["b"], "<", 2), F.lit(0)))))


def lines(page: Column) -> Column:
    """(marker, text) of the rows of the last table, editors' notes left out."""
    notes = F.filter(F.split(F.element_at(F.split(page, TEXT_TABLE), -1), "<fn>"), lambda x: x.isNotNull())
    body = F.array_join(F.transform(notes, lambda x, i: F.when((i == 0) | ~x.contains("</fn>"), x).otherwise(F.get(F.split(x, "</fn>", 2), F.lit(1)))), "")
    rows = F.filter(cells(body), lambda r: F.size(r) == 2)
    both = F.transform(rows, lambda r: F.struct(bare(F.get(r, F.lit(0))).alias("marker"), plain(F.get(r, F.lit(1))).alias("text")))
    return F.filter(both, lambda x: x["text"] != "")


def transliteration(rows: Column) -> Column:
    """All lines in one text; the names of sides stay, line numbers go."""
    return F.array_join(F.flatten(F.transform(rows, lambda x: F.when(x["marker"].isin(*SIDES), F.array(F.concat(F.lit("@"), x["marker"]), x["text"])).otherwise(F.array(x["text"])))), " ")


def tablets(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with tablet_id, metadata, lines, transliteration and line_count."""
    out = pages.withColumns({"tablet_id": title(F.col(page)), "metadata": metadata(F.col(page)), "lines": lines(F.col(page))})
    return out.withColumns({"transliteration": transliteration(F.col("lines")), "line_count": F.size("lines")})


def blocks(page: Column, tag: str) -> Column:
    """Plain texts of all elements of one tag."""
    return F.transform(F.regexp_extract_all(page, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), 1), plain)
