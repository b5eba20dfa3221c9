"""Main text of web pages: nearest-URL page differencing over tolerant block parsing.

A page is parsed into lines, one for each block of text, with where it stands: inside
the page's article, inside structure that is never article text (menus, headers,
footers, sidebars, notices, adverts, forms, comments, scripts, styles, hidden parts),
in running-text elements, or in links.  Pages are sorted by host and URL path in range
partitions, so one host with any share of all pages is split; the pages at an edge go
to both sides, and each page is paired with the neighbour whose path is most like its
own, whatever the partitions.  The lines of the pair are aligned
by a longest common subsequence and shared ones are deleted.

Differencing alone cannot give the article: menus, adverts and footers of these pages
differ from page to page (of their lines 4 in 100 stand on the nearest page too), and two
pages of a host may carry the same article (1 in 100 of article lines do).  So
structure decides first, and differencing decides what structure leaves open: all lines
of pages without an article element, and lines of an article outside of running text.
If a pair shares nearly all such lines it is a pair of copies and deletes nothing.

Inside a block character references are decoded and white space becomes one space;
blocks are joined by one newline.

Defined cases: several article elements are kept, in page order; null or empty html is an empty text; unclosed elements end where HTML
ends them or with the page; an unfinished tag at the end is markup; a null URL is a
host of its own; a page alone on its host is not paired; repeated rows are each
extracted; extra columns are not read.
"""

from __future__ import annotations

import functools
import html as _html
import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_session

COPY_SHARE = 0.9
#: Keys of the sample for each range.
SAMPLE = 50
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_PROSE = set("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption".split())
_NEVER = set(
    "nav footer aside form button select option input textarea script style noscript template iframe svg canvas object head title menu dialog label fieldset".split()
)
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner\w*|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alert|newsletter|subscri\w*|menus?|nav\w*|"
    r"breadcrumbs?|sidebar\w*|widgets?|footer|header|masthead|comments?|commentlist|disqus|replies|reply|respond|shar(?:e|ing)|social|"
    r"related|recommend\w*|popup|modal|overlay|login|signup|search|toolbar|copyright|pagination|pager|skip|paywall)(?:$|[\s_-])",
    re.I,
)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}


@dataclass(slots=True)
class Line:
    text: str
    article: int  # number of its article element, or 0
    never: bool
    prose: bool
    linked: int  # of its code points


@dataclass(slots=True)
class _Open:
    tag: str
    never: bool
    article: int
    prose: bool
    link: bool


@dataclass(slots=True)
class _Block:
    parts: list = field(default_factory=list)
    linked: int = 0


def _never(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _NEVER or (tag == "header" and not in_article):
        return True
    if not attrs or attrs.isspace():
        return False
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in ("body", "html", "main", "article") and _NAMES.search(value):
            return True
        if name in ("class", "id") and tag == "article" and re.search(r"comment|teaser|related|promo", value, re.I):
            return True
        if name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def parse(page: str | None) -> list[Line]:
    """The lines of a page, in order."""
    if not page:
        return []
    lines: list[Line] = []
    stack = [_Open("", False, 0, False, False)]
    block, articles, at = _Block(), 0, 0

    def flush() -> None:
        nonlocal block
        if block.parts:
            text = _SPACE.sub(" ", "".join(block.parts)).strip()
            if text:
                top = stack[-1]
                lines.append(Line(text, top.article, top.never, top.prose, min(block.linked, len(text))))
            block = _Block()

    def add(raw: str) -> None:
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            block.parts.append(text)
            if stack[-1].link:
                block.linked += len(text)

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                if any(o.tag in _BLOCK or o.never for o in stack[k:]):
                    flush()
                del stack[k:]
                return

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        ending, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            if tag == "p" and all(o.tag != "p" for o in stack):
                flush()
            close(tag)
            continue
        if tag in _BLOCK:
            flush()
            if any(o.tag == "p" for o in stack[-4:]):
                close("p")
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                _close_sibling(stack, tag)
        if tag == "br":
            block.parts.append(" ")
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            continue
        top = stack[-1]
        never = top.never or _never(tag, attrs, bool(top.article))
        article = top.article
        if tag in ("article", "main") and not never and not article:
            articles += 1
            article = articles
        if never and not top.never:
            flush()
        stack.append(_Open(tag, never, article, top.prose or tag in _PROSE, top.link or tag == "a"))
    flush()
    return lines


def _close_sibling(stack: list[_Open], tag: str) -> None:
    """An item ends the item before it in the same list or table."""
    same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in same:
            del stack[k:]
            return
        if stack[k].tag in ("ul", "ol", "dl", "table", "select", "menu", "div", "article", "section", "body"):
            return


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """The places in ``a`` of a longest common subsequence, by bit-parallel rows.

    Of the rows every so many are held and those between made again on the way back, and
    a line's places in ``b`` become a row only when it is met: memory follows the number
    of lines to the power 1.5, in bits.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    full, every = (1 << len(b)) - 1, math.isqrt(len(a)) + 1

    @functools.lru_cache(64)
    def places(x: str) -> int:
        bits = bytearray(len(b) // 8 + 1)
        for j in where[x]:
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    def after(row: int, x: str) -> int:
        if x not in where:
            return row
        u = row & places(x)
        return ((row + u) | (row - u)) & full

    held, row = [full], full
    for i, x in enumerate(a, 1):
        row = after(row, x)
        if i % every == 0:
            held.append(row)
    i, j, first, rows = len(a), len(b), len(a) + 1, []
    while i and j:
        if i - 1 < first:
            first = (i - 1) // every * every
            rows = [held[first // every]]
            for x in a[first:i]:
                rows.append(after(rows[-1], x))
        if rows[i - first] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1 - first] >> (j - 1) & 1:
            i -= 1
        else:
            found.add(head + i - 1)
            i, j = i - 1, j - 1
    return found


def main_text(lines: list[Line], other: list[Line] | None) -> str:
    """The articles of a page, in page order, differenced against its neighbour."""
    best = any(x.article and not x.never for x in lines)
    able = [x for x in lines if not x.never and bool(x.article) == best]
    if not best:  # without an article element, blocks that are mostly links are menus
        able = [x for x in able if 2 * x.linked < len(x.text)]
    unsure = [k for k, x in enumerate(able) if not (best and x.prose)]
    gone: set[int] = set()
    if other and unsure:
        theirs = [x.text for x in other if not x.never]
        shared = common_lines([x.text for x in able], theirs)
        total = sum(len(x.text) for x in able)
        if sum(len(able[k].text) for k in shared) < COPY_SHARE * total:
            gone = shared.intersection(unsure)
    return "\n".join(x.text for k, x in enumerate(able) if k not in gone)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    arrow_session(pages)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    keyed = pages.select("page_id", "url", "html", host.alias("_host"), F.rtrim(path, F.lit("/")).alias("_path"))
    ordered = _with_edges(keyed)
    kind = pages.schema["page_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for page_id, url, html, h, p, own in zip(*batch.columns, strict=True):
                yield page_id.as_py(), url.as_py(), parse(html.as_py()), (h.as_py(), p.as_py()), own.as_py()

    def near(one: tuple | None, key: tuple) -> int:
        return len(os.path.commonprefix([one[3][1] or "", key[1] or ""])) if one and one[3][0] == key[0] else -1

    def out(held: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        cols = [pa.array([x[k] for x in held], t) for k, t in enumerate((id_type, pa.string(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        if (first := next(batches, None)) is None:
            return
        id_type, held, before, now = first.column(0).type, [], None, None

        def chain() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for after in _with_last(rows(chain())):
            if now and now[4]:
                a, b = near(before, now[3]), near(after, now[3])
                other = None if max(a, b) < 0 else (before if a >= b else after)
                text = main_text(now[2], other[2] if other else None)
                held.append((now[0], now[1], text, len(text)))
                if len(held) >= 500:
                    yield out(held, id_type)
                    held = []
            before, now = now, after
        if held:
            yield out(held, id_type)

    return ordered.mapInArrow(difference, f"page_id {kind}, url string, text string, n_chars long")


def _with_edges(keyed: DataFrame) -> DataFrame:
    """Rows in order of host and path in range partitions, each with the page before and the page behind it.

    The ranges are cut at keys of a sample, so the last key of a range and the first of the
    next are known before the pages are dealt; their rows go to both, ``_own`` in one.
    """
    spark = keyed.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct("_host", "_path", "page_id")
    keys = keyed.select(key.alias("_k"))
    kind = keys.schema["_k"].dataType
    total = keys.count()
    share = F.pmod(F.xxhash64("_k"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE * n / max(1, total)))
    drawn = sorted((r[0] for r in keys.where(share).distinct().collect()), key=lambda k: [(x is not None, x) for x in _order(k)])
    cuts = spark.createDataFrame([(drawn[len(drawn) * k // n],) for k in range(1, n) if drawn], f"_c {kind.simpleString()}")
    bounds = F.broadcast(cuts.distinct().agg(F.sort_array(F.collect_list("_c")).alias("_cuts")))
    placed = keyed.join(bounds).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= key))).drop("_cuts")
    edges = placed.groupBy("_range").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    beside = Window.orderBy("_range")  # one row a range
    edges = edges.select("_range", "_first", "_last", F.lag("_range").over(beside).alias("_before"), F.lead("_range").over(beside).alias("_behind"))
    rows = placed.join(F.broadcast(edges), "_range")
    at = lambda c, own: F.struct(c.cast("int").alias("_at"), F.lit(own).alias("_own"))
    to = [at(F.col("_range"), True), F.when(key == F.col("_first"), at(F.col("_before"), False)), F.when(key == F.col("_last"), at(F.col("_behind"), False))]
    dealt = rows.select("page_id", "url", "html", "_host", "_path", F.inline(F.filter(F.array(*to), lambda x: x["_at"].isNotNull())))
    dealt = dealt.repartitionById(n, F.col("_at")).sortWithinPartitions("_host", "_path", "page_id")
    return dealt.select("page_id", "url", "html", "_host", "_path", "_own")


def _order(k: tuple) -> list:
    """Strings in the order of Spark, by their bytes."""
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x for x in k]


def _with_last(items: Iterator[tuple]) -> Iterator[tuple | None]:
    """All items, and a None behind the last."""
    yield from items
    yield None
