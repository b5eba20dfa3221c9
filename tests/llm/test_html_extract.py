import os
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <p>x</p> -->
<div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
<article><h1>Head&nbsp; &eacute;</h1><p>One
 two<br>three <b>bold <a href="x">link</a> a<p>Four &lt;b&gt; &#x263A;<ul><li>i<li>j</ul><aside>side</aside><table><tr><td>c</td><td>d</td></tr></table>
<section class="comments"><p>Reader says</p></section><form><p>Mail</p><input></form></article>
<footer>&copy; x<p>imprint</footer></body></html>"""


def text(page, other=None):
    return H.main_text(H.parse(page), H.parse(other) if other else None)


def test_article():
    assert text(PAGE) == "Head é\nOne two three bold link a\nFour <b> ☺\ni\nj\nc\nd"


def test_odd_pages():
    assert text(None) == text("") == text("<nav>a</nav>") == text("<!-- open <p>x") == ""
    assert text("<article><p>cut off <b>he") == "cut off he" == text("<article>cut off he</article><foot")
    assert text("<article>a < b & c > d</article>") == "a < b & c > d"
    assert text("<ARTICLE><P CLASS=ad>x</P>y</ARTICLE>") == "y"
    assert text("<article><script>if (a<b) '</article>'</script>t</article>") == "t"
    assert text("<main><article>m</article> n</main>") == "m\nn"
    assert text("<article>" + "<p>w</p>" * 30_000 + "</article>").count("\n") == 29_999
    assert text("<p>x</p><article>one</article><div>y</div><article><p>two, longer</article><article class='teaser'>z</article>") == "one\ntwo, longer"
    assert text(" \x00<article>a\ud800 b</article>") == "a\ud800 b"


def test_shared_lines_go_where_structure_leaves_them_open():
    a = "<body><div>Top line</div><div>Own words of the first page</div><div>Bottom line</div></body>"
    b = "<body><div>Top line</div><div>The second page says something else</div><div>Bottom line</div></body>"
    assert text(a, b) == "Own words of the first page"
    assert text(a, a) == "Top line\nOwn words of the first page\nBottom line"
    c = "<article><p>Same</p><div>Share this story with all</div><p>Own</p><p>More</p></article>"
    d = "<article><p>Same</p><div>Share this story with all</div><p>Else and so on and so on</p></article>"
    assert text(c, d) == "Same\nOwn\nMore"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_alignment_is_a_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    found = [a[i] for i in sorted(H.common_lines(a, b))]
    rest = iter(b)
    assert len(found) == best[-1][-1] and all(x in rest for x in found)


def test_alignment_of_very_long_pages():
    a = [f"line {k}" for k in range(30_000)]
    b = ["x", *a[:9000], "y", *a[9500:], "line 3"]
    assert H.common_lines(["z", *a], b) == {*range(1, 9001), *range(9501, 30_001)}


def longest(a, b):
    """Places in ``a`` of a longest common subsequence, by the whole table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    found = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            found.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def test_pages_without_structure_equal_brute_force(spark):
    """Each page less the lines it shares with the neighbour whose path is most like its own.

    Lines of a page differ, and shared ones stand in one order on all pages, so the longest common
    subsequence is the only one."""
    rng, rows = random.Random(3), []
    for k in range(120):
        own = [f"own line {k}.{i}" for i in range(rng.randrange(1, 6))]
        lines = [f"shared {i}" for i in range(8) if rng.random() < 0.5]
        for x in own:
            lines.insert(rng.randrange(len(lines) + 1), x)
        url = f"http://h{rng.randrange(3)}.example/{rng.choice(['a', 'ab', 'b'])}/{rng.randrange(30)}"
        rows.append((k, url, lines))
    pages = spark.createDataFrame([(k, u, "<body>" + "".join(f"<div>{x}</div>" for x in lines)) for k, u, lines in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    order = sorted(rows, key=lambda r: (r[1].split("/")[2], "/" + r[1].split("/", 3)[3], r[0]))
    for at, (k, url, lines) in enumerate(order):
        near = []
        for side in (at - 1, at + 1):
            if 0 <= side < len(order) and order[side][1].split("/")[2] == url.split("/")[2]:
                near.append((len(os.path.commonprefix([url, order[side][1]])), side < at, order[side][2]))
        other = max(near, key=lambda x: x[:2])[2]
        gone = longest(lines, other)
        if sum(len(lines[i]) for i in gone) >= 0.9 * sum(map(len, lines)):
            gone = set()
        assert got[k] == "\n".join(x for i, x in enumerate(lines) if i not in gone)


def test_pages(spark):
    rows = [(k, f"http://h{k % 3}.example/en/{k}?q=1#top", PAGE.replace("One", f"One{k}"), "clash") for k in range(40)]
    rows += [(100, None, PAGE, None), (101, "::bad[url", None, None), (None, "http://h0.example/en/3", "", "x"), (3, *rows[3][1:])]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = sorted(str((p, u, t := text(h), len(t))) for p, u, h, _ in rows)
    assert sorted(str(tuple(r)) for r in got) == want
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pairs_do_not_depend_on_partitions(spark):
    page = "<body><div>Menu of {0} pages</div><div>Own words of page {1} and no other</div><div>Foot of {0}</div></body>"
    rows = [(k, f"http://{'ab'[k % 2]}.example/{'xyz'[k % 3]}/{k:03}", page.format("xyz"[k % 3] + "ab"[k % 2], k * 7919)) for k in range(90)]
    rows += [(900, None, page.format("n", 1)), (901, None, page.format("n", 2)), (902, "http://é.example/𝒳", page.format("o", 3)), (903, "http://é.example/\uff5e", page.format("o", 4))]
    seen, held, joined = [], spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(joined, "false")
        for n in (1, 2, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            frame = spark.createDataFrame(rows, "page_id long, url string, html string")
            got = sorted(tuple(r) for r in H.extract(frame).collect())
            assert len(got) == len(rows)
            seen.append(got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset(joined)
    assert all(x == seen[0] for x in seen)
    assert all("Menu" not in t and t.startswith("Own words") for _, _, t, _ in seen[0])
