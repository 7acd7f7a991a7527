"""Main text of pages: markup cases, alignment against plain dynamic programming, and pages against a brute-force version."""

import random
import re
from html import unescape

import numpy as np
import pytest

from ledgerlens.llm import page_text as pt
from ledgerlens.llm.common import table

MARKUP = [
    (None, ""), ("", ""), ("just text", "just text"), ("a < b &amp; c &lt;p&gt;", "a < b & c <p>"),
    ("<p>one\n \t two</p><p>three<br>four</p>", "one two\n\nthree four"), ("<p>one<p>two<div>three", "one\n\ntwo\n\nthree"),
    ("<body><nav>menu</nav><article><h1>T</h1><p>x<nav>inner</nav></article>outside</body>", "T\n\nx"),
    ("<main><p>x<aside>side<p>more</aside></p><footer>f</footer>tail</main>", "x\n\ntail"),
    ("<article>a<script>if (a</b) '</p>'</script>b<style>p{}</style><!-- c <p> -->d</article>", "abd"),
    ("<article>a<!-- never closed <p>b</p></article>", "a"), ("<article>a<script>never closed <p>b</p></article>", "a"),
    ("<title>T</title><p>x", "x"), ("<head><title>T</title><p>x</p>", "x"), ("<p>x<a href='q>r\"s'>y</a></p", "xy"), ("<p>x</p><p", "x"),
    ("<article><div class='ad-box'>buy</div><span class='ad'>now <span>go</span></span>text</article>", "text"),
    ("<div class='has-sidebar'><p class=notice>hush<p>say</div>", "say"), ("<div id=comments><article class=comment>me too</article></div><p>x", "x"),
    ("<article>x<section class='comments'><article>reader</article></section></article>", "x"),
    ("<form><div><article>page</article><p>field</div></form>", "page"), ("<article><form>name <p>x</form>y</article>", "y"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\n\nb\n\nc\n\nd"), ("<table><tr><td>a<td>b<tr><th>c</table>", "a\n\nb\n\nc"),
    ("<p>a&nbsp;&nbsp;b&#x41;&copy;</p>", "a bA©"), ("<p hidden>a</p><p style='display: none'>b</p><p role=alert>c</p><p>d</p>", "d"),
    ("<p>a <b>b<i>c</b> d</i></p>e", "a bc d\n\ne"), ("<header>h</header><div class='page-header'>x</div><h2 class='section-header'>kept</h2>", "kept"),
]


@pytest.mark.parametrize(("html", "text"), MARKUP)
def test_markup(html, text):
    lines, kinds = pt.lines_of(html or "")
    assert "\n\n".join(x for x, k in zip(lines, kinds, strict=True) if k == (2 if 2 in kinds else 1)) == text


def test_broken_markup_is_read_in_linear_time():
    for piece in ("<", "<a ", "<a '", '<p class="', "<!--", "<script>", "</", "<div class='ad'>", "<p>x"):
        lines, _ = pt.lines_of(piece * 20_000)
        assert len(lines) <= 20_000


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_longest():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randint(0, rng.choice([2, 8, 40])) for _ in range(rng.randint(0, 30))] for _ in range(2))
        i, j = pt.aligned(np.array(a, np.int64), np.array(b, np.int64))
        assert len(i) == len(j) == longest(a, b)
        assert (np.diff(i) > 0).all() and (np.diff(j) > 0).all() and all(a[p] == b[q] for p, q in zip(i, j, strict=True))


def brute(pages):
    """Text and shared lines of (id, url, html), where equal lines of a page are all shared or none (as in these fixtures)."""
    parsed = {}
    for n, (_, url, html) in enumerate(pages):
        m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
        lines, kinds = pt.lines_of(html or "")
        parsed[n] = (m[1].lower() if m else "", m[2] if m else "", lines, kinds)
    hosts = {}
    for host, path, lines, kinds in parsed.values():
        if host and lines:
            known = hosts.setdefault(host, {})
            key = (tuple(lines), tuple(kinds))
            known[key] = min(path, known.get(key, path))
    shared = {}
    for host, known in hosts.items():
        order = sorted(known, key=lambda k: (known[k], pt._digest(list(k[0]), list(k[1]))))
        for a, b in zip(order, order[1:]):
            common = set(a[0]) & set(b[0])
            assert longest(a[0], b[0]) == sum(x in common for x in a[0]) == sum(x in common for x in b[0])
            size = sum(len(x) for x in a[0] if x in common)
            if size < 0.8 * sum(map(len, a[0])) and size < 0.8 * sum(map(len, b[0])):
                for k in (a, b):
                    shared.setdefault((host, k), set()).update(x for x in k[0] if x in common)
    out = []
    for n, (i, url, _) in enumerate(pages):
        host, _, lines, kinds = parsed[n]
        gone = shared.get((host, (tuple(lines), tuple(kinds))), set())
        kept = [x for x, k in zip(lines, kinds, strict=True) if k == 2] if 2 in kinds else [x for x, k in zip(lines, kinds, strict=True) if k == 1 and x not in gone]
        text = "\n\n".join(kept)
        out.append((i, url or "", text, len(text), len(lines), sum(x in gone for x in lines)))
    return sorted(out)


def extracted(spark, pages):
    df = spark.createDataFrame([(*p, "mine", 3) for p in pages], "page_id long, url string, html string, host string, n_chars int")
    got = pt.main_text(df)
    assert got.columns == ["page_id", "url", "host", "text", "n_chars", "n_lines", "n_shared"]
    return sorted((r.page_id, r.url or "", r.text, r.n_chars, r.n_lines, r.n_shared) for r in got.collect())


def site(n, host, article, seed):
    """Pages of one template: its lines stand around each page's own, in one order."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        own = [f"own {host} {i} {k} " + "w" * rng.randint(0, 60) for k in range(rng.randint(1, 6))]
        body = "".join(f"<p>{x}</p>" for x in own)
        body = f"<article>{body}<p>shared sentence</p></article>" if article else f"<div>{body}</div>"
        out.append((f"https://{host}/{rng.randint(0, 99):02}/{i}?q={i}", f"<html><body><div>Top of {host}</div><ul><li>Home<li>News</ul>{body}<div>Imprint &copy;</div></body></html>"))
    return out


def test_pages_against_brute(spark):
    pages = site(40, "a.example", False, 1) + site(25, "b.example", True, 2) + site(1, "c.example", False, 3)
    pages += [pages[4]] * 5 + [("https://a.example/zz/copy", pages[4][1]), ("HTTPS://A.Example/00", pages[7][1].replace("own", "mine"))]
    pages += [(None, "<p>x"), ("no scheme", "<p>x"), ("http://", None), ("http://d.example", None), ("http://d.example/x", ""), ("http://e.example/1", "<p>" + "y " * 300_000)]
    near = "<div>same</div>" * 1 + "".join(f"<p>paragraph {k} of a long story</p>" for k in range(30))
    pages += [("http://f.example/1", near), ("http://f.example/2", near + "<p>end</p>")]
    rows = [(i, *p) for i, p in enumerate(pages)] + [(0, *pages[0])]
    got = extracted(spark, rows)
    assert got == brute(rows)
    by_id = {r[0]: r for r in got}
    assert all("Imprint" not in by_id[i][2] and "own" in by_id[i][2] for i in range(40))
    assert all("shared sentence" in by_id[i][2] for i in range(40, 65))
    assert by_id[len(pages) - 1][2].startswith("same\n\nparagraph 0")


def test_ranges_change_nothing(spark):
    rows = [(i, *p) for i, p in enumerate(site(60, "a.example", False, 4) + site(9, "b.example", False, 5))]
    expected = brute(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert extracted(spark, rows) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_pages(spark):
    assert extracted(spark, []) == []


def test_table_of_pages(spark, sf_dir):
    """Every page of the table names its article: plain cutting of that element gives the same text."""
    got = {r.page_id: r for r in pt.page_texts(spark, sf_dir).collect()}
    pages = table(spark, sf_dir, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = p.html[p.html.index("<article>") + 9:p.html.index("</article>")]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n\n".join(x for x in blocks if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (text, len(text), p.url)
