"""Main text of web pages: markup rules and differencing against the pages next to them by url.

A page is cut into lines, its blocks in page order. Two things tell the article from the rest:

* Markup. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are named by elements, roles
  and class or id names (``SKIP``, ``ROLES``, ``HINTS``). Where a page has an ``article`` or ``main`` element outside of these, its text is the article.
* Differencing. Within a host, pages are sorted by path, so each stands between the pages nearest to it by url. The lines of
  two neighbours are aligned by a longest common subsequence; lines shared with either neighbour belong to the site's template.
  They are deleted from pages whose markup names no article. Where it does, shared lines inside stay: they are sentences that two articles share.

Pages of a host with equal lines are one page here, so copies are never compared with each other. A neighbour that shares ``COPY``
of a page's characters or more is a near copy and no witness of a template. Of several alignments of one length, any has the same number of lines
and the one found first is taken.

Scale: pages are sorted by (host, path) in ranges, so a host of any size is many tasks, and a task streams its range and holds two pages. The last
page of a range meets the first of the next in a join of one row for each end of a range. Only digests of lines are sorted; a page is parsed again
where its result is made. An alignment takes memory in proportion to the lines.

Null and empty html give an empty text. Urls that are null, without ``://`` or with an empty host have no neighbours; their template lines stay. Broken markup:
unclosed elements end with their parent, unclosed comments and scripts at the page's end. Very long pages are read whole. Repeated rows each
get their row. An empty table gives an empty result. The columns of ``pages`` but the html are kept; ``text``, ``n_chars``, ``n_lines`` and ``n_shared`` replace columns of these names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlens.llm.common import stored, table
from ledgerlens.plans.registry import Query

# What markup calls the parts of a page.
#: Elements that are no article text.
SKIP = frozenset("nav header footer aside form button select textarea dialog menu search svg canvas iframe object audio video noscript template head".split())
#: Elements whose content is no markup.
RAW = frozenset("script style title textarea noscript iframe xmp noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog status form menu menubar toolbar".split())
#: Pieces of class and id names (cut at hyphens, underscores and spaces).
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
HINTS = ADVERTS | frozenset(
    """nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar widget cookie cookies consent gdpr notice notices notification
    alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended teaser comment comments disqus respond
    replies toolbar masthead banner copyright""".split())
WHOLE = frozenset("header footer site-header site-footer page-header page-footer".split())
#: Names that begin so describe a state of the element.
STATES = frozenset("has no with without is js".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
IN_HEAD = frozenset("base link meta script style title noscript template head".split())
#: Elements that say nothing of their content.
PLAIN = frozenset("div section center".split())
#: An element that an equal one ends, and the elements that keep them apart.
ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: Share of a page's characters from which its neighbour is a copy.
COPY = 0.8

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[/a-zA-Z!?][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _named(attributes: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}


def _aside(name: str, attributes: str) -> bool:
    """Whether an element is no part of the article."""
    if name in SKIP:
        return True
    if not attributes.strip() or name in ("html", "body", "main"):
        return False
    own = _named(attributes)
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", "").lower()):
        return True
    if own.get("role", "").lower() in ROLES:
        return True
    hints = ADVERTS if name in INLINE else HINTS
    for given in f"{own.get('class', '')} {own.get('id', '')}".lower().split():
        pieces = re.split("[-_]+", given)
        if pieces[0] not in STATES and (given in WHOLE and name not in INLINE or not hints.isdisjoint(pieces)):
            return True
    return False


def lines_of(html: str) -> tuple[list[str], list[int]]:
    """The lines of a page, and of each whether it is set aside (0), plain text (1) or inside an article (2)."""
    lines: list[str] = []
    kinds: list[int] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the kind of text in them
    kind = 1

    def cut() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            lines.append(text)
            kinds.append(kind)

    def pop(to: int) -> None:
        nonlocal kind
        cut()
        del stack[to:]
        kind = stack[-1][1] if stack else 1

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            held.append(unescape(html[at:]))
            break
        if m.start() > at:
            held.append(unescape(html[at:m.start()]))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in INLINE and not any(n == name for n, _ in stack):
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
            else:
                cut()
            continue
        if name in RAW:
            end = re.compile(f"</{name}\\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            if name != "xmp":
                continue
        if name == "br":
            held.append(" ")
            continue
        if name == "body":
            pop(0)
            continue
        if stack and stack[0][0] == "head" and name not in IN_HEAD:
            pop(0)
        if name in VOID:
            if name == "hr":
                cut()
            continue
        attributes = m[3] or m[6] or ""
        away = _aside(name, attributes)
        if name in INLINE:
            if away and kind:
                at = _after(html, at, name)
            continue
        # an open paragraph ends where a block starts
        top = len(stack) - 1
        if top >= 0 and stack[top][0] == "p":
            pop(top)
        if name in ENDS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ENDS[name]:
                    break
                if stack[i][0] == name or {stack[i][0], name} <= {"td", "th"} or {stack[i][0], name} <= {"dt", "dd"}:
                    pop(i)
                    break
        cut()
        article = name in ("article", "main") or 'role="main"' in attributes.lower()
        # a form may wrap the whole page
        wrapped = not kind and next(n for n, k in stack if not k) == "form" and all(k or n in ("form", *PLAIN) for n, k in stack)
        if away or not (kind or article and wrapped):
            inner = 0
        else:
            inner = 2 if article else kind
        stack.append((name, inner))
        kind = inner
    cut()
    return lines, kinds


def _after(html: str, at: int, name: str) -> int:
    """Where an inline element that starts before ``at`` ends: at its end tag, nested ones counted, or where it stands if it has none."""
    depth = 1
    for m in re.compile(f"<(/?){name}\\b[^>]*>", re.I).finditer(html, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


# --- alignment ----------------------------------------------------------------------------------

def _prefix_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with every prefix of ``b``; one bit for each line of ``b``."""
    masks: dict[int, int] = {}
    order = np.argsort(b, kind="stable")
    keys, starts = np.unique(b[order], return_index=True)
    for key, places in zip(keys.tolist(), np.split(order, starts[1:]), strict=True):
        bits = np.zeros(len(b), np.uint8)
        bits[places] = 1
        masks[key] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << len(b)) - 1
    v = full
    for x in a.tolist():
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of a longest common subsequence; memory in proportion to the lines."""
    here, there = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    left: list[int] = []
    right: list[int] = []
    todo = [(0, len(here), 0, len(there))]
    x, y = a[here], b[there]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and x[i] == y[k]:
            left.append(i)
            right.append(k)
            i, k = i + 1, k + 1
        while i < j and k < m and x[j - 1] == y[m - 1]:
            j, m = j - 1, m - 1
            left.append(j)
            right.append(m)
        if i == j or k == m:
            continue
        if j - i == 1:
            same = np.flatnonzero(y[k:m] == x[i])
            if len(same):
                left.append(i)
                right.append(k + int(same[0]))
            continue
        mid = (i + j) // 2
        before = _prefix_lengths(x[i:mid], y[k:m])
        after = _prefix_lengths(x[mid:j][::-1], y[k:m][::-1])[::-1]
        cut = k + int((before + after).argmax())
        todo += [(i, mid, k, cut), (mid, j, cut, m)]
    return here[np.sort(np.array(left, np.int64))], there[np.sort(np.array(right, np.int64))]


def shared_lines(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lines (digests, lengths) of each page that the other shares; none where one is a near copy of the other."""
    i, j = aligned(a[0], b[0])
    size = a[1][i].sum()
    if size >= COPY * a[1].sum() or size >= COPY * b[1].sum():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return i, j


# --- pages --------------------------------------------------------------------------------------

def _place(url: str | None) -> tuple[str, str]:
    """Host and path of a url; an empty host where it has none."""
    rest = (url or "").partition("://")[2]
    cut = re.search(r"[/?#]", rest)
    host = rest[:cut.start()] if cut else rest
    return host.lower(), re.split(r"[?#]", rest[len(host):])[0]


def _digest(lines: list[str], kinds: list[int]) -> bytes:
    h = blake2b(bytes(kinds), digest_size=16)
    for x in lines:
        h.update(b"\0" + x.encode("utf-8", "surrogatepass"))
    return h.digest()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with a host: what is needed to align them."""
    for b in batches:
        rows = []
        for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            host, path = _place(url)
            lines, kinds = lines_of(html or "") if host else ([], [])
            if lines:
                hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64)
                rows.append((host, path, _digest(lines, kinds), hashes.tobytes(), np.array([len(x) for x in lines], "<i4").tobytes()))
        names = ["host", "path", "digest", "lines", "sizes"]
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.string() if i < 2 else pa.binary()) for i, n in enumerate(names)})


def _arrays(lines: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(lines, np.int64), np.frombuffer(sizes, "<i4")


_PAIRED = T.StructType([T.StructField(n, t) for n, t in (
    ("host", T.StringType()), ("digest", T.BinaryType()), ("at", T.ArrayType(T.IntegerType())), ("part", T.IntegerType()), ("last", T.BooleanType()),
    ("lines", T.BinaryType()), ("sizes", T.BinaryType()))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], _PAIRED.names)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range: shared lines of every two pages in a row, and the first and last page for the ranges beside it."""
    part, before = TaskContext.get().partitionId(), None
    for b in batches:
        rows = []
        for host, digest, lines, sizes in zip(*(b.column(c).to_pylist() for c in ("host", "digest", "lines", "sizes")), strict=True):
            if before is None:
                rows.append((host, digest, [], part, False, lines, sizes))
            elif before[0] == host:
                i, j = shared_lines(_arrays(*before[2:]), _arrays(lines, sizes))
                rows += [(host, d, at.tolist(), None, None, None, None) for d, at in ((before[1], i), (digest, j)) if len(at)]
            before = host, digest, lines, sizes
        yield _batch(rows)
    if before is not None:
        yield _batch([(before[0], before[1], [], part, True, *before[2:])])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last page of a range beside the first of the next."""
    for b in batches:
        rows = []
        for pair in b.column("pair").to_pylist():
            if len(pair) == 2:
                a, z = sorted(pair, key=lambda r: not r["last"])
                if a["host"] == z["host"] and a["digest"] != z["digest"]:
                    i, j = shared_lines(_arrays(a["lines"], a["sizes"]), _arrays(z["lines"], z["sizes"]))
                    rows += [(r["host"], r["digest"], at.tolist(), None, None, None, None) for r, at in ((a, i), (z, j)) if len(at)]
        yield _batch(rows)


def template_lines(pages: DataFrame) -> DataFrame:
    """(host, digest, at): places of the lines that a page shares with the pages next to it by url; pages that share none are left out."""
    spark = pages.sparkSession
    sketch = pages.select("url", "html").mapInArrow(_sketch, "host string, path string, digest binary, lines binary, sizes binary")
    kinds = stored(sketch.groupBy("host", "digest").agg(F.min("path").alias("path"), F.first("lines").alias("lines"), F.first("sizes").alias("sizes")), "page-lines")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = kinds.repartitionByRange(parts, "host", "path", "digest").sortWithinPartitions("host", "path", "digest")
    paired = stored(dealt.select("host", "digest", "lines", "sizes").mapInArrow(_neighbours, _PAIRED), "page-pairs")
    # as many ranges as there are partitions, at most: their order is known on the driver
    used = sorted(r["part"] for r in paired.where("last").select("part").collect())
    order = spark.createDataFrame([(p, i) for i, p in enumerate(used)], "part int, range int")
    ends = paired.where("part is not null").join(order, "part").withColumn("seam", F.col("range") + F.col("last").cast("int"))
    pair = F.collect_list(F.struct("host", "digest", "last", "lines", "sizes")).alias("pair")
    met = ends.groupBy("seam").agg(pair).select("pair").mapInArrow(_ends, _PAIRED)
    found = paired.where("part is null").unionByName(met)
    # at most two neighbours
    return found.groupBy("host", "digest").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))


OUT = ("text", "n_chars", "n_lines", "n_shared")


def _parsed(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"_host": [], "_digest": [], "_lines": [], "_at": [], "_article": [], "n_lines": []}
            for url, html in zip(b.column("_url").to_pylist(), b.column("_html").to_pylist(), strict=True):
                lines, kinds = lines_of(html or "")
                article = 2 if 2 in kinds else 1
                at = [i for i, k in enumerate(kinds) if k == article]
                for name, value in zip(out, (_place(url)[0], _digest(lines, kinds), [lines[i] for i in at], at, article == 2, len(lines)), strict=True):
                    out[name].append(value)
            types = [pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], [*kept, *out])
    return run


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without the html, with the article's ``text``, its ``n_chars``, the page's ``n_lines`` and how many of them a neighbour shares."""
    shared = template_lines(pages.select(F.col(url).alias("url"), F.col(html).alias("html")))
    kept = [c for c in pages.columns if c not in (html, *OUT)]
    schema = T.StructType([pages.schema[c] for c in kept])
    for name, kind in (("_host", T.StringType()), ("_digest", T.BinaryType()), ("_lines", T.ArrayType(T.StringType())), ("_at", T.ArrayType(T.IntegerType())),
                       ("_article", T.BooleanType()), ("n_lines", T.LongType())):
        schema = schema.add(name, kind)
    parsed = pages.select(*kept, F.col(url).alias("_url"), F.col(html).alias("_html")).mapInArrow(_parsed(kept), schema)
    shared = shared.select(F.col("host").alias("_host"), F.col("digest").alias("_digest"), F.col("at").alias("_shared"))
    named = parsed.join(shared, ["_host", "_digest"], "left")
    own = F.filter("_lines", lambda x, i: F.col("_article") | ~F.coalesce(F.array_contains("_shared", F.element_at("_at", i + 1)), F.lit(False)))
    text = F.array_join(own, "\n\n")
    out = named.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).withColumn("n_shared", F.when(F.col("_shared").isNull(), F.lit(0)).otherwise(F.size("_shared")).cast("long"))
    return out.select(*kept, *OUT)


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


#: Markup and alignment are not expressible in SQL; tests compare with a brute-force version.
QUERIES = {"op12_page_differences": Query(page_texts)}
