"""Main text of HTML pages: markup rules, and differencing of pages that are neighbours by URL.

A page is cut into blocks at block elements. Blocks in elements that never hold main text (menus,
headers, footers, asides, forms, scripts, styles, and elements that have a class, or are wholly named by
id or role, as an advert, notice, sidebar, comments or the like) are left out; names never leave out a
heading, an article or what is around it. If the page marks its article (``article``
or ``main``), the blocks inside are the main text. Otherwise the page differs from its neighbours
only by its main text: pages of a host are sorted by URL path, each is aligned with the page before
and after it by the longest common subsequence of their lines, and lines that both have are deleted.
Pages of a host with equal lines are one page. A neighbour that has nearly all lines of the page may be a
copy of it; only lines that the next page on either side has too are then deleted, and none if one of the
two has no other lines. Lines inside a marked article are never deleted, since articles quote
each other.

Sorting is by range over all hosts together, so a host with a third of all pages is spread over many
tasks; pages at the border of two tasks are aligned in a second, small step. Lines travel as hashes;
pages move only if the list of deleted lines is too large to be broadcast.

Defined results for odd input: NULL html is empty and gives an empty text. A NULL url, or one without
``://``, has no host: such pages have no neighbours. Rows that repeat id and html are cut alike.
Columns beyond the named ones are ignored. An unclosed element ends with its parent or the page.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.llm.common import broadcast_if_small, stored
from echoloom.llm.url_filter import host_and_path

TOKENS = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"""
                    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|(?P<text>[^<]+|<)""", re.S | re.I)
LEFT_OUT = frozenset("nav header footer aside form menu button select dialog fieldset head".split())
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tr td th section article main body html blockquote pre hr "
                   "figure figcaption address details summary nav header footer aside form menu fieldset dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: class names, ids, roles and labels of elements that hold no main text; each is compared as a whole
HINTS = frozenset("""ad ads advert adverts advertisement advertising ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper adsbygoogle banner sponsor sponsored promo promotion
    sidebar side-bar left-sidebar right-sidebar sidebar-left sidebar-right widget widgets widget-area menu main-menu nav-menu navbar nav main-nav top-nav site-nav navigation main-navigation
    site-navigation post-navigation breadcrumb breadcrumbs header site-header page-header masthead footer site-footer page-footer notice alert cookie cookies cookie-banner cookie-bar
    cookie-consent cookie-notice consent popup modal newsletter newsletter-signup subscribe signup login comment comments comment-list comments-area comment-form comment-section replies reply
    disqus disqus_thread respond discussion related related-posts related-articles related-content recommended share share-buttons share-bar sharing social social-links social-media
    social-share toolbar complementary contentinfo search search-form searchform""".split())
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NO_HINTS = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
MARKED = re.compile(r"<(?:article|main)\b", re.I)
#: what the start of an element closes: open elements of these names, up to the nearest one of the others
ENDED_BY = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TABLE = frozenset("table thead tbody tr td th".split())
#: share of a page's free text from which a neighbour may be a copy
COPY_SHARE = 0.8


def hinted(rest: str) -> bool:
    """Whether a class, or the whole id, role or label, among the attributes is one of ``HINTS``."""
    for m in ATTRIBUTE.finditer(rest):
        value = (m[2] or m[3] or m[4] or "").lower()
        if any(x in HINTS for x in (value.split() if m[1].lower() in ("class", "role") else (value.strip(),))):
            return True
    return False


class OpenElements:
    """Names and numbers of the elements that are open; numbers follow the order of start tags."""

    def __init__(self):
        self.names: list[str] = []
        self.numbers: list[int] = []
        self.count = 0
        self.of: dict[str, int] = {}

    def cut(self, at: int) -> None:
        for x in self.names[at:]:
            self.of[x] -= 1
        del self.names[at:], self.numbers[at:]

    def start(self, tag: str) -> None:
        """Close what a start tag closes."""
        if tag in BLOCKS and self.of.get("p"):
            for i in range(len(self.names) - 1, -1, -1):
                if self.names[i] == "p":
                    self.cut(i)
                    break
                if self.names[i] in BLOCKS:
                    break
        ended, bound = ENDED_BY.get(tag, ((), ()))
        if any(self.of.get(x) for x in ended):
            for i in range(len(self.names) - 1, -1, -1):
                if self.names[i] in ended:
                    self.cut(i)
                    break
                if self.names[i] in bound or self.names[i] in ("article", "main"):
                    break

    def push(self, tag: str) -> int:
        self.names.append(tag)
        self.numbers.append(self.count)
        self.of[tag] = self.of.get(tag, 0) + 1
        self.count += 1
        return self.count - 1

    def end(self, tag: str) -> None:
        """Close the nearest open element of that name with all in it; a stray end tag closes nothing."""
        if not self.of.get(tag):
            return
        for i in range(len(self.names) - 1, -1, -1):
            x = self.names[i]
            if x == tag:
                self.cut(i)
                return
            if tag in ("body", "html"):
                continue
            if x in ("article", "main") and tag not in ("article", "main") or x in ("table", "td", "th") and tag not in TABLE and tag not in ("article", "main"):
                return
            if tag not in BLOCKS and x in BLOCKS:
                return


def around_articles(html: str) -> set[int]:
    """Numbers of the elements that have an article or main in them and are in none."""
    found: set[int] = set()
    if MARKED.search(html):
        stack = OpenElements()
        for m in TOKENS.finditer(html):
            if m["tag"] is None:
                continue
            tag = m["tag"].lower()
            if m["end"]:
                stack.end(tag)
            else:
                stack.start(tag)
                if tag not in VOID and not m["rest"].endswith("/"):
                    if tag in ("article", "main") and not (stack.of.get("article") or stack.of.get("main")):
                        found.update(stack.numbers)
                    stack.push(tag)
    return found


def blocks(html: str) -> tuple[list[str], list[str]]:
    """(lines inside article or main, other lines) of a page, without the left-out elements."""
    inside, free, held = [], [], []
    stack, around = OpenElements(), around_articles(html)
    skip = -1                         # how many elements are open around the left-out one we are in

    def marked() -> bool:
        return bool(stack.of.get("article") or stack.of.get("main"))

    def close(content: bool):
        if held:
            line = " ".join(unescape("".join(held)).split())
            held.clear()
            if line:
                (inside if content else free).append(line)

    for m in TOKENS.finditer(html):
        if m.lastgroup == "text":
            if skip < 0:
                held.append(m["text"])
            continue
        if m["tag"] is None:
            if m["raw"] and skip < 0:
                held.append(" " if m["raw"].lower() in ("textarea", "iframe", "svg") else "")
            continue
        tag, content, left_out = m["tag"].lower(), marked(), skip >= 0
        if m["end"]:
            stack.end(tag)
        else:
            stack.start(tag)
        if len(stack.names) <= skip:
            skip = -1
        if not left_out or (skip < 0 and not m["end"]):
            if tag in BLOCKS:
                close(content)
            elif tag in ("br", "option"):
                held.append(" ")
        if not m["end"] and tag not in VOID and not m["rest"].endswith("/"):
            within, number = marked(), stack.push(tag)
            if skip < 0 and (tag in LEFT_OUT or (m["rest"] and tag not in NO_HINTS and (within or number not in around) and hinted(m["rest"]))):
                if tag not in BLOCKS:
                    held.append(" ")
                skip = len(stack.names) - 1
        elif left_out and skip < 0 and m["end"] and tag in BLOCKS:
            close(content)
    close(marked())
    return inside, free


def common_lines(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions in ``a`` and in ``b`` of a longest common subsequence.

    Matching pairs are walked in order of ``a``; the subsequence that rises in ``b`` is found by
    patience, with bisection, so pages that share little cost little.
    """
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    nodes: list[tuple[int, int, int]] = []           # (i, j, previous node)
    ends: list[int] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            at = bisect_left(tails, j)
            nodes.append((i, j, ends[at - 1] if at else -1))
            if at == len(tails):
                tails.append(j)
                ends.append(len(nodes) - 1)
            else:
                tails[at], ends[at] = j, len(nodes) - 1
    left, right, at = [], [], ends[-1] if ends else -1
    while at >= 0:
        i, j, at = nodes[at]
        left.append(i)
        right.append(j)
    return left[::-1], right[::-1]


def template_lines(a: dict, b: dict, before: dict | None, after: dict | None) -> tuple[list[int], list[int]]:
    """Free lines of two neighbours that belong to their template.

    These are the common lines. If they are nearly all of a page, the pair may be copies: nothing is
    deleted if one page has nothing else, and otherwise what the next page on either side has as well.
    """
    if not set(a["lines"]) & set(b["lines"]):
        return [], []
    left, right = common_lines(a["lines"], b["lines"])
    if sum(a["sizes"][i] for i in left) >= COPY_SHARE * min(sum(a["sizes"]), sum(b["sizes"])):
        if len(left) == min(len(a["lines"]), len(b["lines"])):
            return [], []
        third = {x for r in (before, after) if r for x in r["lines"]}
        both = [(i, j) for i, j in zip(left, right, strict=True) if a["lines"][i] in third]
        left, right = [i for i, _ in both], [j for _, j in both]
    return left, right


def deleted_lines(pages: DataFrame) -> DataFrame:
    """(k, sig, lines): positions of free lines to delete, for pages (k, sig, url, html) that have any."""
    import pyarrow as pa
    import xxhash

    host, path = host_and_path(F.col("url"))
    given = pages.select("k", "sig", host.alias("host"), path.alias("path"), F.coalesce("url", F.lit("")).alias("url"), "html").filter("host <> ''")
    key = given.schema["k"].dataType
    long, longs, string = T.LongType(), T.ArrayType(T.LongType()), T.StringType()
    fields = [T.StructField("k", key), T.StructField("sig", long), *(T.StructField(c, string) for c in ("host", "path", "url")),
              T.StructField("lines", longs), T.StructField("sizes", longs)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, sizes = [], []
            for h in b.column(5):
                inside, free = blocks(h.as_py() or "")
                free = [] if inside else free
                lines.append([xxhash.xxh64_intdigest(x) - (1 << 63) for x in free])
                sizes.append([len(x) for x in free])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64()))],
                                             [f.name for f in fields])

    rows = stored(given.mapInArrow(hashed, T.StructType(fields)).filter("size(lines) > 0").withColumn("body", F.xxhash64("lines")), "lines")
    # pages of a host with equal lines are one: it stands at their first URL, and its result is that of all
    first = F.min(F.struct("path", "url")).alias("at")
    distinct = rows.groupBy("host", "body").agg(first, F.first("lines").alias("lines"), F.first("sizes").alias("sizes")).select(
        "host", "at.path", "at.url", "body", "lines", "sizes")
    order = ["host", "path", "url", "body"]
    out = T.StructType([*(T.StructField(c, string) for c in ("host", "path", "url")), T.StructField("body", long), T.StructField("lines", longs),
                        T.StructField("sizes", longs), T.StructField("del", longs), T.StructField("pos", long), T.StructField("n", long)])
    schema = pa.schema([(f.name, pa.string() if f.dataType == string else pa.int64() if f.dataType == long else pa.list_(pa.int64())) for f in out])

    def batch(made):
        return pa.RecordBatch.from_pylist([{c: r.get(c) for c in schema.names} for r in made], schema)

    def hits(before, a, b, after):
        """Deletions of two neighbours; pages of other hosts say nothing."""
        if a["host"] != b["host"]:
            return []
        left, right = template_lines(a, b, *(r if r and r["host"] == a["host"] else None for r in (before, after)))
        return [{"host": r["host"], "body": r["body"], "del": gone} for r, gone in ((a, left), (b, right)) if gone]

    def inner_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs with a page before and after them in the task; the three pages at either end go on, with their place."""
        head, last, n = [], [], 0
        for b in batches:
            made = []
            for r in b.to_pylist():
                n += 1
                last = [*last[-3:], r | {"pos": n}]
                if n <= 3:
                    head.append(last[-1])
                if len(last) == 4:
                    made += hits(*last)
            yield batch(made)
        edge = {r["pos"]: r for r in [*head, *last[-3:]]}
        yield batch([edge[p] | {"n": n} for p in sorted(edge)])

    def edge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs at the ends of tasks and between two tasks."""
        rows = [r for b in batches for r in b.to_pylist()]
        made = []
        for i in range(len(rows) - 1):
            a, b = rows[i], rows[i + 1]
            crosses = a["pos"] == a["n"]
            if crosses or (b["pos"] == a["pos"] + 1 and (a["pos"] == 1 or b["pos"] == b["n"])):
                made += hits(rows[i - 1] if i else None, a, b, rows[i + 2] if i + 2 < len(rows) else None)
        yield batch(made)

    inner = stored(distinct.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(inner_pairs, out), "aligned")
    # six pages for each task of the sort: few enough for one task
    edges = inner.filter("pos IS NOT NULL").coalesce(1).sortWithinPartitions(*order).mapInArrow(edge_pairs, out)
    found = inner.filter("pos IS NULL").unionByName(edges).groupBy("host", "body").agg(F.array_distinct(F.flatten(F.collect_list("del"))).alias("gone"))
    found = broadcast_if_small(stored(found, "templates"))
    return rows.select("k", "sig", "host", "body").distinct().join(found, ["host", "body"]).groupBy("k", "sig").agg(
        F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: id, url, ``text`` (blocks joined by line feeds), ``n_chars``."""
    import pyarrow as pa

    given = pages.select(pages[f"`{id_col}`"].alias("k"), F.xxhash64(pages[f"`{html}`"]).alias("sig"), pages[f"`{url}`"].alias("url"), pages[f"`{html}`"].alias("html"))
    gone = broadcast_if_small(stored(deleted_lines(given), "deleted").withColumnsRenamed({"k": "gone_k", "sig": "gone_sig"}))
    rows = given.join(gone, F.col("k").eqNullSafe(F.col("gone_k")) & (F.col("sig") == F.col("gone_sig")), "left").select("k", "url", "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for h, gone in zip(b.column(2), b.column(3), strict=True):
                inside, free = blocks(h.as_py() or "")
                drop = set(gone.as_py() or ())
                texts.append("\n".join(inside or [x for i, x in enumerate(free) if i not in drop]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [id_col, url, "text", "n_chars"])

    return rows.mapInArrow(run, T.StructType([T.StructField(id_col, given.schema["k"].dataType), T.StructField(url, T.StringType()),
                                              T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
