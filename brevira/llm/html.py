"""HTML extraction with site template removal.

Pages are parsed into element trees. The source of every element outside the article (all elements, where a page has
none) is hashed together with the page's host; Spark counts on how many pages of its host each hash occurs, and elements
that recur on many of them are deleted with all that they hold. What is left is read as the page's main text:
the article (``article``, ``main``), or the whole body where there is none, without elements that are page furniture by
their tag, role or class.

Inside the article the small blocks that are not paragraphs are counted too, by the different articles that hold them, and go
if half of the host's articles do. Articles are told apart by their longest paragraph, so copies of a text on several pages
count as one and stay whole.
"""

from __future__ import annotations

import hashlib
import html as entities
import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, bounded, free, mix, span_hashes, stash
from .urls import split_url

#: An element is a template if it recurs on so many pages of its host, and on that share of them.
MIN_PAGES, MIN_SHARE = 4, 0.05
#: A block of the article is one if it recurs in so many different articles of its host, on that share of them, and has at
#: most so many characters and that share of the text around it.
MIN_ARTICLES, ARTICLE_SHARE, MOST_CHARS, MOST_PART = 4, 0.5, 1000, 0.5

#: A tag holds no "<" but in quotes, so that unclosed tags are not read over and over.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CUT_OFF = re.compile(r"<[/!a-zA-Z][^<>]*\Z")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ROOTS = frozenset(("article", "main"))
#: Elements of the article that never go for recurring.
PARAGRAPHS = INLINE | ROOTS | frozenset("html body head p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd caption thead tbody tfoot tr td th colgroup figcaption summary".split())
#: Tags that are never main text; the second set only outside the article.
FURNITURE = RAW | frozenset("nav footer aside form head button select dialog menu object embed audio video canvas".split())
OUTSIDE = frozenset(("header",))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLASSES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs comment comments commentlist respond disqus share sharing social newsletter subscribe subscription related footer".split()
)
OUTSIDE_CLASSES = frozenset(("header", "masthead", "topbar", "widget"))
#: A start tag closes open elements of these tags, up to the nearest of the stops.
CLOSES = {t: frozenset(("p",)) for t in "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
CLOSES |= {"li": frozenset(("li", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "tr": frozenset(("tr", "td", "th", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")), "option": frozenset(("option",))}
STOPS = frozenset("html body article main section div ul ol dl table nav aside footer header form blockquote".split())
#: Kinds of furniture: a form, by a class or id, and what no article lies in.
FORM, NAMED, HARD = 1, 2, 3
FORM_ROLES = frozenset(("form", "search"))
COMMENTS = frozenset("comment comments commentlist respond disqus".split())
#: Names that tell what an element goes with, or wraps, and not what it is.
APART, AROUND = frozenset("with without no not non has".split()), frozenset("wrap wrapper layout".split())
STUDIES = frozenset("work works research literature studies".split())


def named(value: str) -> set[str]:
    """Words of a class or id, but for those of names that don't name the element."""
    out: set[str] = set()
    for name in value.split():
        words = re.split(r"[_-]+", name)
        if not (APART.intersection(words[:-1]) or (len(words) > 1 and words[-1] in AROUND)):
            out.update(w for w, after in zip(words, [*words[1:], ""], strict=True) if not (w == "related" and after in STUDIES))
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


class Page:
    """Elements of a page, in order: tag, parent, source start and end, furniture or not; and its text tokens.

    ``article`` and ``main`` are roots in a form too, and ``main`` in any element that is furniture by its class. An ``article``
    in such an element waits: it counts only where the page has no other root.
    """

    __slots__ = ("ends", "html", "inside", "junk", "marks", "open_", "parents", "roots", "starts", "tags", "texts", "waiting")

    def __init__(self, html: str | None):
        self.html = html = html or ""
        self.tags, self.parents, self.starts, self.ends, self.junk, self.inside = ["#"], [-1], [0], [len(html)], [0], [False]
        self.marks = [0]
        self.roots: list[int] = []
        self.waiting: list[int] = []
        self.texts: list[tuple[int, str | None, str]] = []  # (element, text or None for an edge, tag of the edge)
        stack, at = [0], 0
        size, last = len(html), html.rfind(">")
        self.open_: Counter = Counter()
        while at < size:
            m = TOKEN.search(html, at) if at <= last else None
            if m is None:
                rest = html[at:]
                self._text(stack[-1], CUT_OFF.sub("", rest[: rest.find("<!--")] if "<!--" in rest else rest))
                break
            if m.start() > at:
                self._text(stack[-1], html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(stack, tag, m.start(), at)
                continue
            closing = CLOSES.get(tag)
            if closing and any(self.open_[t] for t in closing):
                for i in range(len(stack) - 1, 0, -1):
                    own = self.tags[stack[i]]
                    if own in closing:
                        self._pop(stack, i, m.start(), m.start())
                    elif own in STOPS:
                        break
            if tag in VOID or m[3].endswith("/") and tag not in RAW:
                self.texts.append((stack[-1], None, tag))
                continue
            self._open(stack, tag, m[3], m.start())
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else size
                self._pop(stack, len(stack) - 1, at, at)
        while len(stack) > 1:
            self._pop(stack, len(stack) - 1, size, size)
        if self.waiting:
            self.junk = [j and (j == 2 or bool(self.roots)) for j in self.junk]
            self.roots = self.roots or self.waiting

    def _text(self, node: int, text: str) -> None:
        if text and self.junk[node] < 2:
            self.texts.append((node, text, ""))

    def _open(self, stack: list[int], tag: str, attributes: str, start: int) -> int:
        up = stack[-1]
        inside, mark = self.inside[up], self.marks[up]
        own = FORM if tag == "form" else HARD if tag in FURNITURE else NAMED if not inside and tag in OUTSIDE else 0
        main = tag == "main"
        if own < HARD and mark < HARD and attributes:
            for m in ATTRIBUTE.finditer(attributes):
                value = (m[2] or m[3] or m[4] or "").lower()
                if m[1].lower() == "role":
                    words = set(re.split(r"[\s_-]+", value))
                    main |= "main" in words
                    if words & ROLES:
                        own = max(own, FORM if words & ROLES <= FORM_ROLES else HARD)
                    continue
                words = named(value)
                if words & COMMENTS and (tag not in ("html", "body", "article", "main") or "comment" in words or "comments" in words):
                    own = HARD
                elif tag not in ("html", "body", "article", "main") and (words & CLASSES or (not inside and words & OUTSIDE_CLASSES)):
                    own = max(own, NAMED)
        root = not inside and mark < HARD and (main or tag in ROOTS) and own < (HARD if main else FORM)
        wait = root and mark > FORM and not main
        mark = 0 if root else max(mark, own)
        junk = 2 if mark else 1 if wait else self.junk[up] if inside else 0
        inside |= root
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(up)
        self.starts.append(start)
        self.ends.append(len(self.html))
        self.junk.append(junk)
        self.marks.append(mark)
        self.inside.append(inside)
        if root:
            (self.waiting if wait else self.roots).append(node)
        stack.append(node)
        self.open_[tag] += 1
        if tag not in INLINE:
            self.texts.append((node, None, tag))
        return node

    def _pop(self, stack: list[int], i: int, start: int, end: int) -> None:
        for j in range(len(stack) - 1, i - 1, -1):
            node = stack.pop()
            self.open_[self.tags[node]] -= 1
            self.ends[node] = end if j == i else start
            if self.tags[node] not in INLINE:
                self.texts.append((self.parents[node], None, self.tags[node]))

    def _close(self, stack: list[int], tag: str, start: int, end: int) -> None:
        if not self.open_[tag]:
            return
        for i in range(len(stack) - 1, 0, -1):
            own = self.tags[stack[i]]
            if own == tag:
                self._pop(stack, i, start, end)
                return
            if tag not in STOPS and own in STOPS:
                return  # an end tag of what isn't open here

    def subtrees(self, host: str) -> dict[int, int]:
        """Hashes of the elements that may be templates: those outside the article and not around it."""
        around = {0}
        for r in self.roots:
            while r > 0:
                around.add(r)
                r = self.parents[r]
        own = [i for i in range(1, len(self.tags)) if not (i in around or (self.inside[i] and self.roots) or self.tags[i] in ("html", "body", "head"))]
        return dict(zip(own, self._hashes(own, host), strict=True))

    def _hashes(self, own: list[int], host: str) -> list[int]:
        """Hashes of a host and of elements' sources with white-space runs as one space, from sums over the whole page."""
        if not own:
            return []
        code = np.frombuffer(self.html.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = np.isin(code, _SPACES)
        kept = ~space
        kept[1:] |= space[1:] & ~space[:-1]  # the first of each run
        at = np.concatenate(([0], np.cumsum(kept)))
        # an element ends behind its last character that is not white space
        last = np.maximum.accumulate(np.where(space, -1, np.arange(len(code))))
        starts = np.array([self.starts[i] for i in own])
        ends = np.maximum(last[np.maximum(np.array([self.ends[i] for i in own]), starts + 1) - 1] + 1, starts)
        h = span_hashes(np.where(space, 32, code)[kept], at[starts], at[ends])
        return mix(h ^ np.uint64(_hash(host) & (1 << 64) - 1)).view(np.int64).tolist()

    def blocks(self, host: str) -> tuple[int | None, dict[int, tuple[int, int]]]:
        """The article's hash (None without one), and for each of its elements that may be a template the element's hash and that
        of the article without it."""
        if not self.roots:
            return None, {}
        runs: list[tuple[int, str]] = []  # (element, text) of the article's text blocks
        now: list[tuple[int, str]] = []
        for node, text, _ in [*self.texts, (0, None, "")]:
            if text is not None:
                if self.inside[node] and not self.junk[node]:
                    now.append((node, text))
            elif now:
                block = " ".join("".join(x for _, x in now).split())
                if block:
                    runs.append((now[0][0], block))
                now = []
        last = list(range(len(self.tags)))
        for i in range(len(last) - 1, 0, -1):
            last[self.parents[i]] = max(last[self.parents[i]], last[i])
        before = [0] * (len(last) + 1)  # characters of the text blocks of elements before each
        for n, b in runs:
            before[n + 1] += len(b)
        before = list(itertools.accumulate(before))
        may = []
        for i in range(1, len(last)):
            if self.inside[i] and self.inside[self.parents[i]] and not self.junk[i] and self.tags[i] not in PARAGRAPHS:
                size = before[last[i] + 1] - before[i]
                if 0 < size <= min(MOST_CHARS, MOST_PART * (before[-1] - size)):
                    may.append(i)
        within = [False] * len(last)
        for i in may:
            if not within[i]:
                within[i : last[i] + 1] = [True] * (last[i] + 1 - i)
        runs.sort(key=lambda x: -len(x[1]))
        main = next((b for n, b in runs if not within[n]), None)
        whole = _hash(main if main is not None else runs[0][1] if runs else "")
        out = {}
        for i, h in zip(may, self._hashes(may, f"{host}\0article"), strict=True):
            out[i] = (h, whole if main is not None else _hash(next(b for n, b in runs if not i <= n <= last[i])))
        return whole, out

    def dead(self, host: str, bad: set[int]) -> set[int]:
        """The elements whose hashes are in ``bad``."""
        return {i for i, h in self.subtrees(host).items() if h in bad} | {i for i, (h, _) in self.blocks(host)[1].items() if h in bad}

    def text(self, gone: set[int] = frozenset()) -> str:
        """Main text without the elements of ``gone`` and all below them."""
        dead = [False] * len(self.tags)
        for i in range(1, len(dead)):
            dead[i] = dead[self.parents[i]] or i in gone
        blocks, now = [], []
        for node, text, _ in self.texts:
            if text is None:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif not dead[node] and not self.junk[node] and (self.inside[node] or not self.roots):
                now.append(entities.unescape(text))
        if now:
            blocks.append(" ".join("".join(now).split()))
        return " ".join(b for b in blocks if b)


def _keyed(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    return pages.withColumn(free("_key", pages), F.xxhash64(url_col, html_col))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(_key, _gone): for each page with template elements, their hashes. _key is a hash of url and html."""

    def make():
        def hashes(urls, htmls):
            hosts, outer, articles, inner = [split_url(u)[0] for u in urls], [], [], []
            for h, host in zip(htmls, hosts, strict=True):
                page = Page(h)
                outer.append(sorted(set(page.subtrees(host).values())))
                article, blocks = page.blocks(host)
                articles.append(article)
                inner.append([{"h": x, "article": y} for x, y in sorted(set(blocks.values()))])
            return hosts, outer, articles, inner

        return hashes

    src = _keyed(pages.select(url_col, html_col), url_col, html_col)
    own = stash(pages.sparkSession, add_columns(src, [url_col, html_col], "_host string, _hashes array<long>, _article long, _blocks array<struct<h:long,article:long>>", make).select("_key", "_host", "_hashes", "_article", "_blocks"), "subtrees")
    total = own.groupBy("_host").agg(F.count("*").alias("_pages"))
    each = own.select("_key", "_host", F.explode("_hashes").alias("_h"))
    often = each.groupBy("_host", "_h").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages)
    often = often.join(total, "_host").where(F.col("_n") >= F.col("_pages") * F.lit(min_share)).select("_h")
    if not own.where("size(_blocks) > 0").isEmpty():
        inner = own.select("_key", "_host", F.explode("_blocks").alias("_b")).select("_key", "_host", F.col("_b.h").alias("_h"), F.col("_b.article").alias("_a"))
        articles = own.where("_article is not null").groupBy("_host").agg(F.countDistinct("_article").alias("_articles"))
        within = inner.groupBy("_host", "_h").agg(F.countDistinct("_a").alias("_n")).where(F.col("_n") >= MIN_ARTICLES)
        within = within.join(articles, "_host").where(F.col("_n") >= F.col("_articles") * F.lit(ARTICLE_SHARE)).select("_h")
        each, often = each.unionByName(inner.drop("_a")), often.unionByName(within)
    # a hash holds the host, and a key stands for equal pages; a template of a third of all pages is one row of a broadcast table
    often = stash(pages.sparkSession, often.distinct(), "often")
    return each.select("_key", "_h").join(bounded(often, often.count()), "_h").groupBy("_key").agg(F.collect_set("_h").alias("_gone"))


def extracted(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``pages`` with their main text ("" where there is none; null html is empty). Every row is kept, repeated ones too;
    a null url is a page of the host ""."""
    found = stash(pages.sparkSession, templates(pages, url_col, html_col, min_pages, min_share), "templates")
    key, gone_col = free("_key", pages), free("_gone", pages)
    # the bound counts hashes, not rows
    found = bounded(found.select(F.col("_key").alias(key), F.col("_gone").alias(gone_col)), found.agg(F.coalesce(F.sum(F.size("_gone") + 2), F.lit(0))).first()[0])
    joined = _keyed(pages, url_col, html_col).join(found, key, "left").drop(key)

    def make():
        def read(urls, htmls, gone):
            out = []
            for url, html, hashes in zip(urls, htmls, gone, strict=True):
                page = Page(html)
                bad = set(hashes or ())
                out.append(page.text(page.dead(split_url(url)[0], bad) if bad else frozenset()))
            return (out,)

        return read

    return add_columns(joined, [url_col, html_col, gone_col], f"`{out_col}` string", make, drop=[gone_col])


def report(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extracted(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
