"""Main text of web pages, without what a site repeats.

Every container's subtree is hashed twice: its shape (tags and class names, runs
of like children as one, inline markup left out) and its block (shape and
text).  Spark counts per host on how many different pages each occurs, where
pages of one article text count once.  Template of a host, and deleted from its pages, are

* blocks on ``LEAST_PAGES`` or more pages, and
* shapes with a class or id, outside the article, on as many pages, whose texts
  come back (a tenth of the pages or more show a text of another one, as rotating
  adverts do) or are links for the most part (menus whose links differ from page to page).

How many pages make a template doesn't depend on the host's size.  Inside an
article only containers can be template, not its text blocks: a sentence that
many articles share is still part of each.

Elements whose tag or role says that they are menus, headers, footers, sidebars,
adverts, forms or reader comments go in any case, and so do scripts and styles.
An aside inside an article goes if it is template or mostly links, else it is a
quotation.  Outside the article a class name or id of nothing but such words
(``site-footer``, ``related posts``) decides too, where a host's pages may be too
few to tell; one that has such a word among others (``social-science``) only
marks its element, whose shape is then template by its count of pages alone.
Inside the article only those few names drop that can mean nothing else.  What is
left of the article is the page's text; formulas belong to it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import longs, only, stored

#: A subtree is template from so many different pages of a host.
LEAST_PAGES = 10
#: Share of a shape's pages that must be beyond its number of texts.
LEAST_REPEATED = 0.1
#: Template hashes up to this number are broadcast; more are joined page by page.
MOST_BROADCAST = 500_000

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|textarea|iframe|svg|annotation|annotation-xml)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# HTML's void elements, and elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
TEXT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead tfoot table caption ul ol dl figcaption figure".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
DROPPED = frozenset("head nav footer aside form button select option menu dialog object canvas audio video map search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo"
    " promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login"
    " share sharing social related recommended comment comments disqus respond reply replies widget pagination pager toolbar skip".split()
)
#: Words that change nothing of what those say: a name of both kinds alone drops an element outside the article.
NEUTRAL_WORDS = frozenset(
    "site page main global primary secondary top bottom left right side sticky fixed box list links link bar block container wrapper wrap inner outer"
    " content section area header head title text form button buttons icons icon item items group row col column posts articles stories media inline js the".split()
)
#: Whole class names and ids that drop elements inside an article too.
DROPPED_INSIDE = frozenset("ad ads advert adverts advertisement advertisements sponsored comment comments comment-list user-comments cookie-notice cookie-banner newsletter-signup".split())
#: Dropped outside an article; inside they hold its title.
HEADER = "header"
CLOSES_P = BLOCK - {"body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Page:
    """A page's elements: tag, names, start and end in the page, parent's place, whether tag, role or names drop it."""

    def __init__(self, html: str, words: bool = True):
        self.html, self.words = html, words
        self.tag: list[str] = ["#page"]
        self.names: list[str] = [""]
        self.start: list[int] = [0]
        self.end: list[int] = [len(html)]
        self.parent: list[int] = [-1]
        self.dropped: list[bool] = [False]
        self.in_article: list[bool] = [False]
        #: elements with a class word that may say so, and asides of articles
        self.marked: set[int] = set()
        self.asides: list[int] = []
        #: (start, end, element) of stretches of text, and (place, place, element) with None for block ends
        self.events: list[tuple] = []
        self.articles: list[int] = []
        self.mains: list[int] = []
        self._read()

    def _read(self) -> None:
        html, stack, at = self.html, [0], 0
        events, tags = self.events, self.tag
        for m in _MARKUP.finditer(html):
            s, e = m.span()
            if s > at:
                events.append((at, s, stack[-1]))
            at = e
            name = m.group(3)
            if not name:
                continue
            name = name.lower()
            if m.group(2):
                if name == "br" or name in VOID:
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == name:
                        self._close(stack, depth, e)
                        break
                    if name in INLINE and tags[stack[depth]] not in INLINE:
                        break
                if name in BLOCK:
                    events.append((None, e, stack[-1]))
                continue
            if name in CLOSES_P:
                for depth in range(len(stack) - 1, 0, -1):
                    t = tags[stack[depth]]
                    if t == "p":
                        self._close(stack, depth, s)
                        break
                    if t not in INLINE:
                        break
            if name in SIBLINGS:
                for depth in range(len(stack) - 1, 0, -1):
                    t = tags[stack[depth]]
                    if t in SIBLINGS[name]:
                        self._close(stack, depth, s)
                        if name != "tr" or t == "tr":
                            break
                    elif t in SCOPES[name]:
                        break
            if name in BLOCK:
                events.append((None, s, stack[-1]))
            elif name in ("br", "td", "th", "img", "hr"):
                events.append((-1, s, stack[-1]))
            if name in VOID:
                continue
            k = len(tags)
            tags.append(name)
            self.start.append(s)
            self.end.append(-1)
            self.parent.append(stack[-1])
            inside = self.in_article[stack[-1]]
            self.in_article.append(inside or name == "article")
            self.dropped.append(self._drops(k, name, m.group(4), inside))
            if name == "article":
                self.articles.append(k)
            elif name == "main":
                self.mains.append(k)
            if not m.group(4).endswith("/") or name in BLOCK or name in INLINE:
                stack.append(k)
            else:
                self.end[k] = e
        if at < len(html):
            events.append((at, len(html), stack[-1]))
        self._close(stack, 1, len(html))

    def _close(self, stack: list[int], depth: int, at: int) -> None:
        for k in stack[depth:]:
            self.end[k] = at
        del stack[depth:]

    def _drops(self, k: int, name: str, attributes: str, inside: bool) -> bool:
        out = name in DROPPED and not (inside and name == "aside") or name == HEADER and not inside
        names: list[str] = []
        for what, *value in _NAMES.findall(attributes) if attributes and attributes.strip(" /") else ():
            what, value = what.lower(), "".join(value).lower()
            if what in ("class", "id"):
                names += value.split()
            elif name not in ("html", "body", "main"):
                out |= what == "hidden" or what == "aria-hidden" and value == "true" or what == "role" and value in DROPPED_ROLES
        self.names.append(" ".join(sorted(set(names))))
        if names and self.words and name not in ("html", "body", "main", "article"):
            if inside:
                out |= not DROPPED_INSIDE.isdisjoint(names)
            else:
                for x in names:
                    parts = {w for w in re.split(r"[^a-z0-9]+", x) if w}
                    says = parts & DROPPED_WORDS or parts & {"header"}
                    out |= bool(says) and parts <= DROPPED_WORDS | NEUTRAL_WORDS
                    if says:
                        self.marked.add(k)
        if inside and name == "aside" and not out:
            self.asides.append(k)
        return out

    def _linked(self, k: int) -> bool:
        """Whether most letters of an element are in links."""
        letters = linked = 0
        for s, e, at in self.events:
            if s is not None and s >= self.start[k] and e <= self.end[k]:
                n = len("".join(self.html[s:e].split()))
                letters += n
                while at > k and self.tag[at] != "a":
                    at = self.parent[at]
                linked += n * (at > k)
        return 2 * linked > letters

    def shapes(self) -> list[int]:
        """A hash of every element's tags and class names; inline elements stand for what they hold."""
        held: list[list[bytes]] = [[] for _ in self.tag]
        out = [0] * len(self.tag)
        for k in range(len(self.tag) - 1, 0, -1):
            into = held[self.parent[k]]
            if self.tag[k] in INLINE:
                into += held[k]
                continue
            inner = held[k]
            runs = [x for i, x in enumerate(inner) if not i or inner[i - 1] != x]
            digest = xxhash.xxh3_64_digest(f"{self.tag[k]}.{self.names[k]}(".encode("utf-8", "surrogatepass") + b"".join(runs) + b")")
            out[k] = int.from_bytes(digest, "big")
            into.append(digest)
        return out

    def subtrees(self) -> Iterator[tuple[int, int, int, bool, bool, int, int]]:
        """(element, shape, block, whether the shape alone may be template, whether it is marked, letters of text, those in links) of all that can be template."""
        roots = self._inside(self.articles or self.mains)
        shapes = self.shapes()
        pieces, places, letters, linked = [], [], [0], [0]
        link = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            link[k] = self.tag[k] == "a" or link[self.parent[k]]
        for s, e, k in self.events:
            if s is not None and s >= 0:
                piece = " ".join(self.html[s:e].split())
                if piece:
                    pieces.append(piece)
                    places.append(s)
                    letters.append(letters[-1] + len(piece))
                    linked.append(linked[-1] + len(piece) * link[k])
        for k in range(1, len(self.tag)):
            t = self.tag[k]
            if t in INLINE or t in ("html", "body", "article", "main", "head") or roots[k] and t in TEXT_BLOCK:
                continue
            a, b = bisect_left(places, self.start[k]), bisect_left(places, self.end[k])
            block = xxhash.xxh3_64_intdigest(f"{shapes[k]} {' '.join(pieces[a:b])}".encode("utf-8", "surrogatepass"))
            marked = not roots[k] and k in self.marked
            alone = marked or not roots[k] and t not in TEXT_BLOCK and (bool(self.names[k]) or t in DROPPED or t == HEADER)
            yield k, shapes[k], block, alone, marked, letters[b] - letters[a], linked[b] - linked[a]

    def core(self) -> int:
        """A hash of the article's own text, or of all text blocks' where none is marked: what makes pages different ones."""
        roots = [k for k in self.articles or self.mains]
        kept = self._inside(roots) if roots else [True] * len(self.tag)
        held = [False] * len(self.tag)
        gone = [False] * len(self.tag)
        for k in range(1, len(self.tag)):
            held[k] = bool(roots) or self.tag[k] in TEXT_BLOCK or held[self.parent[k]]
            gone[k] = self.tag[k] in DROPPED or gone[self.parent[k]]
        text = " ".join(self.html[s:e] for s, e, k in self.events if s is not None and s >= 0 and kept[k] and held[k] and not gone[k])
        return xxhash.xxh3_64_intdigest(" ".join(text.split() or [self.html]).encode("utf-8", "surrogatepass"))

    def _inside(self, roots: list[int]) -> list[bool]:
        out, roots = [False] * len(self.tag), set(roots)
        for k in range(1, len(out)):
            out[k] = k in roots or out[self.parent[k]]
        return out

    def text(self, template: frozenset[int] = frozenset(), only_article: bool = True) -> tuple[str, int]:
        """The text that is left, and how many subtrees went as template."""
        gone, lost = list(self.dropped), set()
        for k in self.asides:
            gone[k] = gone[k] or self._linked(k)
        if template:
            for k, shape, block, alone, _, _, _ in self.subtrees():
                if block in template or alone and shape in template:
                    lost.add(k)
        n = 0
        for k in range(1, len(gone)):
            up = self.parent[k]
            n += k in lost and up not in lost
            if up in lost:
                lost.add(k)
            gone[k] = gone[k] or gone[up] or k in lost
        roots = [k for k in self.articles if not gone[k]] or [k for k in self.mains if not gone[k]]
        kept = self._inside(roots) if roots and only_article else [True] * len(self.tag)
        blocks: list[str] = []
        now: list[str] = []
        for s, e, k in self.events:
            if s is None:
                if now:
                    blocks.append(" ".join(unescape("".join(now)).split()))
                    now = []
            elif kept[k] and not gone[k]:
                now.append(" " if s < 0 else self.html[s:e])
        if now:
            blocks.append(" ".join(unescape("".join(now)).split()))
        return "\n".join(b for b in blocks if b), n


def host(url: Column) -> Column:
    """The lower-case host of a URL; empty for a null or one without."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_TREES = "host string, html long, page long, shape long, block long, alone boolean, marked boolean, letters long, links long"


def trees(pages: DataFrame, words: bool = True) -> DataFrame:
    """(host, html, page, shape, block, alone, marked, letters, links): the subtrees of ``pages`` (url, html) that can be template.
    ``html`` and ``page`` are hashes of the markup and of the article's text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: list[list] = [[] for _ in range(9)]
                for site, key, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    page = Page(html, words)
                    found = {(shape, block): more for _, shape, block, *more in page.subtrees()}
                    if found:
                        core = page.core()
                        for (shape, block), more in found.items():
                            for c, x in zip(out, (site, key, core, shape, block, *more), strict=True):
                                c.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), *map(_signed, out[2:5]), pa.array(out[5], pa.bool_()), pa.array(out[6], pa.bool_()), *(pa.array(c, pa.int64()) for c in out[7:])],
                    ["host", "html", "page", "shape", "block", "alone", "marked", "letters", "links"],
                )

    rows = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).filter("html <> ''")
    return rows.select("host", F.xxhash64("html").alias("key"), "html").mapInArrow(hashed, _TREES)


def templates(found: DataFrame) -> DataFrame:
    """(host, tree): hashes of the blocks and shapes that are a host's template, from ``trees``."""
    blocks = found.groupBy("host", "block").agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    shapes = found.filter("alone").groupBy("host", "shape").agg(
        F.countDistinct("page").alias("pages"), F.countDistinct("block").alias("texts"), F.sum("letters").alias("letters"), F.sum("links").alias("links"), F.bool_or("marked").alias("marked")
    )
    shapes = shapes.filter((F.col("pages") >= LEAST_PAGES) & (F.col("marked") | (F.col("pages") - F.col("texts") >= LEAST_REPEATED * F.col("pages")) | (2 * F.col("links") >= F.col("letters"))))
    return blocks.select("host", F.col("block").alias("tree")).union(shapes.select("host", F.col("shape").alias("tree"))).distinct()


def _signed(values: list[int]) -> pa.Array:
    return longs(np.array(values, np.uint64))


def main_text(pages: DataFrame, words: bool = True, only_article: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars, n_template) for every row of ``pages`` (page_id, url, html).

    A null or empty page has an empty text.  A null url belongs to the empty
    host.  A page with article elements gives their text, else one with a main
    element its, else all of its body; repeated rows give repeated rows.
    An empty table gives no rows, and texts of any length are read in whole.
    ``n_template`` counts the subtrees deleted as the host's template.  Without ``words`` class
    names drop and mark nothing, without ``only_article`` all of the body counts: what
    recurs, tags and roles then decide alone.
    """
    pages = only(pages, "page_id", "url", "html")
    found = stored(trees(pages, words))
    known = stored(templates(found))
    rows = pages.withColumn("host", host(F.col("url")))
    if known.count() <= MOST_BROADCAST:
        lists = known.groupBy("host").agg(F.collect_list("tree").alias("hashes"))  # MOST_BROADCAST numbers in all
        joined = rows.join(F.broadcast(lists), "host", "left")
    else:
        # each page's own template subtrees, so that a host's list is never in one place
        own = found.select("host", "html", F.explode(F.array("shape", "block")).alias("tree")).distinct().join(known, ["host", "tree"])
        own = own.groupBy("host", F.col("html").alias("_key")).agg(F.collect_list("tree").alias("hashes"))
        joined = rows.withColumn("_key", F.xxhash64("html")).join(own, ["host", "_key"], "left")
    joined = joined.select("page_id", "url", "html", "hashes")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, hashes, last = [], [], frozenset(), None
            for html, known_hashes in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                if known_hashes != last:
                    last = known_hashes
                    hashes = frozenset(h & (1 << 64) - 1 for h in known_hashes.as_py() or ())
                text, n = Page(html, words).text(hashes, only_article) if html else ("", 0)
                texts.append(text)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_template"],
            )

    return joined.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_template long")
