"""Operator 9: main text of web pages by composite text density.

Every block-level node gets a density: characters per tag, scaled by a logarithm that shrinks where characters are
link characters. The node with the greatest sum of child densities is the core of the article; the least density on
the path to it below the body is the threshold for what else belongs to the text, on every page; a declared article or
main lets thinner text pass that isn't mostly links. What a page declares to be menu, header, footer, sidebar, notice,
advert, form or comment is left out before densities are taken; where only the words of a class or id say so, an
element that holds the densest text of the page stays.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle mfenced mspace semantics svg g text tspan".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes template annotation annotation-xml desc metadata".split())
LEFT_OUT = frozenset("nav footer aside form button select dialog menu head object video audio canvas applet".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion comment comments commentlist disqus respond "
    "sidebar nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice popup modal newsletter subscribe share sharing "
    "social related recommended recommendations widget toolbar pagination pager login signup masthead".split()
)
#: Parts of a compound name that say that the rest isn't so.
DENIALS = frozenset("no not non has have with without hide hidden free".split())
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A start tag that ends an open element of the other names, up to the nearest of the last names.
LISTS = frozenset("ul ol dl menu".split())
CLOSES = {"li": (frozenset(("li",)), LISTS), "dt": (frozenset(("dt", "dd")), LISTS), "dd": (frozenset(("dt", "dd")), LISTS), "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))), "td": (frozenset(("td", "th")), frozenset(("table", "tr"))), "th": (frozenset(("td", "th")), frozenset(("table", "tr"))), "option": (frozenset(("option",)), frozenset(("select",)))}

#: Quotes part values only right behind an equals sign.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<""", re.S)
#: One attribute, name and value: what stands in the value of another or ends a longer name is none.
ATTRIBUTE = re.compile(r"""([^\s=/>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
#: Less text than this isn't the main text of an element whose class says otherwise.
LEAST_TEXT = 200
STAYS, BY_WORD, GONE = 0, 1, 2


def _left_out(tag: str, attributes: str, in_article: bool) -> int:
    """GONE for what tag, role or style leave out, BY_WORD for what only words of class or id do."""
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return GONE
    if not attributes or tag in ("html", "body"):
        return STAYS
    said = STAYS
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return GONE
        if name == "role" and value in LEFT_OUT_ROLES and tag not in ARTICLES:
            return GONE
        if name in ("class", "id") and tag not in ARTICLES:
            words = [w for part in value.split() if DENIALS.isdisjoint(found := re.findall("[a-z]+", part)) for w in found]
            if LEFT_OUT_WORDS.intersection(words) or (name == "id" and value == "header"):
                said = BY_WORD
    return said


class Page:
    """Block-level nodes of a page in order, with their text segments and counts."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.out, self.by_word = ["#root"], [-1], [False], [False]
        self.tags, self.link_tags, self.chars, self.link_chars = [0], [0], [0], [0]
        #: Node, text, and whether most of it is links.
        self.segments: list[tuple[int, str, bool]] = []
        self._parse(source)
        self._settle()

    def _parse(self, source: str) -> None:
        stack = [0]
        #: How many elements of each name are open.
        held: Counter = Counter()
        pieces: list[str] = []
        link_pieces: list[str] = []
        links = articles = 0
        # An inline element that is left out, and how many of its name are open; the block around it goes on behind it.
        muted, depth = "", 0
        at, size = 0, len(source)

        def flush() -> None:
            if pieces:
                text = " ".join("".join(pieces).split())
                node = stack[-1]
                if text and not self.out[node]:
                    linked = len(" ".join("".join(link_pieces).split()))
                    self.segments.append((node, text, 2 * linked > len(text)))
                    self.chars[node] += len(text)
                    self.link_chars[node] += linked
                pieces.clear()
                link_pieces.clear()

        def pop() -> None:
            nonlocal articles
            flush()
            name = self.tag[stack.pop()]
            held[name] -= 1
            articles -= name in ARTICLES

        while at < size:
            m = TOKEN.match(source, at)
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if not muted and not m[0].startswith(("<!", "<?")):
                    text = html.unescape(m[0])
                    pieces.append(text)
                    if links:
                        link_pieces.append(text)
                continue
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if tag == muted:
                    depth -= 1
                    muted = muted if depth else ""
                if tag == "a":
                    links = 0
                elif tag in INLINE:
                    pass
                elif tag == "p" and not held["p"]:
                    muted = ""
                    flush()
                elif held[tag] > 0:
                    muted = ""
                    while self.tag[stack[-1]] != tag:
                        pop()
                    pop()
                continue
            if tag in RAW:
                # Text that a browser doesn't show as markup; none of it is article text.
                if not attributes.rstrip().endswith("/"):
                    end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else size
                continue
            node = stack[-1]
            self.tags[node] += 1
            if tag == "a":
                links = 1
                self.link_tags[node] += 1
            if tag == "br":
                pieces.append(" ")
            if tag in VOID and tag not in ("hr",):
                continue
            gone = GONE if self.out[node] else _left_out(tag, attributes, articles > 0)
            if tag in INLINE:
                # A link ends the one before.
                if muted == tag == "a":
                    muted = ""
                if muted:
                    depth += tag == muted
                elif gone and not self.out[node]:
                    muted, depth = tag, 1
                continue
            muted = ""
            if tag != "hr" and held["p"] and any(self.tag[n] == "p" for n in stack[-4:]):
                while self.tag[stack[-1]] != "p":
                    pop()
                pop()
            if tag in CLOSES and any(held[name] for name in CLOSES[tag][0]):
                own, scope = CLOSES[tag]
                k = len(stack) - 1
                while k > 0 and self.tag[stack[k]] not in scope and self.tag[stack[k]] not in own:
                    k -= 1
                if self.tag[stack[k]] in own:
                    while len(stack) > k:
                        pop()
            flush()
            if tag == "hr":
                continue
            node = stack[-1]
            self.tag.append(tag)
            self.parent.append(node)
            self.out.append(self.out[node] or gone == GONE)
            self.by_word.append(gone == BY_WORD)
            for counts in (self.tags, self.link_tags, self.chars, self.link_chars):
                counts.append(0)
            stack.append(len(self.tag) - 1)
            held[tag] += 1
            articles += tag in ARTICLES
        flush()

    def _settle(self) -> None:
        """Leaves out what class and id words name, but for the element with the densest text of the page, if that is one.

        A region is an element so named without those within it; region 0 is the page without any of them. Where
        region 0 has text in a declared article, only a region that has some too can take its place.
        """
        if not any(self.by_word):
            return
        region = [0] * len(self.tag)
        declared = [False] * len(self.tag)
        for node in range(1, len(self.tag)):
            region[node] = node if self.by_word[node] else region[self.parent[node]]
            declared[node] = self.tag[node] in ARTICLES or declared[self.parent[node]]
        core, prose, in_article = ([0.0] * len(self.tag) for _ in range(3))
        for node, (c, lc) in enumerate(zip(self.chars, self.link_chars, strict=True)):
            prose[region[node]] += c - lc
            if declared[node]:
                in_article[region[node]] += c - lc
        density, sums = self.densities(region)
        for node in range(len(self.tag)):
            core[region[node]] = max(core[region[node]], density[node], sums[node])
        able = [n for n in range(1, len(self.tag)) if self.by_word[n] and prose[n] >= LEAST_TEXT and (in_article[n] or not in_article[0])]
        best = max(able, key=lambda n: (core[n], -n), default=0)
        stays = {0}
        if best and core[best] > core[0]:
            while best:
                stays.add(region[best])
                best = self.parent[best]
        for node in range(1, len(self.tag)):
            if region[node] not in stays and not self.out[node]:
                self.out[node], self.chars[node], self.link_chars[node] = True, 0, 0
        self.segments = [x for x in self.segments if not self.out[x[0]]]

    def densities(self, region: list[int] | None = None) -> tuple[list[float], list[float]]:
        """Composite density of each node and the sum over its children, from counts of its subtree (within its region)."""
        tags, link_tags, chars, link_chars = (list(x) for x in (self.tags, self.link_tags, self.chars, self.link_chars))
        within = [region is None or region[n] == region[self.parent[n]] for n in range(len(self.tag))]
        for node in range(len(self.tag) - 1, 0, -1):
            if within[node]:
                for counts in (tags, link_tags, chars, link_chars):
                    counts[self.parent[node]] += counts[node]
        share = sum(self.link_chars) / max(sum(self.chars), 1)
        density, sums = [], [0.0] * len(self.tag)
        for c, t, lc, lt in zip(chars, tags, link_chars, link_tags, strict=True):
            if not c:
                density.append(0.0)
                continue
            base = math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e))
            density.append(c / max(t, 1) * math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1) + 1) / max(base, 1e-6))
        for node in range(1, len(self.tag)):
            if within[node]:
                sums[self.parent[node]] += density[node]
        return density, sums

    def text(self) -> str:
        if not self.segments:
            return ""
        density, sums = self.densities()
        best = max(range(len(self.tag)), key=lambda n: (sums[n] if not self.out[n] else -1.0, -n))
        if not sums[best]:
            best = 0
        path = [best]
        while path[-1]:
            path.append(self.parent[path[-1]])
        # The whole core, and beside the path to it what is as dense as the thinnest node of the path. That an article is
        # declared is only a prior: text in it that is thinner stays if less than half of it is links.
        below_body = [n for n in path if self.tag[n] not in ("#root", "html", "body")]
        threshold = min(density[n] for n in below_body or path)
        on_path = set(path)
        declared = [False] * len(self.tag)
        for node in range(1, len(self.tag)):
            declared[node] = self.tag[node] in ARTICLES or declared[self.parent[node]]
        link_chars, chars = self._of_subtrees(self.link_chars), self._of_subtrees(self.chars)

        def chosen(n: int) -> bool:
            if declared[n] and 2 * link_chars[n] < chars[n]:
                return True
            return self.parent[n] in on_path and (density[n] >= threshold or self.tag[n] in HEADINGS)

        keep = {best} | {n for n in range(1, len(self.tag)) if n not in on_path and chosen(n)}
        if len(self.segments) == sum(s[0] == 0 for s in self.segments) or best == 0:
            keep = {0}
        inside = [False] * len(self.tag)
        for node in range(len(self.tag)):
            inside[node] = node in keep or (node > 0 and inside[self.parent[node]])
        # Loose text beside the path: links outside the article that the core is in are none of it.
        own = lambda n, links: n in on_path and density[n] and (declared[n] or not links or not declared[best])
        return "\n".join(text for node, text, links in self.segments if inside[node] or own(node, links))

    def _of_subtrees(self, counts: list[int]) -> list[int]:
        total = list(counts)
        for node in range(len(total) - 1, 0, -1):
            total[self.parent[node]] += total[node]
        return total


def main_text(source: str | None) -> str:
    """The article's blocks joined by newlines; empty if there is none. Malformed markup never fails."""
    return Page(source).text() if source else ""


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; null and empty html give an empty text; other columns are not read.

    Repeated rows are extracted alike, an empty table gives no rows, and pages of any length are read whole, in time that
    follows their length however their elements are nested.
    """

    def run(batches):
        for batch in batches:
            text = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(text, pa.string()), "n_chars": pa.array(list(map(len, text)), pa.int64())})

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
