"""HTML main text: streaming parser events, text-to-tag ratio per line, Gaussian smoothing and
threshold clustering to select content regions.

The standard library's parser streams a page's events; each block's text is a line, with the tags
that it takes. Element names tell menus, footers, forms, scripts and the like for certain. Words of
classes, ids and roles are a prior alone: an element so marked is boilerplate unless the ratios of its
own lines, its share of the text or the articles in it say otherwise. The ratios of the lines left are
smoothed and split in two clusters by a threshold. The sectioning element that holds the most
content-cluster text is the content region; short lines inside it stay, while runs of links and, in
regions that no element names, other lines out of the content cluster are cut from its ends.

Elements are kept as numbers with their parents, children after parents, so all work is linear in the page.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import pick

# Element names by role, and words of class, id and role that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input menu nav noscript object script select style svg template textarea title video".split())
SECTIONS = ("article", "main")
REGIONS = frozenset("article main body section div td".split())
MARKS = frozenset("ad ads alert advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split())
#: Everyday words among the marks: next to a word that is none of PARTS they tell little.
PLAIN = frozenset("ad alert banner notice notices overlay promotion related reply share sharing skip social".split())
PARTS = frozenset("area articles aside bar block blocks body bottom box boxes btn button buttons card cards col column container content footer form global group header heading icon icons inline inner item items left link links list main media message module news outer page panel post posts reading right row section site slot sticky stories story text this title top unit wrap wrapper".split())
#: Elements whose start ends an open one of these, unless one of the others was opened in it.
CELLS, GROUPS = ("td", "th"), ("tbody", "thead", "tfoot")
CLOSES = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", *CELLS), ("table",))} | {t: (CELLS, ("table",)) for t in CELLS} | {t: (("tr", *CELLS, *GROUPS), ("table",)) for t in GROUPS}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTS = HEADINGS | frozenset("address blockquote caption dd dt figcaption li p pre td th".split())
#: Words that make a class name tell of a layout: with one before or after it, a mark is none.
BEFORE, AFTER = frozenset("has no not with without".split()), frozenset("closed free open".split())
#: Marks of what readers wrote: articles in there are not the page's.
READERS = frozenset("comment comments disqus replies respond".split())
#: How an element is told: for certain; by its names; by everyday words alone; by everyday words among others; as readers'.
HARD, MARKED, USUAL, DOUBT, READER = 1, 2, 3, 4, 5
_SPLIT = re.compile(r"[^a-z0-9]+")


class _Events(HTMLParser):
    """Collects the lines of a page and the elements that they are in.

    A line is (pieces, tags, element), a piece (text, element, in a link). Elements are numbers, 0 the page;
    parent, kind (tag) and mark tell of each. Text told as boilerplate for certain is not kept."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.kind, self.mark = [0], [""], [0]
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of each tag its open elements in the stack
        self.regions: list[int] = []  # places of open regions
        self.hard = 0  # size of the stack at which boilerplate began
        self.lines: list[tuple[list[tuple[str, int, bool]], int, int]] = []
        self.pieces: list[tuple[str, int, bool]] = []
        self.tags, self.link = 0, False

    def _node(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def _break(self) -> None:
        if self.pieces:
            self.lines.append((self.pieces, self.tags, self._node()))
        self.pieces, self.tags = [], 0

    def _push(self, tag: str, mark: int = 0) -> None:
        node = self._node()
        if not self.hard and mark != HARD:
            self.parent.append(node)
            self.kind.append(tag)
            self.mark.append(mark)
            node = len(self.parent) - 1
        self.places[tag].append(len(self.stack))
        if tag in REGIONS:
            self.regions.append(len(self.stack))
        self.stack.append((tag, node))
        if mark == HARD and not self.hard:
            self.hard = len(self.stack)

    def _pop_to(self, depth: int) -> None:
        """Close all elements from this place on."""
        while len(self.stack) > depth:
            self.places[self.stack.pop()[0]].pop()
        while self.regions and self.regions[-1] >= depth:
            self.regions.pop()
        if self.hard > depth:
            self.hard = 0
        self.link = False

    def _last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def handle_starttag(self, tag, attrs):
        if self.hard:
            if tag not in VOID:
                self._push(tag)
            return
        self.tags += 1
        if tag == "br":
            self.pieces.append((" ", self._node(), self.link))
            return
        if tag in INLINE:
            if tag == "a":
                self.link = True
            if tag not in VOID and (mark := self._told(tag, attrs)):
                self._push(tag, mark)
            return
        self._break()
        if tag in ENDS_P and (at := self._last(("p",))) >= 0 and not (self.regions and self.regions[-1] >= at):
            self._pop_to(at)
        if tag in CLOSES:
            closed, around = CLOSES[tag]
            while (at := self._last(closed)) > self._last(around):
                self._pop_to(at)
        if tag not in VOID:
            self._push(tag, self._told(tag, attrs))

    def handle_startendtag(self, tag, attrs):
        """An unknown element's closing slash does not close it in HTML; a void one has no end."""
        self.handle_starttag(tag, attrs)

    def _told(self, tag, attrs) -> int:
        inside = self._last(SECTIONS) >= 0  # an article's own header holds its title
        if tag in DROPPED or tag == "header" and not inside:
            return HARD
        if tag in ("html", "body", *SECTIONS):
            return 0
        out = 0
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return HARD
            if value and name in ("class", "id", "role"):
                for part in value.lower().split():
                    words = _SPLIT.split(part)
                    found = {w for k, w in enumerate(words) if (w in MARKS or w == "header" and not inside) and BEFORE.isdisjoint(words[:k]) and AFTER.isdisjoint(words[k + 1 :])}
                    if not found:
                        continue
                    if not READERS.isdisjoint(found):
                        return READER
                    if not found <= PLAIN:
                        out = MARKED
                    elif out != MARKED:
                        alone = all(w in MARKS or w in PARTS or len(w) < 2 or w.isdigit() for w in words)
                        out = USUAL if alone or out == USUAL else DOUBT
        return out

    def handle_endtag(self, tag):
        at = self._last((tag,))
        if self.hard:
            if at >= self.hard - 1 or at >= 0 and tag in REGIONS:  # the parent ends: so does what was left open in it
                self._pop_to(at)
            return
        self.tags += 1
        if tag in INLINE:
            if tag == "a":
                self.link = False
            if at >= 0 and not (self.regions and self.regions[-1] > at):  # of an element that its names mark
                self._pop_to(at)
            return
        self._break()
        if at >= 0:
            self._pop_to(at)

    def parse_marked_section(self, i, report=1):
        """`<![...` of unknown kind is a bogus comment, where the library would raise."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def handle_data(self, data):
        if not self.hard:
            self.pieces.append((data, self._node(), self.link))


class _Page:
    """The lines of a page with the marks of its elements weighed against what they hold."""

    def __init__(self, html: str, cut: float):
        events = _Events()
        events.feed(html)
        events.close()
        events._break()
        self.parent, self.kind, self.mark, self.lines = events.parent, events.kind, events.mark, events.lines
        self.free = [m == 0 for m in self.mark]  # elements that are themselves no boilerplate
        self._layouts()
        self._texts(cut)

    def _owners(self) -> list[int]:
        """Of each element the innermost boilerplate that it is or is in, else 0."""
        out = [0] * len(self.parent)
        for n in range(1, len(out)):
            out[n] = out[self.parent[n]] if self.free[n] else n
        return out

    def _held(self, owner: list[int]) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
        """By owner the characters without white space, the tags and the lines."""
        chars, tags, lines = defaultdict(int), defaultdict(int), defaultdict(int)
        for pieces, n, _ in self.lines:
            own = defaultdict(int)
            for text, node, _ in pieces:
                own[owner[node]] += len("".join(text.split()))
            for k, size in own.items():
                if size:
                    chars[k] += size
                    tags[k] += max(1, n)
                    lines[k] += 1
        return chars, tags, lines

    def _layouts(self) -> None:
        """Free marked elements that hold most of the page's text, or its articles where none stands outside, and
        those around them. What readers wrote is none unless it is the only text. A pass or two is enough: then
        most text, or an article, is free."""
        while True:
            owner = self._owners()
            chars, _, _ = self._held(owner)
            total, reader, article = sum(chars.values()), [False] * len(self.parent), set()
            for n in range(1, len(self.parent)):
                reader[n] = reader[self.parent[n]] or self.mark[n] == READER and not self.free[n]
                if self.kind[n] in SECTIONS and not reader[n]:
                    article.add(owner[n])
            around = {n for n in article if n} if article and 0 not in article else set()
            around |= {n for n, size in chars.items() if n and 2 * size > total and (not chars.get(0) or not reader[n])}
            if not around:
                return
            for n in around:
                while n and not (self.free[n] and owner[n] == 0):
                    self.free[n], n = True, self.parent[n]

    def _texts(self, cut: float) -> None:
        """Free elements that everyday words mark but whose text is as dense as the page's: with other words in the
        name that alone is enough, else they must hold a fair share of the text too."""
        owner = self._owners()
        chars, tags, lines = self._held(owner)
        free = [sum(len("".join(t.split())) for t, n, _ in pieces if not owner[n]) / max(1, count) for pieces, count, _ in self.lines]
        free = [x for x in free if x]
        least = cut * sum(free) / len(free) if free else 0.0
        for n in range(1, len(self.parent)):
            if self.free[n] or self.mark[n] not in (USUAL, DOUBT) or n not in chars or chars[n] / tags[n] < least:
                continue
            big = 4 * chars[n] >= chars.get(0, 0) and (lines[n] >= 3 or chars[n] >= 600)
            self.free[n] = self.mark[n] == DOUBT or big

    def texts(self) -> list[tuple[str, int, int, float]]:
        """(text, tags, element, share of it in links) of each line out of boilerplate."""
        owner, out = self._owners(), []
        for pieces, tags, node in self.lines:
            kept = [(t, link) for t, n, link in pieces if not owner[n]]
            if text := " ".join("".join(t for t, _ in kept).split()):
                size = lambda rows: sum(len("".join(t.split())) for t in rows)
                out.append((text, max(1, tags), node, size(t for t, link in kept if link) / size(t for t, _ in kept)))
        return out


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with mirrored ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="symmetric"), kernel / kernel.sum(), mode="valid")


def extract(html: str, sigma: float = 1.0, cut: float = 0.5) -> str:
    """The main text: blocks of the content region in page order, one to a line."""
    page = _Page(html, cut)
    lines = page.texts()
    if not lines:
        return ""
    smoothed = smooth(np.array([len(text) / tags for text, tags, *_ in lines], float), sigma)
    content = smoothed >= cut * smoothed.mean()  # the threshold between the two clusters
    mass, total = [0] * len(page.parent), 0
    for (text, _, node, _), good in zip(lines, content):
        if good:
            mass[node] += len(text)
            total += len(text)
    for n in range(len(mass) - 1, 0, -1):
        mass[page.parent[n]] += mass[n]
    named = [n for n, m in enumerate(mass) if m and page.kind[n] in SECTIONS]
    if named:  # articles tell what they are: all those with content text, the inner ones in the outer
        region = set(named)
    else:  # else the innermost element with most of the content text
        region = {max(n for n, m in enumerate(mass) if m >= 0.8 * total and (not n or page.kind[n] in REGIONS))}
    inside = [n in region for n in range(len(mass))]
    for n in range(1, len(mass)):
        inside[n] = inside[n] or inside[page.parent[n]]
    keep = [k for k, line in enumerate(lines) if inside[line[2]]]
    # from both ends: three or more links in a row; where no element names the region, any line out of the
    # content cluster that is mostly links or no paragraph, item, cell or heading
    for step in (1, -1):
        run = 0
        for k in keep[::step]:
            _, _, node, linked = lines[k]
            menu = linked == 1 if named else not content[k] and (linked >= 0.5 or page.kind[node] not in TEXTS)
            if not menu or page.kind[node] in HEADINGS:
                break
            run += 1
        if run < len(keep) and (run >= 3 or not named):
            keep = keep[run:] if step == 1 else keep[: len(keep) - run]
    return "\n".join(lines[k][0] for k in keep)


def extract_text(pages: DataFrame, sigma: float = 1.0, cut: float = 0.5) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null or empty html, and pages of boilerplate alone: empty text, 0. Null ids and urls stay.
    Nothing is cut off, however long the page. No shuffle."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages_ in batches:
            texts = [extract(h, sigma, cut) for h in pages_]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    got = pick(pages, page_id="bigint", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    return got.select("page_id", "url", F.pandas_udf(run, "text string, n_chars bigint")("html").alias("r")).select("page_id", "url", "r.*")
