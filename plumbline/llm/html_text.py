"""Main text of web pages: parser events, text-to-tag ratios by line, Gaussian smoothing, and a threshold that selects the regions of the page where the ratios are high."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.ship import ship

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEAD = frozenset("base link meta noscript script style template title".split())
NO_TEXT = frozenset("head script style noscript template button select option textarea input iframe object svg math canvas audio video map dialog title datalist".split())
PARTS = frozenset("nav footer aside form menu".split())
CONTAINERS = frozenset("article main".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"div", "article", "section", "main", "td", "th", "li", "body", "blockquote", "aside", "nav", "footer", "header", "form", "figure", "dd"}}
# Words of class, id and role that name a part of a page that is not the article, those that may also name a part of the article, readers' comments and adverts, headers, and the article.
OUTSIDE = frozenset("ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login masthead menu menubar nav navbar navigation newsletter paywall pager pagination popup promo promoted replies reply share sharing sidebar signup social sponsor sponsored subscribe contentinfo complementary".split())
UNSURE = frozenset("alert banner discussion form modal notice notices notification overlay promotion recommended related respond responses search skip subscription tags toolbar topbar widget widgets".split())
REPLIES = frozenset("ad ads advert comment comments discussion disqus promo related recommended replies reply responses sponsored".split())
HEADER = frozenset("header siteheader pageheader".split())
INSIDE = frozenset("article content post entry story main maincontent articlebody postbody entrycontent".split())
_NAME = re.compile(r"[a-z0-9]+")
#: Smoothing (in lines), share of the mean ratio that is the threshold, and its largest value (characters by tag).
SIGMA, SHARE, CEILING = 1.0, 0.5, 50.0
#: What is left of the ratio of a line in a block whose name may name a part of the page, and what one more region costs, in thresholds.
DOUBT, REGION = 0.25, 2.0


class Lines(HTMLParser):
    """Reads a page into a tree of blocks and the lines of text in them, in page order."""

    def __init__(self, names: bool = True):
        super().__init__(convert_charrefs=True)
        self.names = names
        self.parents = [-1]
        self.part = [0]  # 0: as its parent; 1: unsure; 2: another part of the page; 3: no text
        self.article = [False]
        self.open: list[tuple[str, int]] = []
        self.lines: list[tuple[str, int, int, int]] = []  # text, characters of links, tags, block
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.articles = 0

    @property
    def node(self) -> int:
        return self.open[-1][1] if self.open else 0

    def flush(self, node: int):
        if self.text:
            text = " ".join("".join(self.text).split())
            if text and self.part[node] < 3:
                self.lines.append((text, min(self.linked, len(text)), max(1, self.tags), node))
            self.text = []
        self.tags = self.linked = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in HEAD and self.open and any(t == "head" for t, _ in self.open):
            self.close_to(next(i for i, (t, _) in enumerate(self.open) if t == "head"))
        if tag in INLINE:
            self.links += tag == "a"
            if not any(k in ("hidden", "style", "class", "id", "aria-hidden") for k, _ in attrs) or tag in VOID:
                if tag not in VOID:
                    self.open.append((tag, self.node))
                return
        else:
            self.flush(self.node)
            self.implied(tag)
        if tag in VOID:
            return
        words: set[str] = set()
        hidden = False
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                for x in v.lower().split():
                    words.add(x.replace("-", "").replace("_", ""))
                    words.update(_NAME.findall(x))
            elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower():
                hidden = True
        self.open.append((tag, self.block(tag, words, hidden)))

    def block(self, tag: str, words: set[str], hidden: bool) -> int:
        """A block in the tree for an element; inline ones that are left out are blocks too."""
        above = self.node
        inside = self.article[above]
        part, article = self.part[above], inside
        if tag in NO_TEXT or hidden:
            part = 3
        elif tag in INLINE and not words & OUTSIDE:
            return above
        elif tag in PARTS and (self.names or tag != "form"):
            part = max(part, 2)
        elif (tag == "header" or words & HEADER and tag not in ("h1", "h2", "h3")) and not inside:
            part = max(part, 2)
        elif tag in CONTAINERS:
            if part < 3 and not self.articles and not self.replies():
                part = 0  # a wrapper that is only named after a part of the page ("with-sidebar") holds the article
            if words & REPLIES and tag == "article":
                part = max(part, 2)
            if part < 2:
                self.articles += 1
                article = True
        elif self.names and tag not in ("html", "body") and words & OUTSIDE:
            part = max(part, 2)
        elif self.names and tag not in ("html", "body") and words & UNSURE:
            part = max(part, 1)
        elif tag in ("div", "section", "td") and words & INSIDE and part < 1:
            article = True
        if part == 2 and words & REPLIES:
            self.for_good.add(len(self.parents))
        self.parents.append(above)
        self.part.append(part)
        self.article.append(article and part < 1)
        return len(self.parents) - 1

    @property
    def for_good(self) -> set[int]:
        return self.__dict__.setdefault("_for_good", set())

    def replies(self) -> bool:
        """Whether a block of comments or adverts, or a part of the page by its tag, is open."""
        return any(n in self.for_good or t in PARTS for t, n in self.open)

    def implied(self, tag):
        """Ends what a new block ends without an end tag."""
        for name, among in ((tag, CLOSES.get(tag, ())), ("p", ("p",))):
            for i in range(len(self.open) - 1, -1, -1):
                x = self.open[i][0]
                if x in among:
                    self.close_to(i)
                    break
                if x in SCOPES.get(name, ()):
                    break

    def close_to(self, i):
        self.links -= sum(t == "a" for t, _ in self.open[i:])
        del self.open[i:]

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.flush(self.node)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in INLINE and self.open[i][1] != (self.open[i - 1][1] if i else 0):
                    self.flush(self.node)
                self.close_to(i)
                return
            if self.open[i][0] in ("article", "main", "body", "table") and tag in ("p", "li", "td", "tr", *INLINE):
                return

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # no known name: a comment up to the next >
            return self.parse_bogus_comment(i, report)

    def handle_data(self, data):
        if self.part[self.node] < 3:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    r = int(3 * sigma + 0.5)
    if not r:
        return x
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(x, r, "edge"), k / k.sum(), "valid")


def _read(html: str, names: bool) -> Lines:
    p = Lines(names)
    try:
        p.feed(html)
        p.close()
    except AssertionError:  # malformed declarations: what was read so far counts
        pass
    p.flush(p.node)
    return p


def _selected(p: Lines, sigma: float, share: float, ceiling: float) -> list[str]:
    part = np.array([p.part[b] for *_, b in p.lines])
    plain = np.array([(len(t) - linked) / tags for t, linked, tags, _ in p.lines], float)
    ratio = smooth(np.where(part == 2, 0, np.where(part == 1, DOUBT * plain, plain)), sigma)
    # a line of another part lends nothing to its neighbours, nor takes from them
    ratio = np.where(part == 2, 0, np.where(part == 1, np.minimum(ratio, DOUBT * plain), ratio))
    cut = min(share * ratio.mean(), ceiling)
    gain = ratio - cut + np.where([p.article[b] for *_, b in p.lines], cut, 0)

    n = len(p.parents)
    total = np.bincount([b for *_, b in p.lines], gain, n)
    below, best, whole = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    for b in range(n - 1, -1, -1):
        own = total[b] - REGION * cut
        whole[b] = total[b] > 0 and own >= below[b]
        best[b] = max(0, below[b], own if total[b] > 0 else 0)
        if b:
            total[p.parents[b]] += total[b]
            below[p.parents[b]] += best[b]
    region, drop = np.zeros(n, bool), np.zeros(n, bool)
    for b in range(n):
        up = p.parents[b]
        region[b] = whole[b] or up >= 0 and region[up]
        # within a region, blocks of another part go where their ratios are low
        drop[b] = up >= 0 and drop[up] or p.part[b] > 0 and (up < 0 or p.part[b] != p.part[up]) and total[b] < 0
    # what stands between two regions of one parent belongs to them
    roots = [b for b in range(n) if region[b] and (p.parents[b] < 0 or not region[p.parents[b]])]
    for a, b in zip(roots, roots[1:]):
        if p.parents[a] == p.parents[b]:
            region[a:b] = True
    return [t for t, _, _, b in p.lines if region[b] and not drop[b] and p.part[b] < 2]


def main_text(html: str | None, sigma: float = SIGMA, share: float = SHARE, ceiling: float = CEILING) -> str:
    """The article of a page.

    Each line (a block's text) has a ratio of characters, links left out, by
    tag, smoothed by a Gaussian; lines in menus, footers, forms, adverts or
    comments have 0, lines in blocks whose name is in doubt ("notice",
    "related-work") a quarter. The threshold is `share` of the mean ratio,
    `ceiling` at most. A region of the page, a block with all in it, is worth
    the sum of what its lines have over the threshold, less a cost for each
    region; lines of an article or main element, or of a block named so, have no
    less than the threshold. The regions worth most together are kept, and what
    stands between two of one parent, without the blocks of other parts. Where that leaves nothing, names and
    forms are not heeded.
    """
    if not html:
        return ""
    for names in (True, False):
        p = _read(html, names)
        if not p.lines:
            return ""
        found = _selected(p, sigma, share, ceiling)
        if found:
            break
    return "\n".join(found)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with the main text and its length instead of the html: columns text and n_chars (columns of these names are replaced).

    Null or empty html, or a page without an article: empty text. Pages are
    read one by one, whole; equal pages give equal texts; no rows give no rows.
    """
    ship(pages.sparkSession)
    own = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    pages = pages.select(*own, html)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [main_text(x) for x in part.column(len(own)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*own, "text", "n_chars"])

    return pages.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html), "text string, n_chars long"]))


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
