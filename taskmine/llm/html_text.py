"""Main text of web pages: tag ratios over parser events, smoothed and clustered by a threshold.

The standard library's event parser is fed page by page and keeps no tree, only the open
elements. Its events become lines: what stands between two block-level tags, with the
number of tags seen for it and the characters inside links. The ratio of a line is its
text outside links over its tags. Ratios are smoothed by a Gaussian over neighbouring
lines; lines at or above the threshold (a share of the mean smoothed ratio, the mean
weighted by text) form clusters, which pick the content regions: the articles that hold a
cluster (all articles if none does), or where the page marks none, the stretch from the first
to the last clustered line, over all elements. Clustered lines that are mostly links begin and
end no stretch, and none are kept in it. Inside a region every other line counts, however short,
except those of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments: by element, role and class or id. Outside of articles a word of a class is
enough; inside, a whole class must be a word of the list or be made of such words alone, as
"search-results" or "side-effects" may well hold text.

Character references are decoded, white space inside a line is one space, lines are joined
by two newlines. A null or empty page, or one without text, gives the empty text. Broken
markup never fails: unclosed elements end with the element around them, and an article
ends whatever was left open before it. Repeated rows are treated alike; other columns pass
through, except those the operator writes.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

SIGMA, SHARE = 1.5, 0.25

# fixed values: elements by their role
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
LEFT_OUT = frozenset("aside audio button canvas dialog footer form head iframe map menu nav noscript object option script select style svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLES = frozenset(["article", "main"])
NOISE_WORDS = frozenset("ad ads adv advert advertisement advertising adsense banner sponsor sponsored sponsors promo promotion popup modal overlay cookie cookies consent gdpr notice notices alert disclaimer sidebar side rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc header masthead topbar footer foot bottom copyright comment comments commentlist discussion disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search toolbar skip tags".split())
# words that article text may carry too, as parts of a class or id: inside an article they say nothing, and the others only as whole classes
NOISE_CLASSES = NOISE_WORDS - frozenset("side search share tags alert skip foot bottom header reply respond rail toc copyright disclaimer overlay promotion sponsor sponsors signup login".split())
NOISE_ROLES = frozenset("banner navigation complementary contentinfo search dialog alert alertdialog menu menubar form".split())
# a new one of these ends an open one of the same group
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_STATES = frozenset(["has", "with", "no", "without"])  # "has-sidebar" is not a sidebar
_CUT_OFF = re.compile(r"<[A-Za-z/!][^<>]*\Z")
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"[ \t\n\r\f\v\x1c-\x1f\x85\xa0  -     　]+")


def _noisy(tag: str, attributes: list, inside_article: bool) -> bool:
    if tag in LEFT_OUT or (tag == "header" and not inside_article):
        return True
    if tag in ("html", "body") or tag in ARTICLES or not attributes:
        return False
    for name, value in attributes:
        if value is None:
            if name == "hidden":
                return True
        elif name in ("class", "id"):
            if inside_article:
                for token in value.lower().split():
                    if token in NOISE_CLASSES or NOISE_WORDS.issuperset(_SPLIT.split(token)) and not NOISE_CLASSES.isdisjoint(_SPLIT.split(token)):
                        return True
                continue
            words = set(_SPLIT.split(value.lower()))
            if not NOISE_WORDS.isdisjoint(words) and _STATES.isdisjoint(words):
                return True
        elif name == "role" and value.lower() in NOISE_ROLES:
            return True
        elif name == "aria-hidden" and value.lower() == "true":
            return True
    return False


class _Lines(HTMLParser):
    """Collects lines: text, tags, characters in links, number of the article and of the block element around."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.open: list[tuple[str, bool, int, int]] = []  # tag, left out, article, element
        self.parts: list[str] = []
        self.tags = self.linked = self.depth = self.elements = self.articles = 0
        self.article = self.element = -1
        self.left_out = False

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip(" ")
            if text:
                self.lines.append((text, self.tags, self.linked, self.article, self.element))
                self.tags = 0
            self.parts, self.linked = [], 0

    def _state(self) -> None:
        if self.open:
            _, self.left_out, self.article, self.element = self.open[-1]
        else:
            self.left_out, self.article, self.element = False, -1, -1

    def _close(self, at: int) -> None:
        for tag, *_ in self.open[at:]:
            if tag == "a":
                self.depth -= 1
        del self.open[at:]
        self._state()

    def handle_starttag(self, tag, attributes):
        self.tags += 1
        block = tag in BLOCKS
        if block:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        ends = _CLOSES.get(tag)
        if ends:
            # formatting left open inside an ended paragraph ends with it
            for at in range(len(self.open) - 1, -1, -1):
                name = self.open[at][0]
                if name in ends:
                    self._close(at)
                    break
                if name in BLOCKS:
                    break
        elif block and self.open and tag not in ("html", "body", "head"):
            for at in range(len(self.open) - 1, -1, -1):
                name = self.open[at][0]
                if name == "p":
                    self._close(at)
                if name in BLOCKS:
                    break
        if tag in ARTICLES and self.left_out and not any(left and name in ("form", "aside", "template", "dialog", "noscript") for name, left, *_ in self.open):
            # an article inside a menu or an advert that was never closed
            for at, (_, left, *_) in enumerate(self.open):
                if left:
                    self._close(at)
                    break
        if tag in ARTICLES and self.article < 0:
            article = self.articles
            self.articles += 1
        else:
            article = self.article
        left_out = self.left_out or _noisy(tag, attributes, self.article >= 0)
        element = self.element
        if block and tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "blockquote", "pre", "tr", "td", "th", "tbody", "dt", "dd"):
            self.elements += 1
            element = self.elements
        if tag == "a":
            self.depth += 1
        self.open.append((tag, left_out, article, element))
        self.left_out, self.article, self.element = left_out, article, element

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._close(at)
                break
            if self.open[at][0] in ARTICLES and tag not in ("body", "html", "article", "main"):
                break  # a stray end tag does not end the article around it

    def handle_data(self, data):
        if not self.left_out:
            self.parts.append(data)
            if self.depth > 0:
                self.linked += len(data)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over three sigmas to each side; the window is cut at the ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[reach:reach + len(ratios)]
    return np.convolve(ratios, kernel, "full")[reach:reach + len(ratios)] / weight


def main_text(page: str | None, sigma: float = SIGMA, share: float = SHARE) -> str:
    """The main text of one page."""
    if not page:
        return ""
    if page.rfind("<!--") > page.rfind("-->"):  # a comment or a tag that the page's end cuts off
        page = page[:page.rfind("<!--")]
    page = _CUT_OFF.sub("", page)
    parser = _Lines()
    parser.feed(page)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    size = np.array([len(line[0]) for line in lines], float)
    linked = np.minimum(np.array([line[2] for line in lines], float), size)
    ratio = (size - linked) / np.maximum(1, np.array([line[1] for line in lines], float))
    smooth = smoothed(ratio, sigma)
    chosen = smooth >= share * np.average(smooth, weights=size)
    article = np.array([line[3] for line in lines])
    if (article >= 0).any():
        held = np.unique(article[chosen & (article >= 0)])
        keep = np.isin(article, held if len(held) else np.unique(article[article >= 0])) & (article >= 0)
    else:
        running = 2 * linked < size  # not mostly links, as menus are
        core = np.flatnonzero(chosen & running)
        if not len(core):
            core = np.flatnonzero(chosen)
        at = np.arange(len(lines))
        keep = (at >= core[0]) & (at <= core[-1]) & (running | np.isin(at, core))
    return "\n\n".join(line[0] for line, wanted in zip(lines, keep) if wanted)


def extracted(pages: DataFrame, html: str = "html", sigma: float = SIGMA, share: float = SHARE) -> DataFrame:
    """``pages`` with ``text`` in place of the html."""
    kept = [f for f in pages.schema.fields if f.name not in (html, "text")]
    schema = StructType(kept + [StructField("text", StringType())])

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(html))
            for lo in range(0, len(column), 500):  # pages of one output batch
                part = batch.slice(lo, 500)
                texts = [main_text(page.as_py(), sigma, share) for page in column.slice(lo, 500)]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(f.name)) for f in kept] + [pa.array(texts, pa.string())],
                                                 names=schema.names)

    return pages.mapInArrow(run, schema)
