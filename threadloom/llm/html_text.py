"""Main text of web pages from the events of the standard library's parser.

The parser's events cut a page into lines, one per block element.  Each line has a
text-to-tag ratio: its characters outside links over its tags.  Ratios are
smoothed with a Gaussian kernel, and a threshold splits the lines into clusters of
content and of the rest.  A content cluster selects the region around it: all
lines of the same container, where an <article> or <main> is one container with
all that it holds and, if it has most of the page's text, counts for more.  What the
markup itself names as no content (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, comments) never
becomes a line.
"""

from __future__ import annotations

import itertools
import math
import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# The workers get this module as code, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIGMA = 1.5
#: A line whose characters are links to this share is a link line.
LINK_SHARE = 0.8
#: Weight of ratios inside an article, if the page's largest one has at least as much text as stands outside of all.
PRIOR = 2.0

# Element names, class words and roles: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head title nav header footer aside form script style noscript template iframe object svg math canvas audio video "
    "button select textarea option datalist dialog menu".split()
)
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre address figure figcaption details summary fieldset legend center hr".split()
)
CONTAINERS = frozenset("body main article section div td".split())
#: A start tag closes an open element of its kind, up to the nearest of these.
OTHER_BLOCKS = BLOCKS - {"p"}
SAME_CLOSES = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table"}
OPTIONS = frozenset("select datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start closes an open paragraph, and whose end tag closes what was left open in them.
CLOSING = BLOCKS | frozenset("nav header footer aside form menu dialog".split())
CLOSED = CLOSING | DROPPED
#: What an end tag inside a dropped part does not reach across.
CELLS = frozenset("td th caption table template object".split())
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())
FOREIGN = frozenset("svg math".split())
#: Inside svg and math these hold HTML again.
FOREIGN_HTML = frozenset("foreignobject desc title annotation-xml".split())
#: A start tag of these ends svg and math that were left open.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
)
NEVER_BY_CLASS = frozenset("html body main article".split())
NOT_CONTENT = re.compile(
    r"(ads?|advert\w*|sponsor\w*|promo\w*|banners?|side|sidebar\w*|aside|menus?|nav|navbar|navigation|breadcrumbs?|foot|footer|"
    r"head|header|masthead|notices?|cookies?|consent|gdpr|alerts?|popup|modal|overlay|newsletter|subscribe|signup|login|share|"
    r"sharing|social|related|recommend\w*|comment\w*|disqus|respond|reply|replies|widgets?|search\w*|pagination|pager|toolbar)"
)
#: Words that only say what sort of box it is: inside an article a name of others than these and listed words is the author's own.
BOX_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons card cards container content count entry extra form global group "
    "icon icons inner item items left link links list lists main now outer page panel post posts primary right row secondary site slot "
    "stories story this title top unit user users wrap wrapper".split()
)
ONLY_STATES = frozenset("has with no without open closed enabled disabled".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


def _named_away(tag: str, attributes: dict, inside: bool) -> bool:
    """Whether the element's own marks say that it is no content.

    A class or id does if its first or last word is listed.  ``inside`` an article all of
    its words must be listed, box words or numbers, as ids there are often made
    from a heading.  The id of a heading or paragraph says nothing anywhere.
    """
    if tag in DROPPED:
        return True
    if tag in NEVER_BY_CLASS:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or (attributes.get("role") or "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style") or ""):
        return True
    own_id = "" if tag == "p" or tag in HEADINGS else attributes.get("id") or ""
    for name in f"{attributes.get('class') or ''} {own_id}".split():
        parts = [x for x in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if x]
        if parts and not ONLY_STATES & set(parts) and (NOT_CONTENT.fullmatch(parts[0]) or NOT_CONTENT.fullmatch(parts[-1])):
            if not inside or all(x in BOX_WORDS or x.isdecimal() or NOT_CONTENT.fullmatch(x) for x in parts):
                return True
    return False


class Lines(HTMLParser):
    """Collects ``lines`` of ``[text parts, link characters, tags, heading, container, article]`` from parser events.

    The article is the outermost <article>, in none the innermost <main>, in neither 0; ``within`` has the one around each.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.open: list[tuple[str, bool]] = []  # element, and whether it starts a dropped part
        self.dropped = self.links = self.articles = self.paragraphs = self.foreign = 0
        self.containers = [0]
        self.n_containers = 0
        self.within = [0]
        self.around = [0]  # the articles of the open <article> and <main> elements
        self.new_line()

    def new_line(self) -> None:
        heading = bool(self.open) and self.open[-1][0] in HEADINGS
        self.lines.append([[], 0, 0, heading, self.containers[-1], self.around[-1]])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.foreign and tag in BREAKOUT:
            self.close_foreign()
        if tag in ("option", "optgroup"):
            for same in ("option", "optgroup") if tag == "optgroup" else ("option",):
                self.close_to(same, OPTIONS)
        if tag in CLOSING:
            if self.paragraphs:  # a block start closes an open paragraph
                self.close_to("p", OTHER_BLOCKS)
            if tag in SAME_CLOSES:
                for same in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
                    self.close_to(same, frozenset(SAME_CLOSES[tag].split()))
            if tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
                self.pop_to(len(self.open) - 1)
        if tag in VOID:
            if not self.dropped:
                self.lines[-1][2] += 1
                self.new_line() if tag == "hr" else self.lines[-1][0].append(" ")
            return
        away = _named_away(tag, dict(attrs), self.around[-1] > 0) if attrs else tag in DROPPED
        self.open.append((tag, away))
        self.dropped += away
        self.links += tag == "a"
        self.paragraphs += tag == "p"
        self.foreign += tag in FOREIGN
        if tag in ("article", "main"):
            if self.articles:  # an article in an article is part of it
                self.around.append(self.around[-1])
            else:
                self.within.append(self.around[-1])
                self.around.append(len(self.within) - 1)
            self.articles += tag == "article"
        if tag in CONTAINERS:
            self.n_containers += 1
            self.containers.append(self.n_containers)
        if tag in BLOCKS or away:
            self.new_line()
        if not self.dropped:
            self.lines[-1][2] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        inside = self.foreign > 0
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in ("script", "style", "iframe", "div", "span", "a", "p") or tag in FOREIGN or (inside and self.foreign)):
            self.handle_endtag(tag)

    def close_to(self, tag: str, within: frozenset) -> None:
        """Close the innermost open ``tag``, unless an element of ``within`` lies between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.pop_to(k)
                return
            if self.open[k][0] in within:
                return

    def pop_to(self, k: int) -> None:
        block = False
        while len(self.open) > k:
            tag, away = self.open.pop()
            self.dropped -= away
            self.links -= tag == "a"
            self.paragraphs -= tag == "p"
            self.foreign -= tag in FOREIGN
            self.articles -= tag == "article"
            if tag in ("article", "main"):
                self.around.pop()
            if tag in CONTAINERS:
                self.containers.pop()
            block |= tag in BLOCKS or away
        if block:
            self.new_line()

    def close_foreign(self) -> None:
        """Close an open svg or math, unless the place is one of those where it holds HTML."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in FOREIGN_HTML:
                return
            if self.open[k][0] in FOREIGN:
                self.pop_to(k)
                return

    def handle_endtag(self, tag: str) -> None:
        """Close the innermost open element of the tag, and with it what was left open in it, dropped or not.

        Inside a dropped part, what the end tag reaches across is what browsers let it;
        a stray one does not end what is around it.
        """
        dropped = self.dropped
        for k in range(len(self.open) - 1, -1, -1):
            name, away = self.open[k]
            if name == tag or (tag in HEADINGS and name in HEADINGS):
                if not self.dropped:
                    self.lines[-1][2] += 1
                self.pop_to(k)
                return
            if dropped:
                if tag in ("body", "html"):
                    stops = False
                elif tag in TABLE_PARTS:
                    stops = name in ("table", "template")
                elif tag not in CLOSED:
                    stops = name in CLOSED and name not in ("option", "optgroup")
                else:
                    stops = name in CELLS or (tag == "li" and name in ("ul", "ol")) or (tag == "p" and name == "button")
            else:  # a stray end tag inside a table cell does not end what is around it
                stops = name in ("td", "th", "table") and tag not in BLOCKS
            if stops:
                return
            dropped -= away

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        self.lines[-1][0].append(data)
        if self.links:
            self.lines[-1][1] += len(data.strip())


def _smoothed(values: list[float]) -> list[float]:
    reach = math.ceil(3 * SIGMA)
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[j - i + reach], values[j]) for j in range(max(0, i - reach), min(len(values), i + reach + 1))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def _threshold(values: list[float]) -> float:
    """Where two clusters of one-dimensional values part: the mean of their means, after a few rounds of 2-means.

    Values whose clusters lie near each other are one cluster: none is below.
    """
    low, high = min(values), max(values)
    for _ in range(20):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not above or not below:
            break
        moved = (sum(below) / len(below), sum(above) / len(above))
        if moved == (low, high):
            break
        low, high = moved
    return (low + high) / 2 if high >= 2 * low else min(values)


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in order, joined by an empty line; empty if there is none."""
    parser = Lines()
    parser.feed(html or "")
    if re.match(r"<[A-Za-z/!?]", parser.rawdata):  # a tag or comment that the end of the page cuts off is no text
        parser.rawdata = ""
    parser.close()
    lines = [(" ".join("".join(parts).split()), *rest) for parts, *rest in parser.lines]
    lines = [x for x in lines if x[0]]
    if not lines:
        return ""
    link_line = [links >= LINK_SHARE * len(text) for text, links, *_ in lines]
    unlinked = [max(len(text) - links, 0) for text, links, *_ in lines]
    places = [(article, 0 if article else box) for *_, box, article in lines]
    held = dict.fromkeys(places, 0)  # text of each article, and of each container that stands in none
    for place, n in zip(places, unlinked):
        held[place] += n
    outside = sum(n for (article, _), n in held.items() if not article)
    trusted = max((n for (article, _), n in held.items() if article), default=-1) >= outside
    own = [n / max(x[2], 1) * (PRIOR if trusted and x[4] else 1) for n, x in zip(unlinked, lines)]
    ratios = _smoothed(own)
    cut = _threshold(ratios)
    # A line that only its neighbours lift over the threshold is no content of its own.
    content = [r >= cut and o >= cut / 4 and not link for r, o, link in zip(ratios, own, link_line)]
    if not any(content):
        content = [not link for link in link_line]
    # The place with most of the text is a region whatever the ratios of its lines.
    regions = {place for place, c in zip(places, content) if c} | {max((p for p in held if p[0] or not trusted), key=held.__getitem__)}
    for article, _ in list(regions):  # a chosen article chooses what stands beside it in the same <main>
        while article := parser.within[article]:
            regions.add((article, 0))
    inside = [k for k, place in enumerate(places) if place in regions]
    kept: list[str] = []
    for listed, run in itertools.groupby(inside, lambda k: link_line[k] and not content[k]):
        run = list(run)
        first, last = run[0] == inside[0], run[-1] == inside[-1]
        named = not first and (lines[before][3] or lines[before][0].endswith(":"))
        before = run[-1]
        # Menus stand before the text and links to other pages after it; a list in the text or under a heading is part of it.
        if not (listed and len(run) > 1 and (first or last) and not named):
            kept += (lines[k][0] for k in run)
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) in place of ``html``.

    Null, empty or unreadable markup gives an empty text; repeated rows repeat; no
    text is cut.  Columns named like a result are replaced.  The parser runs over
    Arrow batches in Python workers, without a shuffle.
    """
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema), "text string", "n_chars bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.schema.get_field_index("html")).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "text", "n_chars"])

    return pages.select(*kept, "html").mapInArrow(run, schema)
