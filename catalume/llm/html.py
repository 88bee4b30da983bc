"""Main text of web pages: parser events, text-to-tag ratios, smoothing, clustering."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from catalume.llm.storage import ship_package

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("head title script style noscript template svg math iframe object select textarea button canvas audio video".split())
_ASIDE = frozenset("nav header footer aside dialog menu".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that are a part of an article, not its container.
_PARTS = frozenset(
    "blockquote ul ol li dl dt dd table thead tbody tfoot tr td th caption pre section figure figcaption details summary "
    "h1 h2 h3 h4 h5 h6 hgroup address center fieldset p".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Elements whose class and id say nothing of what is in them.
_UNNAMED = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
_TABLE = "table html template".split()
#: group -> (open elements whose end a start tag of the group implies, elements beyond which it does not reach)
_ENDS = {
    "li": (["li"], "ul ol menu dir".split()),
    "dt": (["dt", "dd"], ["dl"]),
    "td": (["td", "th"], [*_TABLE, "tr"]),
    "tr": (["tr"], _TABLE),
    "tbody": ("thead tbody tfoot caption".split(), _TABLE),
    "p": (["p"], "table td th caption button object template html".split()),
}
_BLOCKS = _ASIDE | {"form"} | (_PARTS - frozenset("thead tbody tfoot tr td th caption".split())) | frozenset("article main div hr dir".split())
#: start tag -> the groups whose open element it ends
_IMPLIES = {tag: [group for group, (ended, _) in _ENDS.items() if tag in ended and group != "p"] + ["p"] * (tag in _BLOCKS) for group in _ENDS.values() for tag in group[0]}
_IMPLIES |= {tag: ["p"] for tag in _BLOCKS if tag not in _IMPLIES}
#: tag -> (group, whether the group's start tags end it)
_WATCHED = {tag: [(g, tag in ended) for g, (ended, beyond) in _ENDS.items() if tag in ended or tag in beyond] for e in _ENDS.values() for tag in e[0] + e[1]}
_MARKS = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|"
    r"footer|sidebar|aside|widget|related|recommended|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"comments?|disqus|respond|replies|share|sharing|social)(?:$|[^a-z])"
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
_TALK = re.compile(r"(?:^|[^a-z])(?:comments?|disqus|respond|replies)(?:$|[^a-z])")
#: How sure it is that a container is boilerplate: by tag, role or attribute; by a word for readers' comments in its class or
#: id; by another such word, or as a form, which is evidence that its text has to confirm.
SURE, FIRM, LIKELY = 3, 2, 1


_CLOSE = re.compile(r"""=\s*(["'])|>""")
_RAW = re.compile(r"<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>])", re.IGNORECASE)


def complete(html: str) -> str:
    """``html`` with only whole tags, each found in one pass: what the parser would look for again and again at every start.

    A tag ends at the first ``>`` outside of quoted values. Comments, declarations and instructions go; a ``<`` that
    begins none of these, or a tag or comment without an end, is text. A quote that is not closed counts as a
    character, from there on to the page's end.
    """
    out, at, size, last = [], 0, len(html), html.rfind(">")
    comment_end, quotes = html.rfind("-->"), {q: html.rfind(q) for q in "\"'"}
    ends: dict[str, int] = {}
    while (start := html.find("<", at)) >= 0:
        out.append(html[at:start])
        after = html[start + 1 : start + 2]
        if start > last:
            out.append(html[start:].replace("<", "&lt;"))
            return "".join(out)
        if html.startswith("<!--", start) and start + 4 <= comment_end:
            at = html.find("-->", start + 4) + 3
        elif after in ("!", "?"):
            at = start + 4 if html.startswith("<!--", start) else html.find(">", start) + 1
        elif after.isalpha() or after == "/" and html[start + 2 : start + 3].isalpha():
            end = start
            while found := _CLOSE.search(html, end):
                quote = found[1]
                if not quote:
                    end = found.end()
                    break
                if quotes[quote] >= found.end():
                    end = html.find(quote, found.end()) + 1
                else:
                    end = found.end()
            if not found:  # only quoted ends are left
                quotes = dict.fromkeys(quotes, -1)
                end = html.find(">", start) + 1
            tag = html[start:end]
            out.append(tag if _balanced(tag) else "<" + tag[1:].replace('"', "&quot;").replace("'", "&#39;"))
            at = end
            raw = _RAW.match(tag)
            if raw:
                name = raw[1].lower()
                if name not in ends or ends[name] < at and ends[name] != size:
                    closed = re.compile(rf"</{name}", re.IGNORECASE).search(html, at)
                    ends[name] = closed.start() if closed else size
                out.append(html[at : ends[name]] if name in ("textarea", "title") else "")
                at = ends[name]
        else:
            out.append("&lt;")
            at = start + 1
    out.append(html[at:])
    return "".join(out)


def _balanced(tag: str) -> bool:
    return tag.count('"') % 2 == 0 and tag.count("'") % 2 == 0


@dataclass
class Line:
    """One line of the page: the container it stands in, its text, the characters of it in links, the tags in it."""

    box: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    tags: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class _Page(HTMLParser):
    """Turns parser events into lines and a tree of containers; every event takes constant time on average.

    Containers are numbered in the order they begin, 0 is the page; each has
    the one above it, its tag and its mark (0, LIKELY, FIRM, SURE). Text in silent
    elements is left out.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.above, self.tags, self.marks = [0], [""], [0]
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, bool]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.watched: dict[str, list[tuple[int, bool]]] = defaultdict(list)
        self.boxes, self.likely, self.silent = [(0, -1)], [], 0
        self.fresh()

    def fresh(self) -> None:
        self.line = Line(self.boxes[-1][0])
        self.lines.append(self.line)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for group in _IMPLIES.get(tag, ()):
            if self.watched[group] and self.watched[group][-1][1]:
                self.close_from(self.watched[group][-1][0])
        inline = tag in _INLINE
        if tag not in _VOID:
            mark = SURE if tag in _ASIDE else self.mark(tag, attrs)
            silent = tag in _SILENT or inline and mark > 0
            number = 0
            if not inline:
                number = len(self.above)
                self.above.append(self.boxes[-1][0])
                self.tags.append(tag)
                self.marks.append(mark)
                self.boxes.append((number, len(self.open)))
                if 0 < mark < SURE:
                    self.likely.append(number)
                if tag == "h1":  # a page's title does not stand in boilerplate, whatever its containers are called
                    for box in self.likely:
                        self.marks[box] = 0
                    self.likely.clear()
            self.places[tag].append(len(self.open))
            for group, ends in _WATCHED.get(tag, ()):
                self.watched[group].append((len(self.open), ends))
            self.open.append((tag, number, silent))
            self.silent += silent
        if not inline:
            self.fresh()
        self.line.tags += 1

    def close_from(self, at: int) -> bool:
        """Close the open elements from place ``at`` on; whether there was a container among them."""
        blocks = False
        while len(self.open) > at:
            tag, number, silent = self.open.pop()
            self.places[tag].pop()
            for group, _ in _WATCHED.get(tag, ()):
                self.watched[group].pop()
            self.silent -= silent
            if number:
                blocks = True
                self.boxes.pop()
                if self.likely and self.likely[-1] == number:
                    self.likely.pop()
        return blocks

    @staticmethod
    def mark(tag: str, attrs: list[tuple[str, str | None]]) -> int:
        found = LIKELY * (tag == "form")
        for name, value in attrs:
            if name == "hidden" or name == "role" and (value or "").lower() in _ROLES or name == "aria-hidden" and value == "true":
                return SURE
            if name in ("class", "id") and value and tag not in _UNNAMED:
                said = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()
                if tag == "article":
                    found = max(found, FIRM * bool(re.search(r"(?:^|\s)(?:comment|related)", said)))
                elif _MARKS.search(said):
                    found = max(found, FIRM if _TALK.search(said) and tag not in _PROSE else LIKELY)
        return found

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        inline, places = tag in _INLINE, self.places[tag]
        if places and (not inline or places[-1] > self.boxes[-1][1]):
            self.close_from(places[-1])
        if not inline:
            self.fresh()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.line.parts.append(data)
            if self.places["a"]:
                self.line.linked += len(data)

    def spread(self, own: list[int]) -> list[int]:
        """The largest of a container's own value and of those above it."""
        for number in range(1, len(own)):
            own[number] = max(own[number], own[self.above[number]])
        return own

    def gathered(self, own: list[int]) -> list[int]:
        """The sum of a container's own value and of those inside it."""
        for number in range(len(own) - 1, 0, -1):
            own[self.above[number]] += own[number]
        return own


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with a kernel of 3 sigma each way, renormalised at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weights


def split_level(values: np.ndarray, rounds: int = 50) -> float:
    """The threshold between two clusters of values (2-means from the extremes)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(rounds):
        level = (low + high) / 2
        above = values > level
        if not above.any() or above.all():
            return level
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _upper(page: _Page, every: list[tuple[Line, str]], counts: list[bool], sigma: float) -> list[bool]:
    """Which lines are in the upper cluster of smoothed ratios; what is no paragraph or heading has to reach the threshold by its own ratio too."""
    own = [max(0, len(text) - line.linked) / max(1, line.tags) if fits else 0.0 for (line, text), fits in zip(every, counts, strict=True)]
    ratios = smoothed(np.array(own), sigma)
    level = split_level(ratios)
    rows = zip(every, counts, own, ratios.tolist(), strict=True)
    return [fits and ratio >= level and (alone >= level or page.tags[line.box] in _PROSE) for (line, _), fits, alone, ratio in rows]


def _clusters(page: _Page, every: list[tuple[Line, str]], sigma: float) -> tuple[list[bool], list[bool]]:
    """Of each line whether it is outside of boilerplate, and whether it is in the upper cluster; nothing where all is boilerplate."""
    marks = page.spread(list(page.marks))
    most = min((marks[line.box] for line, _ in every), default=SURE)
    if most == SURE:
        return [], []
    plain = [marks[line.box] <= most for line, _ in every]
    upper = _upper(page, every, plain, sigma)
    return plain, upper if any(upper) else plain


def _reprieve(page: _Page, every: list[tuple[Line, str]], named: list[int], sigma: float) -> bool:
    """Take the mark off containers that their text does not confirm: forms with a paragraph of the upper cluster of all lines
    outside of what is marked more surely, and containers in an article, marked by a word, with more of such paragraphs than
    the article has without them. Whether there was one."""
    marks = page.spread(list(page.marks))
    counts = [marks[line.box] <= LIKELY for line, _ in every]
    if LIKELY not in (marks[line.box] for line, _ in every):
        return False
    prose, plain = [0] * len(page.above), defaultdict(int)
    for (line, text), high in zip(every, _upper(page, every, counts, sigma), strict=True):
        if high and page.tags[line.box] in ("p", "blockquote", "pre"):
            prose[line.box] += len(text)
        plain[named[line.box]] += len(text) * (marks[line.box] == 0)
    page.gathered(prose)
    around = lambda box: named[page.above[box]]
    marked = [box for box in range(1, len(prose)) if page.marks[box] == LIKELY and prose[box]]
    free = [box for box in marked if page.tags[box] == "form" or around(box) and prose[box] > plain[around(box)]]
    for box in free:
        page.marks[box] = 0
    return bool(free)


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The page's article, blocks joined by one blank.

    Parser events cut the page into lines at block tags. Each line has a
    ratio of its text outside of links to its tags; a line in a container
    that tag, role, class or id tell as boilerplate (navigation, headers,
    footers, sidebars, notices, adverts, forms, comments) has ratio 0. That a
    container is a form, or has a telling word in its class or id and stands
    in an article, is evidence only: it does not count for a form with a
    paragraph of the upper cluster, nor for a container that holds more of
    such paragraphs than the rest of its article has text (words for readers'
    comments always count). Ratios
    are smoothed along the page (``sigma`` lines) and cut into two clusters,
    and the lines of the upper one (of others than paragraphs and headings
    those whose own ratio is there too) name the content: it starts from the
    innermost container that holds most of their text. If that is in an
    <article> or <main>, the content is every outermost one of these with
    lines of the upper cluster; else it is the innermost container around
    (not a quote, list, table or section) outside of which the next container
    has no further lines of that cluster, paragraphs, headings or quotes.

    Inside the content a region (the lines that share their innermost
    container, parts such as lists not counted) without any line of the upper
    cluster goes if most of its text is links; boilerplate goes; all else
    stays, however short. Words of class and id do not count for containers
    around the page's <h1>, nor where nothing else is left. An empty or null
    page, or one without text outside of boilerplate, gives an empty text.
    Time is proportional to the page, however deep and broken.
    """
    page = _Page()
    page.feed(complete(html or ""))
    page.close()
    every = [(line, text) for line in page.lines if (text := line.text)]
    size = len(page.above)
    named = [0] * size
    for box in range(1, size):
        named[box] = named[page.above[box]] or box * (page.tags[box] in ("article", "main"))
    plain, upper = _clusters(page, every, sigma)
    if not plain:
        return ""
    if _reprieve(page, every, named, sigma):
        plain, upper = _clusters(page, every, sigma)
    lines = [(line, text, high) for (line, text), fits, high in zip(every, plain, upper, strict=True) if fits]
    weights, telling, region = [0] * size, [0] * size, [0] * size
    for line, text, high in lines:
        weights[line.box] += len(text) if high else 0
        telling[line.box] += high or page.tags[line.box] in _PROSE
    page.gathered(weights)
    page.gathered(telling)
    for box in range(1, size):
        region[box] = region[page.above[box]] if page.tags[box] in _PARTS else box
    inner = max(box for box in range(size) if 2 * weights[box] > weights[0])
    if named[inner]:
        wanted = {named[line.box] for line, _, high in lines if high} - {0}
        content = [x for x in lines if named[x[0].box] in wanted]
    else:
        inner = region[inner]
        while inner and telling[region[page.above[inner]]] > telling[inner]:
            inner = region[page.above[inner]]
        inside = page.spread([int(box == inner) for box in range(size)])
        content = [x for x in lines if inside[x[0].box]]
    linked, chars, has_upper = defaultdict(int), defaultdict(int), set()
    for line, text, high in content:
        linked[region[line.box]] += line.linked
        chars[region[line.box]] += len(text)
        if high:
            has_upper.add(region[line.box])
    return " ".join(text for line, text, _ in content if (r := region[line.box]) in has_upper or 2 * linked[r] <= chars[r])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html).

    A null page is empty; repeated rows get a row each; an empty table gives
    an empty result; other columns are ignored. See ``main_text``.
    """
    ship_package(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    fields = f"page_id {kinds['page_id']}, url string, text string, n_chars bigint"
    return pages.select("page_id", "url", "html").mapInArrow(run, fields)
