"""Main text of web pages by tag-path ratios.

A page is read once into blocks: the text between the starts and ends of block
elements, with the path of tags from the root to it. Blocks below elements
that say what they are (navigation, footers, asides, forms, adverts, notices,
comments, hidden parts) are put aside. Outside article and main any such word of
a class or id counts. Inside them names also tell what the text is about (an id
made from a heading, a class "menu" on a paragraph): there a subject word counts
only as the last word of a name, layout words left out ("related-posts", but not
"related-work"), never on headings and sections by their id; on other elements
an id of this kind halves the score of its paths. For each tag path the page's blocks are
added up: characters, punctuation marks, blocks, characters in links. A path's
text ratio (characters a block) and punctuation ratio (marks a block) are
smoothed over the paths in page order by a Gaussian, fused into one score, less
the share of links, and compared with a threshold from the spread of all paths.
The paths above it mark the content, over the whole page. Where most of the
marked text lies in named parts (article, main), the least element around it
is widened to the article, and all blocks of named parts inside are taken;
where most lies outside them, articles are cards or the like: the least element
around the marked blocks outside is the main part, and of named parts inside it
those are taken whose text is mostly marked. Blocks stay in page order, apart
from those put aside. Blocks that are mostly links (lists of sources, say) stay
in an article after its first other block; elsewhere only between other blocks.

Pages are independent rows: no shuffle, one page in memory at a time.

Defined results. Null or empty html, and pages without a text block: empty
text, n_chars 0. Repeated rows are read each. An empty table gives an empty
result. Extra columns are not read. A tag cut off at the end is no text. White
space is Unicode white space; a line break element counts as such.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepulse.llm.common import worker_state

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: Elements whose text is never read.
SILENT = frozenset("script style noscript template iframe object svg math canvas head title select option textarea button audio video".split())
#: Elements that say they are not the article.
ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What starts inside an open element of these kinds closes it.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "thead": {"tr", "td", "th"},
    "tbody": {"thead", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"},
}
#: Elements that an implied end does not reach through.
WALLS = SILENT | frozenset("html body table ul ol dl div section article main aside nav header footer form blockquote dialog fieldset details figure menu td th".split())
#: What may stand in a page's head; anything else ends it.
IN_HEAD = frozenset("title style script noscript template object base link meta".split())
#: Words of a class or id that mark what is not the article, wherever they stand.
HINTS = frozenset(
    "ad ads adv banner captcha comment commenter comments commentlist commenting consent disqus gdpr guestbook login masthead modal nav outbrain overlay pager pagination "
    "paywall share sharing signup skip social taboola toolbar".split()
)
#: Beginnings of such words.
STEMS = ("advert", "breadcrumb", "cookie", "footer", "navbar", "newsletter", "popup", "promo", "sidebar", "sponsor", "subscri")
#: Words that do so, but may also be what an article is about.
SUBJECTS = frozenset(
    "alert alerts announcement copyright dialog discussion feedback header menu notice notices notification reactions related replies reply respond responses search tags "
    "talkback teaser topbar trending widget navigation navig recommend recommended recommendation recommendations".split()
)
#: Those of them that also count on a paragraph or a list item.
NOTES = frozenset("alert alerts announcement copyright notice notices notification tags teaser".split())
#: Words that tell the layout of a name's last word, not its kind.
LAYOUT = frozenset(
    "area articles bar block bottom box button buttons container content form icons inner items left links list module outer panel pages post posts right row section stories "
    "text top widget wrap wrapper info warning".split()
)
#: Elements that hold text, not parts of a page.
TEXTUAL = HEADINGS | frozenset("p li dt dd td th pre blockquote figcaption caption summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(".,;:!?…،。，！？；：、")
CUT_TAG = re.compile(r"<(?:[a-zA-Z/][^<>]*|!--(?:(?!-->).)*|![^<>]*)\Z", re.S)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Element:
    """An open or closed element: what the selection needs of the tree."""

    __slots__ = ("aside", "depth", "main", "parent", "path", "tag", "weight")

    def __init__(self, tag: str, parent: Element | None, path: int, weight: float, main: bool):
        self.tag, self.parent, self.path, self.weight, self.main = tag, parent, path, weight, main
        self.aside = weight == 0
        self.depth = 0 if parent is None else parent.depth + 1


class Block:
    __slots__ = ("element", "links", "marks", "text")

    def __init__(self, element: Element, text: str, links: int):
        self.element, self.text, self.links = element, text, links
        self.marks = sum(map(MARKS.__contains__, text))


def _hinted(word: str) -> bool:
    return word in HINTS or word.startswith(STEMS)


def _kinds(names: str) -> list[str]:
    """The word of each name that tells its kind: the last one, layout words and modifiers left out."""
    kinds = []
    for name in names.split():
        words = [w.lower() for w in WORDS.findall(name.split("--")[0])]
        while len(words) > 1 and words[-1] in LAYOUT:
            words.pop()
        kinds += words[-1:]
    return kinds


def _apart(tag: str, attrs: dict[str, str | None], parent: Element) -> float:
    """The weight that an element's own words leave to its text: 0 for what is not part of the article."""
    if tag in ASIDE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "") in ROLES:
        return 0
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or ""):
        return 0
    if tag == "header" and not parent.main:
        return 0
    if tag in ("html", "body", "main"):
        return 1
    classes, name = attrs.get("class") or "", attrs.get("id") or ""
    # an article's names may tell what it has, not what it is
    words = [w.lower() for w in (f"{classes} {name}".split() if tag == "article" else WORDS.findall(classes))]
    if not parent.main:
        words += [w.lower() for w in WORDS.findall(name)] if tag != "article" else []
        return 0 if any(_hinted(w) or w in SUBJECTS or w.startswith(("comment", "navig", "recommend")) for w in words) else 1
    if any(map(_hinted, words)):
        return 0
    if tag not in HEADINGS and any(k in (NOTES if tag in TEXTUAL else SUBJECTS) and k != "header" for k in _kinds(classes)):
        return 0
    titled = tag in TEXTUAL or tag in ("section", "article")  # such ids are often made from a title
    kinds = _kinds(name) if tag not in HEADINGS else []
    if any(map(_hinted, kinds if titled else [w.lower() for w in WORDS.findall(name)])):
        return 0
    return 0.5 if not titled and any(k in SUBJECTS and k != "header" for k in kinds) else 1


class Page(HTMLParser):
    """Reads a page into blocks with their elements and tag paths."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.paths: dict[tuple[int, str, float], int] = {}
        self.root = Element("", None, 0, 1, False)
        self.open = [self.root]
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.links = self.in_links = self.silent = 0
        self.holder = self.root

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(self.holder, text, self.links))
            self.parts, self.links = [], 0

    def push(self, tag: str, attrs: dict[str, str | None]) -> None:
        parent = self.open[-1]
        weight = parent.weight and min(parent.weight, _apart(tag, attrs, parent))
        path = self.paths.setdefault((parent.path, tag, weight), len(self.paths) + 1)
        main = parent.main or tag in ("article", "main") or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
        self.open.append(Element(tag, parent, path, weight, main))

    def pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag = self.open.pop().tag
            self.in_links -= tag == "a"
            self.silent -= tag in SILENT

    def close_implied(self, tags: set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in tags:
                self.pop_to(depth)
                return
            # what is put aside keeps what starts in it
            if tag in WALLS or (self.open[depth].aside and not self.open[depth - 1].aside):
                return

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("hr",):
                self.flush()
            self.parts.append(" ") if self.parts else None
            return
        if tag not in IN_HEAD and self.open[-1].tag == "head":
            self.pop_to(len(self.open) - 1)
        if tag not in INLINE:
            self.flush()
            self.close_implied(CLOSES.get(tag, set()) | ({"p"} | HEADINGS if tag not in SILENT else set()))
        self.push(tag, dict(attrs))
        self.in_links += tag == "a"
        self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # the slash has no meaning on other elements
            self.handle_starttag(tag, attrs)
            if tag in SILENT:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                self.pop_to(depth)
                return
            if tag in INLINE and self.open[depth].tag not in INLINE:
                return  # an end without a start inside this block
            if tag in TEXTUAL and self.open[depth].tag in SILENT:
                return  # an end without a start inside what is not read

    def handle_data(self, data):
        if self.silent:
            return
        if not self.parts:
            if data.isspace():
                return
            holder = self.open[-1]
            while holder.tag in INLINE and holder.parent is not None:
                holder = holder.parent
            # inline elements that say they are no part of the article keep their own mark
            self.holder = self.open[-1] if self.open[-1].aside and not holder.aside else holder
        self.parts.append(data)
        if self.in_links > 0:
            self.links += len(data)


def read_blocks(html: str) -> tuple[list[Block], Element]:
    page = Page()
    page.feed(CUT_TAG.sub("", html))
    page.close()
    page.flush()
    return page.blocks, page.root


def path_scores(blocks: list[Block], width: float = 1.0) -> dict[int, float]:
    """The fused, smoothed score of each tag path, by the paths' first places on the page."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.element.path, [0.0, 0.0, 0.0, 0.0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += b.marks
        s[3] += b.links
    paths = list(sums)
    text = [s[1] / s[0] for s in sums.values()]
    marks = [s[2] / s[0] for s in sums.values()]
    reach = math.ceil(3 * width)
    bell = [math.exp(-(d * d) / (2 * width * width)) for d in range(reach + 1)]

    def smooth(values: list[float]) -> list[float]:
        out = []
        for i in range(len(values)):
            near = range(max(0, i - reach), min(len(values), i + reach + 1))
            weight = sum(bell[abs(i - j)] for j in near)
            out.append(sum(values[j] * bell[abs(i - j)] for j in near) / weight)
        return out

    fused = [math.sqrt(t * (1 + m)) for t, m in zip(smooth(text), smooth(marks), strict=True)]
    weight = {b.element.path: b.element.weight for b in blocks}
    return {p: f * weight[p] * (1 - min(1.0, sums[p][3] / sums[p][1])) for p, f in zip(paths, fused, strict=True)}


def around(elements: list[Element]) -> Element:
    """The least element around all of these."""
    top = elements[0]
    for e in elements[1:]:
        while top is not e:
            if top.depth >= e.depth:
                top = top.parent  # type: ignore[assignment]
            else:
                e = e.parent  # type: ignore[assignment]
    return top


def whole_part(e: Element) -> Element:
    """The outermost article or main part that an element lies in, or else itself."""
    while e.main and e.parent is not None and e.parent.main:
        e = e.parent
    return e


def in_article(e: Element) -> bool:
    while e.parent is not None and e.tag != "article":
        e = e.parent
    return e.tag == "article"


def main_text(html: str | None, strength: float = 0.5) -> str:
    """The article's blocks, joined by line ends. ``strength``: standard deviations below the mean score that a path may lie."""
    if not html:
        return ""
    blocks, _ = read_blocks(html)
    mine = [b for b in blocks if not b.element.aside]
    if not mine:
        return ""
    scores = path_scores(mine)
    mean = sum(scores.values()) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores.values()) / len(scores))
    content = {p for p, s in scores.items() if s > 0 and s >= mean - strength * spread}
    marked = [b for b in mine if b.element.path in content]
    if not marked:
        return ""
    # the side that holds more of the marked text: the parts that the page names, or the rest
    named = sum((len(b.text) - b.links) * (1 if b.element.main else -1) for b in marked) >= 0 and any(b.element.main for b in marked)
    top = around([b.element for b in marked if b.element.main == named])
    top = whole_part(top)

    def inside(e: Element) -> bool:
        while e.depth > top.depth:
            e = e.parent  # type: ignore[assignment]
        return e is top

    if named:
        mine = [b for b in mine if b.element.main]
    else:
        balance: dict[Element, int] = {}
        for b in mine:
            if b.element.main:
                part = whole_part(b.element)
                balance[part] = balance.get(part, 0) + len(b.text) * (1 if b.element.path in content else -1)
        mine = [b for b in mine if not b.element.main or balance[whole_part(b.element)] > 0]
    rest = [b for b in mine if inside(b.element) and (b.element.weight == 1 or b.element.path in content)]
    plain = [n for n, b in enumerate(rest) if 2 * b.links <= len(b.text) or b.element.path in content]
    if not plain:
        return ""
    taken = set(plain)
    taken.update(n for n, b in enumerate(rest) if n > plain[0] and (n < plain[-1] or in_article(b.element)))
    return "\n".join(b.text for n, b in enumerate(rest) if n in taken)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("html_extract")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_pydict(
                    {
                        "page_id": part.column("page_id"),
                        "url": part.column("url"),
                        "text": pa.array(texts, pa.string()),
                        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    }
                )

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
