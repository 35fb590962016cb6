"""Main text of web pages by maximum-scoring subsequence."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset("td th br".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong"
    " sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "head title nav header footer aside button select option textarea input script style noscript template iframe svg"
    " canvas object audio video menu".split()
)
# These may wrap a whole page; then only their controls go.
WRAPPERS = frozenset("form dialog label".split())
CONTENT = frozenset("article main".split())
KEPT = frozenset("html body article main".split())
SMALL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre tr".split())
# Words in class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent"
    " complementary contentinfo cookie cookies copyright disqus footer gdpr header login masthead menu menubar modal nav"
    " navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion"
    " recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe"
    " toolbar widget".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond thread".split())
# Words that say where or what kind of box a marked element is; headings; containers whose ids are not made from titles.
PLACES = frozenset("area bar block body bottom box buttons container inner left links list main posts primary right section site top wrap wrapper".split())
TITLED = frozenset("h1 h2 h3 h4 h5 h6".split())
UNTITLED = frozenset("div ul ol table".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|title|textarea|noscript|template|iframe|svg)\b[^<>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>"""
    r"|</?[a-zA-Z!?][^<>]*(?:>|\Z|(?=<))",
    re.DOTALL | re.IGNORECASE,
)
# One attribute: its name and value. Quoted text without a name is passed over.
ATTRIBUTE = re.compile(r"""(?:"[^"]*"|'[^']*')|([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
NAMES = sorted(VOID | BLOCK | CELLS | INLINE | DROPPED | WRAPPERS)


NONE, PARTLY, WHOLLY, READERS = range(4)


@dataclass
class Element:
    """An open element: where it began, and whether it is outside the article, by its name (``hard``) or by its marks."""

    name: str
    first: int
    hard: bool
    mark: int
    inside: bool
    dropped: bool
    last: int = -1


@dataclass
class Page:
    """Tokens of a page. ``words`` counts those of a text token; ``tag`` names that of a tag token."""

    text: list[str] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    hard: list[bool] = field(default_factory=list)
    dropped: list[bool] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


class Stack(list):
    """Open elements, with the places of each name and of the blocks among them, so that no lookup scans."""

    def __init__(self):
        super().__init__()
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.first_dropped: int | None = None

    def put(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self))
        if element.name in BLOCK:
            self.blocks.append(len(self))
        if element.dropped and self.first_dropped is None:
            self.first_dropped = len(self)
        self.append(element)

    def close(self, depth: int, at: int) -> None:
        while len(self) > depth:
            element = self.pop()
            element.last = at
            self.places[element.name].pop()
            if element.name in BLOCK:
                self.blocks.pop()
        if self.first_dropped is not None and self.first_dropped >= depth:
            self.first_dropped = None


def attributes(attrs: str) -> dict[str, str]:
    """Values of class, id, role and what hides an element, by whole names; the first of a name counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id", "role", "hidden", "aria-hidden"):
            found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true"


def marked(found: dict[str, str], name: str, inside: bool) -> int:
    """Whether class, id or role say that an element is not part of an article: wholly, partly, or as readers' comments.

    A name does so wholly if it consists of marks, or of marks joined with PLACES. Inside an article a name that holds
    other words does not count, and only those of containers; ids only of those without a title of their
    own, from which ids are made, unless they name comments. Outside, other words leave it to the content. An
    article is marked as a comment alone.
    """
    if inside and name in SMALL:
        return NONE
    most = NONE
    for attribute in ("class", "id", "role"):
        if attribute == "id" and name in TITLED:
            continue
        for part in found.get(attribute, "").split():
            words = [w for w in re.split(r"[^a-z]+", CAMEL.sub("-", part).lower()) if w]
            if not words or words[0] in ("has", "with", "no", "without", "not") or not MARKS.union(COMMENTS).intersection(words):
                continue
            if COMMENTS.intersection(words) and (COMMENTS | PLACES).issuperset(words):
                return READERS
            if name in KEPT or attribute == "id" and inside and name not in UNTITLED:
                continue
            if MARKS.union(PLACES).issuperset(words):
                most = WHOLLY
            elif not inside and MARKS.intersection(words):
                most = max(most, PARTLY)
    return most


def parsed(source: str) -> Page:
    """Tokens of a page in one pass. Elements left open end with the element around them."""
    page, stack, at = Page(), Stack(), 0

    def put(text: str, tag: str) -> None:
        page.text.append(text)
        page.tag.append(tag)
        page.words.append(len(text.split()))
        page.hard.append(bool(stack) and stack[-1].hard)

    for m in TOKEN.finditer(source):
        if m.start() > at:
            put(source[at : m.start()], "")
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            places = stack.places.get(name)
            put("", name)
            if places:
                stack.close(places[-1], len(page.tag))
            continue
        if name in BLOCK and stack.blocks:  # a paragraph ends where the next block begins
            around = stack[stack.blocks[-1]].name
            if around == "p" or name == around == "li":
                stack.close(stack.blocks[-1], len(page.tag))
        if (name in CONTENT or name == "body") and stack.first_dropped is not None:
            # What was left open before the article does not hold it, but comments may be articles.
            if name == "body" or stack[stack.first_dropped].mark != READERS:
                stack.close(stack.first_dropped, len(page.tag))
        found = attributes(m["attrs"])
        above = stack[-1] if stack else None
        hard = bool(above and above.hard) or name not in KEPT and (name in DROPPED or hidden(found))
        inside = bool(above and above.inside)
        mark = NONE if hard or name in ("html", "body", "main") else marked(found, name, inside)
        if name in WRAPPERS and not hard:
            mark = max(mark, WHOLLY)
        element = Element(name, len(page.tag), hard, mark, inside or name in CONTENT, hard or mark >= WHOLLY or bool(above and above.dropped))
        page.elements.append(element)
        if name in VOID or m["attrs"].endswith("/") and name not in BLOCK:
            put("", name)
            element.last = len(page.tag)
        else:
            stack.put(element)
            put("", name)
    if at < len(source):
        put(source[at:], "")
    stack.close(0, len(page.tag))
    return page


def settle(page: Page, weights: dict[str, float] | None) -> Page:
    """Decides which tokens and elements are outside the article.

    A partly marked element is, unless its own words outweigh its tags; without weights it is not. A wholly marked one is,
    unless it wraps the page: it holds most of the words that no name drops. Comments always are.
    """
    marks = [e for e in page.elements if e.mark]
    words, worth = [0], [0.0]
    for t, n, hard in zip(page.tag, page.words, page.hard, strict=True):
        words.append(words[-1] + (0 if hard else n))
        if weights and marks:
            worth.append(worth[-1] + ((0.0 if hard else n * weights["#word"]) if not t else weights.get(t, weights["#tag"])))
    change = [0] * (len(page.tag) + 1)
    for e in marks:
        if e.mark == PARTLY and (weights is None or worth[e.last] > worth[e.first]):
            continue
        if e.mark == WHOLLY and 2 * (words[e.last] - words[e.first]) > words[-1]:
            continue
        change[e.first] += 1
        change[e.last] -= 1
    depth, page.dropped = 0, []
    for more, hard in zip(change, page.hard):
        depth += more
        page.dropped.append(hard or depth > 0)
    for e in page.elements:
        e.dropped = e.hard or e.first < len(page.dropped) and page.dropped[e.first]
    return page


def best_region(scores: list[float]) -> tuple[int, int] | None:
    """First and end of the contiguous run with the greatest sum, in one scan; None if none is positive."""
    best, region, total, first = 0.0, None, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += score
        if total > best:
            best, region = total, (first, i + 1)
    return region


def content_of(page: Page, weights: dict[str, float]) -> tuple[int, int] | None:
    """The best region, widened to the innermost container that holds it, or to its article."""
    scores = [
        (0.0 if d else n * weights["#word"]) if not t else weights.get(t, weights["#tag"])
        for t, n, d in zip(page.tag, page.words, page.dropped, strict=True)
    ]
    region = best_region(scores)
    if region is None:
        return None
    held = [i for i in range(*region) if page.words[i] and not page.dropped[i]]
    around = [e for e in page.elements if e.first < held[0] and e.last > held[-1] and not e.dropped and e.name in BLOCK - SMALL]
    articles = [e for e in around if e.name in CONTENT]
    inner = min(articles or around, key=lambda e: e.last - e.first, default=None)
    return (inner.first, inner.last) if inner else region


def blocks(page: Page, first: int, end: int) -> Iterator[str]:
    held: list[str] = []
    for i in range(first, end):
        tag = page.tag[i]
        if tag in BLOCK:
            yield "".join(held)
            held = []
        elif tag in CELLS:
            held.append(" ")
        elif not page.dropped[i]:
            held.append(page.text[i])
    yield "".join(held)


def main_text(source: str | None, weights: dict[str, float]) -> str:
    page = settle(parsed(source or ""), weights)
    region = content_of(page, weights)
    if region is None:
        return ""
    found = (" ".join(html.unescape(b).split()) for b in blocks(page, *region))
    return "\n".join(b for b in found if b)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and tags inside and outside the article, of the pages that label theirs by one element."""
    inside, outside = Counter(), Counter()
    for batch in batches:
        for source in batch["html"].to_pylist():
            page = settle(parsed(source or ""), None)
            articles = [e for e in page.elements if e.name in CONTENT and not e.dropped]
            if len(articles) != 1:
                continue
            first, last = articles[0].first, articles[0].last
            for i, (tag, n, dropped) in enumerate(zip(page.tag, page.words, page.dropped, strict=True)):
                name = (tag if tag in NAMES else "#tag") if tag else "#word"
                (inside if first < i < last and not dropped else outside)[name] += 1 if tag else n
    names = sorted(inside.keys() | outside.keys())
    yield pa.RecordBatch.from_pydict({"name": names, "inside": [inside[n] for n in names], "outside": [outside[n] for n in names]})


def learned_weights(pages: DataFrame) -> dict[str, float]:
    """Score of a word and of each tag, from all pages that label their article by one element.

    A score is the log of how much more often the token stands inside than outside, with one prior
    occurrence on either side; words are held above 0 and tags below. The counts have one row for each
    HTML element name (about 130), whatever the size of the input.
    """
    counts = pages.select("html").mapInArrow(counted, "name string, inside long, outside long")
    found = {r["name"]: (r["i"], r["o"]) for r in counts.groupBy("name").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).collect()}
    all_in, all_out = (sum(v[k] for v in found.values()) + len(NAMES) for k in (0, 1))

    def score(name: str) -> float:
        i, o = found.get(name, (0, 0))
        return math.log((i + 1) / all_in) - math.log((o + 1) / all_out)

    weights = {name: min(-0.01, score(name)) for name in (*NAMES, "#tag")}
    return weights | {"#word": max(0.5, score("#word"))}


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of (page_id, url, html).

    The text is that of the best region, widened to the element around it, without elements that are
    no part of an article. A null or empty html, and a page without words, has an empty text. A page
    that is cut off ends its open elements. Rows are handled one by one; equal rows give equal texts.
    """
    scores = weights or learned_weights(pages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source, scores) for source in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
