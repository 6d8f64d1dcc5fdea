"""HTML extraction: the maximum-scoring run of words and tags, with weights learned from labelled pages.

A page is a sequence of tags and text. Words score positive and tags negative; what a word or tag scores depends on the
elements around it and its own name, and the weights are log odds of lying inside the main text. Pages label themselves
where their markup names the main text (one ``article`` or ``main`` element); weights are fitted to a bounded sample of such pages
(``SAMPLE_PAGES``) and then used on every page, named or not. One linear scan finds the best contiguous region.

Inside the region, and outside, text of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments never counts, as element names, roles and the names of classes and ids tell them. A header inside the main text is its
headline and stays, and so does a form that holds the page's paragraphs. Names that often mark other matter (``share``, ``tags``, ``legal``) make their words
score negative, so that they end a region but are not cut out of one. Attributes are read one by one.

Null and empty pages give an empty text. Unclosed and stray tags are met as browsers do, by closing what they imply. Time is
linear in the page. Ties go to the earlier and shorter region. Other columns stay as they are.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import added, extend

# Pages the weights are fitted to at most (in expectation; drawn by a hash of the page).
SAMPLE_PAGES = 4_000

# Names that the HTML standard gives to elements and their roles.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg".split())
CUT = frozenset("head nav footer aside script style noscript template iframe svg button select option textarea dialog menu canvas audio video input".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"p": BLOCKS - {"body", "html", "head"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
# Last words of class and id names of what is never main text; one of the words after may follow, and numbers.
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements banner sponsor sponsored promo promotion sidebar widget nav navbar navigation menu breadcrumb "
    "breadcrumbs header footer masthead cookie cookies consent notice popup modal overlay newsletter subscribe comment comments reply replies disqus".split())
PART_WORDS = frozenset("area bar block box container content form inner item items link links list panel section slot thread widget wrap wrapper".split())
# Words that often, but not always, name other matter.
ODD_WORDS = frozenset("alert copyright discussion gdpr legal login pager pagination recommended related responses share sharing side signup skip social tagcloud tags toolbar".split())
# Words in paragraphs that make a form the frame of a page.
FORM_WORDS = 100

# Quotes in a tag count only after an equals sign; an unclosed one ends with the tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|$)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACES = re.compile(r"\s+")


def _marks(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether attributes cut an element out, and whether they name what often is no main text."""
    odd = False
    if name in ("html", "body") or not attributes.strip("/ "):
        return False, False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in CUT_ROLES:
            return True, odd
        if key == "style" and _HIDDEN.search(value):
            return True, odd
        if key in ("class", "id") and name not in MAIN:
            for word in value.split():
                parts = [p.lower() for p in _NAME_PARTS.findall(word) if not p.isdigit()]
                if parts and (parts[-1] in CUT_WORDS or len(parts) > 1 and parts[-1] in PART_WORDS and parts[-2] in CUT_WORDS):
                    return True, odd
                odd = odd or any(p in ODD_WORDS for p in parts)
    return False, odd


class Element:
    """An open element: what it does to its text, and where in the tokens it starts."""

    __slots__ = ("name", "cut", "odd", "main", "start")

    def __init__(self, name: str, cut: bool, odd: bool, start: int):
        self.name, self.cut, self.odd, self.main, self.start = name, cut, odd, name in MAIN, start


class Open:
    """The open elements, innermost last, with the places of each name, of blocks and of main elements."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.cut = self.odd = self.main = 0

    def push(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self.stack))
        if element.name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(element)
        self.cut, self.odd, self.main = self.cut + element.cut, self.odd + element.odd, self.main + element.main

    def pop(self) -> Element:
        element = self.stack.pop()
        self.places[element.name].pop()
        if element.name in BLOCKS:
            self.blocks.pop()
        self.cut, self.odd, self.main = self.cut - element.cut, self.odd - element.odd, self.main - element.main
        return element

    def block(self) -> str:
        return self.stack[self.blocks[-1]].name if self.blocks else ""


def tokens(page: str) -> list[list]:
    """[kind, name, text, cut, main, odd]: tags and runs of text; ``cut`` inside what is never main text, ``main`` the depth of main elements."""
    out: list[list] = []
    open_ = Open()
    at = 0

    def text(raw: str) -> None:
        if raw:
            out.append(["text", open_.stack[-1].name if open_.stack else "", raw, open_.cut > 0, open_.main, open_.odd > 0])

    def close() -> None:
        element = open_.pop()
        if element.name == "form" and not element.cut and not _frames_page(out, element.start):
            for token in out[element.start:]:
                token[3] = True

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            places = open_.places.get(name)
            if places:
                place = places[-1]
                # An inline end tag doesn't close the blocks inside its element, unless that is cut out.
                if name in BLOCKS or not open_.blocks or open_.blocks[-1] < place or open_.stack[place].cut:
                    while len(open_.stack) > place:
                        close()
            out.append(["end", name, "", open_.cut > 0, open_.main, open_.odd > 0])
            continue
        if name == "form" and open_.places.get("form"):
            continue  # forms don't nest
        while open_.blocks and name in CLOSED_BY.get(open_.block(), ()):
            place = open_.blocks[-1]
            while len(open_.stack) > place:
                close()
        cut, odd = _marks(name, m[3])
        cut = cut or name in CUT or name == "header" and not open_.main
        out.append(["start", name, "", open_.cut > 0 or cut, open_.main, open_.odd > 0 or odd])
        if name in VOID or m[3].rstrip().endswith("/") and name in ("svg", "math"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        open_.push(Element(name, cut, odd, len(out)))
    while open_.stack:
        close()
    return out


def _frames_page(found: list[list], start: int) -> bool:
    """Whether the tokens of a form hold the page's text rather than fields."""
    words = 0
    for kind, name, raw, cut, _, _ in found[start:]:
        if kind == "start" and (name in MAIN or name == "h1"):
            return True
        if kind == "text" and not cut and name not in ("label", "legend", "li", "td", "th"):
            words += len(raw.split())
    return words >= FORM_WORDS


def feature(token: list) -> str:
    kind, name, _, cut, _, odd = token
    return f"{'word' if kind == 'text' else 'tag'} {name}{' odd' if odd else ''}{' cut' if cut else ''}"


def counts_of(page: str) -> tuple[Counter, Counter] | None:
    """Words and tags inside and outside the main text of a page that names it."""
    found = tokens(page)
    inside, outside = Counter(), Counter()
    for token in found:
        n = len(token[2].split()) if token[0] == "text" else 1
        (inside if token[4] and not token[3] else outside)[feature(token)] += n
    return (inside, outside) if inside else None


def weights(pages: DataFrame, *, page: str = "html", rows: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log odds of each feature, words bounded to be positive and tags to be negative."""
    n = pages.count()
    share = min(1.0, rows / max(1, n))
    drawn = pages.select(F.col(page).alias("page")).where(F.pmod(F.xxhash64("page"), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside, pages_of = Counter(), Counter(), Counter()
        for batch in batches:
            for value in batch.column("page").to_pylist():
                got = counts_of(value or "")
                if got:
                    inside.update(got[0])
                    outside.update(got[1])
                    pages_of.update(got[0].keys() | got[1].keys())
        names = sorted(pages_of)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in (inside, outside, pages_of)]],
                                         names=["feature", "inside", "outside", "pages"])

    sums = drawn.mapInArrow(run, "feature string, inside long, outside long, pages long").groupBy("feature").agg(
        F.sum("inside").alias("i"), F.sum("outside").alias("o"), F.sum("pages").alias("pages"))
    # A feature is an element's name, so a sampled page that makes names up could make many: those of one page alone teach nothing and keep the defaults.
    return {r["feature"]: math.log((r["i"] + 1) / (r["o"] + 1)) for r in sums.where(F.col("pages") > 1).collect()}


# What a word, a block's tag, a heading's and any other tag score before pages have taught better; and what a headline's text adds
# to that of its words, which makes up for the tags between it and the first paragraph.
WORD, TAG, HEADING, INLINE, HEADLINE = 1.0, -1.0, -0.25, -0.2, 3.0


def token_score(token: list, learned: dict[str, float], clip: float = 4.0) -> float:
    """What a token adds to a region. Text in parts that never count costs as much as it would have gained."""
    odds = learned.get(feature(token))
    if token[0] == "text":
        n = len(token[2].split())
        if token[3]:
            return -WORD * n
        if token[5]:
            return n * (-WORD if odds is None else min(clip, max(-clip, odds)))
        return n * (WORD if odds is None else min(clip, max(0.1, odds + WORD))) + HEADLINE * (n > 0 and token[1] == "h1" and odds is None)
    plain = HEADING if token[1] in HEADINGS else TAG if token[1] in BLOCKS else INLINE
    return plain if odds is None or token[3] else max(-clip, min(-0.1, odds + plain))


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum; an empty run if none is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None, learned: dict[str, float]) -> str:
    """Blocks of the best region, white space inside a block made one space, joined by an empty line."""
    found = tokens(page or "")
    start, end = best_run([token_score(t, learned) for t in found])
    blocks, now = [], []
    for kind, name, raw, cut, _, _ in found[start:end]:
        if kind == "text":
            if not cut:
                now.append(raw)
        elif name in BLOCKS:
            blocks.append(now)
            now = []
        elif name == "br":
            now.append(" ")
    blocks.append(now)
    made = (_SPACES.sub(" ", entities.unescape("".join(b))).strip() for b in blocks)
    return "\n\n".join(b for b in made if b)


def extract(pages: DataFrame, learned: dict[str, float] | None = None, *, page: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of every page in the column ``out``."""
    learned = weights(pages, page=page) if learned is None else learned
    schema = added(pages, [(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield extend(batch, schema, {out: pa.array([main_text(v, learned) for v in batch.column(page).to_pylist()], pa.string())})

    return pages.mapInArrow(run, schema)
