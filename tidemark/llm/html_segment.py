"""Main text of web pages as the maximum-scoring subsequence of words and tags.

Every word scores positive and every tag negative. The weights are log-odds of lying inside or
outside the marked content of labelled pages: of a word by the block it stands in, of a tag by its
name and role. One linear scan finds the contiguous stretch of largest total; stretches in blocks
that never are content (menus, adverts, forms, comments, ...) neither score nor stay. An element is such
a block by its own name, or by a class or id that names a role, unless what it holds speaks against it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import to_ints

# Elements by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("nav header footer aside form menu dialog button select title head".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion comment "
    "comments reply replies respond disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies "
    "consent notice notices popup modal newsletter subscribe subscription share sharing social related footer "
    "masthead toolbar widget pagination pager".split())
READERS = frozenset("comment comments reply replies respond disqus".split())
# Words that leave a role as it is: "ad-box", "comment-list", "site-footer".
FILLERS = frozenset(
    "area bar block bottom box button buttons container form global header icons inner item items left link links "
    "list main outer posts primary right secondary section signup site slot stories thread title top unit wrap "
    "wrapper".split())
# Words that say the element is laid out around the role, not that it is one: "has-sidebar".
AROUND = frozenset("has with no without by".split())
ROLE_NAMES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu")

TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|iframe)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|(?=<)|\Z)"
    r"|<[!?][^<>]*+(?:>|(?=<)|\Z)", re.S | re.I)
NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


@dataclass(frozen=True)
class Weights:
    """Scores of words by enclosing block and of tags by name; unseen ones take the defaults."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    word: float = 1.0
    tag: float = -1.5


@dataclass
class Span:
    """A piece of a page: a tag, or text with its enclosing block; `out`: inside a block that is never content."""

    tag: str
    text: str
    block: str
    out: bool
    element: int = 0


@dataclass
class Element:
    """What decides whether an element is left out: its own role, and what it holds."""

    name: str
    parent: int
    role: str
    words: int = 0
    main: bool = False
    article: bool = False


def _token_role(token: str) -> str:
    """The role that one class or id gives an element: "strong" if it names nothing but a role, "readers" if that is
    the readers' comments, "weak" if other words stand beside it, else ""."""
    parts = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", token)]
    named = [w for w in parts if w in ROLES]
    if not named or not AROUND.isdisjoint(parts):
        return ""
    if all(w in ROLES or w in FILLERS or w.isdigit() for w in parts):
        return "readers" if not READERS.isdisjoint(named) else "strong"
    return "weak"


def _role(name: str, attributes: str, inside: bool, headline: bool) -> str:
    """How an element's own name and attributes speak against it: "never", "readers", "strong", "weak" or "".
    `inside`: it lies in an article or main element, where ids are mostly anchors; `headline`: it lies in
    an article, main element or section, whose header is its title."""
    if name in NEVER and not (name == "header" and headline):
        return "never"
    if not attributes or name in ("html", "body", "main", "article"):
        return "readers" if name == "article" and "comment" in attributes and _classes(attributes) == "readers" else ""
    if HIDDEN.search(attributes):
        return "never"
    return _classes(attributes, ids=name not in HEADINGS, weak_ids=not inside)


def _classes(attributes: str, ids: bool = True, weak_ids: bool = True) -> str:
    found = set()
    for key, *values in NAMES.findall(attributes):
        value, key = "".join(values), key.lower()
        if key == "role":
            if value.lower() in ROLE_NAMES:
                return "never"
        elif key == "class" or ids:
            found |= {r for r in map(_token_role, value.split()) if key == "class" or weak_ids or r != "weak"}
    return next((r for r in ("readers", "strong", "weak") if r in found), "")


def _left_out(elements: list[Element]) -> list[bool]:
    """Which elements never are content, with all they hold. A role in a class or id counts only as far as what the
    element holds agrees: none leaves out the main element, a weak one no article and no half of the page's words,
    a strong one not both an article and half of the words. Readers' comments may be of any length."""
    for k in range(len(elements) - 1, 0, -1):
        e, up = elements[k], elements[elements[k].parent]
        if e.role != "never":
            up.words += e.words if e.role != "readers" else 0
            up.main |= e.main or e.name == "main"
            up.article |= e.article or (e.name == "article" and e.role == "")
    half = elements[0].words / 2
    out = [False] * len(elements)
    for k, e in enumerate(elements[1:], 1):
        large = e.words > half
        own = e.role in ("never", "readers") or (e.role == "strong" and not (e.article and large)) or (
            e.role == "weak" and not (e.article or large))
        out[k] = out[e.parent] or (own and (e.role == "never" or not e.main))
    return out


def spans(page: str) -> list[Span]:
    """The page as tags and texts, in order; comments, scripts and styles are left out."""
    elements = [Element("", 0, "")]
    found = list(_parts(page, elements))
    out = _left_out(elements)
    for p in found:
        p.out = out[p.element]
    return found


def _parts(page: str, elements: list[Element]) -> Iterator[Span]:
    """The spans with the number of their element, which is appended to `elements`; `out` is not known yet."""
    stack: list[tuple[str, int]] = []
    open_main = open_articles = 0
    at = 0

    def text(piece: str) -> Span:
        element = stack[-1][1] if stack else 0
        elements[element].words += len(piece.split())
        return Span("", piece, _block(stack), False, element)

    def close(k: int) -> None:
        nonlocal open_main, open_articles
        for name, _ in stack[k:]:
            open_main -= name == "main"
            open_articles -= name == "article"
        del stack[k:]

    for m in TOKENS.finditer(page):
        if m.start() > at:
            yield text(page[at:m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:  # a closing tag closes up to its opening one, if that is open, and is out where that is
            element = stack[-1][1] if stack else 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    element = stack[k][1]
                    close(k)
                    break
                if stack[k][0] in _WALLS and name not in _WALLS:
                    break
            yield Span("/" + name, "", _block(stack), False, element)
            continue
        if name in _IMPLIED:  # p, li, td, ... end where the next begins
            ends, walls = _IMPLIED[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in walls:
                    break
        headline = name == "header" and next(
            (n for n, _ in reversed(stack) if n in _SECTIONS), "") in ("article", "main", "section")
        elements.append(Element(
            name, stack[-1][1] if stack else 0, _role(name, m[4], open_main + open_articles > 0, headline)))
        yield Span(name, "", _block(stack), False, len(elements) - 1)
        if name not in EMPTY and not m[4].endswith("/"):
            stack.append((name, len(elements) - 1))
            open_main += name == "main"
            open_articles += name == "article"
    if at < len(page):
        yield text(page[at:])


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SECTIONS = frozenset("article aside body footer header main nav section".split())
_WALLS = frozenset("article aside body div footer form header main nav section table td th ul ol".split())
_P_ENDERS = "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main " \
    "nav ol p pre section table ul".split()
_IMPLIED = {name: ({"p"}, _WALLS) for name in _P_ENDERS} | {
    "li": ({"li"}, frozenset({"ul", "ol", "menu"})), "dt": ({"dt", "dd"}, frozenset({"dl"})),
    "dd": ({"dt", "dd"}, frozenset({"dl"})), "tr": ({"tr"}, frozenset({"table"})),
    "td": ({"td", "th"}, frozenset({"tr", "table"})), "th": ({"td", "th"}, frozenset({"tr", "table"})),
    "option": ({"option"}, frozenset({"select"}))}


def _block(stack: list[tuple[str, int]]) -> str:
    for name, _ in reversed(stack):
        if name in BLOCKS:
            return name
    return ""


def _weighed(name: str) -> str:
    """Name under which a tag or block is counted and weighed: headings of all levels are one."""
    return "h1" if name in ("h2", "h3", "h4", "h5", "h6") else name


def region(parts: list[Span], weights: Weights) -> tuple[int, int]:
    """The slice of largest total score; of equal ones the earliest, then the shortest."""
    best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
    for k, p in enumerate(parts):
        if p.out:  # a neutral gap
            continue
        if p.tag:
            total += weights.tags.get(_weighed(p.tag.lstrip("/")), weights.tag)
        else:
            total += weights.words.get(_weighed(p.block), weights.word) * len(p.text.split())
        if total > best:
            best, best_at = total, (begin, k + 1)
        if total <= 0:
            total, begin = 0.0, k + 1
    return best_at


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best region joined by line feeds, white space inside a block as one space."""
    if not page:
        return ""
    parts = spans(page)
    first, last = region(parts, weights)
    blocks, open_text = [], []

    def close() -> None:
        block = " ".join("".join(open_text).split())
        open_text.clear()
        if block:
            blocks.append(block)

    for p in parts[first:last]:
        name = p.tag.lstrip("/")
        if name in BLOCKS:
            close()
        elif name == "br":
            open_text.append(" ")
        elif not p.tag and not p.out:
            open_text.append(html.unescape(p.text) if "&" in p.text else p.text)
    close()
    return "\n".join(blocks)


def counts_of(page: str) -> Counter:
    """(kind, name, inside) counts of a page whose content is marked by an article or main element; what lies
    in blocks that never are content counts on neither side, their articles (comments, teasers) mark nothing."""
    out: Counter = Counter()
    depth, marked = 0, False
    for p in spans(page):
        name = p.tag.lstrip("/")
        if p.out:
            continue
        if name in ("article", "main"):
            depth = max(0, depth + (-1 if p.tag[0] == "/" else 1))
            marked = True
        inside = depth > 0 and name not in ("article", "main")
        if p.tag:
            out["tag", _weighed(name), inside] += 1
        else:
            out["word", _weighed(p.block), inside] += len(p.text.split())
    return out if marked else Counter()


def learn(pages: Iterable[str | None]) -> Weights:
    """Weights from pages whose content an article or main element marks: log-odds with one pseudo-count
    a side, kept positive for words and negative for tags; a tag on neither side weighs as little as any. No
    labelled page: the defaults."""
    total: Counter = Counter()
    for page in pages:
        if page and re.search(r"<(article|main)[\s>]", page, re.I):
            total.update(counts_of(page))

    def odds(kind: str, name: str) -> float:
        return math.log((total[kind, name, True] + 1) / (total[kind, name, False] + 1))

    if not total:
        return Weights()
    names = {k: {n for kind, n, _ in total if kind == k} for k in ("word", "tag")}
    return Weights(
        {n: min(3.0, max(0.05, odds("word", n))) for n in names["word"]},
        {n: max(-6.0, min(-0.25, odds("tag", n))) for n in names["tag"]}, tag=-0.25)


def labelled_sample(pages: DataFrame, n: int) -> list[str]:
    """At most n pages to learn from, the same on every run: those with the smallest hash of the url and id."""
    rows = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.length("html") < 200_000)).select(
        F.xxhash64("url", "page_id").alias("h"), "page_id").orderBy("h", "page_id").limit(n)
    found = F.broadcast(rows.select(F.col("h").alias("_sample_h"), F.col("page_id").alias("_sample_id")))
    chosen = pages.select("html", "page_id", F.xxhash64("url", "page_id").alias("h")).join(
        found, (F.col("h") == F.col("_sample_h")) & F.col("page_id").eqNullSafe(F.col("_sample_id")), "left_semi")
    return sorted(r[0] for r in chosen.select("html").limit(n).collect())


def extract(pages: DataFrame, sample: int = 200) -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    Weights are learned from at most `sample` labelled pages. Null or empty html gives empty text;
    null ids and urls and repeated rows stay as they are; other columns are not read. Without a shuffle.
    """
    weights = learn(labelled_sample(pages, sample))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p if isinstance(p, str) else None, weights) for p in batch["html"]]
            yield pd.DataFrame({
                "page_id": to_ints(batch["page_id"]), "url": batch["url"], "text": texts,
                "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(
        run, "page_id long, url string, text string, n_chars long")
