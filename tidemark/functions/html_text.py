"""Article text of an HTML page, one page at a time inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Elements whose content never counts as article text.
DROPPED = frozenset({"aside", "footer", "form", "header", "iframe", "nav", "noscript", "script", "style", "svg", "template"})
# Elements without content.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})


class _Paragraphs(HTMLParser):
    """Collects the text of every <p>, noting whether it lies in the first <article> or <main>."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.paragraphs: list[tuple[bool, bool, list[str]]] = []
        self.first: dict[str, int] = {}
        self.dropped = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.open.append((tag, len(self.paragraphs)))
        if tag in DROPPED:
            self.dropped += 1
        elif not self.dropped:
            if tag in ("article", "main") and tag not in self.first:
                self.first[tag] = len(self.open)
            elif tag == "p":
                inside = [self.first.get(t, 10**9) <= len(self.open) for t in ("article", "main")]
                self.paragraphs.append((inside[0], inside[1], []))

    def handle_startendtag(self, tag, attrs):
        return

    def handle_endtag(self, tag):
        names = [t for t, _ in self.open]
        if tag not in names:
            return
        while self.open:
            closed, _ = self.open.pop()
            if closed in DROPPED:
                self.dropped -= 1
            elif self.first.get(closed) == len(self.open) + 1:
                # The container is over; later paragraphs are outside it.
                self.first[closed] = 10**9
            if closed == tag:
                return

    def handle_data(self, data):
        text = data.strip()
        if text and not self.dropped:
            for tag, at in self.open:
                if tag == "p":
                    self.paragraphs[at][2].append(text)


def article_text(html: str | None) -> tuple[str | None, str]:
    """(text, where it came from): article, then main, then all paragraphs, without repeats."""
    parser = _Paragraphs()
    parser.feed(html or "")
    parser.close()
    for source, keep in (("article_tag", 0), ("main_tag", 1), ("paragraph_fallback", None)):
        seen: dict[str, str] = {}
        for paragraph in parser.paragraphs:
            if keep is None or paragraph[keep]:
                text = " ".join(" ".join(paragraph[2]).split())
                if text:
                    seen.setdefault(text.lower(), text)
        if seen:
            return "\n\n".join(seen.values()), source
    return None, "no_article_text_found"


def with_article_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace the HTML column by `article_text` and `text_source`; a narrow, shuffle-free pass."""
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [article_text(h) for h in batch[html]]
            out = batch.drop(columns=[html])
            out["article_text"] = [t for t, _ in found]
            out["text_source"] = [s for _, s in found]
            yield out

    return pages.mapInPandas(extract, f"{schema}, article_text string, text_source string")
