"""Main text of web pages by minimum cut.

A page is cut into blocks of text. A score from its words, links and place in
the document becomes each block's capacity to the content or the boilerplate
terminal; neighbours in page order and blocks close in the document tree are
tied by edges. The maximum flow between the terminals separates content from
boilerplate: a short line among paragraphs stays with them, one among links
goes with those. Parts that their tags or names mark as menus, headers,
footers, sidebars, notices, adverts, forms or comments are tied to the
boilerplate terminal for good.

One row is one page, so pages are spread as the input is; no shuffle. Work per
page grows with its blocks, and flow is sought only where both kinds meet.

Defined results: null or empty html gives an empty text; truncated or
unbalanced markup is read as far as it goes; every row gives one row, repeated
ones too, also without page_id; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|object)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<!\w[^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
OUTSIDE = frozenset("head nav footer aside form button select menu dialog search".split())
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer gdpr login menu modal nav navbar navigation newsletter notice pagination popup promo promoted recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo".split()
)
INSIDE = frozenset(("article", "main"))
INSIDE_NAMES = frozenset("article content entry main post story".split())
FIRM = 1e6


class Block:
    __slots__ = ("text", "linked", "outside", "inside", "heading", "path")

    def __init__(self, text, linked, outside, inside, heading, path):
        self.text, self.linked, self.outside, self.inside, self.heading, self.path = text, linked, outside, inside, heading, path

    def score(self) -> float:
        """Above 0 where it reads as content, below where as boilerplate."""
        if self.outside:
            return -FIRM
        words = self.text.split(" ")
        links = self.linked / max(len(self.text), 1)
        ended = self.text[-1:] in ".!?…:;»\"')”"
        return -1.6 + 0.5 * min(len(words), 60) ** 0.5 + 0.7 * ended - 4 * min(links, 1.0) + 3.0 * self.inside + 0.5 * (self.heading and self.inside)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with where they stand."""
    out: list[Block] = []
    # open elements: tag, number, outside, inside, in a link
    stack: list[tuple[str, int, bool, bool, bool]] = []
    parts: list[str] = []
    state = {"linked": 0, "number": 0}
    top = (False, False, False)

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            own = stack[-1][2:] if stack else top
            path = tuple(s[1] for s in stack if s[0] in BLOCKS)
            out.append(Block(text, state["linked"], own[0], own[1], any(re.fullmatch("h[1-6]", s[0]) for s in stack), path))
        state["linked"] = 0

    def close(tag: str) -> None:
        while stack:
            if stack.pop()[0] == tag:
                return

    at = 0
    for m in MARK.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if stack and stack[-1][4]:
                state["linked"] += len(piece.strip())
        at = m.end()
        tag = m[3]
        if not tag:
            if m[1]:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag in ("br", "wbr"):
            parts.append(" " if tag == "br" else "")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if m[2]:
            if any(s[0] == tag for s in stack):
                close(tag)
            continue
        shut = CLOSES.get(tag)
        while shut and stack and stack[-1][0] in shut | {"b", "i", "em", "strong", "a", "span", "font", "u"} and any(s[0] in shut for s in stack):
            done = stack.pop()[0] in shut
            if done and not (stack and stack[-1][0] in shut):
                break
        if tag in EMPTY:
            continue
        outside, inside, link = stack[-1][2:] if stack else top
        if not outside and tag not in ("html", "body"):
            names = {w for found in NAMED.finditer(m[4]) for name in (found[1] or found[2] or found[3] or "").lower().split() if not name.startswith(("has-", "with-", "no-", "is-")) for w in re.split(r"[^a-z0-9]+", name)} if m[4] else ()
            outside = tag in OUTSIDE or (tag == "header" and not inside) or bool(OUTSIDE_NAMES.intersection(names)) or ("header" in names and not inside and tag not in INSIDE)
            inside = not outside and (inside or tag in INSIDE or (block and bool(INSIDE_NAMES.intersection(names))))
        state["number"] += 1
        stack.append((tag, state["number"], outside, inside, link or tag == "a"))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def content_side(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: which blocks stay with the content terminal. Augments along shortest paths."""
    n = len(score)
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        room[a][b] = room[a].get(b, 0.0) + w
        room[b][a] = room[b].get(a, 0.0) + w
    give, take = [max(s, 0.0) for s in score], [max(-s, 0.0) for s in score]
    while True:
        came = {i: i for i in range(n) if give[i] > 1e-12}
        queue, end = deque(came), None
        while queue and end is None:
            x = queue.popleft()
            for y, w in room[x].items():
                if w > 1e-12 and y not in came:
                    came[y] = x
                    if take[y] > 1e-12:
                        end = y
                        break
                    queue.append(y)
        if end is None:
            return [i in came for i in range(n)]
        path = [end]
        while came[path[-1]] != path[-1]:
            path.append(came[path[-1]])
        flow = min([take[end], give[path[-1]]] + [room[a][b] for b, a in zip(path, path[1:])])
        take[end] -= flow
        give[path[-1]] -= flow
        for b, a in zip(path, path[1:]):
            room[a][b] -= flow
            room[b][a] += flow


def proximity(a: Block, b: Block) -> float:
    """Near in the document tree: 1 for siblings' children, falling with the steps between."""
    common = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        common += 1
    return 2.0 / (len(a.path) + len(b.path) - 2 * common + 1)


def main_text(page: str | None) -> str:
    """The content blocks of one page, joined by a space."""
    found = blocks_of(page or "")
    scores = [b.score() for b in found]
    if all(s > 0 or b.outside for s, b in zip(scores, found)):
        kept = [s > 0 for s in scores]
    else:
        edges = [(i, i + 1, 0.1 + 0.25 * proximity(a, b)) for i, (a, b) in enumerate(zip(found, found[1:])) if a.outside == b.outside and a.inside == b.inside]
        last: dict[tuple, int] = {}
        for i, b in enumerate(found):
            if not b.outside:
                parent = b.path[:-1]
                if parent in last and last[parent] != i - 1:
                    edges.append((last[parent], i, 0.15 * proximity(found[last[parent]], b)))
                last[parent] = i
        kept = content_side(scores, edges)
    return " ".join(b.text for b, k in zip(found, kept) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """Contract of op7: (page_id, url, text, n_chars)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
