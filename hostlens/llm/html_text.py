"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block element. Lines of menus, headers, footers, sidebars,
notices, adverts, forms and comments become blank. They are known by their element or by class, id or role, an
`article` too. Only where nothing stands outside the parts known by name, those that hold most of the text stay. Scripts, styles and embedded parts (drawings,
frames, option lists) leave no line; formulas are text. A line weighs its length without link texts. Over sliding
windows of `WINDOW` lines the weights are summed: text surges where a window passes `SURGE` and dives where the
next windows are empty. The lines between surge and dive are kept, all of them, short ones too, with the lines
that adjoin the surge (title, byline) and the lines of links that stand in the text's own container. A part left
out is a gap of as many blank lines as a window has, unless text goes on after it in the same container.

A page that marks its main part, or else its articles, says where text is: outside it lines are blank. If no window surges,
the run of lines with the most text is kept.

Defined cases: null counts as empty; empty html, or html without text, gives an empty text; unclosed elements
end with their parent; text without any markup is one block. Repeated rows are handled each for itself, there are no ties;
an empty table gives an empty table; a page may be as long as a row may be. Further columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import chosen, cuts

WINDOW, SURGE = 3, 80

SCHEMA = "page_id long, url string, text string, n_chars long"

_ATTRIBUTES = r"(?:[^>\"'/]|\"[^\"]*\"|'[^']*'|/(?!>))*"  # never the '/' of a self-closing element
_TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    # Raw text: these hold no markup and run to their closing tag, or to the end of the page.
    rf"|<(script|style|textarea|title)(?=[\s/>]){_ATTRIBUTES}(?:/>|>.*?(?:</\1(?=[\s/>])[^>]*>|\Z))"
    rf"|<(/?)([a-zA-Z][\w:-]*)({_ATTRIBUTES}/?)>",
    re.S | re.I,
)
_NAMES = re.compile(r"(?<=[\s\"'])(class|id|role|aria-label|data-role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Fixed words: elements and names of parts that are no article text.
_OUT_ELEMENTS = frozenset("nav header footer aside form button dialog menu head".split())
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice"
    " notices alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer"
    " comment comments disqus reply replies share sharing social related recommended newsletter subscribe subscription signup"
    " login search pagination pager toolbar widget widgets skip contentinfo complementary copyright".split()
)
# Elements without text of the page that hold markup; they leave no blank line.
_EMBEDDED = frozenset("noscript template svg iframe select object".split())
_BLOCKS = frozenset(
    "p div section article main ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre figure"
    " figcaption address hr details summary fieldset legend body html center".split()
) | _OUT_ELEMENTS
#: What the next element of that name does not reach through.
_ENDS = {n: _EMBEDDED | (_BLOCKS - {"p"} if n == "p" else {"table"} if n == "tr" else {"ul", "ol", "table", "dl", "tr"}) for n in ("p", "li", "tr", "td", "th", "dt", "dd")}
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_MAIN_WORDS = frozenset("articlebody main".split())
#: A name ends with the word for what it names ('main-menu', 'cookie-banner') or begins with it and
#: ends with one of these ('comment-list'). Any other name only speaks of such a part ('no-sidebar', 'comments-open').
_HOLDERS = frozenset(
    "area bar block body bottom box button buttons container content desktop feed form holder icons inner item items label layer left link"
    " links list message mobile panel placeholder popup primary right row secondary section slot text top unit widget wrap wrapper zone".split()
)
#: Before such a word a name says how the page is laid out or what state it is in.
_TERMS = frozenset("category cat tag type format status term".split())  # of a post: these say what it is about
_STATES = frozenset("no has have with without is not non hide hidden hides show shows toggle disable disabled enable enabled allow layout".split())
#: These are no parts; the ids of texts are made from what they say.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: A removed part that frames the page (2), or stands beside its text (1).
_FRAME = re.compile(r"nav|menu|header|masthead|footer|contentinfo", re.I)
_BESIDE = re.compile(r"sidebar|aside|complementary", re.I)
#: Blocks that hold other blocks, as a page or an article does; body and html are the root, ROOT.
_CONTAINERS = frozenset("div section article main td center form fieldset aside".split())
ROOT = -1


class Line(NamedTuple):
    """A line, or the blank of a part left out. Its chain are the containers around it from the root on."""

    text: str
    weight: int
    inside: int  # of a marked article (1), of the marked main part (2)
    out: bool
    chain: tuple[int, ...]
    heading: bool = False
    frame: int = 0


def _names_part(value: str) -> bool:
    """Whether one class, id or role names a part that is left out."""
    parts = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if w and not w.isdigit()]
    if not 0 < len(parts) <= 3 or not _STATES.isdisjoint(parts) or parts[0] in _TERMS:
        return False
    return parts[-1] in _OUT_WORDS or (len(parts) > 1 and parts[-1] in _HOLDERS and not _OUT_WORDS.isdisjoint(parts[:-1]))


@lru_cache(maxsize=4096)
def _named(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's names call it the main part, and whether they call it one that is left out."""
    main = left = False
    if name in _HEADINGS:
        return main, left
    for key, *values in _NAMES.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "id" and name == "p":
            continue
        for one in [value] if key == "aria-label" else value.split():
            main = main or (key != "aria-label" and one.lower() in _MAIN_WORDS)
            # An article's class may end with any word ('weather-notice'); one that begins with it is such a part.
            left = left or (_names_part(one) and (name != "article" or re.split(r"[^a-z]", one.lower())[0] in _OUT_WORDS))
    return main and not left, left


def lines(page: str) -> list[Line]:
    """The page's lines, with a blank for each part left out."""
    tokens = list(_TOKENS.finditer(page))
    unclosed = _unclosed(tokens)
    # Names are only a hint: first all parts are read, then they are left out if there is text outside them.
    found, named = _read(page, tokens, unclosed, None)
    if not named:
        return found
    without = _read(page, tokens, unclosed, set(named))[0]
    if any(line.weight for line in without):
        return without
    whole = sum(line.weight for line in found)
    return _read(page, tokens, unclosed, {at for at, weight in named.items() if 2 * weight <= whole})[0]


def _read(page: str, tokens: list[re.Match], unclosed: set[int], named_out: set[int] | None) -> tuple[list[Line], dict[int, int]]:
    """The lines without the elements that begin at named_out; if that is None, with all that are named as parts
    to leave out, and the weight of the lines in each of them by its begin."""
    named: dict[int, int] = {}
    out: list[Line] = []
    held: list[str] = []
    linked = 0
    # name, left out, main, link, where it begins if it is weighed, and if it is a container
    open_: list[tuple[str, bool, int, bool, int, int]] = []

    def inside() -> int:
        return max((e[2] for e in open_), default=0)

    def chain() -> tuple[int, ...]:
        return (ROOT, *[e[5] for e in open_ if e[5] >= 0])

    def close_line() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            heading = any(e[0] in _HEADINGS for e in open_)
            out.append(Line(text, max(0, len(text) - linked), inside(), False, chain(), heading))
        held.clear()
        linked = 0

    at = 0
    outside = False  # inside a part that is left out
    for token in tokens:
        if token.start() > at and not outside:
            text = references.unescape(page[at : token.start()])
            held.append(text)
            size = len(" ".join(text.split()))
            if any(e[3] for e in open_):
                linked += size
            elif named:
                for e in open_:
                    if e[4] >= 0:
                        named[e[4]] += size
        at = token.end()
        name = (token.group(3) or "").lower()
        if not name:
            continue
        if not token.group(2):
            if name == "br":
                held.append(" ")
            if name in _BLOCKS:
                if not outside:
                    close_line()
                if name in _ENDS:  # these end where the next of them begins
                    _end(open_, name, stop=_ENDS[name])
            if name in _VOID or token.group(4).rstrip().endswith("/") or token.start() in unclosed:
                continue
            attributes = token.group(4)
            # Long ones (data in an address) are not remembered.
            main, by_name = (_named if len(attributes) < 500 else _named.__wrapped__)(name, attributes) if attributes else (False, False)
            by_name = by_name and name not in ("main", "body", "html")
            main = 2 if main or name == "main" else 1 if name == "article" and not by_name else 0
            head = name == "header" and any(e[2] for e in open_)
            left = outside or name in _EMBEDDED or (name in _OUT_ELEMENTS and not head)
            weighed = -1
            if by_name and not left:
                if named_out is None:
                    weighed = token.start()
                    named[weighed] = 0
                else:
                    left = token.start() in named_out
            if left and not outside and name in _BLOCKS:
                said = f"{name} {attributes}"
                frame = 2 if name == "head" or _FRAME.search(said) else 1 if _BESIDE.search(said) else 0
                out.append(Line("", 0, inside(), True, chain(), False, frame))
            open_.append((name, left, main, name == "a", weighed, token.start() if name in _CONTAINERS else -1))
            outside = left
        else:
            if name in _BLOCKS and not outside:
                close_line()
            _end(open_, name, stop=frozenset())
            outside = bool(open_) and open_[-1][1]
    if not outside:
        held.append(references.unescape(page[at:]))
    close_line()
    return out, named


def _unclosed(tokens: list[re.Match]) -> set[int]:
    """Where embedded parts begin that no closing tag ends: they are empty, or they would take the page with them."""
    begun: dict[str, list[int]] = {n: [] for n in _EMBEDDED}
    for token in tokens:
        name = (token.group(3) or "").lower()
        if name in _EMBEDDED:
            if not token.group(2):
                if not token.group(4).rstrip().endswith("/"):
                    begun[name].append(token.start())
            elif begun[name]:
                begun[name].pop()
    return {at for places in begun.values() for at in places}


def _end(open_: list, name: str, stop: frozenset) -> None:
    """Closes the innermost element of that name and what is open in it, if none of stop is in between."""
    for k in range(len(open_) - 1, -1, -1):
        if open_[k][0] == name:
            del open_[k:]
            return
        if open_[k][0] in stop:
            return


def _framed(found: list[Line]) -> set[int]:
    """Containers that hold more than an article: the root, and all around a part that frames the page."""
    return {ROOT}.union(*[line.chain for line in found if line.out and line.frame])


def _flowing(found: list[Line], framed: set[int]) -> list[Line]:
    """The lines without the blanks of parts in the flow of a text: text goes on after them in the same container."""
    after: list[Line | None] = [None] * len(found)
    following = None
    for i in range(len(found) - 1, -1, -1):
        after[i] = following
        following = found[i] if found[i].text else following
    out, before = [], None
    for line, following in zip(found, after, strict=True):
        if line.text:
            before = line
        elif before and following:
            parent = line.chain[-1]
            if parent in framed:
                in_flow = before.chain[-1] == parent == following.chain[-1] and not (parent == ROOT and line.frame == 2)
            else:
                in_flow = parent in before.chain and parent in following.chain
            if in_flow:
                continue
        out.append(line)
    return out


def _widened(spread: list[Line], spans: list[tuple[int, int]], framed: set[int]) -> list[tuple[int, int]]:
    """The spans with what adjoins them: lines before that no window reaches, and lines of links in the text's own containers."""

    def own(link: Line, text: Line) -> bool:
        return link.chain[-1] in text.chain and link.chain[-1] not in framed

    out, floor = [], 0
    for n, (start, end) in enumerate(spans):
        first, at = spread[start], start
        while at > floor and spread[at - 1].text:
            at -= 1
            line = spread[at]
            if line.weight or line.heading or own(line, first):
                start = at
            elif start - at >= WINDOW:
                break
        top = spans[n + 1][0] if n + 1 < len(spans) else len(spread)
        last = next(spread[k] for k in range(end - 1, start - 1, -1) if spread[k].weight)
        at = end
        while at < top and spread[at].text:
            line, at = spread[at], at + 1
            if own(line, last) or (line.weight and (line.chain[-1] == last.chain[-1] or own(last, line))):
                end = at
            elif line.weight or line.chain[-1] != last.chain[-1]:
                break
        out.append((start, end))
        floor = end
    return out


def main_text(page: str | None) -> str:
    found = lines(page or "")
    framed = _framed(found)
    marked = max((line.inside for line in found if line.text), default=0)
    if marked:
        # What stands between two marked parts is a gap; what is left out inside one is none.
        found = [line if line.inside >= marked else line._replace(text="", weight=0, out=True) for line in found]
        rows = [line for line in found if not (line.out and line.inside >= marked)]
    else:
        rows = _flowing(found, framed)
    spread: list[Line] = []
    for line in rows:
        # A part left out stands for as many blank lines as a window has.
        spread += [line] if line.text else [line] * WINDOW
    weights = [line.weight for line in spread]
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    spans, i = [], 0
    while i < len(sums):
        if sums[i] >= SURGE and weights[i]:
            end = i
            while end < len(sums) and sums[end]:
                end += 1
            spans.append((i, end))
            i = end
        else:
            i += 1
    if not spans:
        runs, start = [], 0
        for k in range(len(weights) + 1):
            if k == len(weights) or not spread[k].text:
                if k > start:
                    runs.append((sum(weights[start:k]), -start, k))
                start = k + 1
        if not runs or max(runs)[0] == 0:
            return ""
        _, start, end = max(runs)
        spans = [(-start, end)]
    else:
        spans = _widened(spread, spans, framed)
    return "\n".join(line.text for a, b in spans for line in spread[a:b] if line.text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cuts(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = chosen(pages, page_id=F.col("page_id").cast("long"), url=F.col("url").cast("string"), html=F.col("html"))
    return rows.mapInArrow(run, SCHEMA)
