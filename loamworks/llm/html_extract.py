"""HTML extraction by line-block distribution.

Markup is stripped to lines: each block element starts a line, inline tags vanish, scripts, styles and comments go. Elements
that group others (div, section, nav ...) leave WINDOW empty lines at their ends, and a first-level heading before it. A
line weighs its text's length; link text, copyright notices and menus of bare labels weigh nothing. Weights are summed over
blocks of WINDOW lines. The page's own distribution sets the threshold: the mean of its blocks with text, SURGE at most. Text
begins at the first surge (a line from which a block reaches the threshold) and ends at the dive (a block without weight)
behind the last surge; all between is kept, short lines and stretches too.

Names and tags are prior weights. Containers that are boilerplate by their element or by a whole name in their class, id,
role or label (adverts, forms, reader comments ...) weigh less than nothing, so that the text dives where they stand, unless they
hold half of the page's text or of its articles'; headings, paragraphs, items and cells never do. Article and main elements are
candidates: those under one parent are whole if their lines in surging blocks weigh at least as much as all such lines outside; otherwise
the text outside wins, and those that aren't in its home go. The home of the text is the innermost container that holds more than
half of the surging weight (sections belong to what they are in). From its first-level heading or first sentence to its last
sentence, short lines of the home stay, if nothing about the site (footer, menu ...) comes before. If no text is left, names
and forms don't count.

Nulls: null or empty html gives an empty text; a page without text too. Broken markup never fails: a container that isn't
closed skips only its own tag, and script, style or a comment without an end takes the rest of the page, as in a browser.
Very long pages are handled one at a time. Empty table: an empty result. Repeated rows and ties get the same text; extra
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 3
#: The threshold's upper bound in characters, so that long paragraphs don't make short sections beside them boilerplate.
SURGE = 160
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>"
    r"|<(script|style|iframe|textarea)\b(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: HTML's block elements: their tags part lines.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset title head".split())
#: Elements without text of the article that may stand inside a line: they vanish and don't part it.
INLINE_SKIPS = frozenset("noscript template svg select button object canvas math".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner promo promoted sponsor sponsored nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar footer foot sidebar aside widget widgets comment comments commentlist reply replies disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended recommendations teaser form search pagination pager copyright".split()
)
#: Site headers; inside an article a header holds its title and stays.
HEADER_TAGS, HEADER_WORDS = frozenset(["header"]), frozenset(["header", "siteheader", "pageheader"])
#: Elements that a name can make boilerplate.
CONTAINERS = frozenset("address article center details dir div dl figure header hgroup ol section table ul".split())
#: Words beside those of boilerplate that a name of boilerplate may have.
NEUTRAL_WORDS = frozenset(
    "area article articles bar block body bottom box buttons col column container content entry first global group holder icons inner item items last left link links list main message mini mobile outer page panel post posts primary region right row secondary section site slot small sticky sub top unit wrap wrapper".split()
)
#: Elements that may hold the whole page, as named ones may. Reader comments may be longer than the article.
WRAPPERS = frozenset(["form", "header"])
COMMENT_WORDS = frozenset("comment comments commentlist reply replies disqus".split())
MAIN_TAGS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that group others: empty lines at both ends, where they hold blocks of their own.
GROUPS = frozenset("article aside center details div fieldset footer form header main menu nav section".split())
#: Elements about the site, and such words: text ends there, unless there is a surge behind them.
SITE_TAGS = frozenset("nav footer menu header head title".split())
SITE_WORDS = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar footer foot pagination pager copyright".split()) | HEADER_WORDS
#: A notice of rights: it begins with the sign or the word, is short, and has a sign, a year or the phrase.
_NOTICE = re.compile(r"(?=.{1,200}$)(©|\(c\)|copyright\b(?=.*(©|\(c\)|\b(19|20)\d\d\b|rights reserved)))", re.I)
_LABEL = re.compile(r"\S+( \S+)?(?<![.?!:;,…])")
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SPACES = re.compile(r"\s+")


def _boilerplate(tag: str, attrs: str, inside: bool, names: bool = True) -> bool:
    if tag in WRAPPERS:
        return names and (tag == "form" or not inside or bool(_words(attrs) & BOILERPLATE_WORDS))
    if tag in BOILERPLATE_TAGS or tag in INLINE_SKIPS:
        return True
    if not names or tag not in CONTAINERS:
        return False
    words = _words(attrs)
    return bool(words & BOILERPLATE_WORDS) or not inside and bool(words & HEADER_WORDS)


def _words(attrs: str) -> set[str]:
    """Words of the names that consist of words of boilerplate and neutral ones; a label is one name."""
    out: set[str] = set()
    for m in _NAMED.finditer(attrs) if "=" in attrs else ():
        value = m[2].strip("\"'").lower()
        for name in [value] if m[1].lower() == "aria-label" else value.split():
            words = {w for w in re.split(r"[^a-z0-9]+", name) if w and not w[0].isdigit()}
            if words <= BOILERPLATE_WORDS | HEADER_WORDS | NEUTRAL_WORDS:
                out |= words
    return out


def _holding(page: str, tokens: list, names: list[tuple[str, bool]], closes: list[int], attrs: list[str]) -> Callable[[int, bool], bool]:
    """Whether the element that a tag opens holds half of the page's text, or half of that of its article and main elements (comments: all of that)."""
    total, main = [0], [0]
    at = depth = 0
    ends: set[int] = set()
    for i, m in enumerate(tokens):
        n = len("".join(page[at : m.start()].split()))
        total.append(total[-1] + n)
        main.append(main[-1] + (n if depth else 0))
        at = m.end()
        if i in ends:
            depth -= 1
        elif names[i][0] in MAIN_TAGS and closes[i] and not _words(attrs[i]) & BOILERPLATE_WORDS:
            depth += 1
            ends.add(closes[i])
    text = total[-1] + len("".join(page[at:].split()))

    def holds(i: int, comments: bool) -> bool:
        a, b = i + 1, closes[i] + 1
        if comments:
            return main[b] - main[a] == main[-1] > 0
        return 2 * (total[b] - total[a]) >= text > 0 or 2 * (main[b] - main[a]) >= main[-1] > 0

    return holds


class Line(NamedTuple):
    text: str
    #: Number of the article or main element it is in, 0 for none.
    main: int
    #: Below zero in a container that is boilerplate.
    weight: int
    #: A few words without an end mark, in no heading.
    label: bool
    title: bool
    #: The containers it is in, from the outermost.
    path: tuple[int, ...] = ()
    #: Part of what is about the site, behind which no text is resumed.
    site: bool = False


GAP = Line("", 0, 0, False, False)
#: Containers of the path. A section is part of what it is in.
BOXES = frozenset("article aside center details div dl fieldset figure form footer header main menu nav table".split())


def to_lines(page: str, by_name: bool = True) -> list[Line]:
    """The page's lines; those without text stand for gaps."""
    lines: list[Line] = []
    piece: list[str] = []
    linked: list[str] = []
    skip: list = []  # the open element without text of the article: tag, depth
    low: list[list] = []  # the open boilerplate containers: tag, depth, whether they are about the site
    path: list[tuple[str, int]] = []
    mains: list[str] = []
    number = seen = links = 0
    heading = ""

    def end() -> None:
        if piece:
            text = _plain(piece)
            if text:
                weight = 0 if _NOTICE.match(text) else max(len(text) - len(_plain(linked)), 0)
                if low:
                    weight = -len(text)
                lines.append(Line(text, number if mains else 0, weight, not heading and bool(_LABEL.fullmatch(text)), heading == "h1", tuple(i for _, i in path), any(x[2] for x in low)))
            piece.clear()
            linked.clear()

    def add(text: str) -> None:
        piece.append(text)
        if links:
            linked.append(text)

    def leave(name: str) -> None:
        if name in BOXES and any(t == name for t, _ in path):
            while path.pop()[0] != name:
                pass

    at = 0
    tokens = list(_TOKEN.finditer(page))
    names = [((m[3] or m[6] or "").lower(), (m[2] if m[3] else m[5]) == "/") for m in tokens]
    closes = _closes(names)
    groups = _groups(names, closes)
    attrs = [m[4] or m[7] or "" for m in tokens]
    holds = None
    for i, (m, (name, close)) in enumerate(zip(tokens, names)):
        if not skip and m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not name:
            continue
        if skip:
            if name == skip[0]:
                skip[1] += -1 if close else 1
                if not skip[1]:
                    skip = []
            continue
        if name == "br":
            add(" ")
            continue
        if name in _EMPTY and name != "hr":
            continue
        if name in BLOCKS:
            end()
            links, heading = 0, ""
        elif name == "a":
            links = 0 if close else closes[i]
        if low and name == low[-1][0]:
            low[-1][1] += -1 if close else 1
            if not low[-1][1]:
                if low.pop()[2]:
                    lines += [GAP] * WINDOW
                leave(name)
                continue
        if close:
            leave(name)
            if name in MAIN_TAGS and name in mains and not low:
                while mains.pop() != name:
                    pass
            if i in groups and not low:
                lines += [GAP] * WINDOW
            continue
        named = not low and _boilerplate(name, attrs[i], bool(mains), by_name)
        if named:
            gone = bool(closes[i])
            words = _words(attrs[i])
            comments = bool(words & COMMENT_WORDS)
            if gone and (name in WRAPPERS or name in CONTAINERS) and not (comments and mains):
                holds = holds or _holding(page, tokens, names, closes, attrs)
                gone = not holds(i, comments and name != "article")
            if gone and (name in INLINE_SKIPS or name in ("head", "title")):
                skip = [name, 1]
                if name in SITE_TAGS:
                    lines += [GAP] * WINDOW
                continue
            if gone:
                end()
                low.append([name, 1, name in SITE_TAGS or bool(words & SITE_WORDS)])
        elif low and name in INLINE_SKIPS and closes[i]:
            skip = [name, 1]
            continue
        if name in BOXES and closes[i]:
            path.append((name, i))
        if low or named:
            if not low and i in groups:
                lines += [GAP] * WINDOW
            if low or name not in MAIN_TAGS:
                continue
        if i in groups and lines[-WINDOW:] != [GAP] * WINDOW or name == "h1":
            lines += [GAP] * WINDOW
        if name in HEADINGS:
            heading = name
        if name in MAIN_TAGS:
            if not mains:
                seen += 1
                number = seen
            mains.append(name)
    if not skip and at < len(page):
        add(page[at:])
    end()
    return lines


def _plain(pieces: list[str]) -> str:
    return _SPACES.sub(" ", html.unescape("".join(pieces))).strip()


def _groups(names: list[tuple[str, bool]], closes: list[int]) -> set[int]:
    """The tags that open or close a grouping element with a block element in it."""
    after, out = len(names), set()
    for i in range(len(names) - 1, -1, -1):
        name, close = names[i]
        if close or name not in BLOCKS:
            continue
        if name in GROUPS and after < closes[i]:
            out |= {i, closes[i]}
        after = i
    return out


def _closes(names: list[tuple[str, bool]]) -> list[int]:
    """For every tag that opens an element, the tag that closes it; 0 for none."""
    open_at: dict[str, list[int]] = {}
    out = [0] * len(names)
    for i, (name, close) in enumerate(names):
        if not close:
            open_at.setdefault(name, []).append(i)
        elif open_at.get(name):
            out[open_at[name].pop()] = i
    return out


def blocks(lines: list[Line]) -> list[int]:
    """Weight of the block of WINDOW lines that begins at each line. Labels under each other, as menus have, weigh nothing before the first long line."""
    n = [x.weight for x in lines]
    for i, x in enumerate(lines):
        if x.weight >= SURGE:
            break
        if x.label and any(0 <= j < len(lines) and lines[j].label for j in (i - 1, i + 1)):
            n[i] = 0
    if not any(n):
        n = [len(x.text) for x in lines]
    return n


def span(lines: list[Line]) -> tuple[int, int]:
    """The lines from the first surge to the last dive, as (first, behind the last); (0, 0) if there is no text."""
    n = blocks(lines)
    sums = [sum(n[i : i + WINDOW]) for i in range(len(n))]
    full = [x for x in sums if x]
    if not full:
        return 0, 0
    threshold = min(SURGE, sum(full) / len(full))
    first = next(i for i, x in enumerate(sums) if x >= threshold and n[i])
    at = first
    while at and lines[at - 1].text:
        at -= 1
        if lines[at].title:
            first = at
    last = next(i for i in range(len(n) - 1, -1, -1) if n[i] and sum(n[max(0, i - WINDOW + 1) : i + 1]) >= threshold)
    at = last
    while at + 1 < len(n) and sums[at + 1]:  # until a block without text
        at += 1
        if n[at]:
            last = at
    return first, last + 1


def _surging(lines: list[Line]) -> list[int]:
    """Weight of each line that lies in a block that reaches the threshold, else 0."""
    n = blocks(lines)
    sums = [sum(n[i : i + WINDOW]) for i in range(len(n))]
    full = [x for x in sums if x]
    threshold = min(SURGE, sum(full) / len(full)) if full else 0
    return [x if x and max(sums[max(0, i - WINDOW + 1) : i + 1]) >= threshold else 0 for i, x in enumerate(n)]


def body(every: list[Line]) -> list[int]:
    """Numbers of the lines that are text."""
    at = [i for i, x in enumerate(every) if x.weight >= 0]
    lines = [every[i] for i in at]
    first, stop = span(lines)
    if first == stop:
        return []
    surging = _surging(lines)
    # Article and main elements by the container they are in.
    parents: dict[int, tuple[int, ...]] = {}
    for x in lines:
        if x.main and x.text:
            parents[x.main] = min(parents.get(x.main, x.path), x.path, key=len)
    group = {m: p[:-1] for m, p in parents.items()}
    weight: dict[tuple[int, ...], int] = {}
    for x, n in zip(lines, surging):
        if x.main in group:
            weight[group[x.main]] = weight.get(group[x.main], 0) + n
    total = sum(surging)
    if weight:
        best = max(weight, key=lambda p: weight[p])
        if 2 * weight[best] >= total:
            return [i for i, x in zip(at, lines) if x.text and x.main and group[x.main] == best]
    home: tuple[int, ...] = ()
    while True:
        inner: dict[tuple[int, ...], int] = {}
        for x, n in zip(lines, surging):
            if n and len(x.path) > len(home) and x.path[: len(home)] == home:
                inner[x.path[: len(home) + 1]] = inner.get(x.path[: len(home) + 1], 0) + n
        most = max(inner, key=lambda p: inner[p], default=None)
        if most is None or 2 * inner[most] <= total:
            break
        home = most
    inside = [x.path[: len(home)] == home and not (x.main and home == ()) for x in lines]
    sentence = [x.weight > 0 and not x.label and not x.title for x in lines]
    site = [i for i, x in enumerate(every) if x.site]
    after = min((i for i in site if i > at[stop - 1]), default=len(every))
    before = max((i for i in site if i < at[first]), default=-1)
    above = [j for j in range(first) if inside[j] and at[j] > before]
    titles = [j for j in above if lines[j].title]
    start = min(titles or [j for j in above if sentence[j]], default=first)
    end = max((j for j in range(stop, len(lines)) if inside[j] and sentence[j] and at[j] < after), default=stop - 1) + 1
    kept = [j for j in range(start, end) if inside[j] or first <= j < stop]
    # Articles that lost, outside of the home.
    return [at[j] for j in kept if lines[j].text and (not lines[j].main or home and lines[j].path[: len(home)] == home)]


def extract(page: str | None) -> str:
    if not page:
        return ""
    lines = to_lines(page)
    if not any(x.text and x.weight >= 0 for x in lines):
        lines = to_lines(page, False)
    return "\n\n".join(lines[i].text for i in body(lines) if lines[i].text)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column("html").to_pylist()
        for a in range(0, len(pages), 500):
            texts = [extract(p) for p in pages[a : a + 500]]
            part = batch.slice(a, len(texts))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(_run, f"{kinds}, text string")
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(common.table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_extract": op10_html_extract}
ORACLES = {}
