"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. Marks only weigh a line; the text's length is its weight but for
three rules. Lines in places beside the text (navigation, page headers and footers, asides, forms, elements whose class or id
names such a place) weigh an eighth of their length, or of the threshold if they are longer. Lines whose marks say that they are
no text wherever they stand (adverts, notices, comments, controls, what is hidden and the like) weigh nothing, and neither do
lines that are mostly links. If article and main hold at least half of the text in the windows above the threshold (or in the
fullest one if none is), a line in them weighs at least the threshold, links or not, and lines outside nothing; else these marks
say nothing (teaser cards beside a body, say).

Weights are summed over sliding windows of the lines that weigh something, apart for the lines outside such places and for those
of each place, so boilerplate takes up no place between the text and its edges. Outside, the text begins at the first surge (a
window above the threshold, or the fullest one) and runs to the dive to no weight, the last such line: a short ending is never
cut. A place is dropped because no window of it surges. In a place that holds a headline, an article or main it would, with lines
of the threshold's length throughout a window and no window outside that weighs more; then the mark is wrong (a form or a layout's
element around the whole page), and the page is read again without it. Without one it would have to reach the whole threshold,
which takes windows of eight lines: a page that has nothing but a sidebar, say, has no text.

A null page gives the empty text. Text has its character references decoded and white space turned into single blanks. Repeated
rows each get their text, an empty table gives no rows, further columns are left out. A long page is taken whole, in time
linear in its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Set
from itertools import count

#: Elements that never hold text of the article.
DROPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video map nav footer aside form button select textarea input label option datalist dialog menu head title".split())
#: Elements whose text isn't markup: it ends at their own end tag only.
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
#: Elements, and names as parts of class and id, of places beside the article; layouts put such marks around whole pages as well.
PLACES = frozenset("nav footer aside form menu header".split())
PLACE_NAMES = frozenset("banner sidebar menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead popup modal overlay pagination pager footer header widget widgets skip tags toc".split())
#: Names, as parts of class and id, of what is not the article.
NAMES = PLACE_NAMES | frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts "
    "comment comments disqus respond reply replies discussion "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login copyright".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar tooltip".split())
WHOLE = frozenset("html body article main".split())

# A tag's attributes: a quoted value comes after an equals sign and ends before white space or the tag's end (else the quote is a
# character like others). No part can be matched in two ways, so that time is linear in the page.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:(?:\"[^\"]*+\"|'[^']*+')(?=[\s/>]|\Z))?+)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
#: Elements that an opening tag ends if they are open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

WINDOW, SURGE, LINKED = 3, 80, 0.6
#: How many times lighter a line in a place beside the text is.
LIGHTER = 8
#: What marks say of an element: nothing, that it is a place beside the text, that it is no text.
NONE, PLACE, NEVER = 0, 1, 2


class Line:
    __slots__ = ("boiler", "inside", "links", "marks", "text")

    def __init__(self, text: str, links: int, boiler: bool, inside: bool, marks: Marks | None) -> None:
        self.text, self.links, self.boiler, self.inside, self.marks = text, links, boiler, inside, marks


class Marks:
    """A marked element around a line: where it begins, the next marked one around it and the outermost one, whether it or one around it is no text anywhere, whether it holds a headline."""

    __slots__ = ("at", "headed", "never", "outer", "outermost")

    def __init__(self, at: int, outer: Marks | None, never: bool) -> None:
        self.at, self.outer, self.headed = at, outer, False
        self.outermost: Marks = outer.outermost if outer else self
        self.never = never or outer is not None and outer.never

    def around(self) -> Iterator[Marks]:
        m: Marks | None = self
        while m:
            yield m
            m = m.outer


def named(attributes: str) -> int:
    """Whether class, id or role says that an element is none of the article, and of which kind it is then."""
    if "class" not in attributes and "id" not in attributes and "role" not in attributes and "hidden" not in attributes:
        return NONE
    kind = NONE
    for name, *values in _ATTR.findall(attributes):
        value = next(filter(None, values), "")
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return NEVER
        if name in ("class", "id"):
            parts = [p.lower() for p in _PART.findall(value)]
            found = [p for before, p in zip(["", *parts], parts, strict=False) if p in NAMES and before not in ("has", "with", "no")]
            if found:
                kind = max(kind, PLACE if PLACE_NAMES.issuperset(found) else NEVER)
    return kind


def lines(page: str, ignored: Set[int] = frozenset()) -> list[Line]:
    """The page's blocks in order, each with the length of its links, whether it is boilerplate and by which marks, and whether an article holds it.

    Marks of the elements that begin at ``ignored`` don't count.
    """
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, bool, Marks | None, int]] = []  # name; then, before it: in boilerplate, in an article, in a link, marks, open elements that are dropped
    open_: Counter[str] = Counter()  # of the stack's names
    boiler = inside = linked = False
    marks: Marks | None = None
    drops = 0
    links = at = 0

    def text(raw: str) -> None:
        nonlocal links
        if raw and not (boiler and not out and not parts and not raw.strip()):
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if linked:
                links += len(raw.strip())

    def flush() -> None:
        nonlocal links
        if parts:
            whole = _SPACE.sub(" ", "".join(parts)).strip()
            if whole:
                out.append(Line(whole, links, boiler, inside, marks))
            parts.clear()
        links = 0

    def leave(k: int) -> None:
        nonlocal boiler, inside, linked, marks, drops
        if any(x[0] in BLOCK for x in stack[k:]) or stack[k][1] != boiler:
            flush()
        _, boiler, inside, linked, marks, drops = stack[k]
        open_.subtract(x[0] for x in stack[k:])
        del stack[k:]

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if open_[name]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            elif name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            flush()
            while stack and stack[-1][0] == "p":
                leave(len(stack) - 1)
        elif name in ("br", "td", "th"):
            parts.append(" ")
        if name in ENDS and any(open_[x] for x in ENDS[name]):
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ENDS[name] or stack[k][0] in ("ul", "ol", "dl", "table")), -1)
            if k >= 0 and stack[k][0] in ENDS[name]:
                leave(k)
        if name in VOID or m[3].endswith("/") and name in ("svg", "path", "iframe"):
            continue
        kind = NONE
        if m.start() not in ignored and name not in ("html", "body", "main"):
            kind = named(m[3])
            if name in DROPPED or name == "header" and not inside:
                kind = max(kind, PLACE if name in PLACES else NEVER)
            elif inside and name in ("header", "h1", "h2", "h3", "h4", "h5", "h6"):
                kind = NONE
        off = drops > 0 if name == "main" else boiler or kind != NONE
        if name in ("h1", "article", "main"):
            for x in marks.around() if marks else ():
                if x.headed:
                    break
                x.headed = True
        if off != boiler:
            flush()
        stack.append((name, boiler, inside, linked, marks, drops))
        open_[name] += 1
        if not off:
            marks = None
        elif kind:
            marks = Marks(m.start(), marks, kind == NEVER)
        drops += name in DROPPED and m.start() not in ignored
        boiler, inside, linked = off, inside or name in ("article", "main") and not off, linked or name == "a"
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])|\\Z", re.I).search(page, at)
            at = end.start()  # type: ignore[union-attr]
    flush()
    return out


def window_sums(weight: list[float], window: int) -> list[float]:
    return [sum(weight[i : i + window]) for i in range(len(weight))]


def article_is_bulk(found: list[Line], window: int, surge: int) -> bool:
    """Whether article and main hold at least half of the text in the windows above the threshold (or the fullest one)."""
    sums = window_sums([len(x.text) for x in found], window)
    least = min(surge, max(sums, default=0))
    full = {k for i, s in enumerate(sums) if s >= least for k in range(i, min(i + window, len(found)))}
    return any(x.inside for x in found) and sum(len(found[k].text) * (1 if found[k].inside else -1) for k in full) >= 0


def weights(found: list[Line], window: int, surge: int, linked: float) -> list[float]:
    """What each line weighs in the windows."""
    own = [x.links <= linked * len(x.text) for x in found]
    light = [min(len(x.text), surge) / LIGHTER if x.boiler and t and not (x.marks and x.marks.never) else 0 for x, t in zip(found, own, strict=True)]
    if article_is_bulk([x for x, t in zip(found, own, strict=True) if not x.boiler and (t or x.inside)], window, surge):
        return [w if x.boiler else max(len(x.text), surge) if x.inside else 0 for x, w in zip(found, light, strict=True)]
    return [w if x.boiler else len(x.text) if t else 0 for x, t, w in zip(found, own, light, strict=True)]


def surges(found: list[Line], window: int, surge: int, linked: float) -> tuple[list[Line], list[Line]]:
    """The lines of the text outside of places, from the first surge on; and a surge (a window's lines) in the heaviest place with one."""
    groups: dict[Marks | None, list[tuple[Line, float]]] = {None: []}
    for x, w in zip(found, weights(found, window, surge, linked), strict=True):
        if w:
            groups.setdefault(x.marks.outermost if x.marks else None, []).append((x, w))
    fullest = max(window_sums([w for _, w in groups[None]], window), default=0)
    kept: dict[Marks | None, list[Line]] = {}
    for place, own in groups.items():
        least = min(surge, fullest) if place is None else max(window * surge / LIGHTER if place.headed else surge, fullest)
        first = next((i for i, s in enumerate(window_sums([w for _, w in own], window)) if s >= least), None)
        if first is not None:
            kept[place] = [x for x, _ in own[first:]]
    text = kept.pop(None, [])
    heaviest = max(kept, key=lambda place: sum(w for _, w in groups[place]), default=None)
    return text, kept[heaviest][:window] if heaviest else []


def extract(page: str | None, *, window: int = WINDOW, surge: int = SURGE, linked: float = LINKED) -> str:
    """The main text: blocks in page order, two line ends between them."""
    wrong: set[int] = set()
    for times in count():
        text, place = surges(lines(page or "", wrong), window, surge, linked)
        if not place:
            break
        # The outermost mark; from the fifth time on the outermost 8, 64 and so on, so that any depth takes few readings.
        wrong.update(m.at for x in place if x.marks for m in [*x.marks.around()][-(8 ** max(0, times - 3)) :])
    return "\n\n".join(x.text for x in text)


def main_text(pages, *, window: int = WINDOW, surge: int = SURGE):  # type: ignore[no-untyped-def]
    """For every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    from papyra.llm.common import map_rows

    def make():  # type: ignore[no-untyped-def]
        def one(page_id, url, page):  # type: ignore[no-untyped-def]
            text = extract(page, window=window, surge=surge)
            return [(page_id, url, text, len(text))]

        return one

    return map_rows(pages.selectExpr("cast(page_id as bigint)", "cast(url as string)", "cast(html as string)"), make, "page_id bigint, url string, text string, n_chars bigint")
