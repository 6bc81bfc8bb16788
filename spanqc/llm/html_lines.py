"""A page as lines of text, each with the part of the page it stands in."""

from __future__ import annotations

import html
import re

#: Parts of a page: unmarked, the main element, an article, and what no article is made of.
PLAIN, MAIN, ARTICLE, OTHER = 0, 1, 2, 3

# Fixed names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe math noembed noframes noscript object script style svg template textarea title xmp".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: An element that begins ends an open one of these, if no element of the second kind stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements that are no part of an article wherever they stand; a header is part of the article that it stands in.
OUTSIDE = set("aside button dialog footer form head menu nav search select".split())
#: Words of classes, ids and roles that say the same: menus, headers, footers, sidebars, notices, adverts, forms, comments of readers.
NAMES = set(
    "ad ads adsbygoogle advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "dialog disqus footer form gdpr menu menubar modal nav navbar navigation newsletter notice notices popup promo promoted respond search searchbox sidebar sponsor sponsored subscribe toolbar".split()
)
#: The same, but for an article's own header.
HEADERS = {"header", "masthead"}
#: Words of a name that turn it round: a page with a sidebar isn't one.
WITH = {"with", "has", "no", "without", "js"}

TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"<]*"|'[^'<]*')*+|[^>]*)>""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
CLOSES = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}


def names_of(attributes: str, whole: bool) -> set[str]:
    """First and last words of the hyphenated names in class, id and role; with ``whole`` only of names of one word."""
    found: set[str] = set()
    for _, value in ATTRIBUTE.findall(attributes):
        for name in html.unescape(value.strip("\"'")).lower().split():
            words = [w for w in re.split(r"[-_]+", name) if w]
            if words and WITH.isdisjoint(words) and not (whole and words[1:]):
                found |= {words[0], words[-1]}
    return found


def part_of(name: str, attributes: str, within: int) -> int:
    """The part that an element's text belongs to."""
    if within == OTHER or name in OUTSIDE or name == "header" and within != ARTICLE:
        return OTHER
    if attributes and name not in ("html", "body"):
        names = names_of(attributes, whole=name in ("article", "main"))
        if names & NAMES or names & HEADERS and within != ARTICLE:
            return OTHER
        if name == "main" or "main" in names and re.search(r"""role\s*=\s*["']?main""", attributes, re.IGNORECASE):
            return max(within, MAIN)
    return ARTICLE if name == "article" else max(within, MAIN) if name == "main" else within


def lines_of(page: str) -> list[tuple[int, str]]:
    """The lines of a page in order: part and text, with references decoded and white space as one blank.

    Lines end where elements of blocks begin or end, and at breaks. What scripts, styles and comments of the markup hold is no text. An
    element that isn't closed ends with the one around it; what isn't a tag is text.
    """
    lines: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    text: list[str] = []  # of the line
    waste: list[str] = []  # that stands within the line, but in another part
    here, part = PLAIN, PLAIN

    def flush() -> None:
        for held, of in ((text, part), (waste, OTHER)):
            if held:
                line = " ".join(html.unescape("".join(held)).split())
                if line:
                    lines.append((of, line))
                held.clear()

    def say(piece: str) -> None:
        nonlocal part
        if here == OTHER:
            waste.append(piece)
        else:
            if not text:
                part = here
            text.append(piece)

    def pop_to(names: set[str], barrier: set[str]) -> None:
        if not any(count.get(n) for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                for name, _ in stack[k:]:
                    count[name] -= 1
                del stack[k:]
                return
            if stack[k][0] in barrier:
                return

    at = 0
    while tag := TAG.search(page, at):
        if tag.start() > at:
            say(page[at : tag.start()])
        at = tag.end()
        if not (name := (tag["name"] or "").lower()):
            continue
        if name in BLOCK:
            flush()
        if tag["end"]:
            pop_to({name}, set() if name in BLOCK and name != "p" else BLOCK - {name})
        elif name in RAW:
            if not tag["rest"].endswith("/") or name not in ("svg", "math"):
                close = CLOSES[name].search(page, at)
                at = close.end() if close else len(page)
        elif name not in VOID:
            if name in BLOCK:
                pop_to({"p"}, BLOCK - {"p"})
            if name in ENDS:
                pop_to(*ENDS[name])
            within = stack[-1][1] if stack else PLAIN
            stack.append((name, part_of(name, tag["rest"], within)))
            count[name] = count.get(name, 0) + 1
        here = stack[-1][1] if stack else PLAIN
    if at < len(page):
        say(page[at:])
    flush()
    return lines


def chosen(lines: list[tuple[int, str]]) -> int:
    """The part that is a page's main text: its articles, else its main element, else what isn't marked."""
    parts = {part for part, _ in lines}
    return ARTICLE if ARTICLE in parts else MAIN if MAIN in parts else PLAIN


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of both.

    A row of the table of lengths is one integer, a bit for each line of ``a``. Rows are kept at distances of the square root of their
    number, and those between worked out again on the way back.
    """
    both = set(a) & set(b)
    places = [k for k, x in enumerate(a) if x in both]
    b = [x for x in b if x in both]
    n = len(places)
    if not n:
        return []
    bits: dict[int, int] = {}
    for k, place in enumerate(places):
        bits[a[place]] = bits.get(a[place], 0) | 1 << k
    full = (1 << n) - 1

    def row(v: int, x: int) -> int:
        u = v & bits[x]
        return (v + u | v - u) & full

    step = max(1, int(len(b) ** 0.5))
    v, marks = full, []
    for k, x in enumerate(b):
        if k % step == 0:
            marks.append(v)
        v = row(v, x)
    found: list[int] = []
    i, j = n, len(b)
    for block in range(len(marks) - 1, -1, -1):
        rows = [marks[block]]
        for x in b[block * step : j]:
            rows.append(row(rows[-1], x))
        while j > block * step and i:
            now, before = rows[j - block * step], rows[j - block * step - 1]
            if now >> (i - 1) & 1:
                i -= 1
            elif not before >> (i - 1) & 1:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append(places[i])
    return found[::-1]
