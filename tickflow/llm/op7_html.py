"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block element; the text of menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles is left out.  Menus, headers, footers and sidebars
leave blank lines, and so does all that is left out directly in the body; the rest, such as an advert in the text, leaves
none.  The distribution is the text length (links not counted) summed over windows of ``WINDOW`` lines.  The text starts where the
sum surges over a threshold and ends where it dives to nothing; lines that adjoin it without a
blank line belong to it, and so do all lines of the ``article`` or ``main`` element it lies in: of several, such as
teasers beside the article, those that hold a surge.  On a
page without these, all lines of a container (``div``, ``section``, a table's cell) belong to it that
holds a surge's worth of the text in lines of its own, whatever was left out between them; of the body,
the lines of its own.

What is left out, besides the elements that say so themselves (``nav``, ``footer``, ``aside``, ``form`` ...): an element
whose class, id or role names a part that isn't the article.  A name counts as a whole, or if all its parts are such words
or say nothing (``site-footer``, ``commentList``); ``has-sidebar`` or ``search-engines`` are no such names.  Words that an
article may use itself (``WEAK``) need more: links for most of their text, or for a class little text.  Whatever its name,
an element that holds an article or main element is kept, and so is one that holds over half of the page's text, unless its
name leaves no doubt.  Headings are never left out for an id, which is an anchor.

Defined cases: null or empty html, and pages without text, give the empty text; an element left
out that is never closed hides nothing (script and style hide the rest, as in browsers); repeated rows and
null ids pass through; an empty table gives no rows.  Time is linear in the page, whatever its markup.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickflow.llm.common import map_rows, table

WINDOW = 3
#: Containers within containers, and articles, that are told apart; deeper ones are taken for their parent.
DEEPEST = 100
#: A surge is this many characters in a window, or the page's highest sum if that is less.
SURGE = 80
#: An element of a weak name is left out if links are this share of its text, or, for a class, if it has less text.
LINKS, LITTLE = 0.5, 200

#: HTML's elements by their part in a page.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p "
    "pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template iframe svg math object canvas noframes".split())
LEFT_OUT = RAW | frozenset(
    "head nav header footer aside form menu button select textarea dialog input label".split()
)
MAIN = ("article", "main")
#: What parts a page, rather than stand in its text.
PARTING = frozenset("head nav header footer aside menu".split())
CONTAINERS = frozenset("blockquote center details div fieldset figure section td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements left out by what they are that may as well hold the page's text.
HOLDING = frozenset("header footer form label menu dialog".split())
#: Words of class, id and role names that mark what isn't the article.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo cookie cookies consent gdpr "
    "newsletter comment comments disqus respond sidebar footer nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager popup modal masthead share sharing contentinfo complementary".split()
)
WEAK = frozenset(
    "aside widget widgets menu menus header notice notices notification alert overlay banner "
    "subscribe subscription signup login discussion replies reply sponsor promotion toolbar social related "
    "recommended search form skip copyright legal disclaimer".split()
)
#: Words that say nothing about a part of a page.
NEUTRAL = frozenset(
    "site page global main top bottom left right upper lower primary secondary inner outer wrap wrapper container box block "
    "area section panel bar list items item links link buttons button icons text content body title posts post thread "
    "stories news user reader readers js side".split()
)
#: Elements whose content is text without tags, with their end tags.
PLAIN = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "title")}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_OPENING = re.compile(r"<(?:(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|[!?]|(?P<close>/?)(?P<name>[a-zA-Z][^\s/><]*))")
#: The rest of a tag: quoted values hold anything; without a fitting end, up to the next ``>`` before a ``<``.
_REST = re.compile(r"[^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*>|[^<>]*>")
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)


class Token(NamedTuple):
    """A tag, or a comment or the like (without a name); ``text`` is a CDATA section's."""

    start: int
    end: int
    name: str = ""
    close: bool = False
    attrs: str = ""
    text: str = ""

    @property
    def opens(self) -> bool:
        return bool(self.name) and not self.close and self.name not in _VOID and not self.attrs.endswith("/")


def tokens_of(page: str) -> list[Token]:
    """The page's tokens; what stands in an element of ``PLAIN`` is text up to its own end tag, whatever
    it looks like.  A script or style that is never closed is the last token.  What isn't found once, such as the end of
    a CDATA section, isn't looked for again."""
    out: list[Token] = []
    missing: set[str] = set()
    at = 0

    def find(end: str, begin: int) -> int:
        if end in missing:
            return -1
        found = page.find(end, begin)
        if found < 0:
            missing.add(end)
        return found

    while m := _OPENING.search(page, at):
        start, after = m.span()
        if m["comment"]:
            end = find("-->", after)
            at = end + 3 if end >= 0 else len(page)
            out.append(Token(start, at))
        elif m["cdata"] and (end := find("]]>", after)) >= 0:
            at = end + 3
            out.append(Token(start, at, text=page[after:end]))
        elif not m["name"]:
            end = find(">", after)
            at = end + 1 if end >= 0 else len(page)
            out.append(Token(start, at))
        elif rest := _REST.match(page, after):
            at = rest.end()
            name, close = m["name"].lower(), bool(m["close"])
            out.append(Token(start, at, name, close, page[after : at - 1]))
            if name in PLAIN and out[-1].opens and name not in missing:
                if end_tag := PLAIN[name].search(page, at):
                    at = end_tag.start()
                elif name in ("script", "style"):
                    return out
                else:
                    missing.add(name)
        else:
            at = after
    return out


def _value(attrs: dict[str, str], name: str) -> str:
    return attrs.get(name, "")


def attributes(attrs: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(attrs):
        out.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return out


def strength(name: str) -> int:
    """2 for a name that leaves no doubt, 1 for one that an article may use, 0 for any other."""
    if name.lower() in STRONG:
        return 2
    if name.lower() in WEAK:
        return 1
    words = [w.lower() for w in _WORD.findall(name)]
    if not all(w in STRONG or w in WEAK or w in NEUTRAL or w.isdigit() for w in words):
        return 0
    return max((2 if w in STRONG else 1 if w in WEAK and w not in NEUTRAL else 0 for w in words), default=0)


class Page:
    """A page's tokens, the end of each element, and how much text, link text and how many main elements stand before
    each token."""

    def __init__(self, page: str):
        self.page = page
        self.tokens = tokens = tokens_of(page)
        self.end: dict[int, int] = {}
        opened: dict[str, list[int]] = {}
        lengths, linked, mains = [], [], []
        at, raw_until, links = 0, -1, False
        for i, t in enumerate(tokens):
            n = 0 if raw_until == i else len(page[at : t.start].strip())
            lengths.append(n)
            linked.append(n if links else 0)
            mains.append(t.name in MAIN and t.opens)
            at, raw_until = t.end, -1
            if t.name == "a":
                links = not t.close
            if t.name in ("script", "style") and t.opens:
                raw_until = i + 1
            if t.opens:
                opened.setdefault(t.name, []).append(i)
            elif t.close and opened.get(t.name):
                self.end[opened[t.name].pop()] = i
        tail = 0 if raw_until == len(tokens) else len(page[at:].strip())
        self.before = list(accumulate(lengths))
        self.linked = list(accumulate(linked))
        self.mains = [0, *accumulate(mains)]
        self.total = (self.before[-1] if tokens else 0) + tail

    def left_out(self, i: int, in_main: bool) -> bool:
        """Whether the element that token ``i`` opens is left out; only asked of elements that are closed."""
        t, end = self.tokens[i], self.end[i]
        if t.name in RAW or t.name in ("head", "select", "textarea", "button"):
            return True
        if t.name in ("html", "body") or self.mains[end] > self.mains[i + 1]:
            return False
        text = self.before[end] - self.before[i]
        large = 2 * text > self.total
        if t.name in LEFT_OUT and not (in_main and t.name in ("header", "label")):
            if not (large and t.name in HOLDING):
                return True
        if "=" not in t.attrs and "hidden" not in t.attrs:
            return False
        attrs = attributes(t.attrs)
        hidden = (
            "hidden" in attrs or _value(attrs, "aria-hidden").lower() == "true" or _NO_DISPLAY.search(_value(attrs, "style"))
        )
        if hidden and not large:
            return True
        classes = [*_value(attrs, "class").split(), *_value(attrs, "role").split()]
        by_class = max(map(strength, classes), default=0)
        by_id = 0 if t.name in HEADINGS else max(map(strength, _value(attrs, "id").split()), default=0)
        if t.name in MAIN and self.mains[-1] == 1 and large:
            return False  # the page's article, whatever its name
        if max(by_class, by_id) == 2:
            return True
        if not max(by_class, by_id) or large:
            return False
        links = self.linked[end] - self.linked[i]
        return links >= LINKS * max(text, 1) or (bool(by_class) and t.name not in HEADINGS and text < LITTLE)


def lines(page: str) -> list[tuple[str, int, tuple[int, ...], tuple[int, ...]]]:
    """(text, length outside links, numbers of the article and main elements from the outermost, and so of
    the containers) of every block; what parts the page gives blank lines."""
    out: list[tuple[str, int, tuple[int, ...], tuple[int, ...]]] = []
    held: list[str] = []
    outside = links = 0
    inside: tuple[int, ...] = ()
    within: list[tuple[str, int]] = []
    path: tuple[int, ...] = ()
    places: dict[str, list[int]] = {}
    counted = 0
    whole = Page(page)
    tokens = whole.tokens

    def flush():
        nonlocal outside
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append((text, min(outside, len(text)), inside, path))
        held.clear()
        outside = 0

    def take(piece):
        nonlocal outside
        held.append(piece)
        if not links:
            outside += len(piece.strip())

    at = i = 0
    while i < len(tokens):
        t = tokens[i]
        take(page[at : t.start])
        at = t.end
        name, opens = t.name, not t.close
        if t.text:
            take(entities.unescape(t.text))
        if not name:
            i += 1
            continue
        if name in ("script", "style") and t.opens and i not in whole.end:
            flush()
            return out  # never closed: hides the rest
        if t.opens and i in whole.end and whole.left_out(i, bool(inside)):
            flush()
            if name in PARTING or not within:
                out.extend([("", 0, (), ())] * WINDOW)
            at = tokens[whole.end[i]].end
            i = whole.end[i] + 1
            continue
        if name == "a":
            links = 1 if opens else 0
        elif name in BLOCKS:
            flush()
            links = 0
            if name in MAIN:
                if opens and len(inside) < DEEPEST:
                    counted += 1
                    inside = (*inside, counted)
                elif not opens:
                    inside = inside[:-1]
            elif name in CONTAINERS:
                if opens and len(within) < DEEPEST:
                    counted += 1
                    places.setdefault(name, []).append(len(within))
                    within.append((name, counted))
                    path = (*path, counted)
                elif not opens and places.get(name):
                    last = places[name].pop()
                    del within[last:]
                    path = path[:last]
                    for open_places in places.values():
                        del open_places[bisect_left(open_places, last) :]
        elif name in ("br", "wbr", "img"):
            held.append(" " if name == "br" else "")
        i += 1
    take(page[at:])
    flush()
    return out


def main_text(page: str | None) -> str:
    found = lines(page or "")
    weights = [w for _, w, *_ in found]
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(found))]
    if not sums or not max(sums):
        weights = [len(t) for t, *_ in found]  # nothing but links
        sums = [sum(weights[i : i + WINDOW]) for i in range(len(found))]
        if not sums or not max(sums):
            return ""
    surge = min(SURGE, max(sums))
    kept = [False] * len(found)
    i = 0
    while i < len(found):
        if sums[i] < surge:
            i += 1
            continue
        end = i
        while end < len(found) and sums[end]:
            kept[end] = True
            end += 1
        while i and found[i - 1][0] and not kept[i - 1]:  # adjoining lines before the surge
            i -= 1
            kept[i] = True
        i = end
        while i < len(found) and found[i][0]:  # links that end the text
            kept[i] = True
            i += 1
    mains = {m for (_, _, m, _), k in zip(found, kept, strict=True) if k and m}
    if mains:
        surges: Counter[tuple[int, ...]] = Counter()
        for (_, _, m, _), weight, k in zip(found, weights, kept, strict=True):
            if k and m:
                surges[m] += weight
        chosen = {m for m, n in surges.items() if n >= surge} or mains
        around = {m[:n] for m in chosen for n in range(1, len(m))}
        belongs = {m for m in mains if m in around or any(m[:n] in chosen for n in range(1, len(m) + 1))}
        return "\n".join(t for t, _, m, _ in found if t and m in belongs)
    own: Counter[int] = Counter()
    for (_, _, _, path), weight, k in zip(found, weights, kept, strict=True):
        if k:
            own[path[-1] if path else 0] += weight
    holds = {c for c, n in own.items() if n >= surge}
    return "\n".join(
        t for (t, _, _, path), k in zip(found, kept, strict=True)
        if t and (k or (not holds.isdisjoint(path) if path else 0 in holds))
    )


def extract(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row."""

    def run(rows):
        for page_id, url, page in rows:
            text = main_text(page)
            yield page_id, url, text, len(text)

    picked = df.select(
        df[id_col].cast("long").alias("page_id"),
        df[url_col].alias("url"),
        F.coalesce(df[html_col], F.lit("")).alias("html"),
    )
    return map_rows(picked, run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
