"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block element. Every line has a weight:
its text's length, or 0 where the markup shows that it is not article text
(menus, headers, footers, sidebars, notices, adverts, forms, reader comments,
hidden parts, lists of links; and, on pages that mark an article, all that lies
outside). Weights are summed over sliding windows of lines, on every page alike;
the sum's surges and dives bound the text, and the weighted lines between them
are kept. Time is linear in the page's length, however deeply it is nested.

Defined results: null and empty pages give an empty text; pages may be cut off
anywhere (open comments, scripts and tags end with the page); character
references are decoded, white space within a block becomes one space, blocks
are joined by an empty line; repeated rows give the same; extra columns are
kept; an empty table gives an empty result. Nothing is capped.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerloom.llm.common import need, with_text_columns

WINDOW = 3
#: Characters in a window from which a page's text begins (or the page's best window, if that has fewer).
SURGE = 80

BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SPACING = set("br td th img wbr input".split())
RAW = set("script style textarea title noscript template iframe noframes xmp svg math canvas object select audio video".split())
NOT_TEXT = set("head nav aside footer form button menu dialog fieldset option optgroup label".split())
INLINE = set("b i u s em strong font small big tt code kbd samp var sub sup mark q cite abbr acronym dfn ins del strike bdi bdo time data ruby rt rp".split())
#: Words of class and id, and roles, that mark what isn't article text.
SIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising advertorial adsense banner billboard sponsor sponsored sponsors promo promos promotion outbrain taboola doubleclick dfp"
    " nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs crumbs pagination pager toc topbar toolbar skip"
    " sidebar sidebars aside rail footer foot colophon masthead copyright legal disclaimer imprint"
    " cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay paywall subscribe subscription newsletter signup signin login register"
    " comment comments commentlist commentary respond reply replies discussion disqus guestbook reactions"
    " share sharing social follow related recommended recommendations popular trending widget widgets search searchbox form contact tags tagcloud byline-links hidden".split()
)
#: Of these, words that also name layouts (has-sidebar, menu-open): a container that turns out to hold the article isn't aside for them.
LAYOUT_WORDS = set("nav navbar navigation navi menu menus submenu topbar toolbar sidebar sidebars aside rail foot banner ad ads search form contact skip toc hidden cookie cookies consent modal overlay".split())
SIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status tablist".split())
HEAD_WORDS = set("header head top".split())
TEXT_WORDS = set("article post entry story content main body text".split())
TEXT_IDS = re.compile(r"(?:article|post|entry|story|content)[-_]?(?:body|text|content|main)?|main|main[-_]?content|page[-_]?content", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^\"'>]|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)|\b(hidden)\b""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Line:
    text: str
    side: bool  # known not to be article text
    linked: float  # share of characters in links
    marked: int  # 2 inside an article, 1 inside another container of text
    lifted: bool = False  # in a container of text whose surroundings are aside unless they hold the article


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[3]).lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)} if len(text) > 2 else {}


def _side_of(tag: str, attributes: dict[str, str], in_text: bool) -> int:
    """2 if an element is aside from the article, 1 if it is unless it holds the article, 0 else."""
    if tag in NOT_TEXT:
        return 1 if tag == "form" else 2
    if tag == "header" and not in_text:
        return 2
    if not attributes or tag in ("html", "body"):
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return 2
    if attributes.get("role", "").lower() in SIDE_ROLES:
        return 2
    words = {w.lower() for key in ("class", "id") for w in _WORDS.findall(attributes.get(key, ""))}
    if tag in ("article", "main"):
        words -= LAYOUT_WORDS | {"share", "sharing", "social", "tags", "follow"}
    found = words & SIDE_WORDS
    if found:
        return 1 if found <= LAYOUT_WORDS else 2
    return 2 if words & HEAD_WORDS and not in_text and not words & TEXT_WORDS else 0


def _is_text(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ("article", "main") or attributes.get("role") in ("main", "article") or attributes.get("itemprop") == "articleBody":
        return True
    names = [*attributes.get("class", "").split(), attributes.get("id", "")]
    return tag in ("div", "section", "td") and any(TEXT_IDS.fullmatch(n) for n in names if n)


class _Open:
    """The open elements, with what they say of the text inside; every question takes constant time."""

    FENCES = ("article", "main", "body", "table")

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int, bool]] = []  # tag, side, mark, link
        self.at: dict[str, list[int]] = {}  # where each tag is open
        self.fences: list[int] = []  # where a fence is open
        self.sides: list[int] = []  # where an element is aside, and where it is whatever it holds
        self.hard = 0
        self.marks: list[int] = []
        self.articles = self.links = 0

    def push(self, tag: str, side: int, mark: int, link: bool) -> None:
        i = len(self.stack)
        self.stack.append((tag, side, mark, link))
        self.at.setdefault(tag, []).append(i)
        if tag in self.FENCES:
            self.fences.append(i)
        if side:
            self.sides.append(i)
            self.hard += side == 2
        if mark:
            self.marks.append(i)
            self.articles += mark == 2
        self.links += link

    def pop(self) -> None:
        tag, side, mark, link = self.stack.pop()
        i = len(self.stack)
        self.at[tag].pop()
        for held in (self.fences, self.sides, self.marks):
            if held and held[-1] == i:
                held.pop()
        self.hard -= side == 2
        self.articles -= mark == 2
        self.links -= link

    def close(self, tag: str) -> None:
        """Closes the innermost element of that name and all in it; only an article, main, body or html reaches beyond a fence."""
        where = self.at.get(tag)
        if where and (tag in ("body", "html", "article", "main") or not self.fences or self.fences[-1] <= where[-1]):
            for _ in range(len(self.stack) - where[-1]):
                self.pop()

    def found_article(self) -> None:
        """Elements that were aside unless they hold the article aren't."""
        for i in self.sides:
            tag, _, mark, link = self.stack[i]
            self.stack[i] = (tag, 0, mark, link)
        self.sides.clear()

    @property
    def marked(self) -> int:
        return 2 if self.articles else 1 if self.marks else 0

    @property
    def lifted(self) -> bool:
        return bool(self.sides and self.marks) and not self.hard and self.marks[-1] > self.sides[-1]


#: What a block element closes by its own beginning.
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}


def strip_markup(page: str) -> list[Line]:
    """The page as lines of plain text, one a block element, with what the markup says of each."""
    lines: list[Line] = []
    around = _Open()
    parts: list[str] = []
    linked = 0

    def end_line() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                lines.append(Line(text, bool(around.sides), linked / len(text), around.marked, around.lifted))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text)
            parts.append(text)
            linked += len(text) if around.links else 0

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in INLINE and "=" not in m[3]:
            continue
        if m[1]:
            if tag in BLOCKS:
                end_line()
            around.close(tag)
            continue
        if tag in RAW:
            if m[3].rstrip(">").endswith("/"):
                continue
            end = re.compile(rf"</{tag}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCKS:
            end_line()
            if around.stack and around.stack[-1][0] in _IMPLIED.get(tag, ("p",)):
                around.pop()
        elif tag in SPACING:
            parts.append(" ")
        if tag in VOID or tag == "p" and "=" not in m[3]:
            continue
        attributes = _attributes(m[3])
        mark = 2 if tag == "article" else 1 if _is_text(tag, attributes) else 0
        side = _side_of(tag, attributes, around.marked == 2)
        if side and tag not in BLOCKS:
            end_line()
        if around.sides and not around.hard and not side and tag in ("article", "main"):
            around.found_article()
        around.push(tag, side, mark, tag == "a")
    add(page[at:])
    end_line()
    return lines


def weights(lines: list[Line]) -> tuple[list[int], list[bool]]:
    """Text length of each line, 0 for lines that can't be article text; and whether each is inside what the page marks as its text."""
    # What may hold the article does if it has more text than all that isn't aside.
    text = [len(x.text) * (1 - x.linked) for x in lines]
    up = sum(n for x, n in zip(lines, text, strict=True) if x.lifted) > sum(n for x, n in zip(lines, text, strict=True) if not x.side)
    side = [x.side and not (up and x.lifted) for x in lines]
    # Articles with less than half of the text in containers of text are teasers beside it.
    held = [sum(len(x.text) for x, aside in zip(lines, side, strict=True) if not aside and x.marked >= mark) for mark in (1, 2)]
    best = 2 if held[1] and 2 * held[1] >= held[0] else 1 if held[0] else 0
    weight = [0 if aside or x.marked < best or not best and x.linked > 0.6 else len(x.text) for x, aside in zip(lines, side, strict=True)]
    return weight, [bool(best) and x.marked >= best for x in lines]


def spans(weight: list[int], inside: list[bool]) -> list[tuple[int, int]]:
    """Ranges of lines between a surge and the next dive of the sums of WINDOW lines.

    A surge is a sum of more than SURGE (or the best sum, if that is less), a
    dive a sum of nothing; after the first surge any weight is one, as a text
    goes on after what interrupts it. A span begins where the text that leads up
    to its surge does, or the marked text around it.
    """
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(weight))]
    surge = min(SURGE, max(sums, default=0) - 1)
    out, i = [], 0
    while i < len(sums):
        if sums[i] <= max(surge, 0):
            i += 1
            continue
        end = i
        while end < len(sums) and sums[end] > 0:
            end += 1
        begin, least = i, out[-1][1] if out else 0
        while begin > least and (weight[begin - 1] > 0 or inside[begin - 1]):
            begin -= 1
        out.append((begin, end))
        i, surge = end + 1, 0
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line; empty if there is none."""
    if not page:
        return ""
    lines = strip_markup(page)
    weight, inside = weights(lines)
    return "\n\n".join(lines[i].text for begin, end in spans(weight, inside) for i in range(begin, end) if weight[i])


def _extract(pages: list[bytes | None]) -> list:
    texts = [main_text((p or b"").decode("utf-8", "replace")) for p in pages]
    return [texts, [len(t) for t in texts]]


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html and any others) with text and n_chars (code points) of each row; html is dropped."""
    need(pages, "page_id", "url", "html")
    return with_text_columns(pages, "text string, n_chars long", _extract, "html").drop("html")
