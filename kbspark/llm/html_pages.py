"""Forgiving reading of one HTML page into blocks of text with their place.

A block is the text between two block borders (start or end of a block
element, or a line break); inline markup neither splits nor spaces it.  Its
path names the open block elements, with classes, from the root.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from typing import NamedTuple

# Element kinds of HTML, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset(
    "address article aside blockquote body center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
FURNITURE_TAGS = frozenset("nav footer aside form script style noscript template button select option menu dialog svg math canvas object audio video head iframe textarea title datalist".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus
    footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo
    promotion recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget""".split())
#: Words that also name parts of an article's own text (its header, a section on search engines, a menu).
AMBIGUOUS = frozenset(
    """advertising banner consent cookie cookies disclaimer header login masthead menu modal navigation newsletter notice notices notification overlay
    promotion recommended related replies reply search share sharing skip social sponsor sponsored subscribe widget""".split())
#: Of these, words that inside an article name its own parts at least as often.
OWN_PARTS = frozenset("header masthead recommended related search skip widget".split())
#: Words of class names that only say where or how an element stands.
NEUTRAL = frozenset(
    """area article bar block bottom box button buttons col column container content count desktop entry fixed form global group icon icons inline
    inner item items large left link links list main mobile outer page panel post primary right row secondary section site small sticky story
    top wrap wrapper""".split())
#: With these a header is that of a piece of text, not of the page.
TEXT_PARTS = frozenset("article block card content entry item list post section story".split())
CONTENT = ("main", "article")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Ids of sections that are no slugs of their headings.
SECTION_IDS = frozenset("comments disqus sidebar".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Block(NamedTuple):
    path: str
    text: str
    furniture: bool
    content: str  # "main", "article" or ""


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", name) if w]


def _clear(name: str) -> bool:
    """Whether a whole id says page furniture even inside an article."""
    words = name.split("-")
    return all(w in FURNITURE_WORDS for w in words) and any(w not in AMBIGUOUS for w in words)


def _clear_class(name: str) -> bool:
    """Whether a class says page furniture even inside an article: all that its
    name says, besides where it stands, is furniture (``entry-comments``, not
    ``share-price`` or ``entry-header``)."""
    said = [w for w in _words(name) if w not in NEUTRAL]
    return bool(said) and all(w in FURNITURE_WORDS for w in said) and any(w not in OWN_PARTS for w in said)


def _outside(name: str) -> bool:
    """Whether a class or id says page furniture outside an article: by a word
    that means nothing else, or by its whole name (``site-search``, not
    ``market-share`` or ``section-header``)."""
    words = _words(name)
    said = [w for w in words if w in FURNITURE_WORDS]
    if "header" in said and TEXT_PARTS & set(words):
        said.remove("header")
    if any(w not in AMBIGUOUS for w in said):
        return True
    return bool(said) and all(w in FURNITURE_WORDS or w in NEUTRAL for w in words)


@functools.lru_cache(maxsize=4096)
def _element(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """``(name in paths, furniture by itself, furniture inside content)`` of a start tag."""
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    classes, ident = got.get("class", "").lower(), got.get("id", "").lower()
    words = [w for w in re.split(r"[^a-z]+", f"{classes} {ident}") if w]
    furniture = (tag in FURNITURE_TAGS or got.get("role", "").lower() in FURNITURE_ROLES or "hidden" in got or got.get("aria-hidden") == "true"
                 or bool(re.search(r"display\s*:\s*none", got.get("style", ""), re.I)))
    # ids of headings, and of sections, are mostly slugs of their titles
    slug = tag in HEADINGS or tag == "section" and ident not in SECTION_IDS
    named = tag not in ("html", "body", *CONTENT)
    names = classes.split()
    outside = named and any(map(_outside, names + [ident] * (not slug)))
    inside = named and (any(map(_clear_class, names)) or not slug and _clear(ident))
    return ".".join([tag, *sorted(set(words))]), furniture or outside, furniture or inside


def read_page(page: str) -> tuple[list[Block], Counter]:
    """The blocks of a page in order, and how often each tag path occurs."""
    blocks: list[Block] = []
    tags: Counter = Counter()
    stack: list[tuple[str, str, bool, str]] = []  # tag, path, furniture, content element around
    here = ("", "", False, "")
    parts: list[str] = []
    at, skip_to = 0, 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append(Block(here[1], text, here[2], here[3]))

    def close(depth: int) -> None:
        nonlocal here
        flush()
        del stack[depth:]
        here = stack[-1] if stack else ("", "", False, "")

    for m in TAG.finditer(page):
        if m.start() < skip_to:
            continue
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue
        if m[1] or m[4]:
            flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        flush()
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end or tag in ("script", "style"):
                at = skip_to = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] in ("table", "ul", "ol", "div", "section", "td", "th", "li", "article", "main", "body"):
                    break
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and (stack[-1][0] == tag or {stack[-1][0], tag} in ({"dt", "dd"}, {"td", "th"})):
            close(len(stack) - 1)
        if tag in CONTENT:  # a menu or header that was never closed does not swallow the content
            for depth, open_element in enumerate(stack):
                if open_element[0] in FURNITURE_TAGS or open_element[0] == "header":
                    close(depth)
                    break
        name, outside, inside = _element(tag, m[3] or m[6] or "")
        # a page's header is furniture; an article's header may hold its headings
        furniture = here[2] or (inside if here[3] else outside or tag == "header")
        here = (tag, f"{here[1]}/{name}", furniture, here[3] or (tag if tag in CONTENT else ""))
        stack.append(here)
        tags[here[1]] += 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return blocks, tags
