"""Cutting an HTML page into blocks of text, each told by its markup to be article, page furniture or neither."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

ARTICLE, FURNITURE, OPEN = 0, 1, 2

# A quote only opens a value behind "="; possessive repeats keep broken tags linear.
_TAG = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements whose content is no markup.
_RAW = {
    name: re.compile(rf"</{name}(?=[\s/>])", re.I)
    for name in ("script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg", "math")
}
_BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Blocks that end by themselves and so are not followed.
_LOOSE = {"p", "hr", "li", "dt", "dd", "option", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "head", "html", "body"}
_FURNITURE_TAGS = set(
    "nav header footer aside form button select menu dialog audio video object canvas datalist fieldset label".split()
)
_FURNITURE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_FURNITURE_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos "
    "promotion banner cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay newsletter subscribe "
    "subscription signup signin login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars rail footer "
    "header masthead topbar comment comments commentlist disqus discussion discussions feedback respond reply replies related "
    "recommended recommendations share sharing social widget widgets toolbar pagination pager skip hidden".split()
)
# With these in a name, it says what else the page has, or lacks ("no-sidebar", "content-with-menu").
_OTHER_PLACE = set("no with has without".split())
# Inside an article these hold its title.
_HEADS = set("header masthead".split())


@dataclass(slots=True)
class Block:
    kind: int
    text: str


def _is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    heads = _HEADS if in_article else frozenset()
    if name in _FURNITURE_TAGS and name not in heads:
        return True
    if not attributes or attributes.isspace():
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape("".join(values))
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key == "role" and value.strip().lower() in _FURNITURE_ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "main"):
            for word in value.split():
                parts = [part.lower() for part in _NAME_PARTS.findall(word)]
                if parts and not _OTHER_PLACE & set(parts) and ({parts[0], parts[-1]} & _FURNITURE_NAMES) - heads:
                    return True
    return False


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; white space is made single, character references are decoded.

    Comments, scripts, styles and the title are no text. An element left open runs to the end of the one it is in.
    """
    found: list[Block] = []
    pieces: list[str] = []
    # Open elements: name and what they make of their content.
    stack: list[tuple[str, int]] = [("", OPEN)]

    def close() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            found.append(Block(stack[-1][1], text))

    at = 0
    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            pieces.append(html.unescape(page[at:]))
            break
        pieces.append(html.unescape(page[at : tag.start()]))
        at = tag.end()
        name = tag[2] and tag[2].lower()
        if not name:
            continue
        if name == "br":
            pieces.append(" ")
            continue
        ends = bool(tag[1])
        if name in _RAW and not ends and not (name in ("svg", "math") and tag[3].endswith("/")):
            stop = _RAW[name].search(page, at)
            at = stop.start() if stop else len(page)
            continue
        is_block = name in _BLOCKS
        if ends:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            # An inline element never closes the block that it was left open in.
            if depth and (is_block or not any(stack[i][0] in _BLOCKS for i in range(depth + 1, len(stack)))):
                close()
                del stack[depth:]
            elif is_block:
                close()
            continue
        if is_block:
            close()
        kind = stack[-1][1]
        furniture = kind != FURNITURE and _is_furniture(name, tag[3], kind == ARTICLE)
        if name in _VOID or tag[3].endswith("/") and not is_block:
            continue
        if furniture:
            close()
            stack.append((name, FURNITURE))
        elif kind == OPEN and (name in ("article", "main") or re.search(r"""\brole\s*=\s*["']?main\b|\bitemprop\s*=\s*["']?articleBody\b""", tag[3])):
            close()
            stack.append((name, ARTICLE))
        elif is_block and name not in _LOOSE:
            stack.append((name, kind))
    close()
    return found
