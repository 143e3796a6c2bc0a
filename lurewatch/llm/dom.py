"""A forgiving HTML reader: the block elements of a page and the runs of text between them.

Block elements are nodes; inline elements melt into the text around them.  A
run of text that no block element interrupts is a leaf.  Missing end tags close
as browsers do: a new block closes an open paragraph, an item the item before
it, and what is left is closed at the end of the page.  A quote opens a string
only directly after ``=``.  An element that hides its contents and is never
closed ends with the block around it, a drawing also at a block of its own.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_BLANK = re.compile(r"\s+")
#: Elements of HTML. Fixed names.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
 fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol
 option optgroup p pre search section select summary table tbody td tfoot th thead tr ul""".split())
HIDDEN = frozenset("script style noscript template title svg iframe object canvas audio video textarea "
                   "noembed noframes xmp datalist".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NO_PARAGRAPH = BLOCKS - frozenset("body button html label legend option optgroup tbody td tfoot th thead tr caption".split())
_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
         "td": {"td", "th"}, "th": {"td", "th"}}
_STOPS = frozenset("ul ol dl table select menu body html article section div td th blockquote main nav aside footer header".split())


@dataclass
class Node:
    """A block element, or a leaf of text (``tag`` is empty)."""

    tag: str
    parent: int
    names: str = ""
    label: str = ""
    text: str = ""
    linked: int = 0
    children: list[int] = field(default_factory=list)


def read(page: str) -> list[Node]:
    """The nodes of a page, parents before children, leaves in page order."""
    nodes = [Node("html", -1)]
    open_: list[int] = [0]
    pieces: list[tuple[str, bool]] = []
    links = hidden = 0
    hidden_tag = ""
    inside: list[str] = []  # elements open below the one that hides

    def flush() -> None:
        if pieces:
            text = _BLANK.sub(" ", "".join(p for p, _ in pieces)).strip()
            if text:
                linked = sum(len(p.strip()) for p, in_link in pieces if in_link)
                nodes[open_[-1]].children.append(len(nodes))
                nodes.append(Node("", open_[-1], text=text, linked=linked))
            pieces.clear()

    def close(at: int) -> None:
        flush()
        del open_[at:]

    def last(tags, stops=frozenset()) -> int:
        for i in range(len(open_) - 1, 0, -1):
            tag = nodes[open_[i]].tag
            if tag in tags:
                return i
            if tag in stops:
                break
        return 0

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        text = page[at:found.start() if found else size]
        if text and not hidden:
            pieces.append((html.unescape(text), links > 0))
        if not found:
            break
        at = max(found.end(), found.start() + 1)
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if hidden:  # until the element that hides its contents ends
            if tag == hidden_tag:
                hidden += -1 if found[1] else 1
            elif found[1] and tag in inside:
                del inside[len(inside) - 1 - inside[::-1].index(tag):]
            elif found[1] and tag in BLOCKS and last({tag}):
                hidden = 0  # it was never closed
            elif not found[1] and hidden_tag == "svg" and tag in BLOCKS and "foreignobject" not in inside:
                hidden = 0
            elif not found[1] and tag in RAW:
                at = _after_raw(page, at, tag)
            elif not found[1] and tag not in VOID:
                inside.append(tag)
            if hidden or tag == hidden_tag:
                continue
        if found[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCKS:
                i = last({tag})
                if i:
                    close(i)
                    links = 0
        elif tag in HIDDEN:
            if tag in RAW:
                at = _after_raw(page, at, tag)
            elif not found[3].rstrip().endswith("/"):
                hidden, hidden_tag, inside = 1, tag, []
        elif tag in ("br", "wbr", "img", "input"):
            pieces.append((" " if tag != "wbr" else "", False))
        elif tag == "a":
            links = 1
        elif tag in BLOCKS:
            if tag in ("html", "body"):
                if tag == "body" and len(open_) > 1:
                    continue
                if tag == "html":
                    continue
            links = 0
            if tag in _NO_PARAGRAPH and (i := last({"p"}, _STOPS)):
                close(i)
            if tag in _LIKE and (i := last(_LIKE[tag], _STOPS - _LIKE[tag])):
                close(i)
            flush()
            if tag not in VOID:
                given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(found[3])} if found[3].strip() else {}
                names = " ".join(given.get(k, "") for k in ("class", "id", "role", "aria-label") if given.get(k)).lower()
                nodes[open_[-1]].children.append(len(nodes))
                nodes.append(Node(tag, open_[-1], names, given.get("data-label", "")))
                open_.append(len(nodes) - 1)
    flush()
    return nodes


def _after_raw(page: str, at: int, tag: str) -> int:
    """The place after the end tag of an element whose contents are no markup.

    Without one, scripts and styles reach to the end of the page, others to the next tag.
    """
    found = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, at)
    if not found and tag not in ("script", "style"):
        found = re.compile(r"(?=<[a-zA-Z/])").search(page, at)
    return found.end() if found else len(page)
