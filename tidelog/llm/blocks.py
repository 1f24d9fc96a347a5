"""Leaf blocks of an HTML page: runs of text between the borders of block elements."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

# Element kinds of the HTML standard.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav
noscript object ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template title textarea iframe svg xmp noembed noframes".split())
INLINE = frozenset("""a abbr acronym audio b bdi bdo big canvas cite code data datalist del dfn em font i ins kbd map mark
math meter nobr output picture progress q rp rt ruby s samp slot small span strike strong sub sup time tt u var
video""".split())
ELEMENTS = BLOCKS | VOID | RAW | INLINE
#: Left open, these go on to the end of the page; of others only the tag is passed over.
RAW_TO_END = frozenset(("script", "style"))
#: Starting one of these ends an open paragraph.
ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul""".split())
#: Starting one of the left ends the nearest open one of the right, unless the border comes first.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody"}, {"table"})}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"""
    r"""|</?[a-zA-Z][^>]*\Z|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAMED = ("class", "id", "role", "itemprop", "aria-label")


@dataclass(slots=True)
class Element:
    """An element, what it is called, its label (its own or that of those around it), and the element around it,
    which is shared by all that lies in it: blocks hold no copies of their place."""

    name: str
    named: str
    label: str | None
    around: Element | None


@dataclass
class Block:
    """Text of a block, the innermost element around it, and how much of it is linked."""

    inside: Element | None
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: int = 0

    def close(self) -> Block | None:
        self.text = " ".join(html.unescape("".join(self.pieces)).split())
        return self if self.text else None


def _names(attributes: str) -> tuple[str, str | None]:
    """What an element is called by its attributes, and its label if it has one."""
    if not attributes.strip(" /\n\t\r"):
        return "", None
    named, label = [], None
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in _NAMED:
            named.append(value.strip("\"'"))
        elif name == "data-label":
            label = value.strip("\"'")
    return " ".join(named), label


def leaf_blocks(page: str, labelled: bool = True) -> list[Block]:
    """Blocks with text in page order, in time linear in the page, however deep it is nested. Scripts, styles,
    comments and other elements without text of their own are left out; elements left open end with the page.
    ``labelled`` pages are training pages: ``data-label`` has the label of the blocks inside an element."""
    out: list[Block] = []
    stack: list[Element] = []
    # where in the stack the open elements of a name are, and those that are blocks
    places: dict[str, list[int]] = defaultdict(list)
    borders: list[int] = []
    now: Block | None = None
    at = 0
    open_ended: set[str] = set()

    def finish():
        nonlocal now
        if now is not None and (done := now.close()):
            out.append(done)
        now = None

    def pop_to(k: int):
        while len(stack) > k:
            name = stack.pop().name
            places[name].pop()
            if name in BLOCKS:
                borders.pop()
                finish()

    def nearest(names) -> int:
        return max((places[n][-1] for n in names if places[n]), default=-1)

    size = len(page)
    while at < size:
        token = _TOKEN.match(page, at)
        at = token.end()
        name = token[2] or token[5]
        if name is None:
            text = token.group()
            if text[0] == "<" and len(text) > 1:
                continue
            if now is None:
                if text.isspace():
                    continue
                now = Block(stack[-1] if stack else None)
                if labelled:
                    now.label = int(stack[-1].label or "0") if stack else 0
            now.pieces.append(text)
            now.linked += len(text) if places["a"] else 0
            continue
        name, closing = name.lower(), bool(token[1] or token[4])
        if name == "br":
            if now is not None:
                now.pieces.append(" ")
        elif closing:
            if places[name]:
                pop_to(places[name][-1])
            if name in BLOCKS:
                finish()
        else:
            attributes = token[3] if token[2] else token[6]
            if name in RAW and not attributes.endswith("/"):
                end = None if name in open_ended else re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                if end is None:
                    open_ended.add(name)
                at = end.end() if end else size if name in RAW_TO_END else at
                continue
            if name in ENDS_P and borders and stack[borders[-1]].name == "p":
                pop_to(borders[-1])
            if name in CLOSES:
                ends, border = CLOSES[name]
                if (k := nearest(ends)) > nearest(border):
                    pop_to(k)
            if name in BLOCKS:
                finish()
            if name not in VOID:
                named, label = _names(attributes)
                around = stack[-1] if stack else None
                places[name].append(len(stack))
                if name in BLOCKS:
                    borders.append(len(stack))
                stack.append(Element(name, named, around.label if label is None and around else label, around))
    finish()
    return out
