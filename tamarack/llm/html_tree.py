"""HTML text to a tree: a small, forgiving builder that never fails and reads each character once.

Only what decides about text is kept: elements with their names, where each text stands, and
which texts form a block. A block is what stands between two starts or ends of block-level
elements. Deeper nesting than DEPTH is flattened, as browsers do.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass, field

DEPTH = 512

# Element names of the HTML standard, by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style iframe noembed noframes".split())  # raw text that is never shown
RAW = DROPPED | frozenset("title textarea xmp".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = ENDS_P | frozenset("html head body title li dt dd caption colgroup thead tbody tfoot tr td th option optgroup select textarea legend button template noscript".split())
#: A start closes the nearest open element of the first set, unless one of the second stands between.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "thead": (frozenset("thead tbody tfoot".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
#: An end tag doesn't reach beyond these, unless it names one.
CELLS = frozenset("table td th caption html template".split())

_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*+)))?+|=)?+""")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_KEPT = frozenset(["class", "id", "role", "hidden", "style", "aria-hidden"])


@dataclass
class Tree:
    """Nodes in page order, a parent before its children; node 0 stands for the page. ``text`` is
    null for elements, ``names`` what their class, id and role say."""

    tag: list[str] = field(default_factory=lambda: ["#page"])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    names: list[str] = field(default_factory=lambda: [""])
    text: list[str | None] = field(default_factory=lambda: [None])
    block: list[int] = field(default_factory=lambda: [0])

    def add(self, tag: str, parent: int, names: str, text: str | None, block: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.names.append(names)
        self.text.append(text)
        self.block.append(block)
        return len(self.tag) - 1


def _hidden(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "").lower()
    return "hidden" in attributes or "display:none" in style or "visibility:hidden" in style


def parse(page: str) -> Tree:
    tree = Tree()
    stack, opened = [0], {}  # open elements and how many of each name
    at, end, block, space = 0, len(page), 0, False

    def push(tag: str, names: str) -> None:
        if len(stack) < DEPTH:
            stack.append(tree.add(tag, stack[-1], names, None, block))
            opened[tag] = opened.get(tag, 0) + 1

    def pop_to(place: int) -> None:
        while len(stack) > place:
            opened[tree.tag[stack.pop()]] -= 1

    def nearest(wanted: frozenset[str], until: frozenset[str]) -> int:
        """The place of the nearest open element that is wanted, 0 if there is none before ``until``."""
        for place in range(len(stack) - 1, 0, -1):
            tag = tree.tag[stack[place]]
            if tag in wanted:
                return place
            if tag in until:
                return 0
        return 0

    def say(text: str) -> None:
        nonlocal space
        if text.isspace():
            space = True
        elif text:
            tree.add("#text", stack[-1], "", (" " if space else "") + references.unescape(text), block)
            space = False

    start = 0  # of text that isn't said yet
    while at < end:
        mark = page.find("<", at)
        if mark < 0 or mark == end - 1:
            break
        sign = page[mark + 1]
        if sign == "!" or sign == "?" or (sign == "/" and not page[mark + 2 : mark + 3].isalpha()):
            if sign == "/" and mark + 2 >= end:
                break
            say(page[start:mark])
            if page.startswith("<!--", mark):
                if page.startswith((">", "->"), mark + 4):
                    at = page.find(">", mark) + 1
                else:
                    found = _COMMENT_END.search(page, mark + 4)
                    at = found.end() if found else end
            else:
                at = page.find(">", mark) + 1 or end
            start = at
            continue
        closing = sign == "/"
        if not closing and not (sign.isalpha() and sign.isascii()):
            at = mark + 1
            continue
        say(page[start:mark])
        name = _NAME.match(page, mark + 1 + closing)
        tag, at, attributes = name.group().lower(), name.end(), {}
        while at < end and page[at] != ">":
            found = _ATTRIBUTE.match(page, at)
            if found.end() == at:
                break
            key = found.group(1)
            if key and key.lower() in _KEPT and key.lower() not in attributes:
                attributes[key.lower()] = references.unescape(found.group(2) or found.group(3) or found.group(4) or "")
            at = found.end()
        at = start = min(at + 1, end)
        if tag in BLOCK:
            block, space = block + 1, False
        if closing:
            if tag == "br":
                space = True
            elif opened.get(tag):
                place = nearest(frozenset([tag]), CELLS if tag not in CELLS else frozenset())
                if place and (tag in BLOCK or all(tree.tag[i] not in BLOCK for i in stack[place + 1 :])):
                    pop_to(place)
            continue
        if tag in ENDS_P and opened.get("p") and (place := nearest(frozenset(["p"]), CELLS | {"button"})):
            pop_to(place)
        if tag in HEADINGS and tree.tag[stack[-1]] in HEADINGS:
            pop_to(len(stack) - 1)
        if tag in CLOSES and (place := nearest(*CLOSES[tag])):
            pop_to(place)
        if tag in VOID:
            space = space or tag == "br"
            continue
        if tag in RAW:
            found = _RAW_END[tag].search(page, at)
            stop = found.start() if found else end
            if tag not in DROPPED:
                push(tag, "")
                say(page[at:stop])
                if tree.tag[stack[-1]] == tag:
                    pop_to(len(stack) - 1)
                block += 1
            at = start = (page.find(">", stop) + 1 or end) if found else end
            continue
        names = " ".join(attributes[k] for k in ("class", "id", "role") if attributes.get(k))
        push(tag, names + (" #hidden" if attributes and _hidden(attributes) else ""))
    say(page[start:])
    return tree


def blocks_of(tree: Tree, content: list[bool] | None = None) -> list[str]:
    """The texts of the blocks (of the nodes that are content), trimmed, white space as one space; empty ones go."""
    parts: dict[int, list[str]] = {}
    for i, text in enumerate(tree.text):
        if text is not None and (content is None or content[i]):
            parts.setdefault(tree.block[i], []).append(text)
    joined = (" ".join("".join(p).split()) for p in parts.values())
    return [t for t in joined if t]
