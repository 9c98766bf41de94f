"""A page as a tree of block elements and runs of text, read leniently with one pass over its tags."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Elements that start a block of their own; elements whose text is no text of the page.
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 header footer nav aside ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption form fieldset legend select option button details summary address dialog menu hgroup center search iframe object".split()
)
SILENT = frozenset("script style noscript template head title svg textarea audio video canvas datalist".split())
#: Silent elements that, left open, last to the end of the page; others then last to the next block's tag.
RAW = frozenset("script style".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr param frame".split())
#: What an opening tag closes, if it is open nearer than any of the fences.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
for _t in ("thead", "tbody", "tfoot"):
    CLOSES[_t] = ({"thead", "tbody", "tfoot"}, {"table"})
#: Elements that an end tag further out doesn't close from within.
FENCES = frozenset({"table", "td", "th"})
NOT_IN_P = BLOCKS - {"button", "select", "option", "iframe", "object", "html", "body", "legend", "summary"}

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
_REST = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_NEXT_BLOCK = re.compile(r"</?(?:" + "|".join(sorted(BLOCKS)) + r")\b", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


@dataclass(slots=True)
class Node:
    tag: str  # "" for a run of text
    parent: int
    depth: int
    names: str  # class, id and role
    text: str
    linked: int  # characters of the text that are in links
    mark: str  # of labelled pages: "1" where the main text starts, "0" where something else does


def _attributes(raw: str) -> tuple[str, str]:
    names, mark = [], ""
    if "=" in raw:
        for name, *values in _ATTRIBUTE.findall(raw):
            value = next((v for v in values if v), "")
            if name.lower() == "data-main":
                mark = value
            else:
                names.append(value)
    return " ".join(names), mark


def parse(page: str) -> list[Node]:
    """Nodes in page order, each after its parent; the first is the root. Text is decoded, in single blanks."""
    nodes = [Node("html", -1, 0, "", "", 0, "")]
    stack = [0]
    run: list[tuple[str, bool]] = []
    links = 0

    open_at: dict[str, list[int]] = {}  # where in the stack each tag is open
    unclosed: set[str] = set()  # silent elements without an end tag further on

    def flush():
        if run:
            pieces = [(unescape(t), inside) for t, inside in run]
            text = " ".join("".join(t for t, _ in pieces).split())
            if text:
                linked = sum(len("".join(t.split())) for t, inside in pieces if inside)
                nodes.append(Node("", stack[-1], len(stack), "", text, linked, ""))
            run.clear()

    def nearest(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def pop_to(tags, fences) -> None:
        k = nearest(tags)
        if k and k >= nearest(fences):
            flush()
            for i in stack[k:]:
                open_at[nodes[i].tag].pop()
            del stack[k:]

    at, end = 0, len(page)
    while True:
        m = _TAG.search(page, at)
        if m is None:
            if at < end:
                run.append((page[at:], links > 0))
            break
        if m.start() > at:
            run.append((page[at : m.start()], links > 0))
        if m[1]:
            close = page.find("-->", m.end())
            at = end if close < 0 else close + 3
            continue
        rest = _REST.match(page, m.end())
        if rest is not None:
            at = rest.end()
        else:  # an unpaired quote, or a tag that is cut off
            close = page.find(">", m.end())
            at = end if close < 0 else close + 1
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                run.append((" ", False))
        elif tag in SILENT:
            if not closing and page[at - 2 : at] != "/>":
                gone = None if tag in unclosed else re.compile(rf"</{tag}\b[^>]*>" if tag != "head" else r"</head\b[^>]*>|(?=<body\b)", re.IGNORECASE).search(page, at)
                if gone is not None:
                    at = gone.end()
                    continue
                unclosed.add(tag)
                if tag in RAW:
                    at = end
                elif tag not in ("head", "noscript", "title"):
                    block = _NEXT_BLOCK.search(page, at)
                    at = end if block is None else block.start()
        elif tag not in BLOCKS:
            if tag == "a":
                links = 0 if closing else 1
        elif closing:
            if tag not in ("html", "body"):
                pop_to({tag}, FENCES if tag not in FENCES else {"table"} if tag != "table" else set())
            links = 0 if tag != "p" else links
        else:
            flush()
            if tag in ("html", "body"):
                names, mark = _attributes(page[m.end() : at])
                if tag == "html" or open_at.get("body"):
                    continue
            else:
                names, mark = _attributes(page[m.end() : at])
                if tag in NOT_IN_P:
                    pop_to({"p"}, FENCES | {"button"})
                if tag in CLOSES:
                    pop_to(*CLOSES[tag])
                if tag[0] == "h" and tag[1:].isdigit() and nodes[stack[-1]].tag[1:].isdigit():
                    pop_to({nodes[stack[-1]].tag}, set())
            nodes.append(Node(tag, stack[-1], len(stack), names, "", 0, mark))
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(len(nodes) - 1)
    flush()
    return nodes
