"""HTML as trees: tags with their class names, text, and the usual end tags that pages leave out."""

from __future__ import annotations

import re
from functools import lru_cache

#: Element names of the HTML standard (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style".split())
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span
strike strong sub sup time tt u var wbr img""".split())
CLOSES_P = set("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr main menu nav ol p pre section table ul""".split())
#: An opening tag ends an open one of these, up to the nearest container.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, {"html"}),
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/>]|$)|display\s*:\s*none", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_P, _AROUND_P = {"p"}, CLOSES_P - {"p"} | {"button", "td", "th"}
#: Elements of drawings, which a slash closes.
FOREIGN = set("path circle rect line polyline polygon ellipse use g svg stop".split())
#: Elements deeper than this stand beside each other instead, as in browsers; no text is lost by that.
DEEPEST = 200
_DIGITS = re.compile(r"\d+")


class Node:
    """An element: ``key`` is its name with its class, id and role names (digits left out), ``kids`` are nodes and strings."""

    __slots__ = ("name", "key", "kids")

    def __init__(self, name: str, rest: str = ""):
        self.name, self.kids = name, []
        self.key = _key(name, rest) if rest else name


@lru_cache(maxsize=10_000)
def _key(name: str, rest: str) -> str:
    names = " ".join(a or b or c for a, b, c in _NAMED.findall(rest)) if "=" in rest else ""
    if _HIDDEN.search(rest):
        names += " hidden"
    return f"{name} {_DIGITS.sub('', ' '.join(names.split()))}".strip().lower()


def parse(page: str | None) -> Node:
    """The tree of a page; texts as written, character references not decoded."""
    root = Node("#root")
    stack, at, page = [root], 0, page or ""
    while True:
        token = _TOKEN.search(page, at)
        start = token.start() if token else len(page)
        if start > at:
            stack[-1].kids.append(page[at:start])
        if not token:
            return root
        at = token.end()
        closing, name, rest = token.groups()
        if name is None:
            continue
        name = name.lower()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    del stack[depth:]
                    break
            continue
        if name in CLOSES_P:
            _end(stack, _P, _AROUND_P)
        elif name in ENDS:
            _end(stack, *ENDS[name])
        node = Node(name, rest[:-1])
        stack[-1].kids.append(node)
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not (rest.endswith("/>") and name in FOREIGN) and len(stack) < DEEPEST:
            stack.append(node)


def _end(stack: list[Node], ended: set[str], within: set[str]) -> None:
    """Closes the outermost open element of ``ended`` inside the nearest of ``within``."""
    cut = None
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].name in within:
            break
        if stack[depth].name in ended:
            cut = depth
    if cut is not None:
        del stack[cut:]
