"""Element trees of web pages, folded into union-free expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

TEXT = "#"
GROUP = "()"

# Fixed values of HTML: elements without content, with raw text, and without a line of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong "
    "sub sup time tt u var wbr object math mi mn mo ms mtext mrow mstyle mfrac msqrt mroot msup msub msubsup mover munder munderover "
    "semantics".split())
# Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
    "table ul".split())
# Start tags that end an open element of the listed kinds, up to the listed container.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)),
    "option": (("option",), ("select",)),
}
# Elements that hold parts of a page: neighbours of one label are a repetition only if their contents are alike.
CONTAINERS = frozenset("div section article main aside header footer nav ul ol dl table form".split())
# A list of more parts than this becomes one repeated group with each label once.
MAX_WIDTH = 48
# Elements nested deeper than this count as part of the one at this depth.
MAX_DEPTH = 150

_TAG = re.compile(
    r"<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def label_of(tag: str, attributes: str) -> str:
    """Tag with the words of class, id and role; runs of digits become 0."""
    words: list[str] = []
    if "=" in attributes:
        for _, a, b, c in _NAMES.findall(attributes):
            words += re.sub(r"\d+", "0", (a or b or c).lower()).split()
    return ".".join([tag, *sorted(set(words))]).replace("/", "_")


def events(html: str) -> Iterator[tuple[str, str]]:
    """``("open", label)``, ``("close", label)``, ``("text", decoded text)`` and ``("break", "")`` in page order.

    Missing end tags are supplied where HTML implies them; raw elements and comments are left out.
    """
    open_labels: list[str] = []
    tags: list[str] = []
    count: Counter[str] = Counter()
    at, n = 0, len(html)

    def close_to(depth: int) -> Iterator[tuple[str, str]]:
        while len(tags) > depth:
            count[tags.pop()] -= 1
            yield "close", open_labels.pop()

    def last(tag: str) -> int:
        depth = len(tags) - 1
        while tags[depth] != tag:
            depth -= 1
        return depth

    while at < n:
        if html.find(">", at) < 0:  # nothing but text is left, and no sign needs to be tried
            yield "text", unescape(html[at:])
            break
        found = _TAG.search(html, at)
        end = found.start() if found else n
        if end > at:
            yield "text", unescape(html[at:end])
        if not found:
            break
        at = found.end()
        if found.group() == "<!--":
            stop = html.find("-->", at)
            at = n if stop < 0 else stop + 3
            continue
        tag = (found.group(2) or "").lower()
        if not tag:
            continue
        if found.group(1):
            if count[tag]:
                yield from close_to(last(tag))
            continue
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}[\\s/>]|</{re.escape(tag)}$", re.I).search(html, at)
            at = n if stop is None else n if (gt := html.find(">", stop.start())) < 0 else gt + 1
            continue
        if tag in ENDS_P and count["p"]:
            yield from close_to(last("p"))
        if tag in ENDS and any(count[kind] for kind in ENDS[tag][0]):
            kinds, fence = ENDS[tag]
            for depth in range(len(tags) - 1, -1, -1):
                if tags[depth] in fence:
                    break
                if tags[depth] in kinds:
                    yield from close_to(depth)
        if tag in VOID:
            if tag not in INLINE:
                yield "break", ""
            continue
        label = label_of(tag, found.group(3))
        tags.append(tag)
        count[tag] += 1
        open_labels.append(label)
        yield "open", label
    yield from close_to(0)


@dataclass
class Node:
    """Part of an expression: a label, its contents, and whether it may be absent or repeated."""

    label: str
    children: list[Node] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False

    def write(self) -> str:
        """The expression as text: ``label{contents}`` with ``?``, ``+`` or ``*``."""
        inside = " ".join(c.write() for c in self.children)
        mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[self.optional, self.repeated]
        return self.label + ("{" + inside + "}" if inside else "") + mark


_PART = re.compile(r"[^\s{}?+*]+|[{}?+*]")


def read(written: str) -> Node:
    """Inverse of ``Node.write``."""
    stack, last = [Node("")], Node("")
    for part in _PART.findall(written):
        if part == "{":
            stack.append(last)
        elif part == "}":
            last = stack.pop()
        elif part in "?+*":
            last.optional, last.repeated = part in "?*", part in "+*"
        else:
            last = Node(part)
            stack[-1].children.append(last)
    return stack[0].children[0]


def raw_tree(html: str) -> tuple[Node, list[tuple[str, Node, str]]]:
    """The page's elements as they stand, and ``(kind, part, value)`` of its texts and borders of blocks in page order.

    The parts of texts are their ``#`` nodes, those of borders the elements around them. A
    blank text has no node and is a border.
    """
    root = Node("page")
    stack: list[Node] = [root]
    items: list[tuple[str, Node, str]] = []
    for kind, value in events(html):
        if kind == "open":
            node = stack[-1]
            if len(stack) < MAX_DEPTH:
                node = Node(clean(value))
                stack[-1].children.append(node)
            stack.append(node)
        elif kind == "text" and value.strip():
            if not stack[-1].children or stack[-1].children[-1].label != TEXT:
                stack[-1].children.append(Node(TEXT))
            items.append(("text", stack[-1].children[-1], value))
            continue
        if kind in ("break", "text") or value.partition(".")[0] not in INLINE:
            items.append(("border", stack[-1], ""))
        if kind == "close":
            stack.pop()
    return root, items


def relabelled(node: Node, kept: set[str]) -> Node:
    """The elements with none but the kept words in their labels."""
    tag, *words = node.label.split(".")
    label = ".".join([tag, *(w for w in words if w in kept)])
    return Node(label, [c if c.label == TEXT else relabelled(c, kept) for c in node.children], node.optional, node.repeated)


def folded(node: Node) -> Node:
    """The expression of a page's elements."""
    return Node(node.label, bounded(fold([folded(c) for c in node.children])))


def page_tree(html: str) -> tuple[Node, list[tuple[str, str]]]:
    """The page's folded expression, and the innermost element's label and text of every non-blank text in page order."""
    root, items = raw_tree(html)
    inside = {id(t): n.label for n in walk(root) for t in n.children if t.label == TEXT}
    return folded(root), [(inside[id(part)], value) for kind, part, value in items if kind == "text"]


def walk(node: Node) -> Iterator[Node]:
    """All parts of an expression, from the top in order."""
    stack = [node]
    while stack:
        yield (node := stack.pop())
        stack.extend(reversed(node.children))


def clean(label: str) -> str:
    """A label without the signs that the written form uses."""
    return re.sub(r"[{}?+*()#\s]", "_", label)


def fold(nodes: list[Node]) -> list[Node]:
    """Runs of equal labels, and then of equal groups of labels, become repeated parts."""
    out: list[Node] = []
    for node in nodes:
        if out and out[-1].label == node.label and node.label != TEXT and alike(out[-1], node):
            out[-1] = merge(out[-1], node)
            out[-1].repeated = True
        elif not (out and node.label == TEXT == out[-1].label):
            out.append(node)
    for size in range(2, 7):
        i = 0
        while i + 2 * size <= len(out):
            group = out[i : i + size]
            if not repeats(group, out[i + size : i + 2 * size]) or any(x.label == GROUP for x in group):
                i += 1
                continue
            while repeats(group, out[i + size : i + 2 * size]):
                group = [merge(a, b) for a, b in zip(group, out[i + size : i + 2 * size], strict=True)]
                del out[i + size : i + 2 * size]
            out[i : i + size] = [Node(GROUP, group, repeated=True)]
            i += 1
    return out


def score(a: Node, b: Node) -> float:
    """How well two parts match: 0 for other labels, 2 for one label and, in containers, the same kinds of children."""
    if a.label != b.label:
        return 0.0
    if a.label.partition(".")[0] not in CONTAINERS:
        return 2.0
    kinds, others = ({c.label for c in flat(x.children)} for x in (a, b))
    return 1.0 + (len(kinds & others) / len(kinds | others) if kinds or others else 1.0)


def alike(a: Node, b: Node) -> bool:
    """Whether neighbours of one label are a repetition: containers must share most kinds of children."""
    if a.label.partition(".")[0] not in CONTAINERS:
        return True
    kinds, others = ({c.label for c in flat(x.children)} for x in (a, b))
    return 2 * len(kinds & others) > len(kinds | others) or kinds == others


def repeats(group: list[Node], others: list[Node]) -> bool:
    """Whether the second list repeats the first part by part."""
    return [x.label for x in group] == [x.label for x in others] and all(map(alike, group, others))


def flat(nodes: list[Node]) -> list[Node]:
    """The list with the members of groups in their place."""
    return [x for n in nodes for x in (n.children if n.label == GROUP else [n])]


def bounded(nodes: list[Node]) -> list[Node]:
    """A list of too many parts as ``(a? b? c?)*``, each label once; such a group takes in what it is aligned with."""
    if len(flat(nodes)) <= MAX_WIDTH and not any(n.label == GROUP and n.optional and all(c.optional for c in n.children) for n in nodes):
        return nodes
    found: dict[str, Node] = {}
    for node in flat(nodes):
        old = found.get(node.label)
        found[node.label] = Node(node.label, node.children, True, True) if old is None else merge(old, node)
    parts = [Node(n.label, n.children, True, n.label != TEXT) for n in found.values()]
    return [Node(GROUP, parts, True, True)]


def match(page: Node, wrapper: Node) -> Iterator[tuple[Node, Node]]:
    """Pairs of a page's parts and the wrapper's parts at which they are aligned, from the top.

    Parts of a level keep their order; a repeated part takes any number, a group starts
    again after each of its members. As many parts as can be are aligned.
    """
    yield page, wrapper
    parts: list[Node] = []
    after: list[int] = []
    for node in wrapper.children:
        start = len(parts)
        for member in node.children if node.label == GROUP else [node]:
            after.append(start if node.label == GROUP else len(parts) + (not node.repeated))
            parts.append(member)
    a, width = page.children, len(parts)
    best = [[0.0] * (width + 1)]
    for child in reversed(a):
        below, row = best[-1], [0.0] * (width + 1)
        for j in range(width - 1, -1, -1):
            row[j] = max(row[j + 1], below[j])
            if parts[j].label == child.label:
                row[j] = max(row[j], below[after[j]] + score(child, parts[j]))
        best.append(row)
    best.reverse()
    i = j = 0
    while i < len(a) and j < width:
        if a[i].label == parts[j].label and best[i][j] == best[i + 1][after[j]] + score(a[i], parts[j]):
            yield from match(a[i], parts[j])
            i, j = i + 1, after[j]
        elif best[i][j] == best[i][j + 1]:
            j += 1
        else:
            i += 1


def merge(a: Node, b: Node) -> Node:
    """The expression of two of one label: matches are joined, mismatches become optional or repeated parts."""
    children = align(a.children, b.children)
    return Node(a.label, bounded(fold(children)), a.optional or b.optional, a.repeated or b.repeated)


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """One list for two: a best common sequence of labels is joined, everything else is optional.

    Of parts with one label those with like contents match.
    """
    head: list[Node] = []
    i = j = 0
    while i < len(a) and j < len(b) and score(a[i], b[j]) == 2:
        head.append(merge(a[i], b[j]))
        i, j = i + 1, j + 1
    a, b = a[i:], b[j:]
    tail: list[Node] = []
    while a and b and score(a[-1], b[-1]) == 2:
        tail.insert(0, merge(a[-1], b[-1]))
        a, b = a[:-1], b[:-1]
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], (near := score(a[i], b[j])) and best[i + 1][j + 1] + near)
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and (near := score(a[i], b[j])) and best[i][j] == best[i + 1][j + 1] + near:
            head.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            head.append(Node(a[i].label, a[i].children, True, a[i].repeated))
            i += 1
        else:
            head.append(Node(b[j].label, b[j].children, True, b[j].repeated))
            j += 1
    return head + tail
