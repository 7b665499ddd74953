"""A tolerant HTML tree, its folded skeleton, simple tree matching of skeletons, and block text."""

from __future__ import annotations

import html as _html
import re
import zlib

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<close>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|(?P<text>[^<]+|<)", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "body", "head", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "legend", "li",
    "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
    "select", "option", "button",
}
#: What an opening tag closes, and the elements that the search for it doesn't leave.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}
SCOPE = {"table", "td", "th", "button", "caption", "html", "article", "section", "main", "aside", "nav", "header", "footer", "div", "li", "body"}
#: Elements nested deeper than this have their content beside them, or in the outermost of them that is to be dropped.
MAX_DEPTH = 150


class Node:
    __slots__ = ("attrs", "children", "foreign", "holds_main", "label", "node_id", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        names = attrs.get("class", "").split() + attrs.get("id", "").split()
        marks = sorted({m for x in names if (m := re.sub(r"[^a-z_-]", "", x.lower()))})
        self.label = ".".join([tag, *marks])
        self.node_id = -1
        self.holds_main = False
        self.foreign = False  # neither article nor layout: adverts, comments, forms, what is hidden


def parse(source: str, apart=lambda node, in_content: False) -> Node:
    """The element tree of a page; children are nodes and strings with their character references decoded.

    ``apart(node, in_content)`` is true for an element that keeps its content to itself even below ``MAX_DEPTH``.
    """
    root = Node("html", {})
    stack = [root]
    deep: list[tuple[str, Node]] = []  # tags of open elements below MAX_DEPTH, and where their content goes
    at, n = 0, len(source)
    while at < n:
        m = TOKEN.match(source, at)
        if m is None:  # a tag that never ends
            break
        at = m.end()
        text = m["text"]
        if text is not None:
            (deep[-1][1] if deep else stack[-1]).children.append(_html.unescape(text) if "&" in text else text)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            at_ = next((k for k in range(len(deep) - 1, -1, -1) if deep[k][0] == tag), -1)
            if at_ >= 0:
                del deep[at_:]
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    deep.clear()
                    break
                if tag not in BLOCK and stack[k].tag in SCOPE:
                    break
            continue
        attrs = {a[0].lower(): _html.unescape(a[1] or a[2] or a[3]) for a in ATTR.findall(m["attrs"])} if m["attrs"].strip(" /\n\t") else {}
        if tag == "html" or tag == "body":
            root.attrs |= attrs if tag == "html" else {}
            if tag == "html":
                continue
        if not deep and tag in BLOCK and tag not in ("option", "button", "select"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        if not deep and tag in CLOSES:
            shut, within = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shut:
                    del stack[k:]
                    break
                if stack[k].tag in within:
                    break
        node = Node(tag, attrs)
        parent = deep[-1][1] if deep else stack[-1]
        parent.children.append(node)
        if tag in ("article", "main"):
            for outer in stack:
                outer.holds_main = True
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(source, at)
            at = end.end() if end else n
        elif tag not in VOID and not m["attrs"].endswith("/"):
            if len(stack) < MAX_DEPTH:
                deep.clear()
                stack.append(node)
            else:
                inside = any(x.tag in ("article", "main") for x in stack)
                deep.append((tag, node if parent is stack[-1] and apart(node, inside) else parent))
    return root


def _blocks(node: Node) -> list[Node]:
    """Child elements with inline ones looked through."""
    out = []
    for c in node.children:
        if isinstance(c, Node):
            if c.tag in BLOCK:
                out.append(c)
            elif c.tag not in RAW:
                out += _blocks(c)
    return out


def own_text(node: Node) -> str:
    parts = []

    def walk(x: Node) -> None:
        for c in x.children:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag not in BLOCK and c.tag not in RAW:
                walk(c)
            else:
                parts.append(" ")
    walk(node)
    return " ".join("".join(parts).split())


def fold(node: Node) -> tuple[str, list[list[Node]]]:
    """Skeleton of a tree, and the members of each of its nodes in preorder: runs of equal siblings are one node."""
    parts: list[tuple[str, list[list[Node]]]] = []
    for c in _blocks(node):
        sig, members = fold(c)
        if parts and parts[-1][0] == sig:
            for have, more in zip(parts[-1][1], members, strict=True):
                have += more
        else:
            parts.append((sig, members))
    inner = ",".join(s for s, _ in parts)
    return f"{node.label}({inner})", [[node], *(m for _, ms in parts for m in ms)]


def text_hashes(members: list[list[Node]]) -> tuple[list[int], list[int]]:
    """A 32-bit hash of the text that each skeleton node holds itself, -1 where it holds none, and the text's length."""
    hashes, chars = [], []
    for nodes in members:
        text = "\n".join(t for x in nodes if not x.foreign and (t := own_text(x)))
        hashes.append(zlib.crc32(text.encode("utf-8", "surrogatepass")) if text else -1)
        chars.append(len(text))
    return hashes, chars


Tree = tuple  # (label, preorder number, children)


def skeleton_tree(sig: str) -> Tree:
    root: list = []
    stack, label, count = [root], [], 0
    for ch in sig:
        if ch == "(":
            kids: list = []
            stack[-1].append(("".join(label), count, kids))
            label, count = [], count + 1
            stack.append(kids)
        elif ch == ")":
            stack.pop()
        elif ch != ",":
            label.append(ch)
    return root[0]


def match(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the largest order-keeping match of two skeletons, as numbers of a -> numbers of b."""
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def best(x: Tree, y: Tree) -> int:
        if x[0] != y[0]:
            return 0
        key = (x[1], y[1])
        if key not in memo:
            p, q = x[2], y[2]
            w = [[best(c, d) for d in q] for c in p]
            m = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
            for i in range(1, len(p) + 1):
                for j in range(1, len(q) + 1):
                    m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + w[i - 1][j - 1])
            pairs, i, j = [], len(p), len(q)
            while i and j:
                if w[i - 1][j - 1] and m[i][j] == m[i - 1][j - 1] + w[i - 1][j - 1]:
                    pairs.append((p[i - 1], q[j - 1]))
                    i, j = i - 1, j - 1
                elif m[i][j] == m[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
            memo[key] = (m[-1][-1] + 1, pairs)
        return memo[key][0]

    out: dict[int, int] = {}

    def take(x: Tree, y: Tree) -> None:
        out[x[1]] = y[1]
        for c, d in memo[(x[1], y[1])][1]:
            take(c, d)

    if best(a, b):
        take(a, b)
    return out
