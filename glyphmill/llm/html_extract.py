"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks. A linear classifier on a block's text and on the elements
around it gives the cost of calling it boilerplate or content; these are the capacities of its edges
from the source and to the sink. Edges between neighbours in page order, weaker with their distance
in the DOM tree, and between consecutive children of one element make it dear to part blocks that
belong together. The blocks that a minimum cut leaves with the source are the main text.

A class name that only hints at a page part (``legal-analysis``, ``share-wrap``) is a node of its own: bounded
capacity to the sink for the whole element, and an edge to each of its blocks. Text enough inside outvotes it.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

# Element names of HTML by their role.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole content is no text of the page.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title head select button".split())
#: Elements whose content is text without markup until their end tag.
TEXT_ONLY = frozenset("script style textarea title iframe noscript".split())
#: Elements that may stand in a head; any other start tag, or text, ends an open one.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag that ends an open element of the same set, up to the named container.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"})}
# Words in class, id and role that mark parts of a page.
OFF_ELEMENTS = frozenset("nav footer aside form menu dialog".split())
OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "sidebar aside side nav navbar navigation menu breadcrumb breadcrumbs toolbar topbar footer foot header masthead comment comments commentlist respond reply replies discussion disqus "
    "share sharing social related recommended recommendations trending popular newsletter subscribe subscription signup login search pagination pager copyright legal disclaimer widget widgets "
    "complementary contentinfo search hidden".split()
)
ON_ELEMENTS = frozenset("article main".split())
ON_WORDS = frozenset("article content post entry story main body text".split())

#: Of these, words that only hint at a page part where they stand among other words in a name; alone they name one.
HINTS = frozenset(
    "alert banner copyright disclaimer discussion foot head hidden legal login modal notice notices notification overlay pager popular popup promo promotion "
    "reply replies respond search share sharing social trending widget widgets".split()
)
#: Parts of class names that tell what an element or a page has, not what it is: what follows them is not read.
STATES = frozenset("no has with without is not hide show".split())
#: Part that is a matter of layout where it follows another: overflow-hidden.
LAYOUT = frozenset({"hidden"})

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<|[^<]+", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: End tags of elements whose content is text, and what in a script says that "</script>" is part of it ("<!-- <script> ... -->").
END_TAG = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>])[^>]*>?", re.I | re.A) for name in TEXT_ONLY}
SCRIPT_PART = re.compile(r"<!--|-->|<(/?)script(?=[ \t\n\f\r/>])(?:(?<=/script)[^>]*>?)?", re.I | re.A)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
GAP = re.compile(r"\s+")


@lru_cache(maxsize=20_000)
def named_parts(value: str) -> tuple[frozenset[str], frozenset[str], bool]:
    """Words in a class, id or role that mark page parts, (off, on), and whether a name hints at a part that goes."""
    off, on, hint = set(), set(), False
    for name in value.split():
        parts = [w.lower() for w in PART.findall(name)]
        parts = parts[: next((k for k, w in enumerate(parts) if w in STATES), len(parts))] if len(parts) > 1 else parts
        if not parts:
            continue
        on.update(w for w in parts if w in ON_WORDS)
        found = {w for k, w in enumerate(parts) if w in OFF_WORDS and not (k and w in LAYOUT)}
        # Words written together: sitefooter, commentlist.
        found.update(w for p in parts if p not in OFF_WORDS for w in OFF_WORDS if 6 <= len(w) < len(p) and (p.startswith(w) or p.endswith(w)))
        if len(parts) > 1 and len(found) == 1 and found <= HINTS:
            hint = True
        else:
            off |= found
    return frozenset(off), frozenset(on), hint


class Node:
    """An open element: what it and the elements around it say about its text."""

    __slots__ = ("depth", "hint", "name", "off", "on", "parent", "skip")

    def __init__(self, name: str, parent: Node | None, attributes: dict[str, str]):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        off, on, skip = (parent.off, parent.on, parent.skip) if parent else (False, False, False)
        self.hint = parent.hint if parent else None  # the nearest element whose name hints at a page part
        named, good, hint = named_parts(" ".join(attributes[key] for key in ("class", "id", "role") if key in attributes))
        whole = name in ("html", "body") or name in ON_ELEMENTS  # their classes describe the page
        if name in ON_ELEMENTS or (good and name not in ("html", "body")):
            on = True
        if not whole:
            if hint:
                self.hint = self
            if named - {"header"} or (named and not good):
                off = True
            if name in OFF_ELEMENTS or (name == "header" and not on):
                off = True
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
            skip = True
        if name in RAW:
            skip = True
        self.off, self.on, self.skip = off, on, skip


def script_end(page: str, start: int) -> int:
    """Where a script whose content starts at ``start`` ends: after its end tag, but as in HTML not at one after "<!--" and "<script". -1: nowhere."""
    hidden = inner = False
    while m := SCRIPT_PART.search(page, start):
        start = m.end()
        if m[0] == "<!--":
            hidden = True
            start -= 2  # "<!-->" opens and closes
        elif m[0] == "-->":
            hidden = inner = False
        elif not m[1]:
            inner = hidden
        elif inner:
            inner = False
        else:
            return start
    return -1


def blocks(page: str) -> list[tuple[str, Node, int, str]]:
    """Text blocks in page order: (text, the element that holds it, characters in links, block element's name).

    Character references are decoded; runs of white space inside a block are one space.
    """
    root = Node("", None, {})
    stack, out = [root], []
    opened: dict[str, list[int]] = {}  # where in the stack elements of a name are

    def close(to: int) -> None:
        """Close the elements from place ``to`` of the stack on."""
        while len(stack) > to:
            opened[stack.pop().name].pop()

    def last(names) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=0)

    text: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = GAP.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if joined:
                holder = next(n for n in reversed(stack) if n.name in BLOCK or n.parent is None)
                out.append((joined, holder, linked, holder.name))
        linked = 0

    position, nested = 0, True
    while match := TOKEN.match(page, position):
        token, position = match[0], match.end()
        if token[0] != "<" or token == "<" or token[:9] == "<![CDATA[":
            if token[:2] == "<!":
                token = ""
            if stack[-1].name == "head" and token.strip(" \t\n\f\r"):
                close(len(stack) - 1)
            if not stack[-1].skip and token:
                text.append(token)
                if in_link:
                    linked += len(token)
            continue
        named = NAME.match(token)
        if not named:
            continue
        name = named[1].lower()
        if token[1] == "/":
            if name in BLOCK or name in RAW:
                if opened.get(name):
                    flush()
                    close(opened[name][-1])
                elif name == "p":
                    flush()
            elif name == "a":
                in_link = max(0, in_link - 1)
            continue
        if name not in IN_HEAD and stack[-1].name == "head":
            close(len(stack) - 1)
        if name == "br":
            if not stack[-1].skip:
                text.append(" ")
            continue
        if name in BLOCK:
            flush()
            in_link = 0
            if stack[-1].name == "p":  # a block ends a paragraph
                close(len(stack) - 1)
            if name in ENDS:
                own, container = ENDS[name]
                if last(own) > last(container):
                    close(last(own))
        if name == "a":
            in_link += 1
        if name in VOID:
            continue
        if name in BLOCK or name in RAW:
            attributes = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(token, named.end(), len(token) - 1)} if len(token) > named.end() + 1 else {}
            if token[-2] == "/" and name in ("svg", "math"):
                continue
            if name in TEXT_ONLY:
                end = END_TAG[name].search(page, position)
                if end and nested and name == "script" and page.find("<!--", position, end.start()) >= 0:
                    whole = script_end(page, position)
                    nested = whole >= 0  # if not, first end tags count from here on
                    position = whole if nested else end.end()
                else:
                    position = end.end() if end else len(page)
                continue
            opened.setdefault(name, []).append(len(stack))
            stack.append(Node(name, stack[-1], attributes))
    flush()
    return out


#: Log-odds of a block in an article or main element, or one named so; of a block in a page part that is no main text.
ON, OFF = 4.0, -12.0


def score(text: str, holder: Node, linked: int, name: str) -> float:
    """Log-odds that a block is main text; its positive and negative parts are the terminal capacities."""
    words = text.count(" ") + 1
    value = -0.5 + min(words, 40) / 12.0
    if text[-1] in ".!?:;,…。»”\"'":
        value += 0.5
    value -= 4.0 * min(1.0, linked / len(text))
    if holder.on:
        value += ON
    elif name in HEADINGS:
        value += 0.5
    if holder.off:
        value += OFF
    return value


#: Capacities of the edges between neighbours in page order and between consecutive children of one element.
NEAR, SIBLING = 0.8, 0.6
#: Of an element whose name hints at a page part: its capacity to the sink, and of its edge to each block in it.
HINT, HINTED = 6.0, 4.0


def _distance(a: Node, b: Node) -> int:
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


TINY = 1e-9


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut.

    Node i has an edge of capacity max(score, 0) from the source and max(-score, 0) to the sink;
    ``edges`` (i, j, capacity) go both ways. A node whose terminal capacity is above all its edges
    together is on that terminal's side in every minimum cut; its edges then are terminal capacities
    of its neighbours. What is left after all such nodes is cut by maximum flow.
    """
    n = len(scores)
    left = list(scores)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        around[i][j] = around[i].get(j, 0.0) + c
        around[j][i] = around[j].get(i, 0.0) + c
    pull = [sum(a.values()) for a in around]
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is not None or abs(left[i]) <= pull[i] + TINY and around[i]:
            continue
        side[i] = left[i] > 0
        for j, c in around[i].items():
            if side[j] is None:
                del around[j][i]
                pull[j] -= c
                left[j] += c if side[i] else -c
                todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        reached = _maximum_flow([left[i] for i in rest], [{number[j]: c for j, c in around[i].items() if side[j] is None} for i in rest])
        for i, source in zip(rest, reached, strict=True):
            side[i] = source
    return side


def _maximum_flow(excess: list[float], residual: list[dict[int, float]]) -> list[bool]:
    """Nodes that the source still reaches after a maximum flow: blocking flows along layers of shortest paths."""
    n = len(excess)
    while True:
        # Layers count from the sink's side: what is left to the sink is layer 0.
        layer = [0 if e < -TINY else -1 for e in excess]
        queue = deque(i for i in range(n) if layer[i] == 0)
        while queue:
            j = queue.popleft()
            for i in residual[j]:
                if layer[i] < 0 and residual[i][j] > TINY:
                    layer[i] = layer[j] + 1
                    queue.append(i)
        starts = [i for i in range(n) if excess[i] > TINY and layer[i] > 0]
        if not starts:
            # The source's side: all that nodes with capacity left from the source reach.
            seen = [e > TINY for e in excess]
            queue = deque(i for i in range(n) if seen[i])
            while queue:
                i = queue.popleft()
                for j, c in residual[i].items():
                    if c > TINY and not seen[j]:
                        seen[j] = True
                        queue.append(j)
            return seen
        arcs = [iter(tuple(r)) for r in residual]
        ahead = [next(a, None) for a in arcs]
        for start in starts:
            path = [start]
            while path and excess[start] > TINY:
                i = path[-1]
                if layer[i] == 0:
                    if excess[i] < -TINY:
                        flow = min(excess[start], -excess[i], *(residual[a][b] for a, b in zip(path, path[1:], strict=False)))
                        for a, b in zip(path, path[1:], strict=False):
                            residual[a][b] -= flow
                            residual[b][a] += flow
                        excess[start] -= flow
                        excess[i] += flow
                        path = [start]
                    else:
                        path.pop()
                        if path:
                            ahead[path[-1]] = next(arcs[path[-1]], None)
                    continue
                j = ahead[i]
                if j is None:
                    path.pop()
                    if path:
                        ahead[path[-1]] = next(arcs[path[-1]], None)
                elif layer[j] == layer[i] - 1 and residual[i][j] > TINY:
                    path.append(j)
                else:
                    ahead[i] = next(arcs[i], None)


def label(found: list[tuple[str, Node, int, str]]) -> list[bool]:
    """Whether each block is main text."""
    scores = [score(*b) for b in found]
    edges, last, hints = [], {}, {}
    for k, (_, holder, _, _) in enumerate(found):
        if k:
            other = found[k - 1][1]
            edges.append((k - 1, k, NEAR / max(1, _distance(other, holder))))
        above = id(holder.parent)
        if above in last and last[above] != k:
            edges.append((last[above], k, SIBLING))
        last[above] = k
        if holder.hint is not None:
            hints.setdefault(id(holder.hint), []).append(k)
    for element, within in enumerate(hints.values(), len(found)):
        scores.append(-HINT)
        edges += [(k, element, HINTED) for k in within]
    return minimum_cut(scores, edges)[: len(found)]


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by newlines (empty if none)."""
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b[0] for b, stays in zip(found, label(found), strict=True) if stays)


def extract(pages: DataFrame, *, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """Every page with ``text``, its main text, and ``n_chars`` long, its code points.

    Columns of these names are replaced; ``carry`` names the columns to keep (default: all but the
    html). Null or empty html: empty text. Repeated rows are separate pages. Empty table: no rows.
    """
    own = ("text", "n_chars")
    keep = [c for c in pages.columns if (c != html_col if carry is None else c in carry) and c.lower() not in own]
    schema = pages.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    needed = [c for c in pages.columns if c in keep or c == html_col]
    at = needed.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, at):
                texts = [main_text(x.as_py()) for x in batch.column(at)]
                columns = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(needed.index(c)) for c in keep] + columns, names=[*keep, *own])

    return pages.select(*[F.col(f"`{c}`") for c in needed]).mapInArrow(run, schema)
