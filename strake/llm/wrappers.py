"""Main text of web pages by wrapper induction (union-free regular expressions).

A page is read as a stream of blocks, each with a key (its path of block
elements, containers with their first class) and a text. Streams of one host are
aligned one after the other; the result, the host's wrapper, is a regular
expression without unions: a node whose texts differ becomes a text slot, a node
that one side lacks becomes optional, and runs that repeat, of one node or of up
to three in a row, become a repeated group. Partitions infer wrappers of their own pages
first, and wrappers are merged like pages, in two levels, so a host with a third
of all pages costs one small row a partition.

A node holds its text if all pages agree on it (a hash of one that is over 40
characters), and a repeated node the texts that its run has on all pages, so
constants of any length are found. With the nodes goes the mass of each
container: the characters of its texts on all pages, less those of links. No
container is left out: each is part of some node's key, so masses are no more
than nodes.

The wrapper decides which slots are the main text. Its constants weigh nothing;
from the root it descends to a container as long as that holds three quarters of
the mass, and the slots of the container where it stops, the region, are the
text. Word lists are priors: blocks in menus, headers, footers, sidebars,
adverts, notices, forms and comments, by element, role and class, weigh nothing
and are no text, and an article or main element weighs 200 characters a page
more. A page that has nothing in its host's region is judged by a wrapper of its
own. Scripts and styles are no text.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

#: Wrappers of up to so many bytes in all are broadcast; more are joined by host with salted pages.
BROADCAST_BYTES = 32_000_000
SALTS = 64
#: So many pages, with other text that differs, must agree before a text counts as the host's own.
AGREE = 3
SHORT = 40
#: Part of a container's mass from which on the search goes on inside.
SHARE = 0.75
#: What an article or main element is taken to weigh more, in characters a page.
HINT = 200
#: Elements of a path beyond so many are told apart by a hash.
DEEP = 32
#: Cells of an alignment's table that are filled at once; a larger one is halved.
CELLS = 1 << 21

# fixed values: elements of HTML and words in class names
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math xmp noembed noframes".split())
CLOSES_P = BLOCK - {"body", "html", "head", "title", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
OUTSIDE = frozenset("nav header footer aside form button select dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription toolbar topbar".split()
)
MAIN = frozenset(["article", "main"])
CONTAINER = frozenset("article body center div main section".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)(?:>|\Z)|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</?\Z",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


def excluded(name: str, attrs: str) -> bool:
    """Whether an element and all in it is no main text, by element, role or being hidden."""
    if name in OUTSIDE:
        return True
    if not attrs.strip() or name in MAIN or name in ("body", "html"):
        return False
    if _HIDDEN.search(attrs.split("=")[0] if "=" not in attrs else re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)):
        return True
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


def named(name: str, attrs: str) -> bool:
    """Whether an element has a class or id all of whose words are in NAMES: cookie-notice, but not no-sidebar."""
    if not attrs.strip() or name in MAIN or name in ("body", "html"):
        return False
    tokens = [t for key, *values in _ATTR.findall(attrs) if key.lower() in ("class", "id") for t in "".join(values).split()]
    return any(all(w.lower() in NAMES for w in words) for t in tokens if (words := [w for w in _SPLIT.split(t) if w]))


_ENDS = {name: re.compile(f"</{name}[^>]*(?:>|\\Z)", re.I | re.A) for name in RAW}
_CLASS = re.compile(r"(?:^|\s)class\s*=\s*[\"']?\s*([^\s\"'>]+)", re.I)
_DIGITS = re.compile(r"[0-9]+")


def _step(name: str, attrs: str) -> str:
    """What an element adds to a path: its name, a container's first class with it, digits aside."""
    m = _CLASS.search(attrs) if name in CONTAINER and attrs else None
    return f"/{name}.{_DIGITS.sub('#', m[1].replace('/', '-'))}" if m else f"/{name}"


class _Open:
    """The open elements, with where each name stands among them."""

    def __init__(self):
        self.stack: list[tuple] = []  # name, element that excludes (0 none, None in any case), in an article, path, elements in it
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def last(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def push(self, *element) -> None:
        self.at[element[0]].append(len(self.stack))
        if element[0] in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            name = self.stack.pop()[0]
            self.at[name].pop()
            if name in BLOCK:
                self.blocks.pop()


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(key, text, characters in links) of each block with a text. A key begins with ! if excluded, with * if inside an article.

    What is excluded by name is decided at the page's end: on a page all of whose
    articles are inside elements so named, or that has none, an element that
    contains an article or more than half of the text is not excluded by its name.
    """
    out: list[tuple[str, int | None, str, str, int]] = []  # mark, innermost element that excludes by name (0 none, None: excluded in any case), path, text, in links
    opened = _Open()
    parts: dict[int | None, list[str]] = {}
    links: Counter = Counter()
    up = [0]  # of each element excluded by name, the one around it
    around: set[int] = set()  # those of them with an article directly inside
    free = False

    def flush() -> None:
        top = opened.stack[-1] if opened.stack else None
        for by in sorted(parts, key=lambda by: (by is None, by or 0)):
            if text := " ".join("".join(parts[by]).split()):
                out.append(("*" if top and top[2] else "-", by, top[3] if top else "", text, min(links[by], len(text))))
        parts.clear()
        links.clear()

    def decided() -> list[tuple[str, str, int]]:
        size, holds = [0] * len(up), [e in around for e in range(len(up))]
        for _, by, _, text, _ in out:
            size[by or 0] += len(text) if by else 0
        for e in range(len(up) - 1, 0, -1):  # what is inside an element is inside those around it
            size[up[e]] += size[e]
            holds[up[e]] |= holds[e]
        half = sum(len(t) for _, by, _, t, _ in out if by is not None) / 2
        fine = [True] * len(up)
        for e in range(1, len(up)):
            fine[e] = fine[up[e]] and not free and (holds[e] or size[e] > half and not around)
        return [(("!" if by is None or not fine[by] else mark) + path, text, n) for mark, by, path, text, n in out]

    def put(raw: str) -> None:
        if raw:
            by = opened.stack[-1][1] if opened.stack else 0
            said = html.unescape(raw) if "&" in raw else raw
            parts.setdefault(by, []).append(said)
            if opened.at.get("a"):
                links[by] += len(said)

    def pop_to(k: int) -> None:
        flush()
        opened.cut(k)

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            k = opened.last((name,))
            if k >= 0:
                if name in BLOCK:
                    pop_to(k)
                elif not opened.blocks or opened.blocks[-1] < k:
                    opened.cut(k)
            elif name in BLOCK:
                flush()
            continue
        attrs = m["attrs"] or ""
        if name in RAW:
            if not attrs.rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                end = _ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            put(" ")
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P:
                k = opened.last(("p",))
                if k >= 0 and opened.last(("td", "th", "table", "button")) < k:
                    pop_to(k)
        if name in SAME:
            k = opened.last(SAME[name])
            if k > opened.last(BARRIER[name]):
                pop_to(k)
        if name in VOID:
            continue
        _, by, in_, path, deep = opened.stack[-1] if opened.stack else ("", 0, False, "", 0)
        if by is not None:
            if excluded(name, attrs):
                by = None
            elif named(name, attrs):
                up.append(by)
                by = len(up) - 1
            if name in MAIN and not in_ and by is not None:
                if by:
                    around.add(by)
                free |= not by
        if name in BLOCK and name not in ("html", "body"):
            deep += 1
            step = _step(name, attrs)
            path = path + step if deep <= DEEP else path.split("/~")[0] + "/~" + hashlib.blake2b((path + step).encode("utf-8", "replace"), digest_size=8).hexdigest()
        opened.push(name, by, in_ or name in MAIN, path, deep)
    flush()
    return decided()


def container(path: str) -> str:
    """The part of a path that is containers only."""
    steps = path.split("/")[1:]
    n = next((i for i, s in enumerate(steps) if s.split(".", 1)[0] not in CONTAINER), len(steps))
    return "".join("/" + s for s in steps[:n])


def masses(found: list[tuple[str, str, int]]) -> dict[str, int]:
    """The mass of each container of a page with text of its own, and the hint on its first article."""
    out: dict[str, int] = defaultdict(int)
    hinted = False
    for key, text, linked in found:
        if key[0] != "!":
            at = container(key[1:])
            out[at] += max(0, len(text) - 2 * linked)
            if key[0] == "*" and not hinted:
                steps = at.split("/")[1:]
                n = next((i for i, s in enumerate(steps) if s.split(".", 1)[0] in MAIN), len(steps) - 1)
                out["".join("/" + s for s in steps[: n + 1])] += HINT
                hinted = True
    return dict(out)


def region_of(mass: dict[str, int]) -> str:
    """The container where the descent along the mass stops."""
    inside: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    whole: dict[str, int] = defaultdict(int)
    for path, n in mass.items():
        at = ""
        whole[at] += n
        for step in path.split("/")[1:]:
            inside[at][f"{at}/{step}"] += n
            at = f"{at}/{step}"
            whole[at] += n
    at = ""
    while inside.get(at):
        best = max(inside[at], key=lambda c: (inside[at][c], c))
        if inside[at][best] <= 0 or inside[at][best] < SHARE * whole[at]:
            break
        at = best
    return at


# A node is [signature, text, optional, repeated, children or None, differs]; a wrapper is a list of nodes.
# The text is what pages agree on: None if nothing, a list if several texts of a run. Differs: some text is not on all pages.


def _leaf(key: str, text: str | None) -> list:
    return [key, text, False, False, None, False]


def _mark(text: str) -> str:
    """A text as nodes hold it: a long one as a hash and its length, which no text equals, as texts have no line breaks."""
    return text if len(text) <= SHORT else f"\n{hashlib.blake2b(text.encode('utf-8', 'replace'), digest_size=16).hexdigest()}{len(text)}"


def _texts(node: list) -> set[str]:
    return set() if node[1] is None else {node[1]} if isinstance(node[1], str) else set(node[1])


def _text(texts: set[str]) -> str | list[str] | None:
    return None if not texts else next(iter(texts)) if len(texts) == 1 else sorted(texts)


def _join(a: list, b: list) -> list:
    """Two nodes of one signature as one: what both hold."""
    children = [_join(x, y) for x, y in zip(a[4], b[4], strict=True)] if a[4] else None
    return [a[0], _text(_texts(a) & _texts(b)), a[2] or b[2], a[3] or b[3], children, a[5] or b[5] or _texts(a) != _texts(b)]


def _row(a: list, b: list) -> list:
    """Two nodes of one signature in a row as one: what pages have in either."""
    children = [_row(x, y) for x, y in zip(a[4], b[4], strict=True)] if a[4] else None
    both = _texts(a) & _texts(b) if a[2] and b[2] else (set() if a[2] else _texts(a)) | (set() if b[2] else _texts(b))
    return [a[0], _text(both), a[2] and b[2], True, children, a[5] or b[5] or a[2] or b[2]]


def fold_repeats(nodes: list[list]) -> list[list]:
    """Runs of one node, then of two and three in a row, as repeated nodes."""
    for size in (1, 2, 3):
        out: list[list] = []
        i = 0
        while i < len(nodes):
            here = nodes[i : i + size]
            n = 1
            while [x[0] for x in nodes[i + n * size : i + (n + 1) * size]] == [x[0] for x in here]:
                here = [_row(x, y) for x, y in zip(here, nodes[i + n * size : i + (n + 1) * size], strict=True)]
                n += 1
            if n == 1 or len(here) < size:
                out.append(nodes[i])
                i += 1
                continue
            out.append([here[0][0], here[0][1], here[0][2], True, *here[0][4:]] if size == 1 else ["(" + " ".join(x[0] for x in here) + ")", None, all(x[2] for x in here), True, here, False])
            i += n * size
        nodes = out
    return nodes


def _table(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of a longest common subsequence, from the full table."""
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        row = np.where(y == x[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def _last_row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of x and each beginning of y: a row of the table is the bits of one number (Hyyrö, 2004)."""
    n = len(y)
    order = np.argsort(y, kind="stable")
    names, first = np.unique(y[order], return_index=True)
    masks: dict[int, int] = {}
    for c, at in zip(names.tolist(), np.split(order, first[1:]), strict=True):
        bits = np.zeros(n, np.uint8)
        bits[at] = 1
        masks[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    whole = (1 << n) - 1
    row = whole
    for c in x.tolist():
        if mask := masks.get(c):
            same = row & mask
            row = (row + same | row - same) & whole
    gone = np.unpackbits(np.frombuffer((row ^ whole).to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(gone, dtype=np.int64)]


def aligned(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of equal places of two sequences, in order.

    Equal ends are paired, then what occurs once in both, where that is in order.
    Between these a longest common subsequence is taken; where its table would be
    large it is halved (Hirschberg), so memory is linear in the page.
    """
    out: list[tuple[int, int]] = []
    work = [(0, len(x), 0, len(y), True)]
    while work:
        a, b, c, d, anchors = work.pop()
        n = min(b - a, d - c)
        if not n:
            continue
        lead = np.flatnonzero(x[a : a + n] != y[c : c + n])
        k = int(lead[0]) if len(lead) else n
        out += zip(range(a, a + k), range(c, c + k), strict=True)
        a, c, n = a + k, c + k, n - k
        if n:
            tail = np.flatnonzero(x[b - n : b][::-1] != y[d - n : d][::-1])
            k = int(tail[0]) if len(tail) else n
            out += zip(range(b - k, b), range(d - k, d), strict=True)
            b, d = b - k, d - k
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= CELLS:
            out += [(a + i, c + j) for i, j in _table(x[a:b], y[c:d])]
            continue
        if anchors:
            once = []
            for z, lo in ((x[a:b], a), (y[c:d], c)):
                names, first, count = np.unique(z, return_index=True, return_counts=True)
                once.append((names[count == 1], first[count == 1] + lo))
            both, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
            if len(both):
                at, to = once[0][1][i], once[1][1][j]
                order = np.argsort(at)
                at, to = at[order].tolist(), to[order].tolist()
                ends: list[int] = []  # longest increasing run of places in y
                piles: list[int] = []
                back = [-1] * len(to)
                for q, t in enumerate(to):
                    p = bisect_left(ends, t)
                    back[q] = piles[p - 1] if p else -1
                    ends[p : p + 1], piles[p : p + 1] = [t], [q]
                q, chain = piles[-1], []
                while q >= 0:
                    chain.append((at[q], to[q]))
                    q = back[q]
                out += chain
                before = (a - 1, c - 1)
                for p in [*reversed(chain), (b, d)]:
                    work.append((before[0] + 1, p[0], before[1] + 1, p[1], p != (b, d) or before != (a - 1, c - 1)))
                    before = p
                continue
        mid = (a + b) // 2
        total = _last_row(x[a:mid], y[c:d]) + _last_row(x[mid:b][::-1], y[c:d][::-1])[::-1]
        to = c + int(total.argmax())
        work += [(a, mid, c, to, False), (mid, b, to, d, False)]
    return sorted(out)


def merge(a: list[list], b: list[list]) -> list[list]:
    """Aligns two wrappers; what only one has becomes optional."""
    names = {name: i for i, name in enumerate({x[0]: None for x in [*a, *b]})}
    x, y = (np.array([names[node[0]] for node in nodes], np.int64) for nodes in (a, b))
    out, i, j = [], 0, 0
    for p, q in [*aligned(x, y), (len(a), len(b))]:
        out += [[*node[:2], True, *node[3:]] for node in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(_join(a[p], b[q]))
        i, j = p + 1, q + 1
    return fold_repeats(out)


def summed(a: dict[str, int], b: dict[str, int]) -> dict[str, int]:
    """The masses of two sets of pages as one, of all their containers: ``a`` with ``b`` added, so a page costs its own containers only."""
    for c, n in b.items():
        a[c] = a.get(c, 0) + n
    return a


def wrapper_of(found: list[tuple[str, str, int]]) -> list[list]:
    """The wrapper of one page."""
    return fold_repeats([_leaf(k, _mark(t)) for k, t, *_ in found])


def _host(url: str | None) -> str:
    rest = (url or "").split("://", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].lower()


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host among a partition's pages, with the masses of its containers."""
    own: dict[str, list] = {}
    for batch in batches:
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            found = blocks(page or "")
            host, new = _host(url), wrapper_of(found)
            if not new:  # a page without a text says nothing of the others
                continue
            if host in own:
                n, old, mass = own[host]
                # most pages of a host have the shape that is known already
                same = len(old) == len(new) and all(x[0] == y[0] for x, y in zip(old, new, strict=True))
                own[host] = [n + 1, [_join(x, y) for x, y in zip(old, new, strict=True)] if same else merge(old, new), summed(mass, masses(found))]
            else:
                own[host] = [1, new, masses(found)]
    part = TaskContext.get().partitionId()
    rows = list(own.items())
    yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([part % 256] * len(rows), pa.int32()), pa.array([n for _, (n, *_) in rows], pa.int64()), pa.array([json.dumps([w, m]) for _, (_, w, m) in rows], pa.string())], names=["host", "salt", "pages", "wrapper"])


def _merged(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table.column("wrapper").to_pylist(), table.column("pages").to_pylist(), strict=True))
    (whole, mass), pages = json.loads(rows[0][0]), rows[0][1]
    for text, n in rows[1:]:
        other, more = json.loads(text)
        whole, mass, pages = merge(whole, other), summed(mass, more), pages + n
    return pa.table({"host": table.column("host").slice(0, 1), "pages": pa.array([pages], pa.int64()), "wrapper": [json.dumps([whole, mass])]})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, pages, wrapper (JSON: nodes and masses) of a table (url, html)."""
    first = pages.select("url", "html").mapInArrow(_infer, "host string, salt int, pages long, wrapper string")
    kind = "host string, pages long, wrapper string"
    return first.groupBy("host", "salt").applyInArrow(_merged, kind).groupBy("host").applyInArrow(_merged, kind)


class Template:
    """What a wrapper says of its pages: the (key, text) of the host's own blocks, long texts as their hash, and the region.

    A block is the host's own if all pages have it and their other text differs.
    Headings and short blocks inside articles never are.
    """

    def __init__(self, nodes: list[list], mass: dict[str, int], pages: int):
        self.fixed: set[tuple[str, str]] = set()
        self.slots: set[str] = set()
        mass = dict(mass)
        lengths: list[tuple[str, int]] = []

        def walk(some: list[list], optional: bool) -> None:
            for node in some:
                name, maybe = node[0], optional or node[2]
                if node[4]:
                    walk(node[4], maybe)
                elif name[0] != "!":
                    if node[5] or maybe or not _texts(node):
                        self.slots.add(name)
                    if not maybe:
                        own = [t for t in _texts(node) if name[0] == "-" or t[0] == "\n" and not re.search(r"/h[1-6]$", name)]
                        self.fixed.update((name, t) for t in own)
                        lengths.extend((container(name[1:]), int(t[33:]) if t[0] == "\n" else len(t)) for t in own)

        walk(nodes, False)
        if not self.slots or pages < AGREE:
            self.fixed = set()
        else:
            for at, n in lengths:  # constants weigh nothing
                mass[at] = max(0, mass.get(at, 0) - n * pages)
        self.region = region_of(mass)

    def text(self, found: list[tuple[str, str, int]]) -> list[str] | None:
        """The texts of a page's blocks in the region; None if it has none there."""
        inside = [(k, t) for k, t, *_ in found if k[0] != "!" and (container(k[1:]) + "/").startswith(self.region + "/")]
        return [t for k, t in inside if (k, _mark(t)) not in self.fixed] if inside else None


def main_text(page: str | None, host: Template | None = None) -> str:
    """The main text of a page by its host's template, or by one of its own: blocks joined by empty lines."""
    found = blocks(page or "")
    texts = host.text(found) if host else None
    if texts is None:
        texts = Template(wrapper_of(found), masses(found), 1).text(found)
    return "\n\n".join(texts or [])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Template | None] = {}
    for batch in batches:
        texts = []
        for page, host, n, wrapper in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "pages", "wrapper")), strict=True):
            if host not in known:
                if len(known) > 10_000:
                    known.clear()
                known[host] = Template(*json.loads(wrapper), n) if wrapper else None
            texts.append(main_text(page, known[host]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text for every row of ``pages``.

    A null or empty html gives an empty text; a null url is a host of its own
    name, the empty one. Rows that repeat an id are read each for itself. Tags
    that are cut off at the end of a page are dropped, elements left open end
    with the page. White space (as Python's ``str.split`` has it) inside a block
    becomes one space. Containers of equal mass are told apart by name. Time and
    memory are linear in the length and depth of a page, but for the alignment of
    pages whose blocks hardly agree.
    """
    found = cut(wrappers(pages), "wrappers")
    host = F.lower(F.element_at(F.split(F.element_at(F.split(F.element_at(F.split(F.coalesce("url", F.lit("")), "://", 2), -1), "[/?#]", 2), 1), "@"), -1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    size = found.agg(F.sum(F.length("host") + F.length("wrapper") + 40)).first()[0] or 0
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        many = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(many, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "host", "pages", "wrapper").mapInArrow(_extract, "page_id long, url string, text string")
