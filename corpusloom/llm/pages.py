"""Main-text extraction by union-free wrappers of each host.

A page becomes a tree of the elements that hold text, with its texts as leaves. The wrapper of a host is such a tree too: a regular
expression over elements, constants and text slots in which nodes may be optional or repeated, without unions. Pages are aligned with it one
after another. Children of matching elements are paired in order, by dynamic programming over how alike they are; what has no partner turns
optional, equal neighbours fold into a repeated node, and a stretch whose shapes come again folds into a repeated group of optional
members. A text that nearly all pages of the host have in the same place is a constant, so that a notice and the paragraph after
it stay two nodes; every other text is a slot. Wrappers align like pages: tasks build partial ones, and these merge in rounds of
bounded size. The nodes carry what alignment learns: pages, characters, characters in links, and whether the text ever changes.

Slots are judged in the wrapper, once for each host (see judge), and a page's text is what lands in content slots when the page is matched to
the wrapper. A page with no text there, as its template is another one, is judged as a wrapper of its own.

Bounds: elements deeper than MAX_DEPTH belong to the one at that depth; a list of more than MAX_ITEMS nodes becomes one repeated group; a group of
more members tells elements by name only; a wrapper of more than MAX_NODES loses its deepest levels. All of these generalise, none drops a text.

Defined cases: null html has no text (empty string); a null url or one without :// belongs to the host with the empty name; unclosed
tags, cut-off pages and stray angle brackets are read as browsers do; repeated rows stay repeated; an empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_batches, broadcast_if_small, scratch, staged, table, unstage
from .urls import host_of

#: HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select button object canvas annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms msqrt mspace mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LABELS = HEADINGS | {"th", "dt", "figcaption", "legend", "caption"}  # a constant there names the texts after it
CELLS = frozenset("td th li dd".split())
LEAVES = frozenset("p dt ul ol dl figure blockquote pre figcaption".split()) | HEADINGS | CELLS
#: Elements that are something else than the article by their meaning, and a form, which hints at it as the words of class, id and role do.
ASIDE_TAGS = frozenset("nav footer aside head menu dialog".split())
HINT_TAGS = ASIDE_TAGS | {"form"}
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert advertisement advertising adsense adslot promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice alert banner popup modal overlay newsletter subscribe subscription signup login search form comment comments reply replies "
    "respond disqus discussion feedback related recommended recommendations share sharing social widget toolbar pagination pager skip copyright masthead contentinfo complementary".split()
)
HEADER_WORDS = frozenset(("header", "topbar"))

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
RAW_END = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in RAW}

MAX_DEPTH = 48
MAX_ITEMS = 40
MAX_NODES = 1500
MERGED_AT_ONCE = 64  # partial wrappers that one task merges for a host
HELD = 512  # wrappers that a task holds while it reads pages
CONSTANT_PAGES, CONSTANT_SHARE = 3, 0.8  # a text on so many different pages of a host, and on such a share of them, is a constant
LINKED = 0.7  # share of characters in links from which a list is a menu


def read_page(html: str) -> tuple[list[str], list[str]]:
    """A page as tokens ('+' and an element, '-' for its end, '#' and the characters in links for a text) and its texts in page order."""
    tokens: list[str] = []
    texts: list[str] = []
    stack: list[str] = []  # names of open elements
    open_names: dict[str, int] = {}
    parts: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                tokens.append(f"#{min(linked, len(text))}" if linked else "#")
                texts.append(text)
        linked = 0

    def pop() -> None:
        if len(stack) <= MAX_DEPTH:
            tokens.append("-")
        name = stack.pop()
        open_names[name] -= 1

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        piece = html[at:] if m is None else html[at : m.start()]
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if anchors:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if name in RAW:
            if not closing and not m[0].endswith("/>"):
                end = RAW_END[name].search(html, at)
                at = n if end is None else end.start()
            parts.append(" ")
            continue
        if name == "a":
            anchors = 0 if closing else 1
        attributes = m[3] or m[6] or ""
        words = sorted({w for x in MARKS.findall(attributes) for w in WORD.findall("".join(x).lower())}) if attributes and not closing and "=" in attributes else []
        if name in INLINE and not (closing and open_names.get(name)) and ASIDE_WORDS.isdisjoint(words):
            continue
        if name in VOID:
            parts.append(" ")
            if name == "hr":
                flush()
            continue
        flush()
        if closing:
            if open_names.get(name):
                while stack[-1] != name:
                    pop()
                pop()
            continue
        if name in CLOSES:
            while stack and stack[-1] in CLOSES[name] | {"p"}:
                pop()
        elif stack and stack[-1] == "p":
            pop()
        stack.append(name)
        open_names[name] = open_names.get(name, 0) + 1
        if len(stack) <= MAX_DEPTH:
            tokens.append("+" + ".".join([name, *words]))
    flush()
    while stack:
        pop()
    return tokens, texts


class Node:
    """An element, a repeated group ('()'), a text slot ('#') or a constant ('=' and its digest), with what alignment knows of it."""

    __slots__ = ("beside", "chars", "content", "digest", "fixed", "kids", "linked", "n", "opt", "rep", "shape", "sig", "template", "texts", "to")

    def __init__(self, sig: str) -> None:
        self.sig, self.kids, self.rep, self.opt = sig, [], False, False
        # pages; characters, those in links; pages that have an article elsewhere; the text's digest, or None as soon as it changes
        self.n, self.chars, self.linked, self.beside, self.digest = 1, 0, 0, 0, None
        self.shape: object = sig
        self.texts: list[int] = []  # of a page: the numbers of its texts here
        self.to: Node | None = None  # of a page: the wrapper's node
        self.content = self.fixed = False
        self.template: frozenset | None = None  # of a judged wrapper's root, see template_of

    def reshape(self) -> None:
        self.shape = (self.sig, frozenset(k.sig for k in self.kids)) if self.kids else self.sig


def name_of(sig: str) -> str:
    return sig.partition(".")[0]


def words_in(sig: str) -> list[str]:
    return sig.split(".")[1:]


def is_article(sig: str) -> bool:
    return name_of(sig) in ("article", "main") or not {"article", "main"}.isdisjoint(words_in(sig))


def is_marked(sig: str, inside: bool) -> bool:
    """Whether the element's name or words hint at something else than the article. inside: of an article."""
    name, words = name_of(sig), words_in(sig)
    return name in HINT_TAGS or not ASIDE_WORDS.isdisjoint(words) or not inside and (name == "header" or not HEADER_WORDS.isdisjoint(words))


_DIGEST = (1 << 64) - 1


def digests(tokens: list[str], texts: list[str]) -> list[int]:
    """For each text a digest of it and of the element around it."""
    out, path, i = [], [""], 0
    for t in tokens:
        if t[0] == "+":
            path.append(t)
        elif t == "-":
            path.pop()
        else:
            out.append(xxhash.xxh64_intdigest(f"{path[-1]}\n{texts[i]}"))
            i += 1
    return out


def tree(tokens: list[str], texts: list[str], constants: frozenset | set = frozenset()) -> Node:
    """The folded tree of a page; elements without text are left out."""
    root = Node("")
    stack, i = [root], 0
    marks = digests(tokens, texts)
    articles = depth = 0
    found = []
    for t in tokens:
        if t[0] == "+":
            stack.append(Node(t[1:]))
            depth += is_article(t[1:])
        elif t == "-":
            done = stack.pop()
            depth -= is_article(done.sig)
            if done.kids:
                fold(done)
                stack[-1].kids.append(done)
        else:
            leaf = Node(f"={marks[i]:x}" if marks[i] in constants else "#")
            leaf.chars, leaf.digest, leaf.linked, leaf.texts = len(texts[i]), marks[i], int(t[1:] or 0), [i]
            found.append((leaf, depth > 0))
            articles += depth > 0
            stack[-1].kids.append(leaf)
            i += 1
    if articles:
        for leaf, inside in found:
            leaf.beside = 0 if inside else 1
    fold(root)
    return root


def _join(a: Node, b: Node, same_page: bool) -> None:
    """b's facts join those of its partner a."""
    a.chars += b.chars
    a.linked += b.linked
    a.rep, a.opt = a.rep or b.rep, a.opt or b.opt
    if same_page:
        a.n, a.beside = max(a.n, b.n), max(a.beside, b.beside)
        a.digest = None if a.digest is None or b.digest is None else (a.digest * 0x9E3779B97F4A7C15 + b.digest) & _DIGEST
        a.texts += b.texts
    else:
        a.n, a.beside = a.n + b.n, a.beside + b.beside
        a.digest = a.digest if a.digest == b.digest else None


def merge(a: Node, b: Node, same_page: bool) -> None:
    """a becomes the wrapper of what a and b match; both are the same kind of node."""
    _join(a, b, same_page)
    if not b.kids:
        if not same_page:
            for k in a.kids:
                k.opt = True
        return
    if not a.kids:
        a.kids = b.kids
        for k in a.kids:
            k.opt = k.opt or not same_page
        a.reshape()
        return
    partner = pair(a.kids, b.kids)
    met, out, waiting = set(), [], {}
    # nodes without a partner go after the partner of the one before them
    last = -1
    for j, k in enumerate(b.kids):
        i = partner[j]
        if i is None:
            k.opt = True
            waiting.setdefault(last, []).append(k)
            continue
        last, w = i, a.kids[i]
        again = same_page or i in met
        if w.sig == "()" and k.sig != "()":
            _into_group(w, [k], again)
            w.n = max(w.n, w.n if i in met else w.n + (0 if same_page else k.n))
        elif k.sig == "()" and w.sig != "()":
            group = Node("()")
            group.rep, group.opt, group.n = True, w.opt or k.opt, w.n + (0 if again else k.n)
            _into_group(group, [w], True)
            _into_group(group, k.kids, again)
            a.kids[i] = group
        elif w.sig == "()":
            _into_group(w, k.kids, again)
            if not again:
                w.n += k.n
        else:
            w.rep = w.rep or i in met
            merge(w, k, again)
        met.add(i)
    out += waiting.get(-1, [])
    for i, w in enumerate(a.kids):
        w.opt = w.opt or i not in met
        out.append(w)
        out += waiting.get(i, [])
    a.kids = out
    fold(a)


def _into_group(group: Node, nodes: list[Node], same_page: bool) -> None:
    """nodes become members of a repeated group, which tells them by element; members are optional."""
    at = {m.sig: m for m in group.kids}
    seen = set()
    for k in nodes:
        m = at.get(k.sig) or (at.get(name_of(k.sig)) if len(group.kids) >= MAX_ITEMS else None)
        if m is None:
            k.opt = True
            group.kids.append(k)
            at[k.sig] = k
        else:
            if m.sig != k.sig:
                k.sig = m.sig
            merge(m, k, same_page or id(m) in seen)
        seen.add(id(at[k.sig]))
    if len(group.kids) > MAX_ITEMS:
        _by_name(group)
    group.reshape()


def _by_name(group: Node) -> None:
    """Members of a group with very many of them are told by name only, unknown names and constants not at all."""
    members, group.kids = group.kids, []
    known = VOID | INLINE | LEAVES | ASIDE_TAGS | {"div", "section", "article", "main", "ul", "ol", "dl", "table", "tbody", "thead", "tr", "header", "figure", "details", "center", "body", "html"}
    at: dict[str, Node] = {}
    for m in members:
        m.sig = "#" if m.sig[0] in "#=" else name_of(m.sig) if name_of(m.sig) in known else "div"
        if m.sig in at:
            merge(at[m.sig], m, True)
        else:
            at[m.sig] = m
            group.kids.append(m)


def fold(parent: Node) -> None:
    """Equal neighbours become one repeated node; a stretch whose shapes come again becomes a repeated group."""
    kids = parent.kids
    if len(kids) > 1:
        out = [kids[0]]
        for k in kids[1:]:
            last = out[-1]
            if k.shape == last.shape and k.sig != "()" and k.sig[0] != "=":
                merge(last, k, True)
                last.rep = True
            elif k.sig == "()" and last.sig == "()":
                _into_group(last, k.kids, True)
            else:
                out.append(k)
        kids = out
        if len(kids) > 3:
            spans = _again([k.shape for k in kids])
            if len(kids) > MAX_ITEMS and not spans:
                spans = [(0, len(kids))]
            if spans:
                out, at = [], 0
                for lo, hi in spans:
                    out += kids[at:lo]
                    group = Node("()")
                    group.rep, group.n = True, max(k.n for k in kids[lo:hi])
                    for k in kids[lo:hi]:
                        _into_group(group, k.kids if k.sig == "()" else [k], True)
                    out.append(group)
                    at = hi
                kids = out + kids[at:]
                if len(kids) > MAX_ITEMS:
                    group = Node("()")
                    group.rep, group.n = True, max(k.n for k in kids)
                    for k in kids:
                        _into_group(group, k.kids if k.sig == "()" else [k], True)
                    kids = [group]
        parent.kids = kids
    parent.reshape()


def _again(shapes: list) -> list[tuple[int, int]]:
    """Stretches to fold: from the first to the last of a shape that comes three times, or a unit that follows itself."""
    at: dict = {}
    for i, s in enumerate(shapes):
        at.setdefault(s, []).append(i)
    spans = []
    for s, places in at.items():
        if isinstance(s, str) and s[0] == "=":
            continue
        if len(places) >= 3:
            spans.append((places[0], places[-1] + 1))
        elif len(places) == 2:
            i, j = places
            if j - i > 1 and shapes[i:j] == shapes[j : 2 * j - i]:
                spans.append((i, 2 * j - i))
    spans.sort()
    out: list[tuple[int, int]] = []
    for lo, hi in spans:
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _alike(a: Node, b: Node) -> float:
    """How well two nodes pair, 0 if they can't."""
    if a.sig == b.sig:
        if a.sig == "()":
            x, y = {k.sig for k in a.kids}, {k.sig for k in b.kids}
            return 2 * len(x & y) / len(x | y)
        if a.sig[0] in "#=":
            return 1.0 if a.sig == "#" else 2.0
        if a.shape == b.shape:
            return 2.0
        x, y = a.shape[1], b.shape[1]
        return 1.0 + len(x & y) / len(x | y)
    if a.sig == "()" or b.sig == "()":
        group, one = (a, b) if a.sig == "()" else (b, a)
        return 0.75 if any(k.sig == one.sig for k in group.kids) else 0.0
    # a page's text where the wrapper has a slot, and elements that were generalised to their name
    if a.sig[0] in "#=" or b.sig[0] in "#=":
        return 0.25 if a.sig == "#" and b.sig[0] == "=" else 0.0
    return 0.5 if a.sig == name_of(b.sig) else 0.0


def pair(a: list[Node], b: list[Node]) -> list[int | None]:
    """For each node of b its partner's place in a, in order; repeated nodes and groups may have several."""
    if len(a) == len(b) and all(x.shape == y.shape for x, y in zip(a, b)):
        return list(range(len(b)))
    n, m = len(a), len(b)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    came = [bytearray(m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        x, row, up, how = a[i - 1], best[i], best[i - 1], came[i]
        many = x.rep
        for j in range(1, m + 1):
            y = b[j - 1]
            top, k = up[j], 1  # a's node has no partner
            if row[j - 1] > top:
                top, k = row[j - 1], 2
            s = _alike(x, y)
            if s:
                if up[j - 1] + s > top:
                    top, k = up[j - 1] + s, 3
                if many and row[j - 1] + s > top:
                    top, k = row[j - 1] + s, 4
                if y.sig == "()" and up[j] + s > top:
                    top, k = up[j] + s, 5
            row[j], how[j] = top, k
    out: list[int | None] = [None] * m
    i, j = n, m
    while i and j:
        k = came[i][j]
        if k == 1:
            i -= 1
        elif k == 2:
            j -= 1
        else:
            if out[j - 1] is None or k != 5:
                out[j - 1] = i - 1
            if k == 3:
                i, j = i - 1, j - 1
            elif k == 4:
                j -= 1
            else:
                i -= 1
    return out


def match(wrapper: Node, page: Node) -> None:
    """Give every node of the page's tree the wrapper's node it lands in."""
    todo = [(wrapper, page)]
    while todo:
        w, p = todo.pop()
        p.to = w
        if not p.kids:
            continue
        if not w.kids:
            if w.sig[:1] not in ("#", "="):
                continue
        if w.sig == "()" and p.sig == "()":
            _members(w, p.kids, todo)
            continue
        for k, i in zip(p.kids, pair(w.kids, p.kids)):
            if i is None:
                continue
            x = w.kids[i]
            if x.sig == "()":
                if k.sig == "()":
                    k.to = x
                _members(x, k.kids if k.sig == "()" else [k], todo)
            elif k.sig == "()":
                k.to = x
                todo += [(x, y) for y in k.kids if _alike(x, y)]
            else:
                todo.append((x, k))


def _members(group: Node, nodes: list[Node], todo: list) -> None:
    at = {m.sig: m for m in group.kids}
    for k in nodes:
        leaf = k.sig[0] in "#="
        m = at.get(k.sig) or at.get("#" if leaf else name_of(k.sig)) or (None if leaf else at.get("div"))
        if m is not None:
            todo.append((m, k))


def every(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += reversed(x.kids)


def bounded(root: Node) -> Node:
    """root without its deepest levels if it has more than MAX_NODES: what is in them belongs to the level above."""
    deepest = MAX_DEPTH
    while deepest > 2 and sum(1 for _ in every(root)) > MAX_NODES:
        deepest = deepest * 3 // 4
        level = [root]
        for _ in range(deepest):
            level = [k for x in level for k in x.kids]
        for x in level:
            leaves = [k for k in every(x) if not k.kids]
            if x.kids and x.kids != leaves:
                x.kids = leaves[:1]
                x.kids[0].sig = x.kids[0].shape = "#"
                x.kids[0].rep = True
                for k in leaves[1:]:
                    _join(x.kids[0], k, True)
                x.reshape()
    return root


def packed(node: Node) -> list:
    """The wrapper as nested lists."""
    return [node.sig, int(node.rep) | int(node.opt) << 1 | int(node.content) << 2 | int(node.fixed) << 3, node.n, node.chars, node.linked, node.beside, node.digest, [packed(k) for k in node.kids]]


def unpacked(row: list) -> Node:
    x = Node(row[0])
    x.rep, x.opt, x.content, x.fixed = bool(row[1] & 1), bool(row[1] & 2), bool(row[1] & 4), bool(row[1] & 8)
    x.n, x.chars, x.linked, x.beside, x.digest = row[2:7]
    x.kids = [unpacked(k) for k in row[7]]
    x.reshape()
    return x


def pattern(node: Node) -> str:
    """The wrapper as a regular expression over tags, constants ('=') and text slots ('#'), for people."""
    inner = "".join(map(pattern, node.kids))
    if node.sig == "()" or not node.sig:
        out = f"({inner})" if node.sig else inner
    elif node.sig[0] in "#=":
        out = node.sig[0]
    else:
        out = f"<{node.sig}>{inner}</>"
    if not (node.rep or node.opt):
        return out
    out = out if node.sig in ("#", "()") else f"({out})"
    return out + ("*" if node.rep and node.opt else "+" if node.rep else "?")


def judge(root: Node) -> list[Node]:
    """Set content on the nodes of a wrapper that hold the article, and fixed on texts that never change; returns the content slots.

    The article is the region of elements named article (else main) with the fewest hints of something else at them and around them. Where there is no such
    element it is found by what alignment knows: constants and slots whose text never changes on three pages or more
    are template, and the region is the innermost element that holds most of the text that changes. Inside the region elements with hints, and
    outside of an article lists of links, are left out unless they hold most of the region's text that changes; ASIDE_TAGS always are. Constants in the region
    are template too, as notices and adverts that every page repeats; only headings and labels between changing texts stay, and all where nothing changes, or less of an article than stays.
    """
    for x in every(root):
        if not x.kids:
            # a constant of the host is one wherever it stands
            x.fixed = x.sig.startswith("=") or x.n >= CONSTANT_PAGES and x.digest is not None
        x.content = False
    slots = [x for x in every(root) if not x.kids]
    steady = all(x.fixed for x in slots)
    if not steady:
        mass_of = lambda x: 0 if x.fixed else x.chars
    else:
        mass_of = lambda x: x.chars
    # bottom-up sums and top-down hints, without recursion
    order = list(every(root))
    mass: dict[int, int] = {}
    for x in reversed(order):
        mass[id(x)] = sum(mass[id(k)] for k in x.kids) if x.kids else mass_of(x)
    articles: list[tuple[int, int, Node]] = []  # hints at it and around it, its place, the element
    todo: list[tuple[Node, int, bool]] = [(root, 0, False)]
    place = 0
    while todo:
        x, hints, inside = todo.pop()
        place += 1
        if x.sig and x.sig != "()" and x.sig[0] not in "#=":
            hints += is_marked(x.sig, inside)
            if is_article(x.sig) and any(k.chars for k in every(x) if not k.kids):
                articles.append((hints, place, x))
            inside = inside or is_article(x.sig)
        todo += [(k, hints, inside) for k in reversed(x.kids)]
    if articles:
        least = min(h for h, _, _ in articles)
        best = [x for h, _, x in articles if h == least]
        named = [x for x in best if name_of(x.sig) == "article" or "article" in words_in(x.sig)]
        regions = named or best
        within = {id(k) for x in regions for k in every(x) if k is not x}
        regions = [x for x in regions if id(x) not in within]
    else:
        regions = [_heaviest(root, mass)]
    found: list[Node] = []
    for region in regions:
        whole = mass[id(region)]
        walk = [(k, False) for k in reversed(region.kids)]
        out: list[Node] = []
        template: set[int] = set()  # constants that are no labels
        while walk:
            x, heading = walk.pop()
            element = x.sig != "()" and x.sig[0] not in "#="
            if element and name_of(x.sig) in ASIDE_TAGS:
                continue
            aside = element and is_marked(x.sig, bool(articles)) or not articles and _is_menu(x)
            if aside and 2 * mass[id(x)] <= whole:
                continue
            if x.kids:
                x.content = True
                walk += [(k, name_of(x.sig) in LABELS if element else heading) for k in reversed(x.kids)]
            else:
                out.append(x)
                if x.fixed and not heading:
                    template.add(id(x))
        # an article of which more stays than changes is one that pages copy from each other, not their template
        copied = bool(articles) and sum(x.chars for x in out if x.fixed) > sum(x.chars for x in out if not x.fixed)
        if not steady and whole and not copied:
            out = [x for x in out if id(x) not in template]
            # a constant heading before the first or after the last text that changes is template
            moving = [i for i, x in enumerate(out) if not x.fixed]
            out = out[moving[0] : moving[-1] + 1] if moving else []
        region.content = True
        found += out
    for x in found:
        x.content = True
    return found


def _is_menu(x: Node) -> bool:
    """A repeated list whose text is mostly links."""
    leaves = [k for k in every(x) if not k.kids]
    chars = sum(k.chars for k in leaves)
    return bool(x.kids) and any(k.rep for k in every(x)) and sum(k.linked for k in leaves) >= LINKED * chars > 0


def _heaviest(root: Node, mass: dict[int, int]) -> Node:
    """The innermost element with most of the changing text, leaving out lighter branches with hints and menus."""
    def aside(k: Node) -> bool:
        return name_of(k.sig) in ASIDE_TAGS or (is_marked(k.sig, False) or _is_menu(k)) and 2 * mass[id(k)] <= whole

    x, whole = root, mass[id(root)]
    while True:
        kids = [m for k in x.kids for m in (k.kids if k.sig == "()" else [k])]
        left = [k for k in kids if not (k.kids and aside(k))]
        top = max((k for k in left if k.kids), key=lambda k: mass[id(k)], default=None)
        if top is None or not mass[id(top)] or mass[id(top)] < 0.6 * sum(mass[id(k)] for k in left):
            return x
        name = name_of(top.sig)
        if (top.rep or top not in x.kids) and not any(k.kids for k in top.kids):
            return x  # repeated blocks of text are paragraphs, whatever their name
        if name in LEAVES and not (name in CELLS and any(k.kids for k in top.kids)):
            return x
        x = top


def own_text(page: Node) -> list[Node]:
    """The content nodes of a page that has no text in its host's content slots."""
    for x in every(page):
        if not x.kids:
            known = x.to is not None and x.to.fixed
            if known and x.to.beside:
                x.chars = x.linked = 0  # template beside articles: no page's article
            x.n, x.digest = (CONSTANT_PAGES, x.digest or 0) if known else (1, x.digest)
    return [x for x in judge(page) if x.chars]


def template_of(wrapper: Node) -> frozenset:
    """The constants that are no content anywhere in a judged wrapper: a page may have them at a place where alignment took them for one of many paragraphs."""
    if wrapper.template is None:
        constants = [x for x in every(wrapper) if not x.kids and x.sig.startswith("=")]
        wrapper.template = frozenset(x.sig for x in constants) - {x.sig for x in constants if x.content}
    return wrapper.template


def extract(wrapper: Node | None, constants: set, tokens: list[str], texts: list[str]) -> str:
    """The text of one page."""
    page = tree(tokens, texts, constants)
    if wrapper is not None:
        match(wrapper, page)
    template = template_of(wrapper) if wrapper is not None else frozenset()
    chosen = []
    todo: list[tuple[Node, bool]] = [(page, False)]
    while todo:
        x, inside = todo.pop()
        if x.to is not None and x.to.sig != "":
            inside = x.to.content  # what has no node of its own goes with what is around it
        if x.kids:
            todo += [(k, inside) for k in x.kids]
        elif inside and x.sig not in template:
            chosen += x.texts
    if not chosen:
        chosen = [i for x in own_text(page) for i in x.texts]
    return "\n\n".join(texts[i] for i in sorted(chosen))


READ = "tokens string, texts string, digests array<long>, page long"


def _split(column: str | None) -> list[str]:
    return column.split("\n") if column else []


def read_pages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Tokens and texts of each page, one a line; the digests of its texts, each once, and one of the whole page."""
    for pages in batches:
        rows = []
        for html in pages:
            tokens, texts = read_page(html)
            seen = sorted({d - (1 << 63) for d in digests(tokens, texts)})
            rows.append(("\n".join(tokens), "\n".join(texts), seen, xxhash.xxh64_intdigest("\n".join(texts)) - (1 << 63)))
        yield pd.DataFrame(rows, columns=["tokens", "texts", "digests", "page"])


def constants_of(seen: DataFrame) -> DataFrame:
    """(host, constants) of (host, digests, page): what CONSTANT_SHARE of a host's different pages have, and at least CONSTANT_PAGES."""
    pages = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= CONSTANT_PAGES)
    each = seen.select("host", "page", F.explode("digests").alias("digest")).distinct().groupBy("host", "digest").agg(F.count("*").alias("n")).filter(F.col("n") >= CONSTANT_PAGES)
    # a page has few texts, so at most its texts over CONSTANT_SHARE of them are constants
    return each.join(pages, "host").filter(F.col("n") >= CONSTANT_SHARE * F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_list("digest")).alias("constants"))


def dumps(wrapper: Node) -> str:
    return json.dumps(packed(wrapper), separators=(",", ":"))


def loads(text: str) -> Node:
    return unpacked(json.loads(text))


def _numbers(constants) -> set:
    return {int(d) + (1 << 63) for d in constants} if constants is not None else set()


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial wrappers of the pages of a task, one for each host and each HELD hosts."""
    held: dict[str, Node] = {}
    known: dict[str, set] = {}

    def out() -> pd.DataFrame:
        rows = pd.DataFrame({"host": list(held), "wrapper": [dumps(bounded(w)) for w in held.values()]})
        held.clear()
        known.clear()
        return rows

    for rows in batches:
        for host, constants, tokens, texts in zip(rows["host"], rows["constants"], rows["tokens"], rows["texts"]):
            if host not in known:
                if len(held) >= HELD:
                    yield out()
                known[host] = _numbers(constants)
            page = tree(_split(tokens), _split(texts), known[host])
            if host in held:
                merge(held[host], page, False)
            else:
                held[host] = page
    if held:
        yield out()


def _merge_group(rows: pd.DataFrame) -> pd.DataFrame:
    wrapper = None
    for s in sorted(rows["wrapper"], key=lambda s: (-len(s), s)):
        if wrapper is None:
            wrapper = loads(s)
        else:
            merge(wrapper, loads(s), False)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [dumps(bounded(wrapper))]})


def infer_wrappers(partial: DataFrame) -> DataFrame:
    """(host, wrapper), one row for each host, of (host, wrapper) rows in any number: merged in rounds of at most about MERGED_AT_ONCE."""
    current = staged(partial, "wrappers")
    while True:
        most = current.groupBy("host").count().agg(F.max("count").alias("m")).first()["m"] or 0
        if most <= 1:
            return current
        # the wrapper's hash deals even a hot host out evenly; equal wrappers that meet are few, as they carry counts
        parts = -(-most // MERGED_AT_ONCE)
        merged = current.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(parts)).alias("part")).applyInPandas(lambda rows: _merge_group(rows), "host string, wrapper string")
        after = staged(merged, "wrappers")
        unstage(current)
        current = after


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for text in rows["wrapper"]:
            wrapper = loads(text)
            judge(wrapper)
            out.append((pattern(wrapper), dumps(wrapper)))
        yield pd.DataFrame({"host": rows["host"], "pattern": [p for p, _ in out], "wrapper": [w for _, w in out], "constants": rows["constants"]})


def host_wrappers(seen: DataFrame) -> DataFrame:
    """(host, pattern, wrapper, constants) of read pages: the judged wrapper of each host, and as an expression."""
    constants = staged(constants_of(seen.select("host", "digests", "page")), "constants")
    size = constants.agg(F.count("*").alias("n"), F.sum(F.size("constants")).alias("c")).first()
    small = F.broadcast(constants) if size["n"] * 64 + (size["c"] or 0) * 8 <= BROADCAST_BYTES else constants
    rows = seen.select("host", "tokens", "texts").join(small, "host", "left")
    partial = rows.mapInPandas(_partial, "host string, wrapper string")
    wrappers = infer_wrappers(partial).join(small, "host", "left")
    return staged(wrappers.mapInPandas(_judge, "host string, pattern string, wrapper string, constants array<long>"), "judged")


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars for every row of pages."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    with scratch() as keep:
        seen = keep(staged(rows.select("key", "url", "host", F.pandas_udf(read_pages, READ)("html").alias("p")).select("key", "url", "host", "p.*"), "read"))
        wrappers = keep(host_wrappers(seen)).select("host", "wrapper", "constants")
    size = wrappers.agg(F.sum(F.length("host") + F.length("wrapper") + 64 + F.coalesce(F.size("constants"), F.lit(0)) * 8).alias("b")).first()["b"] or 0
    joined = seen.select("key", "url", "host", "tokens", "texts").join(broadcast_if_small(wrappers, size, 1), "host", "left")

    def read(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        held: dict[str, tuple[Node | None, set]] = {}
        for hosts, wrapper, constants, tokens, texts in batches:
            out = []
            for h, w, c, k, t in zip(hosts, wrapper, constants, tokens, texts):
                if h not in held:
                    if len(held) >= HELD:
                        held.clear()
                    held[h] = (loads(w) if w is not None else None, _numbers(c))
                out.append(extract(*held[h], _split(k), _split(t)))
            yield pd.Series(out, dtype=object)

    text = F.pandas_udf(read, "string")("host", "wrapper", "constants", "tokens", "texts")
    return joined.select(F.col("key").alias(key), "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
