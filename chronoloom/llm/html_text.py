"""Main text of web pages by wrapper induction over pages of one host.

A few reference pages of each host and layout are aligned, whole, by simple tree matching: the largest set of node pairs that
keeps parents, order and labels. Text that is equal in the aligned nodes is template and is kept in the wrapper; a page is
aligned with its wrapper, template text goes, and what is left are varying slots and nodes that the wrapper does not know.
The wrapper also tells whether the articles or main parts of its host hold most of what varies; only then is a page cut
down to them. Menus, headers, footers, sidebars, adverts, forms and comments that vary from page to page look like content to
any alignment: among what is left, these alone are told by tag, role and class.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Generator, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Fixed values of HTML: elements without content, with raw text, of inline flow.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: A start tag of these closes an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
#: A start tag closes an open element of the same kind of item.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that are no text of the page; parts of a page that are never main text.
NO_TEXT = frozenset("script style noscript template button select textarea input iframe svg canvas object head title".split())
CHROME_TAGS = frozenset("nav footer aside menu dialog".split())
#: Words of a class or id that name a part beside the main text; the second list does not count inside an article, where it may name the title.
CHROME = frozenset(
    "ad ads adsense adslot adv advert advertisement advertisements advertising adverts breadcrumb breadcrumbs comment commentlist comments consent cookie "
    "cookies disqus gdpr hidden login menu menus modal nav navbar navigation newsletter notice notices popup promo promos promotion promotions "
    "recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar "
    "widget widgets".split()
)
CHROME_OUTSIDE = frozenset("banner footer header masthead side".split())
#: Words that may stand beside these without telling of a subject ("related-posts" is a list of links, "related-work" a chapter).
BESIDE = frozenset(
    "alert area article articles aside bar bars blog block body bottom box btn button buttons center col column container content count desktop entry "
    "field fixed float form global google group head holder icon icons inner item items label left link links list lists main media middle mini mobile "
    "module news outer page pages panel popular post posts primary reader readers right row secondary section site slot stories sticky sub thread title "
    "to top unit user users visually wrap wrapper zone".split()
)
_WORDS = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![a-z])")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Possessive: a tag is read once from front to back, whatever it holds.
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
#: Structure by which the pages of a host are told apart before they are parsed.
LAYOUT = ("<article", "<main", "<section", "<aside", "<header", "<table")
#: References that must hold a node, and agree on its text, before the text counts as template.
AGREE, LEAST = 0.8, 3
#: References that share so much of their text, and of the words of the rest, are copies of one page: one of them counts.
COPY, EDIT = 0.8, 0.6
#: Marks of blocks: never main text; by a word of class or id; a form; an article or main part.
CHROME_PART, NAMED, FORM, PART = 1, 2, 3, 4
#: Elements that a block may enclose, as bits.
_HELD = {"article": 1, "main": 2, "h1": 4, "nav": 8, "header": 8, "footer": 8}
#: Cells of an alignment table that are held at once; longer lists are halved, with the same result.
CELLS = 1 << 22


class Block:
    """A block element: its runs of text and child blocks in page order. Inline elements are part of the runs."""

    __slots__ = ("label", "items", "shape", "text", "mark", "held")

    def __init__(self, label: str, mark: int = 0, held: int = 0):
        self.label, self.shape, self.text, self.mark, self.held = label, -1, 0, mark, held
        self.items: list[str | Block] = []

    def kids(self) -> list[Block]:
        return [x for x in self.items if isinstance(x, Block)]

    def runs(self) -> list[str]:
        return [x for x in self.items if isinstance(x, str)]


def _tokens(source: str) -> Generator[tuple[str, str, str, str, int], int | None, None]:
    """(text before, "/" or "", tag, attributes, place behind) of each tag, the last with an empty tag; linear in the source.

    A place that is sent in is where reading goes on.
    """
    at, held, last = 0, [], source.rfind(">")
    while True:
        start = source.find("<", at)
        if start < 0 or start > last:
            break
        held.append(source[at:start])
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = len(source) if end < 0 else end + 3
            continue
        if source[start + 1 : start + 2] in ("!", "?"):
            at = source.find(">", start) + 1
            continue
        match = _TAG.match(source, start + 1)
        if not match and re.match("/?[a-zA-Z]", source[start + 1 : start + 3]):
            match = _TAG.match(source[start + 1 : source.find(">", start) + 1].replace('"', " ").replace("'", " "))  # a quote that never ends
            at = source.find(">", start) + 1
        elif match:
            at = match.end()
        else:
            held.append("<")
            at = start + 1
            continue
        at = (yield "".join(held), match[1], match[2].lower(), match[3], at) or at
        held = []
    yield "".join(held) + source[at:], "", "", "", len(source)


@lru_cache(4096)
def named_chrome(names: str, inside: bool) -> bool:
    """Whether a class or id names a part beside the main text: by words that name such parts, with none that names a subject."""
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        told = [w in CHROME or not inside and w in CHROME_OUTSIDE for w in words]
        if any(told) and all(t or len(w) == 1 or w in BESIDE or w in CHROME_OUTSIDE for t, w in zip(told, words, strict=True)):
            return True
    return False


def page_blocks(source: str) -> Block:
    """The blocks of a whole page, marked by what their tag, role or class tells. Never fails on broken markup, whatever its depth."""
    root, line = Block("#root"), []
    # Open elements: tag, block that takes text and children (None where text is none of the page), whether it is inside an article.
    stack: list[tuple[str, Block | None, bool]] = [("#root", root, False)]
    open_tags: Counter = Counter()

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text and stack[-1][1] is not None:
            stack[-1][1].items.append(text)

    def close(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1][0] not in INLINE:
                flush()
            open_tags[stack[-1][0]] -= 1
            stack.pop()

    tokens = _tokens(source)
    token = next(tokens)
    while True:
        text, closing, tag, rest, after = token
        if text and stack[-1][1] is not None:
            line.append(entities.unescape(text))
        if not tag:
            break
        token = None
        if closing:
            if open_tags[tag] > 0:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
        else:
            closes = ("p",) if tag in CLOSES_P else SIBLINGS.get(tag, ())
            if any(open_tags[c] > 0 for c in closes):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in closes:
                        close(depth)
                        break
                    if stack[depth][0] not in INLINE and stack[depth][0] != "p":
                        break
            marks = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
            _, into, inside = stack[-1]
            here = inside or tag in ("article", "main")
            mark = PART if tag in ("article", "main") else CHROME_PART if tag in CHROME_TAGS or tag == "header" and not inside else FORM if tag == "form" else 0
            if marks and not mark and tag not in ("body", "html"):
                if marks.get("role", "").lower() in _ROLES:
                    mark = CHROME_PART
                elif named_chrome(" ".join(v for k, v in marks.items() if k != "role"), inside):
                    mark = NAMED
            block = None if tag in NO_TEXT or mark and tag in INLINE else into
            if tag == "br" and into is not None:
                line.append(" ")
            if tag not in INLINE:
                flush()
                if block is not None:
                    kept = [c for c in marks.get("class", "").split() if not any(x.isdigit() for x in c)]
                    block = Block(".".join([tag, *kept]), mark, _HELD.get(tag, 0))
                    into.items.append(block)
            if tag in RAW:
                end = _RAW_END[tag].search(source, after)
                token = tokens.send(end.end() if end else len(source))
            elif tag not in VOID and not rest.rstrip().endswith("/"):
                stack.append((tag, block, here))
                open_tags[tag] += 1
        token = token or next(tokens)
    close(1)
    flush()
    return root


def preorder(root: Block) -> list[Block]:
    order, stack = [], [root]
    while stack:
        order.append(node := stack.pop())
        stack += reversed(node.kids())
    return order


def slots(root: Block) -> list[tuple[str, bool]]:
    """(text, whether it is in an article or main part) in page order, of all that no mark takes out.

    A form around an article, main part, main heading, header, menu or footer is the frame of the page and no form. A part that
    is named like a menu or an advert, yet encloses the main part or the only article, stays as well.
    """
    order = preorder(root)
    lone = sum(node.label.split(".", 1)[0] == "article" for node in order) == 1
    for node in reversed(order):
        for kid in node.kids():
            node.held |= kid.held
    out, stack = [], [(iter(root.items), False)]
    while stack:
        items, inside = stack[-1]
        for item in items:
            if isinstance(item, str):
                out.append((item, inside))
                continue
            frame = item.mark == FORM and item.held or item.mark == NAMED and (item.held & 2 or lone and item.held & 1)
            if item.mark in (0, PART) or frame:
                stack.append((iter(item.items), inside or item.mark == PART))
                break
        else:
            stack.pop()
    return out


def texts(block: Block) -> Iterator[str]:
    """Runs of text in page order."""
    stack = [iter(block.items)]
    while stack:
        for item in stack[-1]:
            if isinstance(item, str):
                yield item
            else:
                stack.append(iter(item.items))
                break
        else:
            stack.pop()


class Shapes:
    """Numbers for trees of labels, equal for equal trees, and largest matchings of pairs of them, each found once."""

    def __init__(self):
        self.of: dict[tuple, int] = {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def number(self, root: Block, own: Callable[[Block], list[str]] = Block.runs) -> None:
        """Set the shape of each node, and a number for the text below it, 0 for none; ``own`` gives the runs of a node."""
        order, stack = [], [root]
        while stack:
            order.append(node := stack.pop())
            stack += node.kids()
        for node in reversed(order):
            key = (node.label, *(k.shape for k in node.kids()))
            if key not in self.of:
                self.of[key] = len(self.label)
                self.label.append(node.label)
                self.kids.append(key[1:])
                self.size.append(1 + sum(self.size[k] for k in key[1:]))
            node.shape = self.of[key]
            said = (*sorted(own(node)), *(k.text for k in node.kids() if k.text))
            node.text = hash(said) or 1 if said else 0

    def matching(self, a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        """(pairs of nodes in the largest matching of two shapes of one label, the pairs of children in it)."""
        stack = [(a, b)]
        while stack:
            x, y = stack[-1]
            if (x, y) in self.known:
                stack.pop()
                continue
            mine, other = self.kids[x], self.kids[y]
            first = 0
            while first < min(len(mine), len(other)) and mine[first] == other[first]:
                first += 1
            last = 0
            while last < min(len(mine), len(other)) - first and mine[-1 - last] == other[-1 - last]:
                last += 1
            # Equal trees at both ends are matched as a whole: nothing can match them better.
            left, right = mine[first : len(mine) - last], other[first : len(other) - last]
            pairs = [(p, q) for p in set(left) for q in set(right) if self.label[p] == self.label[q] and p != q]
            open_ = [pair for pair in pairs if pair not in self.known]
            if open_:
                stack += open_
                continue
            middle = self._aligned(left, right) if left and right else []
            kept = [(i, i) for i in range(first)] + [(first + i, first + j) for i, j in middle] + [(len(mine) - i, len(other) - i) for i in range(last, 0, -1)]
            self.known[x, y] = 1 + sum(self.weight(mine[i], other[j]) for i, j in kept), kept
            stack.pop()
        return self.known[a, b]

    def weight(self, a: int, b: int) -> int:
        return self.size[a] if a == b else self.known[a, b][0] if self.label[a] == self.label[b] else 0

    def _aligned(self, left: Sequence[int], right: Sequence[int]) -> list[tuple[int, int]]:
        """Increasing pairs of places of the largest total weight."""
        ours, i = np.unique(np.array(left), return_inverse=True)
        theirs, j = np.unique(np.array(right), return_inverse=True)
        weights = np.array([[self.weight(a, b) for b in theirs.tolist()] for a in ours.tolist()], np.int64)
        return heaviest(weights, np.stack([i, np.zeros_like(i)], 1), np.stack([j, np.zeros_like(j)], 1))

    def children(self, a: Block, b: Block) -> list[tuple[Block, Block]]:
        """Pairs of children in a largest matching of two nodes; of several, one with the most pairs of equal text."""
        mine, other = a.kids(), b.kids()
        if a.shape == b.shape:
            return list(zip(mine, other, strict=True))
        self.matching(a.shape, b.shape)
        alike = lambda p, q: p.shape == q.shape and p.text == q.text
        first = last = 0
        while first < min(len(mine), len(other)) and alike(mine[first], other[first]):
            first += 1
        while last < min(len(mine), len(other)) - first and alike(mine[-1 - last], other[-1 - last]):
            last += 1
        left, right = mine[first : len(mine) - last], other[first : len(other) - last]
        middle = []
        if left and right:
            ours, i = np.unique([k.shape for k in left], return_inverse=True)
            theirs, j = np.unique([k.shape for k in right], return_inverse=True)
            for p in ours.tolist():
                for q in theirs.tolist():
                    if p != q and self.label[p] == self.label[q]:
                        self.matching(p, q)
            weights = np.array([[self.weight(p, q) for q in theirs.tolist()] for p in ours.tolist()], np.int64)
            middle = heaviest(weights * (min(len(left), len(right)) + 1), np.stack([i, [k.text for k in left]], 1), np.stack([j, [k.text for k in right]], 1))
        return [*zip(mine[:first], other[:first], strict=True), *[(left[p], right[q]) for p, q in middle], *zip(mine[len(mine) - last :], other[len(other) - last :], strict=True)]


def _rows(weights: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
    """Best total weights of the first rows with each number of first columns, row by row."""
    row = np.zeros(len(right) + 1, np.int64)
    yield row
    for i, text in left:
        made = np.zeros(len(right) + 1, np.int64)
        gain = weights[i][right[:, 0]]
        if text:
            gain = gain + ((right[:, 1] == text) & (gain > 0))
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gain), out=made[1:])
        yield (row := made)


def heaviest(weights: np.ndarray, left: np.ndarray, right: np.ndarray, up: int = 0, over: int = 0) -> list[tuple[int, int]]:
    """Increasing pairs of places of the largest total weight, of lists of (row or column of ``weights``, text).

    Equal texts other than 0 add one to the weight of a pair.
    """
    if not len(left) or not len(right):
        return []
    if len(left) > 1 and len(left) * len(right) > CELLS:
        half = len(left) // 2
        *_, top = _rows(weights, left[:half], right)
        *_, low = _rows(weights, left[half:][::-1], right[::-1])
        cut = int(np.argmax(top + low[::-1]))
        return heaviest(weights, left[:half], right[:cut], up, over) + heaviest(weights, left[half:], right[cut:], up + half, over + cut)
    best = list(_rows(weights, left, right))
    i, j, out = len(left), len(right), []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((up + i, over + j))
    return out[::-1]


def matched(shapes: Shapes, a: Block, b: Block, into: Callable[[Block], bool] = lambda node: True) -> Iterator[tuple[Block, Block]]:
    """The pairs of nodes of a largest matching of two numbered trees, parents before children; below nodes of ``a`` that ``into`` names."""
    stack = [(a, b)] if a.label == b.label else []
    while stack:
        x, y = stack.pop()
        yield x, y
        if into(x):
            stack += shapes.children(x, y)


def copies(a: Counter, b: Counter) -> bool:
    """Whether two pages, as counted runs of text, are copies: most is equal, and the rest is next to nothing or an edit of the other's rest.

    Pages of one host may share more than they have of their own; only what they do not share tells whether they differ.
    """
    length = lambda said: sum(len(t) * n for t, n in said.items())
    size, alike = max(length(a), length(b), 1), length(a & b)
    if alike < COPY * size:
        return False
    words = lambda said: Counter(w for t, n in said.items() for w in t.split() * n)
    mine, other = words(a - b), words(b - a)
    return size - alike <= (1 - COPY) * size / 4 or (mine & other).total() >= EDIT * max(mine.total(), other.total())


def different(trees: list[Block]) -> list[Block]:
    """The trees without copies of earlier ones."""
    kept: list[tuple[Block, Counter]] = []
    for tree in trees:
        said = Counter(texts(tree))
        if not any(copies(said, other) for _, other in kept):
            kept.append((tree, said))
    return [tree for tree, _ in kept]


def induce(pages: list[str]) -> str | None:
    """The wrapper of reference pages as JSON; None where they are too few to tell template from content, or tell nothing.

    Nodes of the smallest page that most references hold: labels, places of the parents, and the template text of each.
    ``parts``: whether articles and main parts hold most of the text that varies (null: there are none).
    """
    trees = sorted(different([page_blocks(p) for p in pages]), key=lambda t: sum(1 for _ in texts(t)))
    if len(trees) < LEAST:
        return None
    shapes, base = Shapes(), trees[0]
    held: dict[int, int] = {}
    common: dict[int, Counter] = {}
    shapes.number(base)
    for tree in trees[1:]:
        shapes.number(tree)
        for mine, other in matched(shapes, base, tree):
            held[id(mine)] = held.get(id(mine), 0) + 1
            common.setdefault(id(mine), Counter()).update(Counter(mine.runs()) & Counter(other.runs()))
    need = AGREE * (len(trees) - 1)
    labels, parents, constant, stack = [], [], [], [(base, -1)]
    while stack:
        node, parent = stack.pop()
        if held.get(id(node), 0) < need:
            continue
        labels.append(node.label)
        parents.append(parent)
        # Of a run that a node repeats, as many count as are found often enough.
        constant.append(sorted(run for run, n in Counter(node.runs()).items() for _ in range(min(n, int(common[id(node)][run] // need)))))
        stack += [(k, len(labels) - 1) for k in reversed(node.kids())]
    told = {"labels": labels, "parents": parents, "constant": constant, "parts": None}
    wrapper, inside, total = Wrapper(json.dumps(told)), 0, 0
    for tree in trees:
        wrapper.strip(tree)
        for text, part in slots(tree):
            inside, total = inside + part * len(text), total + len(text)
    if inside:
        told["parts"] = 2 * inside > total
    return json.dumps(told) if inside or any(constant) else None


class Wrapper:
    """A wrapper that pages can be aligned with; what it learns about shapes serves the next page."""

    def __init__(self, made: str):
        told = json.loads(made)
        nodes = [Block(label) for label in told["labels"]]
        for node, parent in zip(nodes[1:], told["parents"][1:], strict=True):
            nodes[parent].items.append(node)
        self.root, self.shapes, self.parts = nodes[0], Shapes(), told["parts"]
        self.constant = {id(n): Counter(c) for n, c in zip(nodes, told["constant"], strict=True) if c}
        self.own = lambda node: list(self.constant.get(id(node), Counter()).elements())
        self.shapes.number(self.root, self.own)

    def strip(self, page: Block) -> None:
        """Take the template text out of a page. Nodes are aligned as far down as the wrapper has such text below them."""
        if not self.root.text:
            return
        if len(self.shapes.label) > 20_000:
            self.shapes = Shapes()
            self.shapes.number(self.root, self.own)
        self.shapes.number(page)
        for mine, other in matched(self.shapes, self.root, page, lambda node: node.text != 0):
            if id(mine) in self.constant:
                gone, kept = Counter(self.constant[id(mine)]), []
                for item in other.items:
                    if isinstance(item, str) and gone[item] > 0:
                        gone[item] -= 1
                    else:
                        kept.append(item)
                other.items = kept


def extract(source: str, wrapper: Wrapper | None) -> str:
    """Main text of one page. Without a wrapper, an article or main part counts if it holds most of the page's own text."""
    page, parts = page_blocks(source), None
    if wrapper is not None:
        wrapper.strip(page)
        parts = wrapper.parts
    found = slots(page)
    inside = sum(len(text) for text, part in found if part)
    if parts is None:
        parts = 2 * inside > sum(len(text) for text, _ in found)
    return "\n".join(text for text, part in found if part or not (inside and parts))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def layout_of(html: Column) -> Column:
    """A number for which elements of ``LAYOUT`` a page has; at most 64 layouts a host."""
    low = F.lower(F.coalesce(html, F.lit("")))
    return sum((F.contains(low, F.lit(tag)).cast("int") * (1 << i) for i, tag in enumerate(LAYOUT)), F.lit(0))


def wrappers(pages: DataFrame, references: int) -> DataFrame:
    """(host, layout, wrapper JSON) from ``references`` pages of a host and layout at most.

    The hashes of different pages are dealt to so many buckets and the lowest of each bucket names a reference, so
    a host of any size needs only minima, and copies of one page give one reference.
    """
    signed = pages.select("host", "layout", F.xxhash64("html").alias("signature"), "page_id")
    bucket = F.pmod("signature", F.lit(references)).alias("bucket")
    chosen = signed.groupBy("host", "layout", bucket).agg(F.min(F.struct("signature", "page_id")).alias("least")).select("host", "layout", "least.*")
    # Written, its size is known before the join: Spark then leaves the pages in place where it is small.
    chosen = materialize(chosen.withColumn("page_id", F.coalesce("page_id", F.lit(0))), "wrapper-references")
    named = pages.select("host", "layout", F.coalesce("page_id", F.lit(0)).alias("page_id"), F.xxhash64("html").alias("signature"), "html")
    picked = named.join(chosen, ["host", "layout", "page_id", "signature"]).dropDuplicates(["host", "layout", "signature"])

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        made = induce(frame.sort_values("signature")["html"].fillna("").tolist())
        return pd.DataFrame({"host": [key[0]], "layout": [key[1]], "wrapper": [made]})

    return picked.groupBy("host", "layout").applyInPandas(build, "host string, layout int, wrapper string").where("wrapper is not null")


def extract_text(pages: DataFrame, *, references: int = 8) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page's whole html.

    :param references: pages of a host and layout that its wrapper is induced from, at most. Every page is extracted.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by a line
    feed. Null and empty html give the empty text. A null url belongs to the host "". Hosts with fewer than three
    different pages of a layout have no wrapper: all text that no tag, role or class drops is content, of its articles or main parts
    alone where these hold most of it. Repeated rows each keep their row; other columns are ignored.
    """
    source = pages.select(F.col("page_id").cast("bigint"), "url", "html", host_of(F.col("url")).alias("host"), layout_of(F.col("html")).alias("layout"))
    # Broadcast by Spark below its size limit; beyond it the pages shuffle by host and hot hosts are split.
    found = materialize(wrappers(source, references), "wrappers")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            out = []
            for html, made in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if made is not None and made not in known:
                    if len(known) > 200:
                        known.clear()
                    known[made] = Wrapper(made)
                out.append(extract(html or "", known.get(made)))
            cols = [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    joined = source.join(found, ["host", "layout"], "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
