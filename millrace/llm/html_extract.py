"""Main text of web pages by tag-path ratios.

A page is cut into blocks: runs of text between block-level tags. Each block has a root-to-leaf tag path. Over the blocks of
one path, the text length and the punctuation are summed and divided by the number of blocks; both ratios are smoothed over
neighbouring blocks, multiplied, and compared with a threshold that the page itself gives. The blocks that pass select the
content element: an ``article`` or ``main`` around the deepest element that holds most of their text, else the deepest element
around all of them that is more than a leaf block. Its blocks are the text, short ones included, except those under boilerplate
elements and, where there is no article, those of links only on paths below the threshold. Tags condemn an element for good;
words of its class do unless it holds what must be the article. Formulas are text; an advert within a line goes from the line.

The work is a map over pages: no shuffle, and memory for one Arrow batch at a time, in proportion to its elements and text at any
depth.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import carried, unpacked

#: Element names with a role here, and words of class or id that mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike "
    "strong sub sup time tt u var wbr img picture "
    # of formulas
    "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mstyle "
    "merror mpadded mphantom mfenced menclose mtable mtr mtd annotation annotation-xml".split()
)
BOILERPLATE_TAGS = frozenset(
    "nav header footer aside form button select input textarea option fieldset dialog menu iframe object embed applet map "
    "canvas audio video head noscript svg annotation annotation-xml".split()
)
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu submenu header masthead topbar footer foot sidebar aside rail ad ads adv advert adverts "
    "advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay comment comments disqus replies respond share sharing social related recommended breadcrumb "
    "breadcrumbs newsletter subscribe signup login search pagination pager widget widgets toolbar copyright hidden".split()
)
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
#: Words that condemn an element within a line of text, and words that say a class is about another element.
INLINE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo share sharing hidden".split())
NEGATIONS = frozenset("has have no not non with without".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
NEVER_BY_CLASS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset(["article", "main"])
#: Parts of a text, never the whole of it.
PARTS = frozenset("p li dt dd td th tr thead tbody tfoot caption table ul ol dl pre blockquote figure figcaption address summary h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<title\b[^>]*>[^<]*(?:</title\s*>)?"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\"><]++|\"[^\"<]*+\"|'[^'<]*+')*+|[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SEPARATOR = re.compile(r"[\s|/·•»›>-]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: A start tag of these closes an open one of the listed names first.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}


#: How an element is condemned: by its tag, role or style; by words of readers' comments; by other words of its class or id.
TAG, COMMENT, CLASS = 1, 2, 3


def _words(value: str) -> set[str]:
    """The words of a class or id, without those that a word of ``NEGATIONS`` stands before: ``has-sidebar`` is no sidebar."""
    found = set()
    for name in _CAMEL.sub(" ", value).lower().split():
        words = _WORD.findall(name)
        found.update(w for i, w in enumerate(words) if NEGATIONS.isdisjoint(words[max(i - 2, 0) : i]))
    return found


def _condemned(name: str, attributes: str) -> int:
    """How the element is condemned by itself, 0 if it isn't."""
    if name in BOILERPLATE_TAGS:
        return TAG
    if not attributes or attributes.isspace():
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            if name not in NEVER_BY_CLASS:
                words = _words(value) & (INLINE_WORDS if name in INLINE else BOILERPLATE_WORDS)
                if words:
                    found = max(found, CLASS) if COMMENT_WORDS.isdisjoint(words) else COMMENT
        elif key == "role":
            if value.lower() in BOILERPLATE_ROLES:
                return TAG
        elif key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return TAG
        elif key == "hidden" or value.lower() == "true":
            return TAG
    return found


class _Tree:
    """A page's elements by number, parents before children, 0 around all; and its non-empty blocks in page order.

    A block is the number of the element it ends in, its text, and how many of its characters stand in links. An element's path
    is a number too, so that a deep page takes memory in proportion to its elements.
    """

    def __init__(self) -> None:
        self.names, self.parents, self.depths, self.paths, self.condemned = [""], [0], [0], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._known: dict[tuple[int, str], int] = {}

    def add(self, name: str, parent: int, condemned: int) -> int:
        self.names.append(name)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        self.paths.append(self._known.setdefault((self.paths[parent], name), len(self._known) + 1))
        self.condemned.append(condemned)
        return len(self.names) - 1

    def sums(self, values: dict[int, int]) -> list[int]:
        """For every element the sum over itself and all within it."""
        total = [values.get(e, 0) for e in range(len(self.names))]
        for e in range(len(total) - 1, 0, -1):
            total[self.parents[e]] += total[e]
        return total

    def within(self, marked: list[bool]) -> list[bool]:
        """For every element whether itself or one around it is marked."""
        found = [marked[0]]
        for e in range(1, len(marked)):
            found.append(marked[e] or found[self.parents[e]])
        return found


def tree_of(page: str) -> _Tree:
    """The page's elements and blocks."""
    tree = _Tree()
    stack: list[int] = [0]
    opened: Counter[str] = Counter()
    buffer: list[str] = []
    links, skipped, linked, at = 0, 0, 0, 0  # open links; open condemned inline elements; characters in links

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(htmllib.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                tree.blocks.append((stack[-1], text, linked))
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if not skipped:
            buffer.append(text)
            if links:
                linked += sum(len(w) for w in htmllib.unescape(text).split())

    def close(depth: int) -> None:
        nonlocal links, skipped
        if any(tree.names[e] not in INLINE for e in stack[depth:]):
            flush()
        for e in stack[depth:]:
            name = tree.names[e]
            opened[name] -= 1
            links -= name == "a"
            skipped -= name in INLINE and tree.condemned[e] != 0
        del stack[depth:]

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            if name == "br":
                put(" ")
            elif name == "p" and not opened["p"]:
                flush()
            elif opened[name]:
                for depth in range(len(stack) - 1, 0, -1):
                    here = tree.names[stack[depth]]
                    if here == name:
                        close(depth)
                        break
                    if name in INLINE and here not in INLINE:
                        break
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                put(" ")
            continue
        if name not in INLINE:
            flush()
            if len(stack) > 1 and tree.names[stack[-1]] == "head":
                close(len(stack) - 1)  # its end tag may be left out
            for depth in range(len(stack) - 1, 0, -1):
                here = tree.names[stack[depth]]
                if here == "p" or here in CLOSES.get(name, ()):
                    close(depth)
                    break
                if here not in INLINE:
                    break
        if m[4].endswith("/") and name not in INLINE:
            continue
        how = _condemned(name, m[4])
        stack.append(tree.add(name, stack[-1], how))
        opened[name] += 1
        links += name == "a"
        skipped += name in INLINE and how != 0
    if at < len(page):
        put(page[at:])
    flush()
    return tree


def _own(tree: _Tree) -> list[int]:
    """The numbers of the blocks that are not boilerplate.

    Words of a class are no proof: an element that only they condemn is spared if it holds an article, a main or a first heading
    and half of the characters that neither tags nor words of comments condemn; and, if nothing is left of the page, the one
    that holds most of these characters.
    """
    sure = tree.within([c in (TAG, COMMENT) for c in tree.condemned])
    chars: dict[int, int] = defaultdict(int)
    for e, text, _ in tree.blocks:
        if not sure[e]:
            chars[e] += len(text)
    mass = tree.sums(chars)
    heads = tree.sums({e: 1 for e, name in enumerate(tree.names) if not sure[e] and (name in CONTAINERS or name == "h1")})
    by_class = [e for e, c in enumerate(tree.condemned) if c == CLASS and tree.names[e] not in INLINE]
    spared = {e for e in by_class if heads[e] and 2 * mass[e] >= mass[0]}
    while True:
        bad = tree.within([c != 0 and e not in spared and tree.names[e] not in INLINE for e, c in enumerate(tree.condemned)])
        own = [i for i, b in enumerate(tree.blocks) if not bad[b[0]]]
        rest = [e for e in by_class if e not in spared and mass[e]]
        if own or not rest:
            return own
        spared.add(max(rest, key=lambda e: (mass[e], -e)))


def _smooth(values: list[float]) -> list[float]:
    """A three-point kernel over the page's blocks; the ends repeat."""
    n = len(values)
    return [0.25 * values[max(i - 1, 0)] + 0.5 * values[i] + 0.25 * values[min(i + 1, n - 1)] for i in range(n)]


def main_text(page: str | None, threshold: float = 0.3, cover: float = 0.85) -> str:
    """The article's blocks, joined by newlines; empty for a null or empty page and for one of boilerplate only.

    A block is a content node if its fused score reaches ``threshold`` times the page's mean score. An article is the content
    element if it holds an element with ``cover`` of the content nodes' characters. Else it is the deepest element that holds
    all content nodes, isn't in ``PARTS`` and holds more than one block.
    """
    if not page:
        return ""
    tree = tree_of(page)
    blocks, own = tree.blocks, _own(tree)
    if not own:
        return ""
    length: dict[int, int] = defaultdict(int)
    marks: dict[int, int] = defaultdict(int)
    nodes: dict[int, int] = defaultdict(int)
    for i in own:
        path, text = tree.paths[blocks[i][0]], blocks[i][1]
        length[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        nodes[path] += 1
    places = [tree.paths[blocks[i][0]] for i in own]
    texts = _smooth([length[p] / nodes[p] for p in places])
    points = _smooth([marks[p] / nodes[p] for p in places])
    fused = [t * (p + 0.1) for t, p in zip(texts, points, strict=True)]
    least = threshold * sum(fused) / len(fused)
    chosen = [i for i, f in zip(own, fused, strict=True) if f >= least]
    chars: dict[int, int] = defaultdict(int)
    held: dict[int, int] = defaultdict(int)
    for i in chosen:
        chars[blocks[i][0]] += len(blocks[i][1])
    for i in own:
        held[blocks[i][0]] += 1
    mass, holds = tree.sums(chars), tree.sums(held)
    root = max((e for e in range(len(mass)) if mass[e] >= cover * mass[0]), key=lambda e: tree.depths[e])
    found, e = 0, root
    while e:
        found = e if tree.names[e] in CONTAINERS else found
        e = tree.parents[e]
    kept = own
    if found:
        root = found
    else:
        root = max((e for e in range(len(mass)) if mass[e] == mass[0]), key=lambda e: tree.depths[e])
        while root and (tree.names[root] in PARTS or holds[root] < 2):
            root = tree.parents[root]
        # a block of nothing but links, whose path is below the threshold by itself, is a menu's
        low = {p for p in nodes if length[p] / nodes[p] * (marks[p] / nodes[p] + 0.1) < least}
        kept = [i for i, p in zip(own, places, strict=True) if p not in low or blocks[i][2] < len(_SEPARATOR.sub("", blocks[i][1]))]
    inside = tree.within([e == root for e in range(len(mass))])
    return "\n".join(blocks[i][1] for i in kept if inside[blocks[i][0]])


def extract_main_text(pages: DataFrame, html: str = "html", threshold: float = 0.3, cover: float = 0.85) -> DataFrame:
    """All columns of ``pages`` but ``html``, plus ``main_text`` and ``main_chars`` (its code points).

    Null or empty html gives an empty text. Rows are independent: repeated rows, null ids and an empty table need no care. A
    column of ``pages`` that is already called ``main_text`` or ``main_chars`` is replaced.
    """
    kept = [c for c in pages.columns if c not in (html, "main_text", "main_chars")]
    source = pages.select(carried(kept).alias("row"), F.col(f"`{html}`").cast("string").alias("html"))
    schema = source.drop("html").withColumns({"main_text": F.lit("").cast("string"), "main_chars": F.lit(0).cast("bigint")}).schema

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, threshold, cover) for p in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "main_text", "main_chars"])

    return source.mapInArrow(extract, schema).select(*unpacked("row", kept), "main_text", "main_chars")
