"""Main text of web pages by a tree-structured graphical model over their block elements.

Each block element is a variable, content or not. What is seen of it (words of its class and id,
length and link share of its text) gives its own potential; pairs of parent and child have
potentials that depend on the kinds of both. The graph is the tree of the page, so one pass of messages from the
leaves up and one down give the exact probability of every element to be content. All potentials
are relative frequencies in labelled pages (``labelled_pages``).

Each page is worked on by itself inside of a task.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from noteflow.llm.common import require

# Elements without end tag, elements read up to their end tag, inline elements, and
# elements whose start ends an open element of the same group.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
#: Drawings and formulas: their text is text of the page, their tags are no elements of the tree.
FOREIGN = frozenset("svg math".split())
#: Never shown, but only what stands before an end tag of their own; ``UNSEEN`` only in a drawing.
HIDDEN = frozenset("template iframe".split())
UNSEEN = frozenset("desc metadata".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr canvas math noscript object svg".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that a start tag does not close across.
FENCES = frozenset("article aside blockquote body div footer form header main nav section table ul ol dl".split())
# Words in class, id and role, by what they hint at.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs",
    "head": "header masthead banner topbar logo branding hero",
    "foot": "footer foot copyright colophon legal imprint contentinfo",
    "side": "sidebar aside widget related recommended popular trending teaser complementary rail",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner2 dfp outbrain taboola",
    "comment": "comment comments commentlist discussion disqus replies reply respond feedback reviews",
    "form": "form login search searchbox register contact",
    "share": "share sharing social follow tags tag meta byline author",
    "main": "content article post entry main story body text page-content articlebody prose hentry",
}
WORD_HINT = {word: hint for hint, words in HINTS.items() for word in words.split()}
KINDS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure "
    "figcaption nav header footer aside form fieldset button address details summary".split())

# A quote counts only where a value starts; one that nothing closes ends at the tag's ``>`` like any sign.
TAG = re.compile(
    r"""<(?:!--|[!?]|(/?)([a-zA-Z][^\s/><]*+)((?:[^<>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>)""")
PAIRED = re.compile(rf"<(/?)({'|'.join(sorted(HIDDEN | UNSEEN))})(?=[\s/>])", re.I)
MARKS = re.compile(r"""(?:^|\s)(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
LEAST = 1.0  # added to every count


@dataclass
class Page:
    """Block elements in page order (parents first) and the blocks of text."""

    kind: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    hints: list[tuple[str, ...]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


def _after(source: str, tag: re.Match) -> int:
    """Where a comment or declaration ends that starts with ``tag``."""
    mark = "-->" if tag[0] == "<!--" else ">"
    end = source.find(mark, tag.end())
    return len(source) if end < 0 else end + len(mark)


def _after_raw(source: str, at: int, name: str) -> int:
    """Behind the end tag, or the end of the page as in HTML."""
    end = re.compile(rf"</{name}\b[^>]*+>", re.I).search(source, at)
    return len(source) if end is None else end.end()


def _after_select(source: str, at: int) -> int:
    """Where a list of options ends: behind its end tag, or before what cannot be inside of it."""
    inside: Counter = Counter()
    while (tag := TAG.search(source, at)) is not None:
        if tag[2] is None:
            at = _after(source, tag)
            continue
        name, at = tag[2].lower(), tag.end()
        if name == "select":
            return at if tag[1] else tag.start()
        if name in INLINE:
            inside[name] += -1 if tag[1] else 1
            if inside[name] < 0:
                return tag.start()
        elif name in ("script", "style") and not tag[1]:
            at = _after_raw(source, at, name)
        elif name not in ("option", "optgroup", "hr", "br", "img"):
            return tag.start()
    return len(source)


def _hidden_ends(source: str) -> dict[int, int]:
    """Where the end tags of elements stand that are not shown, by where the elements start."""
    ends, begun = {}, {}
    for tag in PAIRED.finditer(source):
        same = begun.setdefault(tag[2].lower(), [])
        if not tag[1]:
            same.append(tag.start())
        elif same:
            ends[same.pop()] = tag.end()
    return ends


def parse(source: str) -> Page:
    """The tree of a page, however ill-formed. Runs in time linear in the page.

    Left out are comments, what HTML reads up to an end tag (script, style, title, textarea), the
    options of a select, and what is never shown (template, iframe, desc and metadata of a
    drawing) if it has an end tag. Where that is missing, a select ends at the first element that
    cannot be in it, and the others are read like the page around them. The text of math, svg,
    noscript, object and canvas belongs to the element around it, and a block ends them. References
    are decoded in each piece of text between tags, never across a tag.
    """
    page = Page()
    stack: list[tuple[str, int]] = []  # open elements, inline ones too, and their node
    foreign: list[int] = []  # depths of open drawings and formulas
    # Depths of the open elements by name, of those that are not inline, and of the fences: no tag
    # searches the stack.
    named: dict[str, list[int]] = {}
    blocks: list[int] = []
    fences: list[int] = []
    hidden = _hidden_ends(source)
    run: list[str] = []
    links = 0

    def cut(depth: int) -> None:
        nonlocal links
        for old, _ in stack[depth:]:
            links -= old == "a"
            named[old].pop()
        del stack[depth:]
        for depths in (foreign, blocks, fences):
            while depths and depths[-1] >= depth:
                depths.pop()

    def push(name: str, node: int) -> None:
        named.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            blocks.append(len(stack))
        if name in FENCES:
            fences.append(len(stack))
        stack.append((name, node))

    def deepest(name: str) -> int:
        """Depth of the last open element of a name, 0 without any."""
        return named[name][-1] if named.get(name) else 0

    def open_node(kind: str, marks: str) -> int:
        hints, label = set(), 0
        if "=" in marks:
            for name, a, b, c in MARKS.findall(marks):
                value = a or b or c
                if name.lower() == "data-label":
                    label = int(value == "1")
                else:
                    for word in re.split(r"[^a-z0-9]+", value.lower()):
                        if word in WORD_HINT:
                            hints.add(WORD_HINT[word])
        page.kind.append(kind if kind in KINDS else "other")
        page.parent.append(stack[-1][1] if stack else -1)
        page.hints.append(tuple(sorted(hints)))
        page.label.append(label)
        page.chars.append(0)
        page.linked.append(0)
        return len(page.kind) - 1

    def text(piece: str) -> None:
        if not piece:
            return
        piece = html.unescape(piece)
        run.append(piece)
        if links and stack:
            page.linked[stack[-1][1]] += len(piece)

    def end_block() -> None:
        if run:
            joined = SPACE.sub(" ", "".join(run)).strip()
            run.clear()
            if joined:
                node = stack[-1][1]
                page.blocks.append((node, joined))
                page.chars[node] += len(joined)

    stack.append(("", open_node("html", "")))
    at = 0
    while (tag := TAG.search(source, at)) is not None:
        text(source[at:tag.start()])
        at = tag.end()
        if tag[2] is None:
            at = _after(source, tag)
            continue
        name = tag[2].lower()
        if foreign and not (name in KINDS or name in INLINE or name in RAW or name in HIDDEN or name == "select"):
            if stack[foreign[-1]][0] == "svg":
                if name in UNSEEN and tag.start() in hidden:
                    at = source.find(">", hidden[tag.start()]) + 1 or len(source)
                text(" ")
            continue
        if tag[1]:
            if name in RAW or name in HIDDEN or name == "select":
                continue
            depth = deepest(name)
            if depth and name in INLINE and blocks and blocks[-1] > depth:
                continue
            if depth:
                if name not in INLINE:
                    end_block()
                cut(depth)
                if name == "svg":
                    text(" ")
        elif name in RAW:
            at = _after_raw(source, at, name)
            text(" ")
        elif name == "select":
            if not tag[3].rstrip().endswith("/"):
                at = _after_select(source, at)
            text(" ")
        elif name in HIDDEN:
            # A template with a shadow root is shown.
            if tag.start() in hidden and not tag[3].rstrip().endswith("/") and "shadowroot" not in tag[3].lower():
                at = source.find(">", hidden[tag.start()]) + 1 or len(source)
            text(" ")
        elif name == "br":
            text(" ")
        elif name in VOID:
            continue
        elif name in INLINE:
            if name == "svg":
                text(" ")
            if name in FOREIGN or name in ("canvas", "noscript", "object"):
                if tag[3].rstrip().endswith("/"):
                    continue
                if name in FOREIGN:
                    foreign.append(len(stack))
            push(name, stack[-1][1])
            links += name == "a"
        else:
            end_block()
            if foreign:
                cut(foreign[0])
            closing = CLOSES.get(name, {"p"} if name in KINDS else set())
            depth = max(map(deepest, closing), default=0)
            if depth > (fences[-1] if fences else 0):
                cut(depth)
            push(name, open_node(name, tag[3]))
    text(source[at:])
    end_block()
    return page


def features(page: Page) -> list[list[str]]:
    """What is seen of each element."""
    chars, linked = list(page.chars), list(page.linked)
    for node in range(len(page.kind) - 1, 0, -1):
        chars[page.parent[node]] += chars[node]
        linked[page.parent[node]] += linked[node]
    seen = []
    for node, size in enumerate(chars):
        share = linked[node] / size if size else 0.0
        seen.append([
            "size " + ("none" if not size else "short" if size < 40 else "line" if size < 160 else "long"),
            "links " + ("none" if share < 0.02 else "few" if share < 0.35 else "many"),
            *["hint " + h for h in page.hints[node]],
            *([] if page.hints[node] else ["hint none"]),
        ])
    return seen


@dataclass(frozen=True)
class Model:
    """Log potentials: ``own[feature] = (not content, content)``, ``pair[kinds][parent][child]``.

    ``kinds`` is the kind of the child, or that of parent and child where pages showed the two.
    """

    own: dict[str, tuple[float, float]]
    pair: dict[object, tuple[tuple[float, float], tuple[float, float]]]
    root: tuple[float, float]


def train(pages: Iterable[str]) -> Model:
    """Relative frequencies in labelled pages (``data-label="1"`` marks content elements)."""
    seen: list[Counter] = [Counter(), Counter()]
    pairs: Counter = Counter()
    nodes = [0, 0]
    for source in pages:
        page = parse(source)
        for node, found in enumerate(features(page)):
            label = page.label[node]
            nodes[label] += 1
            seen[label].update(found)
            if node:
                above = page.parent[node]
                for kinds in (None, page.kind[node], (page.kind[above], page.kind[node])):
                    pairs[kinds, page.label[above], label] += 1
    names = set(seen[0]) | set(seen[1])
    own = {n: tuple(math.log((seen[y][n] + LEAST) / (nodes[y] + 2 * LEAST)) for y in (0, 1)) for n in names}

    def share(kinds, a: int, b: int) -> float:
        # What is rare leans on the child's kind, and that on all kinds together.
        if kinds is None:
            usual = 0.5
        else:
            usual = share(kinds[1] if isinstance(kinds, tuple) else None, a, b)
        return (pairs[kinds, a, b] + 2 * LEAST * usual) / (pairs[kinds, a, 0] + pairs[kinds, a, 1] + 2 * LEAST)

    shown = {kinds for kinds, _, _ in pairs if kinds is not None} | KINDS | {"other"}
    pair = {k: tuple(tuple(math.log(share(k, a, b)) for b in (0, 1)) for a in (0, 1)) for k in shown}
    return Model(own, pair, (math.log(0.99), math.log(0.01)))


def _add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def marginals(page: Page, model: Model) -> list[float]:
    """The probability of each element to be content, by sum-product over the tree."""
    count = len(page.kind)
    own = []
    for found in features(page):
        no = yes = 0.0
        for name in found:
            if name in model.own:
                a, b = model.own[name]
                no, yes = no + a, yes + b
        own.append((no, yes))
    pairs = [model.pair.get((page.kind[above], kind)) or model.pair[kind]
             for above, kind in zip(page.parent, page.kind, strict=True)]
    up0, up1 = [o[0] for o in own], [o[1] for o in own]  # own potential and all messages from below
    sent0, sent1 = [0.0] * count, [0.0] * count
    for node in range(count - 1, 0, -1):
        (nn, ny), (yn, yy) = pairs[node]
        sent0[node] = _add(nn + up0[node], ny + up1[node])
        sent1[node] = _add(yn + up0[node], yy + up1[node])
        up0[page.parent[node]] += sent0[node]
        up1[page.parent[node]] += sent1[node]
    all0, all1 = [0.0] * count, [0.0] * count
    all0[0], all1[0] = up0[0] + model.root[0], up1[0] + model.root[1]
    for node in range(1, count):
        parent = page.parent[node]
        (nn, ny), (yn, yy) = pairs[node]
        rest0, rest1 = all0[parent] - sent0[node], all1[parent] - sent1[node]
        all0[node] = up0[node] + _add(nn + rest0, yn + rest1)
        all1[node] = up1[node] + _add(ny + rest0, yy + rest1)
    out = []
    for no, yes in zip(all0, all1, strict=True):
        gap = max(-500.0, min(500.0, no - yes))
        out.append(1.0 / (1.0 + math.exp(gap)))
    return out


def main_text(source: str, model: Model) -> str:
    """The blocks of content elements in page order, a line each; empty if there are none."""
    page = parse(source)
    content = marginals(page, model)
    return "\n".join(text for node, text in page.blocks if content[node] > 0.5)


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``id_col, url, text, n_chars`` of every row of ``pages``; other columns are left out.

    A null or empty page has an empty text. Repeated rows and rows without an id are extracted
    like others. White space inside of a block becomes one space, blocks are lines.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    require(pages, [id_col, url, source])
    schema = pa.schema([(id_col, to_arrow_type(pages.schema[id_col].dataType)), (url, pa.string()),
                        ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500)
                texts = [main_text(x, model) if x else "" for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).cast(schema[0].type), some.column(1).cast(pa.string()),
                     pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    id_type = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url, source).mapInArrow(run, f"`{id_col}` {id_type}, `{url}` string, text string, n_chars long")
