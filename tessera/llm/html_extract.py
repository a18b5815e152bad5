"""Main text of web pages by wrapper induction over pages of the same host.

The pages of a host fall into layouts by the classes of their larger elements;
copies count once.  Every page of a layout is aligned, node by node, with the
layout's page of middle size (simple tree matching).  Texts that stand at the same
path on almost all pages of a layout, or on almost all that can be aligned, are
template.  Every page then votes for the path of the smallest subtree that holds its
content without the template; the path of most votes and the template texts are the
wrapper of the layout.  Every page is extracted with the wrapper of its layout; a
page on which the wrapper finds nothing is extracted by itself.

Elements that HTML itself marks as no article text (navigation, footers, asides,
forms, scripts, styles) and those whose class, id or role says so (adverts,
notices, comments, menus) never are content.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, ship_package

#: HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
NO_CONTENT = RAW | frozenset("head nav footer aside form button select option svg math canvas object audio video dialog "
                             "menu datalist fieldset label".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table "
                  "tbody td tfoot th thead tr ul".split())
#: An opening tag closes these open elements, unless one of the stoppers is nearer.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: Words of a class, id or role that mark an element as no part of the article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
                  "navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices "
                  "alert disclaimer comment comments commentlist disqus respond reply replies share sharing social related "
                  "recommended newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination "
                  "pager skip copyright complementary contentinfo search".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s>/]*)[^>]*(?:>|\Z)"
                    # A quote that is never closed hides nothing: the tag then ends at the next ">".
                    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>|\Z)|[^>]*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "name", "parent", "children", "marked", "key", "text")

    def __init__(self, tag: str, name: str, parent: "Node | None", marked: bool):
        self.tag, self.name, self.parent, self.marked = tag, name, parent, marked
        self.children: list[Node | str] = []
        #: own_text(), once it is known.
        self.text: str | None = None
        #: Stands for path_of(), at no cost on deep trees.
        self.key = (0 if parent is None else parent.key if tag in ("html", "body")
                    else xxhash.xxh3_64_intdigest(name.encode("utf-8", "replace"), parent.key))


class Keys(frozenset):
    """Template texts as text_key() of path and text."""


def text_key(node: Node, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), node.key) - 2**63


def _fixed(node: Node, text: str, constant: Keys | set[tuple[str, str]]) -> bool:
    return text_key(node, text) in constant if isinstance(constant, Keys) else (path_of(node), text) in constant


def _marks_of(given: str) -> tuple[str, bool]:
    """The label that the attributes of a tag add to its name, and whether they mark the element."""
    words, label = [], ""
    for key, *values in _NAMED.findall(given):
        value = next((v for v in values if v), "")
        words += [w.lower() for w in _SPLIT.split(value)]
        if key.lower() == "class":
            label = "." + re.sub(r"\d+", "#", " ".join(value.lower().split()))
    return label, not MARKS.isdisjoint(words)


#: Most elements have the attributes of others; long attributes are not kept.
_marks_of_short = lru_cache(4096)(_marks_of)
_RAW_END = {tag: re.compile(rf"</{re.escape(tag)}\s*[>/\s]", re.I) for tag in RAW}


def parse(source: str) -> Node:
    """The element tree of a page, with the repairs that browsers make for unclosed elements."""
    root = Node("#root", "#root", None, False)
    at, top, depth = 0, root, 0
    n = len(source)
    while at < n:
        start = source.find("<", at)
        while start >= 0 and not (m := _TOKEN.match(source, start)):
            start = source.find("<", start + 1)
        if start < 0:
            top.children.append(source[at:])
            break
        if start > at:
            top.children.append(source[at:start])
        at = m.end()
        closed, opened, given = m.groups()
        if closed:
            tag = closed.lower()
            node = top
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                top = node.parent
        elif opened:
            tag = opened.lower()
            if tag in BLOCK and tag not in ("br", "hr"):
                node = top  # a block ends an open paragraph
                while node.parent is not None and node.tag != "p" and (node.tag not in BLOCK or node.tag == "p"):
                    node = node.parent
                if node.tag == "p":
                    top = node.parent
            if tag in CLOSES:
                ends, stops = CLOSES[tag]
                node = top
                while node.parent is not None and node.tag not in ends and node.tag not in stops:
                    node = node.parent
                if node.tag in ends:
                    top = node.parent
            label, marked = "", False
            if given and "=" in given:
                label, marked = (_marks_of_short if len(given) <= 200 else _marks_of)(given)
            node = Node(tag, tag + label, top, marked)
            top.children.append(node)
            if tag in RAW:
                end = _RAW_END[tag].search(source, at)
                at = n if not end else source.find(">", end.start()) + 1 or n
            elif tag not in VOID and not given.endswith("/"):
                top = node
    return root


def elements(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend([c for c in reversed(node.children) if not isinstance(c, str)])


def path_of(node: Node) -> str:
    out = []
    while node.parent is not None:
        if node.tag not in ("html", "body"):
            out.append(node.name)
        node = node.parent
    return "/".join(reversed(out))


def own_text(node: Node) -> str:
    if node.text is None:
        parts = [c for c in node.children if isinstance(c, str)]
        node.text = " ".join(html.unescape(" ".join(parts)).split()) if parts else ""
    return node.text


def _blank(node: Node, inside: bool) -> bool:
    """True for an element that never is content; a heading block counts as such only outside the article."""
    return node.tag in NO_CONTENT or node.marked or node.tag == "header" and not inside


def masses(root: Node, constant: Keys | set[tuple[str, str]] = frozenset()) -> dict[int, int]:
    """Characters of content under every element, without template texts and half of what is linked."""
    return _masses(root, constant)[1]


def _masses(root: Node, constant: Keys | set[tuple[str, str]]) -> tuple[dict[int, int], dict[int, int]]:
    """``masses`` with and without the template texts; one and the same where a page has none."""
    order, out, fixed = [], defaultdict(int), defaultdict(int)
    stack = [(root, False, 1.0)]
    while stack:
        node, inside, share = stack.pop()
        if _blank(node, inside) and not _whole(node):
            continue
        order.append(node)
        inside = inside or node.tag in ("article", "main")
        share = 0.3 if node.tag == "a" else share
        text = own_text(node)
        if text:
            out[id(node)] += share * len(text)
            if constant and _fixed(node, text, constant):
                fixed[id(node)] += share * len(text)
        stack.extend((c, inside, share) for c in node.children if not isinstance(c, str))
    without = out if not fixed else defaultdict(int, {k: v - fixed[k] if k in fixed else v for k, v in out.items()})
    for mass in (out,) if without is out else (out, without):
        for node in reversed(order):
            if node.parent is not None:
                mass[id(node.parent)] += mass[id(node)]
    return out, without


def _whole(node: Node) -> bool:
    """A marked element around an article, or around a title and paragraphs, has a layout class, not a mark."""
    if node.tag in NO_CONTENT:
        return False
    tags = {x.tag for x in elements(node)}
    return bool(tags & {"article", "main"}) or node.tag != "header" and {"h1", "p"} <= tags


def container_of(root: Node, constant: set[tuple[str, str]] = frozenset(), mass: dict[int, int] | None = None) -> Node:
    """The smallest subtree that holds the content: an article element, or where most of the text comes together."""
    mass = masses(root, constant) if mass is None else mass
    total = mass[id(root)]
    named = [x for x in elements(root) if x.tag == "article" or x.tag == "main"]
    named = [x for x in named if mass.get(id(x), 0) >= 0.5 * total and total]
    if named:
        return min(named, key=lambda x: (mass[id(x)] < 0.9 * max(mass[id(y)] for y in named), x.tag != "article"))
    node = root
    while True:
        inner = [c for c in node.children if not isinstance(c, str) and mass.get(id(c), 0) >= 0.75 * mass[id(node)]
                 and mass.get(id(c), 0)]
        if not inner or inner[0].tag in ("p", "h1", "h2", "h3", "li", "td") or inner[0].tag not in BLOCK:
            return node
        node = inner[0]


def _shapes(root: Node, known: dict[tuple, int], sizes: list[int]) -> dict[int, int]:
    """A number for every element that is the same for equal trees of names; its tree's size stands in ``sizes``."""
    out: dict[int, int] = {}
    for node in reversed(list(elements(root))):
        shape = (node.name, *[out[id(c)] for c in node.children if not isinstance(c, str)])
        number = out[id(node)] = known.setdefault(shape, len(known))
        if number == len(sizes):
            sizes.append(1 + sum(map(sizes.__getitem__, shape[1:])))
    return out


class Shapes:
    """The shapes of a model's elements, and those of the trees aligned with it."""

    def __init__(self, model: Node):
        self.numbers: dict[tuple, int] = {}
        self.sizes: list[int] = []
        self.model = _shapes(model, self.numbers, self.sizes)


def align(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None = None, shapes: Shapes | None = None) -> int:
    """Simple tree matching: the size of the largest top-down, order-keeping match of two trees; fills ``pairs``.

    Equal children at both ends of two elements are matched with each other, which
    is among the largest matches; only those between are tried against each other.
    """
    memo: dict[tuple[int, int], tuple[int, int, int, list, list, list]] = {}
    shapes = shapes or Shapes(a)
    left, sizes = shapes.model, shapes.sizes
    right = _shapes(b, shapes.numbers, sizes)

    def kids(x: Node) -> list[Node]:
        return [c for c in x.children if not isinstance(c, str)]

    def match(x: Node, y: Node) -> int:
        if x.name != y.name:
            return 0
        if left[id(x)] == right[id(y)]:
            return sizes[left[id(x)]]
        known = memo.get((id(x), id(y)))
        if known is not None:
            return known[0]
        p, q = kids(x), kids(y)
        first, last, least = 0, 0, min(len(p), len(q))
        while first < least and left[id(p[first])] == right[id(q[first])]:
            first += 1
        while last < least - first and left[id(p[-1 - last])] == right[id(q[-1 - last])]:
            last += 1
        ends = sum(sizes[left[id(c)]] for c in p[:first] + p[len(p) - last:])
        u, v = p[first:len(p) - last], q[first:len(q) - last]
        table = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
        for i, c in enumerate(u):
            for j, d in enumerate(v):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + match(c, d))
        total = table[-1][-1] + ends + 1
        memo[id(x), id(y)] = (total, first, last, table, p, q)
        return total

    size = match(a, b)
    if pairs is not None and size:
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            pairs.append((x, y))
            if left[id(x)] == right[id(y)]:
                stack.extend(zip(kids(x), kids(y)))
                continue
            _, first, last, table, p, q = memo[id(x), id(y)]
            stack.extend(zip(p[:first], q[:first]))
            stack.extend(zip(p[len(p) - last:], q[len(q) - last:]))
            i, j = len(table) - 1, len(table[0]) - 1
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    stack.append((p[first + i], q[first + j]))
    return size


def _fit_to_align(root: Node, most_nodes: int, most_depth: int = 150) -> bool:
    if most_nodes > most_depth and sum(1 for _, x in zip(range(most_depth + 1), elements(root))) <= most_depth:
        return True  # no deeper than it has elements
    count, stack = 0, [(root, 0)]
    while stack:
        node, depth = stack.pop()
        count += 1
        if count > most_nodes or depth > most_depth:
            return False
        stack.extend((c, depth + 1) for c in node.children if not isinstance(c, str))
    return True


def page_texts(root: Node) -> dict[int, int]:
    """The texts of a page by path, as text_key(), by the id() of their nodes."""
    return {id(x): text_key(x, text) for x in elements(root) if x.tag not in RAW and (text := own_text(x))}


def aligned_texts(model: Node, tree: Node, keys: dict[int, int], shapes: Shapes | None = None) -> set[int]:
    """Those of the texts of ``tree`` (page_texts()) that stand on nodes aligned with the same text of ``model``."""
    pairs: list[tuple[Node, Node]] = []
    align(model, tree, pairs, shapes)
    return {keys[id(y)] for x, y in pairs if id(y) in keys and own_text(x) == own_text(y)}


def vote(root: Node, constant: Keys) -> tuple[Node, bool]:
    """Where a page has its content, and whether the template texts are most of it and so are none.

    Pages that are copies of each other say nothing about the template.
    """
    inside, without = _masses(root, constant)
    node = container_of(root, mass=without)
    if without is not inside and without[id(node)] < 0.5 * inside[id(node)]:
        return container_of(root, mass=inside), True
    return node, False


def induce(pages: list[str], *, same: float = 0.8, least_pages: int = 4, most_nodes: int = 2000) -> dict:
    """Wrapper of one layout as extract_pages() finds it, from pages in memory; template texts as path and text."""
    trees = [parse(p) for p in sorted(set(pages))]
    if not trees:
        return {"path": None, "constant": []}
    fit = sorted((t for t in trees if _fit_to_align(t, most_nodes)), key=lambda t: sum(1 for _ in elements(t)))
    seen: Counter[int] = Counter()
    aligned: Counter[int] = Counter()
    for tree in trees:
        seen.update(set(page_texts(tree).values()))
    for tree in fit:
        aligned.update(aligned_texts(fit[len(fit) // 2], tree, page_texts(tree)))
    constant = Keys(k for k in seen if len(trees) >= least_pages and seen[k] >= same * len(trees)
                    or len(fit) >= least_pages and aligned[k] >= same * len(fit))
    votes = [vote(tree, constant) for tree in trees]
    most = 2 * sum(none for _, none in votes) > len(votes)
    paths = Counter((x.key, path_of(x)) for x, none in votes if none == most)
    key, path = max(paths, key=lambda x: (paths[x], x[0]))
    texts = {(path_of(x), own_text(x)) for t in trees for x in elements(t) if text_key(x, own_text(x)) in constant}
    return {"path": path, "key": key, "constant": [] if most else sorted(texts)}


def text_of(root: Node, constant: set[tuple[str, str]] = frozenset()) -> str:
    """The blocks under an element in page order, white space as one space, joined by one space."""
    blocks, line = [], []
    inside = root.tag in ("article", "main") or any(p.tag in ("article", "main") for p in _above(root))
    stack: list = [(root, inside)]
    while stack:
        node, inside = stack.pop()
        if isinstance(node, str):
            line.append(node)
            continue
        if node is None:  # end of a block
            blocks.append("".join(line))
            line = []
            continue
        if node is not root and _blank(node, inside) and not _whole(node):
            blocks.append("".join(line))
            line = []
            continue
        if constant and node is not root and all(isinstance(c, str) for c in node.children):
            if _fixed(node, own_text(node), constant):
                continue
        if node.tag in BLOCK:
            blocks.append("".join(line))
            line = []
            stack.append((None, inside))
        inside = inside or node.tag in ("article", "main")
        stack.extend((c, inside) for c in reversed(node.children))
    blocks.append("".join(line))
    return " ".join(html.unescape(" ".join(filter(None, blocks))).split())


def _above(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def extract(source: str | None, wrapper: dict | None) -> str:
    """The main text of a page by the wrapper of its host."""
    if not source:
        return ""
    root = parse(source)
    if wrapper and wrapper["path"] is not None:
        constant = wrapper["constant"]
        if not wrapper["path"]:
            text = text_of(root, constant)
        else:
            found = [x for x in elements(root) if x.key == wrapper["key"] and x.tag not in ("html", "body")]
            text = " ".join(filter(None, (text_of(x, constant) for x in found)))
        if text:
            return text
    return text_of(container_of(root))


#: Elements whose tags and first classes make a layout.
_LAYOUT = r"<(body|main|article|section|header|footer|nav|aside|table|div)(?=[\s>])(?:[^>]*?\sclass\s*=\s*[\"']?\s*([^\s\"'>]+))?"


def layout_of(source: Column) -> Column:
    """A hash of the distinct tags and first classes of a page's larger elements, numbers in classes aside."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(source), F.lit(_LAYOUT), F.lit(0)))
    names = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "(?s)" + _LAYOUT, "$1.$2"), r"\d+", "#"))
    return F.xxhash64(F.array_sort(F.array_distinct(names)))


def _text_keys(most_nodes: int):
    """(host, layout, page hash, html, model) -> one row per distinct path and text of a page; null for an aligned page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[str, tuple[Node, Shapes] | None] = {}
        for batch in batches:
            take, keys, aligned = [], [], []
            for row, (source, model) in enumerate(zip(batch.column(3), batch.column(4).to_pylist())):
                tree = parse(source.as_py())
                texts, same = page_texts(tree), set()
                found = set(texts.values())
                if model is not None:
                    if model not in models:
                        if len(models) >= 200:
                            models.clear()
                        known = parse(model)
                        models[model] = (known, Shapes(known)) if _fit_to_align(known, most_nodes) else None
                    if models[model] is not None and _fit_to_align(tree, most_nodes):
                        known, shapes = models[model]
                        same = aligned_texts(known, tree, texts, shapes)
                        if len(shapes.sizes) > 20 * most_nodes:
                            models[model] = known, Shapes(known)
                        take.append(row)
                        keys.append(None)
                        aligned.append(True)
                take += [row] * len(found)
                keys += found
                aligned += [k in same for k in found]
            take = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(3)), pa.array(keys, pa.int64()),
                                              pa.array(aligned, pa.bool_())], ["hid", "layout", "h", "key", "aligned"])
    return run


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, layout, page hash, html, template texts) -> the path of each page's content, as key, and vote()'s mark."""
    texts: dict[tuple[int, int], Keys] = {}
    for batch in batches:
        places, eaten = [], []
        for at, source in enumerate(batch.column(3)):
            layout = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
            if layout not in texts:
                if len(texts) >= 1000:
                    texts.clear()
                texts[layout] = Keys(batch.column(4)[at].as_py() or ())
            node, none = vote(parse(source.as_py()), texts[layout])
            places.append(node.key - 2**63)
            eaten.append(none)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places, pa.int64()), pa.array(eaten, pa.bool_())],
                                         ["hid", "layout", "h", "place", "eaten"])


def _extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrappers: dict[str, dict] = {}
    for batch in batches:
        texts = []
        for source, wrapper in zip(batch.column(0), batch.column(1).to_pylist()):
            if wrapper is not None and wrapper not in wrappers:
                if len(wrappers) >= 1000:
                    wrappers.clear()
                known = json.loads(wrapper)
                known["key"] += 2**63
                known["path"] = "/" if known["key"] else ""
                known["constant"] = Keys(known["constant"])
                wrappers[wrapper] = known
            texts.append(extract(source.as_py(), wrappers.get(wrapper)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[2:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            [*batch.schema.names[2:], "text", "n_chars"])


#: Up to this many layouts the wrappers are broadcast; beyond it, Spark joins by shuffle.
BROADCAST_HOSTS = 20_000
#: The same for the pages to align with and the template texts, by their bytes.
BROADCAST_BYTES = 1 << 26


def _with(pages: DataFrame, one: DataFrame, size: Column) -> DataFrame:
    """``pages`` with the row of their layout in ``one``, broadcast if its columns are small."""
    few = (one.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    return pages.join(F.broadcast(one) if few else one, ["hid", "layout"], "left")


def _models(pages: DataFrame, places: DataFrame, scratch: Scratch, least_pages: int, most_nodes: int) -> DataFrame:
    """(hid, layout, model): the page of middle size of each layout, among those that can be aligned."""
    fit = places.where(F.col("size") <= most_nodes)
    middle = (fit.groupBy("hid", "layout").agg(F.median("size").alias("middle"), F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= least_pages).drop("n"))
    off = F.struct(F.abs(F.col("size") - F.col("middle")), F.col("h"))
    chosen = scratch.write(fit.join(middle, ["hid", "layout"]).groupBy("hid", "layout").agg(F.min_by("h", off).alias("h")), "chosen")
    few = chosen.count() <= BROADCAST_HOSTS
    sources = (pages.select("h", "html").join(F.broadcast(chosen) if few else chosen, "h", "left_semi")
               .groupBy("h").agg(F.max("html").alias("model")))
    out = scratch.write(chosen.join(sources, "h").drop("h"), "models")
    scratch.drop(chosen)
    return out


def _template_texts(pages: DataFrame, places: DataFrame, scratch: Scratch, same: float, least_pages: int,
                    most_nodes: int) -> DataFrame:
    """(hid, layout, keys): template texts counted over all distinct pages of a layout, or of the host of a rare layout."""
    models = _models(pages, places, scratch, least_pages, most_nodes)
    counts = scratch.write(
        _with(pages, models, F.octet_length("model")).select("hid", "layout", "h", "html", "model")
        .mapInArrow(bounded(_text_keys(most_nodes)), "hid long, layout long, h long, key long, aligned boolean").distinct()
        .groupBy("hid", "layout", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("aligned").alias("aligned")), "counts")
    fit = counts.where("key is null").select("hid", "layout", F.col("n").alias("fit"))
    counts_ = counts.where("key is not null")
    sizes = places.groupBy("hid", "layout").agg(F.count(F.lit(1)).alias("size"))
    often = F.col("n") >= F.lit(same) * F.col("size")
    alike = (F.col("fit") >= least_pages) & (F.col("aligned") >= F.lit(same) * F.col("fit"))
    keys = F.array_sort(F.collect_list("key")).alias("keys")
    usual = (counts_.where(F.col("n") >= same * least_pages)
             .join(sizes.where(F.col("size") >= least_pages), ["hid", "layout"])
             .join(fit, ["hid", "layout"], "left").where(often | F.coalesce(alike, F.lit(False)))
             .groupBy("hid", "layout").agg(keys))
    rare = sizes.where(F.col("size") < least_pages)
    hosts = sizes.groupBy("hid").agg(F.sum("size").alias("size")).join(rare.select("hid").distinct(), "hid", "left_semi")
    whole = (counts_.groupBy("hid", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= same * least_pages)
             .join(hosts.where(F.col("size") >= least_pages), "hid").where(often).groupBy("hid").agg(keys))
    out = scratch.write(usual.unionByName(rare.join(whole, "hid").select("hid", "layout", "keys")), "texts")
    scratch.drop(counts, models)
    return out


def _wrappers(pages: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(hid, layout, wrapper): the path of most votes and the template texts, unless most pages hold little else."""
    votes = (_with(pages, texts, F.size("keys") * 8).select("hid", "layout", "h", "html", "keys")
             .mapInArrow(bounded(_votes), "hid long, layout long, h long, place long, eaten boolean").distinct()
             .groupBy("hid", "layout", "eaten", "place").agg(F.count(F.lit(1)).alias("n")))
    rank, eaten = F.struct("n", "place"), F.col("eaten")
    found = (votes.groupBy("hid", "layout").agg(
        (2 * F.sum(F.when(eaten, F.col("n")).otherwise(0)) > F.sum("n")).alias("none"),
        F.max(F.when(eaten, rank)).alias("a"), F.max(F.when(~eaten, rank)).alias("b"))
        .join(texts, ["hid", "layout"], "left"))
    wrapper = F.struct(F.when(F.col("none"), F.col("a.place")).otherwise(F.col("b.place")).alias("key"),
                       F.when(F.col("none") | F.col("keys").isNull(), F.array().cast("array<bigint>"))
                       .otherwise(F.col("keys")).alias("constant"))
    return scratch.write(found.select("hid", "layout", F.to_json(wrapper).alias("wrapper")), "wrappers")


def extract_pages(pages: DataFrame, *, keep: tuple[str, ...] = ("page_id", "url"), same: float = 0.8,
                  least_pages: int = 4, most_nodes: int = 2000) -> DataFrame:
    """The ``keep`` columns of every row of ``pages`` (page_id, url, html) with text and n_chars.

    Template texts are counted by path over all distinct pages of a layout of a
    host, of any size and depth; a layout of fewer than ``least_pages`` pages takes
    those of its whole host.  All distinct pages of a layout vote for the path of the
    content.  Pages of more than ``most_nodes`` elements or deeper than 150 are
    counted and vote, but are not aligned.  Null and empty pages give an empty
    text; pages without url form one host; repeated rows are extracted each; pages
    without any text give an empty one; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))
    html_ = F.col("html").cast("string")
    full = pages.where("html is not null and html <> ''").select(
        F.xxhash64(host).alias("hid"), layout_of(html_).alias("layout"), F.xxhash64(html_).alias("h"), html_.alias("html"))
    # All "<" but those of closing tags: no fewer than the elements.
    size = F.octet_length(F.replace("html", F.lit("</"), F.lit("<"))) - F.octet_length(F.replace("html", F.lit("<"), F.lit("")))
    places = scratch.write(full.select("hid", "layout", "h", size.cast("long").alias("size")).distinct(), "places")
    texts = _template_texts(full, places, scratch, same, least_pages, most_nodes)
    wrappers = _wrappers(full, texts, scratch)
    scratch.drop(places, texts)
    few = wrappers.count() <= BROADCAST_HOSTS
    kept = pages.select(*keep)
    rows = pages.select(html_.alias("_html"), F.xxhash64(host).alias("_hid"), layout_of(html_).alias("_layout"), *keep)
    wrappers = wrappers.select(F.col("hid").alias("_hid"), F.col("layout").alias("_layout"), F.col("wrapper").alias("_wrapper"))
    joined = (rows.join(F.broadcast(wrappers) if few else wrappers, ["_hid", "_layout"], "left")
              .select("_html", "_wrapper", *keep))
    return joined.mapInArrow(bounded(_extract_rows), ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", text string, n_chars long")
