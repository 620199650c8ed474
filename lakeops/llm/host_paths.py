"""Main text of web pages by consensus paths of their hosts.

1. Each page's containers are scored: text in its own blocks, less text in links, nothing for
   menus, headers, footers, sidebars, notices, adverts, forms and comments.  A best container without a heading
   gives way to the one around it that has the headline or a lead of its own.
2. A container is named by its generalised path: tags with their classes from the body down,
   digits taken out, so that ``post-17`` and ``post-93`` are one.
3. Per host, Spark adds the pages' votes for paths: each page votes for its best path, weighted by the share of
   the page's text that the path holds.
4. Each page takes, of the paths it has, the one with most votes on its host, and is read again with it.
   Every page has at least its own vote, so none is left without a path.

Votes are combined by counting; pages meet the votes as narrow rows (a key of the page and a hash of host and path for each of its
paths), dealt to ``SALT`` parts, and whole pages move once, by a hash of the page, so neither a host with a third of
all pages nor many copies of a page meet in one task.

The parser is linear in the length of a page and in the depth of its elements.

Defined cases: null or empty html gives an empty text; a page without body or containers is
read whole; a null or malformed url counts as host ''; repeated rows and repeated ids are pages
of their own; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import pin

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg math".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    option p pre section select summary table tbody td tfoot th thead tr ul""".split())
CONTAINER = frozenset("article body div main section td".split())
SKIP_TAGS = frozenset("nav header footer aside form button select dialog menu figure head".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: Words of a class, id or role that mark what is not the article, wherever they stand in it ...
MARKS = frozenset("""advert adverts advertisement breadcrumb breadcrumbs comment comments consent cookie cookies disqus gdpr
    newsletter paywall popup promo promoted promotion replies respond signup sponsor sponsored subscribe""".split())
#: ... or where all its words are among these and the neutral ones.
SKIP_WORDS = MARKS | frozenset("""ad ads banner footer header login menu modal nav navbar navigation notice notices related reply
    search share sharing sidebar social tags toolbar widget widgets""".split())
NEUTRAL = frozenset("""area bar block bottom box container global inner left links list main outer page primary right
    secondary section site top wrap wrapper""".split())
#: A class with one of these says something about its element, as in ``with-sidebar``.
SAYING = frozenset("with without no not has is".split())
#: Headings of the article stand in its own header.
KEPT_IN_ARTICLE = frozenset(("header", "figure"))

#: Share of a container's text that counts for the one around it.
DECAY = 0.8
SALT = 8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|"
                    r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NAMES = frozenset("class id role hidden style".split())
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Node:
    """An element: ``path`` is a number for its generalised path, ``step`` the last step of it."""

    __slots__ = ("tag", "step", "path", "skip", "parent", "link", "box", "order")

    def __init__(self, tag, step, path, skip, parent, link, order):
        self.tag, self.step, self.path, self.skip, self.parent, self.link, self.order = tag, step, path, skip, parent, link, order
        self.box = self if tag in CONTAINER else parent.box


def marks(value: str) -> bool:
    """Whether a class, id or role says that the element is no part of the article."""
    for name in value.lower().split():
        words = set(_WORDS.findall(name))
        if words & SAYING:
            continue
        if words & MARKS or words & SKIP_WORDS and words <= SKIP_WORDS | NEUTRAL:
            return True
    return False


def _attributes(text: str) -> tuple[str, bool]:
    """Generalised class, and whether the attributes mark the element as no article."""
    label, skip = "", False
    for m in _ATTR.finditer(text):
        name = m[1].lower()
        if name not in _NAMES:
            continue
        value = m[2] or m[3] or m[4] or ""
        if name == "hidden":
            skip |= value.lower() != "until-found"
        elif name == "style":
            skip |= "display:none" in value.replace(" ", "").lower()
        else:
            skip |= marks(value)
            if name == "class":
                label = ".".join(sorted({re.sub(r"\d+", "", c) for c in value.lower().split()} - {""}))
    return label, skip


def _number(parent: int, step: str) -> int:
    from xxhash import xxh3_64_intdigest
    return xxh3_64_intdigest(step.encode(), parent)


def parse(html: str | None) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Elements in page order, and blocks of text with the innermost block element of each.

    Paragraphs and list items end where the next one starts, elements left open end with their parents.
    """
    html = html or ""
    root = Node("body", "", 0, False, None, False, 0)
    nodes, blocks, stack, parts = [root], [], [root], []
    open_ = Counter()

    def flush():
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text:
                blocks.append((stack[-1], text))

    def pop():
        open_[stack.pop().tag] -= 1

    def close(tag):
        if not open_[tag]:
            return
        if tag not in BLOCK:  # a link does not end what holds it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    while len(stack) > i:
                        pop()
                    return
                if stack[i].tag in CONTAINER:
                    return
        else:
            while stack[-1].tag != tag:
                pop()
            pop()

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
                close(tag)
            elif tag == "a":
                close(tag)
            continue
        if tag in RAW and not m[3].endswith("/"):
            stop = _ENDS[tag].search(html, at)
            at = stop.end() if stop else end
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if stack[-1].tag == "head":  # its end may be left out
                pop()
            if tag == "body":
                continue
            if stack[-1].tag == "p" or tag == "li" and stack[-1].tag == "li":
                pop()
            if tag in VOID:
                continue
        elif tag != "a":
            continue
        top = stack[-1]
        label, skip = _attributes(m[3]) if m[3].strip() else ("", False)
        inside = tag in KEPT_IN_ARTICLE and (open_["article"] or open_["main"])
        skip = top.skip or skip or tag in SKIP_TAGS and not inside
        step = f"{tag}.{label}" if label else tag
        node = Node(tag, step, _number(top.path, step), skip, top, top.link or tag == "a", len(nodes))
        nodes.append(node)
        stack.append(node)
        open_[tag] += 1
        if m[3].endswith("/") and tag not in CONTAINER:
            pop()
    flush()
    return nodes, blocks


def scores(nodes: list[Node], blocks: list[tuple[Node, str]]) -> dict[int, float]:
    """Share of the page's article-like text under each path.

    A block counts in full for the container that holds it, and less by ``DECAY`` for each one around it, so that
    the tightest container with all blocks wins.  ``article`` and ``main`` say what they are.
    """
    held = defaultdict(float)
    total = 0.0
    for node, text in blocks:
        if not node.skip:
            size = len(text) * (0.1 if node.link else 1.0)
            total += size
            held[node.box.order] += size
    found: dict[int, float] = defaultdict(float)
    for order in range(len(nodes) - 1, -1, -1):
        size, node = held.get(order, 0.0), nodes[order]
        if size:
            found[node.path] += size * (2.0 if node.tag in ("article", "main") else 1.0)
            if node.parent is not None:
                held[node.parent.box.order] += size * DECAY
    return {p: s / total for p, s in found.items()} if total else {}


def best_path(nodes: list[Node], blocks: list[tuple[Node, str]], found: dict[int, float]) -> int | None:
    """The path with the best score, or the one around it that has the headline or a lead of its own."""
    if not found:
        return None
    best = max(found, key=lambda p: (found[p], p))
    box = next(n for n in nodes if n.path == best and n.box is n)
    heads, leads = set(), set()
    for node, _ in blocks:
        if not node.skip and not node.link:
            if node.tag in HEADINGS:
                heads.add(node.box.order)
            if node.tag == "p":
                leads.add(node.box.order)
    headed = set()  # containers with a heading anywhere below
    for order in sorted(heads, reverse=True):
        up = nodes[order]
        while up is not None and up.order not in headed:
            headed.add(up.order)
            up = up.parent.box if up.parent is not None else None
    paths = {nodes[o].path for o in headed}
    while box.path not in paths and box.parent is not None:
        around = box.parent.box
        if around.order not in heads and (around.tag == "body" or around.order not in leads):
            break
        box = around
    return box.path


def text_under(path: int, nodes: list[Node], blocks: list[tuple[Node, str]]) -> str:
    """The blocks below all containers with this path, in page order, joined by an empty line."""
    inside = [False] * len(nodes)
    for node in nodes:
        inside[node.order] = node.path == path or node.parent is not None and inside[node.parent.order]
    return "\n\n".join(text for node, text in blocks if not node.skip and inside[node.order])


def name_of(path: int, nodes: list[Node]) -> str:
    """The path in words."""
    node, steps = next((n for n in nodes if n.path == path and n.box is n), None), []
    while node is not None and node.parent is not None:
        steps.append(node.step)
        node = node.parent
    return "".join(f"/{s}" for s in reversed(steps))


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _vote(host: str, path: int) -> int:
    """A number for a path of a host, as a long."""
    return _number(path, f"host {host}") - (1 << 63)


def _keyed(pages: DataFrame) -> DataFrame:
    body = F.concat(F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("html", F.lit("")))
    return pages.withColumn("key", F.unhex(F.md5(body)))


def candidates(pages: DataFrame) -> DataFrame:
    """(key, vote, share, best): the paths of each page (url, html, key) that hold text, and whether it votes for it."""
    schema = "key binary, vote long, share double, best boolean"

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for key, url, html in zip(*(c.to_pylist() for c in part.columns)):
                    nodes, blocks = parse(html)
                    found, host = scores(nodes, blocks), host_of(url)
                    own = best_path(nodes, blocks, found)
                    total = sum(len(t) for n, t in blocks if not n.skip)
                    held = len(text_under(own, nodes, blocks).replace("\n\n", "")) / max(total, 1) if own is not None else 0.0
                    if own is not None:
                        rows.append((key, _vote(host, own), held, True))
                    rows += [(key, _vote(host, p), s, False) for p, s in found.items() if p != own]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.float64(), pa.bool_()))],
                                                 names=["key", "vote", "share", "best"])

    return pages.select("key", "url", "html").mapInArrow(work, schema)


def votes(found: DataFrame) -> DataFrame:
    """(vote, weight): the shares of all pages that vote for a path of their host, added up."""
    return found.filter("best").groupBy("vote").agg(F.sum("share").alias("weight"))


def chosen(found: DataFrame) -> DataFrame:
    """(key, vote): of each page's paths the one with the greatest weight on its host (ties: the page's own, then the greater share)."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    weights = votes(found).withColumn("part", parts)
    met = found.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int")).join(weights, ["vote", "part"])
    return met.groupBy("key").agg(F.max_by("vote", F.struct("weight", "best", "share", "vote")).alias("vote"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, path): the main text of every row, and the path that gave it."""
    narrow = _keyed(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")))
    best = chosen(pin(candidates(narrow), "host_paths"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    dealt = narrow.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    joined = dealt.join(best.withColumn("part", parts), ["key", "part"], "left").select("page_id", "url", "html", "vote")

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, used = [], []
                for url, html, vote in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    if vote is None:
                        texts.append("")
                        used.append(None)
                        continue
                    nodes, blocks = parse(html)
                    host = host_of(url)
                    path = next(n.path for n in nodes if n.box is n and not n.skip and _vote(host, n.path) == vote)
                    texts.append(text_under(path, nodes, blocks))
                    used.append(name_of(path, nodes))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(used, pa.string())],
                    names=["page_id", "url", "text", "path"])

    return joined.mapInArrow(work, "page_id long, url string, text string, path string")
