"""HTML extraction by wrapper induction.

The pages of a host are aligned with up to REFERENCES of them, which differ (those with the least hashes of their html).
DOM trees are folded first: neighbouring siblings with the same tag and class become one node that holds the
text of all. Simple tree matching then pairs a page's nodes with a reference's: roots must agree, and children are aligned in
order so that the number of pairs is largest. A pair's number depends on the shape of the two subtrees only, so it's made once
for each two shapes, and rows of the alignment table are vectors; tables aren't kept whole, so memory is bounded.

Over the distinct pages of a host, a text is template that stands at one node of a reference in most pages (the lower bound of
its share's confidence interval is CONSTANT or more), and so is all of a node whose texts are few (the upper bound of the
share of different texts is below VARIED), as adverts that rotate. The bounds take the place of a least number of pages. What isn't template varies: the slots.

`choose` then picks a page's content among its slots. Scripts, menus, footers, forms and the like by element never count.
A part that is named as a menu, advert, comment and so on, by whole tokens of class, id or role, is left out, unless
it holds an article or main, or most of the text with none elsewhere. Then the region is found: from the root
down to the one element that holds nearly all slot text. Text of a page's only article or main weighs ARTICLE times, so it is a strong signal
and no rule. Slots in the region are the result. Pages may be copies, or share a title, so in a page's only article just constant texts
are template, and no more than half of it; nor does the template take all text of a page.

The references are joined to the pages by host: broadcast if they have BROADCAST bytes at most, else by a shuffle. Counts are partial sums by host and node. So a
host with most of the pages is split over tasks. Null html counts as empty, and its text is empty. Pages
without a host in their url form one group. Repeated rows are pages of their own in the result and one page in the counts.
Of parts with equal text the first is the region's. An empty table gives an empty result; extra columns play no part.
Very long and very deep pages are aligned whole.
"""

from __future__ import annotations

import math
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torrentia.llm.common import discard, materialise

REFERENCES = 3
VARIED, CONSTANT, Z = 0.5, 0.7, 1.96  # shares, and the width of their intervals
NEARLY, MOST, ARTICLE = 0.9, 0.8, 40
BROADCAST = 32 << 20  # most bytes of references that are broadcast
ENTRY = 64  # bytes of a template's entry, at most

# Fixed values of HTML: elements without content, and elements that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
# Parts that aren't the article, by element and by word in class, id or role.
SKIP_TAGS = frozenset("script style noscript template nav footer aside form head button select textarea iframe object svg canvas audio video dialog menu search".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar "
    "navigation newsletter notice popup promo promoted related reply replies search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
REMARKS = frozenset("comment comments reply replies ad related promo sponsored".split())


#: What `choose` knows of a node.
CONTAINER, MAIN, IS_ARTICLE, NAMED, HEADING, REMARK = 1, 2, 4, 8, 16, 32


class Node:
    __slots__ = ("children", "flags", "hard", "label", "place", "tag", "texts", "up")

    def __init__(self, tag: str, label: str, up: Node | None = None, hard: bool = False, flags: int = 0):
        """hard: left out by element, its parts too."""
        self.tag, self.label, self.up, self.hard, self.flags = tag, label, up, hard, flags
        self.place = -1
        self.children: list[Node] = []
        self.texts: list[int] = []


class Dom(HTMLParser):
    """The page's elements, its block elements in page order, and its blocks of text in page order as (element, text)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", "", flags=CONTAINER)
        self.stack, self.open, self.blocks = [self.root], [], []
        self.feed(html)
        self.close()
        self.flush()
        self.nodes, todo = [], [self.root]
        while todo:
            n = todo.pop()
            n.place = len(self.nodes)
            self.nodes.append(n)
            todo += reversed(n.children)

    def flush(self) -> None:
        """Ends the block of text that is open."""
        if self.open:
            text = " ".join("".join(data for _, data in self.open).split())
            if text:
                owner = self.open[0][0]
                while owner.tag not in BLOCK and owner is not self.root:
                    owner = owner.up
                owner.texts.append(len(self.blocks))
                self.blocks.append((owner, text))
            self.open = []

    def handle_data(self, data: str) -> None:
        at = self.stack[-1]
        if not at.hard:
            self.open.append((at, data))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.handle_data(" ")
            return
        block = tag in BLOCK
        if block:
            self.flush()
            if any(n.tag == "p" for n in self.stack[-3:]):
                self._close("p", BLOCK - {"p"})
            if tag in CLOSES:
                for other in CLOSES[tag]:
                    self._close(other, HOLDS[tag])
        parent, named = self.stack[-1], dict(attrs)
        words = {w for k in ("class", "id", "role") for w in (named.get(k) or "").lower().split()}
        is_named = bool(words & SKIP_WORDS) and tag not in ("html", "body", "main")
        main = (tag in ("article", "main") or named.get("role") == "main") and not (is_named and words & REMARKS)
        top = tag == "header" and not self._inside_main(parent)
        flags = CONTAINER * (tag in CONTAINERS) | MAIN * main | IS_ARTICLE * (main and tag == "article") | NAMED * ((is_named and not main) or top) | HEADING * (tag in ("h1", "h2")) | REMARK * bool(words & REMARKS)
        node = Node(tag, f"{tag}.{named.get('class') or ''}" if block else tag, parent, parent.hard or tag in SKIP_TAGS or "hidden" in named, flags)
        if block:
            owner = parent
            while owner.tag not in BLOCK and owner is not self.root:
                owner = owner.up
            if not node.hard:
                node.up = owner
                owner.children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def _inside_main(self, node: Node) -> bool:
        return any(n.flags & MAIN for n in self.stack)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if any(n.tag == tag for n in self.stack):
            while self.stack[-1].tag != tag:
                self.stack.pop()
            self.stack.pop()

    def _close(self, tag: str, until: frozenset | set) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in until:
                return


class Folded:
    """A run of neighbouring siblings with one label. shape: the number of its label tree among all shapes seen."""

    __slots__ = ("blocks", "children", "label", "number", "shape", "size")


def text_hash(texts: list[str]) -> int:
    return xxhash.xxh64_intdigest("\0".join(texts).encode("utf-8", "replace")) - (1 << 63)


def fold(dom: Dom, shapes: dict) -> list[Folded]:
    """The folded tree's nodes in pre-order; the first is the root. shapes: label and children's shapes to their number."""
    out: list[Folded] = []
    todo = [(None, [dom.root])]
    while todo:
        above, members = todo.pop()
        f = Folded()
        f.label, f.number, f.blocks, f.children = members[0].label, len(out), [b for m in members for b in m.texts], []
        out.append(f)
        if above is not None:
            above.children.append(f)
        runs: list[list[Node]] = []
        for c in (c for m in members for c in m.children):
            if runs and runs[-1][0].label == c.label:
                runs[-1].append(c)
            else:
                runs.append([c])
        todo += [(f, run) for run in reversed(runs)]
    for f in reversed(out):
        f.shape = shapes.setdefault((f.label, *[c.shape for c in f.children]), len(shapes))
    return out


class Matcher:
    """Simple tree matching of folded trees; the numbers of pairs are kept by the two shapes."""

    def __init__(self):
        self.shapes: dict = {}
        self.known: dict[tuple[int, int], int] = {}

    def count(self, a: Folded, b: Folded) -> int:
        """The largest number of pairs of two subtrees whose roots agree."""
        todo = [(a, b)]
        while todo:  # no recursion: pages can be deep
            x, y = todo[-1]
            kinds = [list({c.shape: c for c in t.children}.values()) for t in (x, y)]
            open_ = [] if (x.shape, y.shape) in self.known else [(c, d) for c in kinds[0] for d in kinds[1] if c.label == d.label and (c.shape, d.shape) not in self.known]
            if open_:
                todo += open_
                continue
            todo.pop()
            if (x.shape, y.shape) not in self.known:
                row = np.zeros(len(y.children) + 1, np.int64)
                for w in self._weights(x.children, y.children) if len(row) > 1 else ():
                    row = self._next(row, w)
                self.known[x.shape, y.shape] = 1 + int(row[-1])
        return self.known[a.shape, b.shape]

    def _weights(self, x: list[Folded], y: list[Folded], begin: int = 0, end: int | None = None):
        """For each of x, the numbers of pairs with each of y."""
        shape = np.array([d.shape for d in y])
        kinds = {d.shape: d for d in y}
        made: dict[int, np.ndarray] = {}
        for c in x[begin:end]:
            if c.shape not in made:
                made[c.shape] = np.zeros(len(y), np.int64)
                for s, d in kinds.items():
                    if d.label == c.label:
                        made[c.shape][shape == s] = self.count(c, d)
            yield made[c.shape]

    @staticmethod
    def _next(row: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = row.copy()
        out[1:] = np.maximum(row[1:], row[:-1] + w)
        return np.maximum.accumulate(out)

    def aligned(self, x: list[Folded], y: list[Folded]) -> list[tuple[Folded, Folded]]:
        """The children that an alignment with the most pairs puts together. Every step-th row of the table is kept, the others are made again on the way back."""
        if [c.label for c in x] == [c.label for c in y] and len({c.label for c in x}) == len(x):
            return list(zip(x, y, strict=True))
        step = max(1, math.isqrt(len(x)))
        row, kept = np.zeros(len(y) + 1, np.int64), []
        for i, w in enumerate(self._weights(x, y)):
            if i % step == 0:
                kept.append(row)
            row = self._next(row, w)
        picked, j = [], len(y)
        for k in range(len(kept) - 1, -1, -1):
            ws = list(self._weights(x, y, k * step, (k + 1) * step))
            rows = [kept[k]]
            for w in ws:
                rows.append(self._next(rows[-1], w))
            for i in range(len(ws) - 1, -1, -1):
                while j and rows[i + 1][j] == rows[i + 1][j - 1]:
                    j -= 1
                if j and rows[i + 1][j] != rows[i][j]:
                    picked.append((x[k * step + i], y[j - 1]))
                    j -= 1
        return picked[::-1]

    def pairs(self, a: Folded, b: Folded) -> list[tuple[Folded, Folded]]:
        out, todo = [], [(a, b)] if a.label == b.label else []
        while todo:
            a, b = todo.pop()
            out.append((a, b))
            if a.children and b.children:
                todo += self.aligned(a.children, b.children)
        return out


def choose(up: list[int], label: list[int], flags: list[int], owner: list[int], size: list[int], few: list[bool], constant: list[bool]) -> list[int]:
    """The blocks that are content. Nodes in page order: parent (the root's is -1), label, flags; blocks: node, number of characters, whether their node or they are template."""
    n, size = len(up), np.array(size, np.int64)
    if not len(size):
        return []
    inside, holds = [-1] * n, [False] * n  # the outermost article or main that a node is in; whether it holds one
    end = list(range(1, n + 1))  # a node's subtree is the places up to its end
    for i in range(n):
        inside[i] = inside[up[i]] if i and inside[up[i]] >= 0 else i if flags[i] & MAIN else -1
    for i in range(n - 1, 0, -1):
        end[up[i]] = max(end[up[i]], end[i])
        holds[up[i]] |= holds[i] or bool(flags[i] & MAIN)
    owner = np.array(owner)

    def weigh(alive: np.ndarray, times: np.ndarray | int = 1) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(np.bincount(owner, size * alive * times, minlength=n))])
        return before[end] - before[:-1]

    every = weigh(np.ones(len(size), bool))
    mains = [i for i in range(n) if inside[i] == i and every[i]]
    only = mains[0] if len(mains) == 1 else -1
    within = np.array([inside[o] == only and only >= 0 for o in owner])
    alive = ~(np.array(constant, bool) | (np.array(few, bool) & ~within))
    if only >= 0 and 2 * weigh(alive)[only] < every[only]:
        alive |= within
    if not alive.any():
        alive[:] = True
    w, left, varying = weigh(alive), alive.copy(), weigh(~(np.array(constant, bool) | np.array(few, bool)))
    for i in range(n):
        if flags[i] & NAMED and not holds[i]:
            if inside[i] >= 0 and not flags[i] & REMARK and varying[i]:
                continue  # within an article such a name counts only where the pages show that its text is template
            base = inside[i] if inside[i] >= 0 else 0
            if w[i] < MOST * w[base] or (mains and inside[i] < 0):
                left &= (owner < i) | (owner >= end[i])
    alive = left if left.any() else alive

    w = weigh(alive, np.where(within, ARTICLE, 1))
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        if w[i]:
            kids[up[i]].append(i)
    head = weigh(alive & np.array([bool(flags[o] & HEADING) for o in owner]))
    at = 0
    while kids[at] and not flags[at] & IS_ARTICLE:
        best = max(kids[at], key=lambda i: (w[i], -i))
        others = [i for i in kids[at] if i != best]
        to_main = only >= 0 and best <= only < end[best]
        if not flags[best] & CONTAINER or w[best] < NEARLY * w[at] or any(label[i] == label[best] for i in others):
            break
        if (flags[at] & MAIN and not flags[best] & IS_ARTICLE) or (not to_main and any(head[i] for i in others)):
            break
        at = best
    return [b for b in range(len(size)) if alive[b] and at <= owner[b] < end[at]]


def page_rows(matcher: Matcher, html: str, references: list[tuple[Dom, list[Folded], str]]) -> dict:
    """A page's skeleton and blocks, where they lie in each reference, and what its paired nodes say of the reference's."""
    dom = Dom(html)
    tree = fold(dom, matcher.shapes)
    at, nodes, hits = [], [], []
    for k, (ref, ref_tree, ref_html) in enumerate(references):
        node = [-1] * len(dom.blocks)
        for r, p in matcher.pairs(ref_tree[0], tree[0]):
            for b in p.blocks:
                node[b] = r.number
            if p.blocks and html != ref_html:
                texts = [dom.blocks[b][1] for b in p.blocks]
                nodes.append({"ref": k, "node": r.number, "print": text_hash(texts)})
                hits += [{"ref": k, "node": r.number, "text": text_hash([t])} for t in {ref.blocks[b][1] for b in r.blocks} & set(texts)]
        at.append(node)
    return {
        "up": [n.up.place if n.up else -1 for n in dom.nodes], "label": [zlib.crc32(n.label.encode("utf-8", "replace")) >> 1 for n in dom.nodes], "flags": [n.flags for n in dom.nodes],
        "owner": [n.place for n, _ in dom.blocks], "texts": [t for _, t in dom.blocks], "at": at, "nodes": nodes, "hits": hits, "print": text_hash([html]),
    }


PARSED = (
    "page_id long, url string, host string, print long, up array<int>, label array<int>, flags array<int>, owner array<int>, texts array<string>, at array<array<int>>, "
    "nodes array<struct<ref:int,node:int,print:long>>, hits array<struct<ref:int,node:int,text:long>>"
)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, html to one row a page as in PARSED."""
    references = F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64(F.lit(k), "html"), "html"))["html"] for k in range(REFERENCES)]))
    refs = materialise(pages.where("html <> ''").groupBy("host").agg(references.alias("references")).withColumnRenamed("host", "r_host"))

    size = refs.agg(F.sum(F.aggregate("references", F.lit(0).cast("long"), lambda n, r: n + F.octet_length(r)))).first()[0] or 0
    if size <= BROADCAST:  # else they meet by a shuffle, in which hot hosts are split
        refs = F.broadcast(refs)

    def run(batches):
        matcher, known = Matcher(), {}
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                part, rows = pdf.iloc[k : k + 256], []
                for host, html, of_host in part[["host", "html", "references"]].itertuples(index=False):
                    of_host = [] if of_host is None else list(of_host)
                    if known.get(host, (None,))[0] != of_host:
                        if len(known) >= 64 or len(matcher.known) > 1_000_000:
                            matcher, known = Matcher(), {}
                        doms = [Dom(r) for r in of_host]
                        known[host] = (of_host, [(d, fold(d, matcher.shapes), r) for d, r in zip(doms, of_host, strict=True)])
                    rows.append(page_rows(matcher, html, known[host][1]))
                yield pd.concat([part[["page_id", "url", "host"]].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    joined = pages.join(refs, F.col("host") == F.col("r_host"), "left").select("page_id", "url", "host", "html", "references")
    return joined.mapInPandas(run, PARSED)


def _bound(share: Column, n: Column, side: int) -> Column:
    """The lower (-1) or upper (1) bound of Wilson's interval."""
    z2 = Z * Z
    return (share + z2 / (2 * n) + side * Z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def template(pages: DataFrame) -> DataFrame:
    """From parsed pages: t_host and its template, an array of (ref, node, whole, text): all of a node, or one text at it. A written table."""
    once = materialise(pages.groupBy("host", "print").agg(F.first("nodes").alias("nodes"), F.first("hits").alias("hits")).drop("print"))
    prints = once.select("host", F.explode("nodes").alias("c")).groupBy("host", "c.ref", "c.node", "c.print").agg(F.count(F.lit(1)).alias("n"))
    slots = materialise(prints.groupBy("host", "ref", "node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")))
    few = slots.where(_bound(F.col("d") / F.col("n"), F.col("n"), 1) < VARIED).select("host", "ref", "node", F.lit(True).alias("whole"), F.lit(0).cast("long").alias("text"))
    texts = once.select("host", F.explode("hits").alias("c")).groupBy("host", "c.ref", "c.node", "c.text").agg(F.count(F.lit(1)).alias("k"))
    often = texts.join(slots, ["host", "ref", "node"]).where(_bound(F.col("k") / F.col("n"), F.col("n"), -1) >= CONSTANT).select("host", "ref", "node", F.lit(False).alias("whole"), "text")
    found = materialise(few.union(often).groupBy(F.col("host").alias("t_host")).agg(F.collect_list(F.struct("ref", "node", "whole", "text")).alias("template")))
    discard(once)
    discard(slots)
    return found


def content(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """page_id, url, text of parsed pages."""

    def run(batches):
        for pdf in batches:
            out = []
            for up, label, flags, owner, texts, at, found in pdf[["up", "label", "flags", "owner", "texts", "at", "template"]].itertuples(index=False):
                known = set() if found is None else {(t["ref"], t["node"], None if t["whole"] else t["text"]) for t in found}
                few = [any((k, a[b], None) in known for k, a in enumerate(at)) for b in range(len(texts))] if known else [False] * len(texts)
                constant = [any((k, a[b], text_hash([t])) in known for k, a in enumerate(at)) for b, t in enumerate(texts)] if known else few
                kept = choose(list(up), list(label), list(flags), list(owner), [len(t) for t in texts], few, constant)
                out.append(" ".join(texts[b] for b in kept))
            yield pdf[["page_id", "url"]].assign(text=out)

    size = templates.agg(F.sum(F.size("template"))).first()[0] or 0
    if size * ENTRY <= BROADCAST:  # else pages and templates meet by a shuffle
        templates = F.broadcast(templates)
    joined = pages.drop("nodes", "hits", "print").join(templates, F.col("host") == F.col("t_host"), "left")
    return joined.select("page_id", "url", "up", "label", "flags", "owner", "texts", "at", "template").mapInPandas(run, "page_id long, url string, text string")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), host.alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = materialise(parsed(own))
    found = content(rows, template(rows))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_html_extract(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
