"""Main text of web pages by wrapper induction.

1. Each page becomes a tree of its block elements (label: tag and class words) with a hash of each block's own text.
2. The pages of a host are parted by layout: the tags and class words of the frame around the article (main element, heading,
   first paragraph). Per host and layout the pages with the PIVOTS lowest hashes are pivots. Every page is aligned with them by simple tree
   matching (the largest order-preserving mapping of equally labelled nodes, by dynamic programming over child lists). For each
   pivot node the pages where it is matched with the same text are counted over the distinct pages: pages of a layout with the same
   extracted text (one article under many urls, whatever its scripts and menus) count once, blank pages do not count.
3. A node whose text is the same in at least SUPPORT of the distinct pages and in a share CONSTANT of all of them is template; the
   other nodes are slots. The pivots with their template nodes are the wrapper. What recurs but is absent from one pivot is found in
   another: a node of CONSTANT of the pages is missing from all of them once in a thousand times.
4. Every page is aligned with the wrapper of its host and layout. Its text is what stands in slots, inside the article (or main element)
   where the page marks one, without elements whose tag, role or class names them as menus, headers, footers, sidebars,
   notices, adverts, forms or reader comments. Without an article, menus go too: two or more blocks side by side (items of a list, cells,
   containers) that all hold nothing but links, or one such block with two or more links. Headings, paragraphs and quotes are text, also
   when they are links. Pages without a
   wrapper (under SUPPORT distinct pages of the host and layout, no host) are judged by their own markup.

Text: character references decoded, white space inside a block made one space, blocks joined by a line feed, in page
order. A line break is white space. Null pages are empty. The work per page is linear but for the alignment. Child lists of any length are
matched alike; where their table would exceed CELLS cells, equal ends are paired first and the rest is halved (Hirschberg), row by
row in linear memory. Of the largest mappings of two child lists the one with most equal texts is taken. A hot host is no hot task: counts are combined before the exchange, and
pages join wrappers by a join that can be split.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

from barloom.llm.common import arrow_rows, cut_lineage

SUPPORT = 10
CONSTANT = 0.9
PIVOTS = 3
CELLS = 250_000
#: a matched node counts as so many equal texts
NODE = 1 << 24
DEPTH = 60
TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?/](?![a-zA-Z])[^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?"
                 r"|<([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?=>)|[^>]*)>?", re.S)
#: one attribute after the other from the left: what stands in a value or behind data- is no name
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary "
                   "table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
#: no running text outside an article only
LOOSE_TAGS = frozenset("fieldset object math label".split())
JUNK_TAGS = frozenset("head nav footer aside form button select option dialog menu fieldset object svg canvas audio video math label".split())
RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
JUNK_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay cookie cookies "
                       "consent gdpr notice notices alert disclaimer nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot "
                       "sidebar side aside widget related recommended share sharing social subscribe newsletter signup login search form comment "
                       "comments commentlist disqus reply replies respond discussion pagination pager tags toc copyright skip".split())
TITLE_WORDS = frozenset(("header", "masthead"))
WORDS = re.compile(r"[a-z]+")
#: a start tag that closes an open element of these kinds
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
          "tbody": ("tbody", "thead", "tr", "td", "th")}
ITEMS = frozenset("li dt dd td th".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre caption figcaption address summary legend".split())
SCOPE = frozenset("html body table ul ol dl article section div main td th aside nav header footer form blockquote select".split())


class Page:
    """Block tree of a page. Node 0 is the root; ``pieces`` holds (node, text, in a link) in page order, node -1 marking the
    border of a block."""

    def __init__(self, source: str):
        self.label, self.parent, self.junk, self.main = ["html"], [-1], [0], [False]
        self.pieces: list[tuple[int, str, bool]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block node they belong to
        opened = defaultdict(int)  # how many of a kind are open: what is not open is not searched for
        pieces, at, n = self.pieces, 0, len(source)

        def cut(k: int) -> None:
            for t, _ in stack[k:]:
                opened[t] -= 1
            del stack[k:]

        def close(kinds: tuple[str, ...]) -> None:
            if any(opened[t] > 0 for t in kinds):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in kinds:
                        return cut(k)
                    if stack[k][0] in SCOPE:
                        return

        while at < n:
            m = TAG.search(source, at)
            end = m.start() if m else n
            if end > at:
                pieces.append((stack[-1][1], entities.unescape(source[at:end]), opened["a"] > 0))
            if not m:
                break
            at = m.end()
            if m[1]:
                tag = m[1].lower()
                for k in range(len(stack) - 1 if opened[tag] > 0 else 0, 0, -1):
                    if stack[k][0] == tag:
                        cut(k)
                        break
                    if tag not in SCOPE and stack[k][0] in SCOPE:
                        break
                if tag in BLOCKS:
                    pieces.append((-1, "", False))
            elif m[2]:
                tag = m[2].lower()
                if tag == "br":
                    pieces.append((stack[-1][1], " ", opened["a"] > 0))
                if tag in BLOCKS:
                    pieces.append((-1, "", False))
                    close(("p",))
                    if tag in CLOSES:
                        close(CLOSES[tag])
                if tag in RAW:
                    end = RAW_END[tag].search(source, at)
                    at = end.start() if end else n
                    stack.append((tag, self._node(tag, "", stack[-1][1], junk=True)))
                    opened[tag] += 1
                    continue
                if tag in VOID:
                    continue
                node = stack[-1][1]
                if tag in BLOCKS or tag in JUNK_TAGS or m[3] and self._named_junk(m[3], self.main[node]):
                    node = self._node(tag, m[3], node)
                stack.append((tag, node))
                opened[tag] += 1

    @staticmethod
    @lru_cache(1 << 14)  # start tags of a host repeat
    def _named_junk(attributes: str, in_article: bool = False) -> bool:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in JUNK_ROLES:
                return True
            if name in ("class", "id"):
                # in an article only a whole name counts: text-side and related-work are its own
                words = JUNK_WORDS.intersection(value.split() if in_article else WORDS.findall(value))
                if words and not (in_article and words <= TITLE_WORDS):
                    return True
        return False

    @staticmethod
    @lru_cache(1 << 14)
    def _class_words(attributes: str) -> str:
        words = ""
        for m in ATTRIBUTE.finditer(attributes):
            if m[1].lower() == "class":
                words = " ".join(sorted(WORDS.findall((m[2] or m[3] or m[4] or "").lower())))
        return words

    def _node(self, tag: str, attributes: str, parent: int, junk: bool = False) -> int:
        words = self._class_words(attributes) if attributes else ""
        inside = self.main[parent]
        named = bool(attributes) and tag not in ("html", "body", "main") and self._named_junk(attributes, inside)
        self.label.append(f"{tag}.{words}")
        self.parent.append(parent)
        # by tag 2, by name 1
        self.junk.append(2 if junk or tag in JUNK_TAGS and not (inside and tag in LOOSE_TAGS) or tag == "header" and not inside else int(named))
        self.main.append(inside or tag in ("article", "main") or "role" in attributes and 'role="main"' in attributes)
        return len(self.label) - 1

    def own_texts(self) -> list[str]:
        parts: list[list[str]] = [[] for _ in self.label]
        for node, text, _ in self.pieces:
            if node >= 0:
                parts[node].append(text)
        return [" ".join("".join(p).split()) for p in parts]

    def skeleton(self) -> bytes:
        """Parent, label hash and text hash of each node, in document order."""
        out = np.empty((len(self.label), 3), "<u4")
        out[:, 0] = [max(p, 0) for p in self.parent]
        out[:, 1] = [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in self.label]
        out[:, 2] = [zlib.crc32(x.encode("utf-8", "surrogatepass")) if x else 0 for x in self.own_texts()]
        return out.tobytes()

    def _kept(self) -> list[bool]:
        keep = [True] * len(self.label)
        for i in range(1, len(keep)):
            keep[i] = keep[self.parent[i]] and not self.junk[i]
        return keep

    def text(self, template: set[int]) -> str:
        """Text outside junk and template nodes; within the article where there is one."""
        keep = self._kept()
        if any(self.main) and not any(m and k for m, k in zip(self.main, keep)):
            # a frame named like a sidebar that holds the only article is no sidebar
            i = next((i for i, m in enumerate(self.main) if m and not self.junk[i]), 0)
            while i > 0:
                self.junk[i], i = self.junk[i] * (self.junk[i] == 2), self.parent[i]
            keep = self._kept()
        marked = any(m and k for m, k in zip(self.main, keep))
        blocks, parts, at, linked, size, links, inside = [], [], 0, 0, 0, 0, False
        for node, text, link in [*self.pieces, (-1, "", False)]:
            if node < 0:
                block = " ".join("".join(parts).split())
                if block:
                    blocks.append((block, at, links if linked == size > 0 else 0))
                parts, linked, size, links, inside = [], 0, 0, 0, False
            elif keep[node] and node not in template and (self.main[node] or not marked):
                parts.append(text)
                at = node
                if not marked:
                    n = sum(map(str.isalnum, text))
                    size += n
                    linked += n * link
                    links += link and not inside
                    inside = link
        menu = set() if marked else self._menus(blocks)
        return "\n".join(block for k, (block, _, _) in enumerate(blocks) if k not in menu)

    def _menus(self, blocks: list[tuple[str, int, int]]) -> set[int]:
        """Numbers of the blocks that are menus, of (text, node, number of links if there is nothing else)."""
        beside: dict[int, list[int]] = {}  # blocks by the container of their items
        single, items = set(), {}
        for k, (_, node, links) in enumerate(blocks):
            item, i = node, node
            while i > 0 and self.label[i].partition(".")[0] not in ("ul", "ol", "dl", "table"):
                if self.label[i].partition(".")[0] in ITEMS:
                    item = i
                    break
                i = self.parent[i]
            beside.setdefault(self.parent[item], []).append(k)
            items[k] = item
            tag = self.label[item].partition(".")[0]
            if links > 1 and item > 0 and tag not in RUNNING and tag not in ("body", "html"):
                single.add(k)
        out = {k for k in single if sum(items[j] == items[k] for j in beside[self.parent[items[k]]]) == 1}
        for group in beside.values():
            if len({items[k] for k in group}) > 1 and all(blocks[k][2] and self.label[items[k]].partition(".")[0] not in RUNNING for k in group):
                out.update(group)
        return out


class Tree:
    """A skeleton ready for matching."""

    def __init__(self, skeleton: bytes, shapes: dict):
        data = np.frombuffer(skeleton, "<u4").reshape(-1, 3)
        parents, self.label, self.own = data[:, 0].tolist(), data[:, 1].tolist(), data[:, 2].tolist()
        n = len(parents)
        depth = [0] * n
        self.kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            p = parents[i]
            while depth[p] >= DEPTH:  # very deep markup is hung up higher
                p = parents[p]
            depth[i] = depth[p] + 1
            self.kids[p].append(i)
        self.shape, self.order = [0] * n, [[]] * n
        for i in range(n - 1, -1, -1):
            key = (self.label[i], *(self.shape[k] for k in self.kids[i]))
            self.shape[i] = shapes.setdefault(key, len(shapes))


def match(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Pairs of nodes of the largest order-preserving mapping of a's root onto b's that simple tree matching finds."""
    known: dict[tuple[int, int], int] = {}

    def weight(i: int, j: int) -> int:
        if a.label[i] != b.label[j]:
            return 0
        ka, kb = a.kids[i], b.kids[j]
        if not ka or not kb:
            return 1
        key = (a.shape[i], b.shape[j])
        if key not in known:
            known[key] = 1 + (int(last_row(ka, kb)[-1]) // NODE if len(ka) * len(kb) > CELLS else table(ka, kb)[-1][-1] // NODE)
        return known[key]

    def table(ka: list[int], kb: list[int]) -> list[list[int]]:
        rows = [[0] * (len(kb) + 1)]
        for i in ka:
            last, row, left = rows[-1], [0], 0
            label, own, leaf = a.label[i], a.own[i], not a.kids[i]
            for y, j in enumerate(kb):
                best = last[y + 1] if last[y + 1] > left else left
                if label == b.label[j]:
                    w = last[y] + NODE * (1 if leaf or not b.kids[j] else weight(i, j)) + (own == b.own[j] and own != 0)
                    if w > best:
                        best = w
                row.append(best)
                left = best
            rows.append(row)
        return rows

    def last_row(ka: list[int], kb: list[int]) -> np.ndarray:
        """The table's last row, by whole rows."""
        kinds: dict[tuple[int, int], int] = {}
        place = np.array([kinds.setdefault((b.label[j], b.shape[j]), len(kinds)) for j in kb])
        sample = dict(zip(place.tolist(), kb))
        own = np.array([b.own[j] for j in kb], np.int64)
        row = np.zeros(len(kb) + 1, np.int64)
        for i in ka:
            w = np.array([weight(i, sample[k]) for k in range(len(kinds))], np.int64)[place]
            gain = w * NODE + ((own == a.own[i]) & (w > 0) if a.own[i] else 0)
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gain))
        return row

    def pairs(ka: list[int], kb: list[int]) -> list[tuple[int, int]]:
        out = []
        todo = [(ka, kb)]
        while todo:
            ka, kb = todo.pop()
            if len(ka) * len(kb) > CELLS:
                same = lambda i, j: a.shape[i] == b.shape[j] and a.own[i] == b.own[j]
                x = next((x for x, (i, j) in enumerate(zip(ka, kb)) if not same(i, j)), min(len(ka), len(kb)))
                out += zip(ka[:x], kb[:x])
                ka, kb = ka[x:], kb[x:]
                x = next((x for x, (i, j) in enumerate(zip(reversed(ka), reversed(kb))) if not same(i, j)), min(len(ka), len(kb)))
                out += zip(ka[len(ka) - x:], kb[len(kb) - x:])
                ka, kb = ka[:len(ka) - x], kb[:len(kb) - x]
            if len(ka) * len(kb) > CELLS and len(ka) > 1:
                half = len(ka) // 2
                cut = int(np.argmax(last_row(ka[:half], kb) + last_row(ka[:half - 1:-1], kb[::-1])[::-1]))
                todo += [(ka[:half], kb[:cut]), (ka[half:], kb[cut:])]
            elif ka and kb:
                rows, x, y = table(ka, kb), len(ka), len(kb)
                while x and y:
                    if rows[x][y] == rows[x - 1][y]:
                        x -= 1
                    elif rows[x][y] == rows[x][y - 1]:
                        y -= 1
                    else:
                        x, y = x - 1, y - 1
                        out.append((ka[x], kb[y]))
        return out

    out, todo = [], [(0, 0)]
    while todo:
        i, j = todo.pop()
        out.append((i, j))
        ka, kb = a.kids[i], b.kids[j]
        if ka and kb:
            todo += zip(ka, kb) if a.shape[i] == b.shape[j] else pairs(ka, kb)
    return out


#: where the frame of a page ends, the surest sign first
CONTENT = [re.compile(f"<(?:{tags})(?![a-z0-9-])", re.I) for tags in ("article|main", "h1", "p")]
BLANK = hashlib.blake2b(b"", digest_size=16).digest()
BONES = "host string, layout long, content binary, skeleton binary"


def layout(source: str) -> int:
    """Hash of the labels around the first sign of content: root, body and the containers down to it."""
    m = next((m for m in (c.search(source) for c in CONTENT) if m), None)
    if not m:
        return 0
    frame = Page(source[:m.end()] + ">")
    path, i = [], frame.parent[-1]
    while i > 0:
        path.append(frame.label[i])
        i = frame.parent[i]
    return zlib.crc32("/".join(path).encode("utf-8", "surrogatepass"))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, source in zip(*(batch.column(c).to_pylist() for c in ("host", "html"))):
            page = Page(source)
            bones = page.skeleton()
            text = page.text(set()).encode("utf-8", "surrogatepass")
            rows.append((host, layout(source), hashlib.blake2b(text, digest_size=16).digest(), bones))
        if rows:
            yield arrow_rows(BONES, rows)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shapes, trees, sums = {}, {}, {}
        for host, kind, skeleton, pivots in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "skeleton", "pivots"))):
            if (host, kind) not in trees:
                trees[host, kind] = [Tree(p, shapes) for p in pivots]
            other = Tree(skeleton, shapes)
            for k, own in enumerate(trees[host, kind]):
                for i, j in match(own, other):
                    if own.own[i] and own.own[i] == other.own[j]:
                        key = (host, kind, (k << 32) + i)
                        sums[key] = sums.get(key, 0) + 1
        if sums:
            yield arrow_rows("host string, layout long, place long, same long", [(*key, n) for key, n in sums.items()])


def wrappers(pages: DataFrame) -> DataFrame:
    """One row per host and layout: host, layout, the pivots' skeletons and their template nodes ((pivot << 32) + node)."""
    group = ["host", "layout"]
    rows = pages.select("host", "html").filter("host is not null and html is not null")
    bones = rows.mapInArrow(_skeletons, BONES).filter(F.col("content") != F.lit(BLANK))
    bones = cut_lineage(bones.groupBy(*group, "content").agg(F.min("skeleton").alias("skeleton")))
    sizes = bones.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SUPPORT)
    first = F.row_number().over(Window.partitionBy(*group).orderBy("content"))  # pruned per task before the exchange
    lowest = bones.withColumn("k", first).filter(F.col("k") <= PIVOTS)
    pivots = cut_lineage(lowest.groupBy(*group).agg(F.sort_array(F.collect_list("skeleton")).alias("pivots")).join(sizes, group))
    counts = bones.join(pivots, group).mapInArrow(_counts, "host string, layout long, place long, same long")
    fixed = counts.groupBy(*group, "place").agg(F.sum("same").alias("same")).join(pivots.select(*group, "n"), group)
    fixed = fixed.filter((F.col("same") >= SUPPORT) & (F.col("same") >= CONSTANT * F.col("n")))
    return pivots.join(fixed.groupBy(*group).agg(F.collect_list("place").alias("template")), group).select(*group, "pivots", "template")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(3)
    for batch in batches:
        sources = [s or "" for s in batch.column("html").to_pylist()]
        z = [pack.compress(s.encode("utf-8", "surrogatepass")) for s in sources]
        kinds = pa.array([layout(s) for s in sources], pa.int64())
        yield batch.select(["page_id", "url", "host"]).append_column("layout", kinds).append_column("z", pa.array(z, pa.binary()))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        shapes, trees, texts = {}, {}, []
        for host, kind, z, pivots, places in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "z", "pivots", "template"))):
            page, template = Page(unpack.decompress(z).decode("utf-8", "surrogatepass")), set()
            if places:
                if (host, kind) not in trees:
                    trees[host, kind] = ([Tree(p, shapes) for p in pivots], set(places))
                own, fixed = trees[host, kind]
                other = Tree(page.skeleton(), shapes)
                template = {j for k, tree in enumerate(own) for i, j in match(tree, other) if (k << 32) + i in fixed and tree.own[i] == other.own[j]}
            texts.append(page.text(template))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    host = F.nullif(F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", host.alias("host"), "html")
    kind = T.StructType([*[rows.schema[c] for c in ("page_id", "url", "host")], T.StructField("layout", T.LongType()), T.StructField("z", T.BinaryType())])
    joined = rows.mapInArrow(_packed, kind).join(cut_lineage(wrappers(rows)), ["host", "layout"], "left")
    return joined.mapInArrow(_extracted, T.StructType([rows.schema["page_id"], rows.schema["url"], *T._parse_datatype_string("text string, n_chars long").fields]))
