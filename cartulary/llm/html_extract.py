"""Main text of HTML by gradient-boosted trees over DOM nodes, with hierarchical decoding.

Each block-level node has features of its subtree (text, links, density), attribute tokens, depth and siblings; boosted trees give the log-odds
that it holds main text. Decoding takes the best set of nodes that is closed upwards: a node is kept only with its parent, so no choice contradicts
that of an ancestor or a descendant. The trees are fitted on pages made by rule with known main text (html_pages.py), so no labelled page is needed.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var del nobr strike".split())
#: Never shown; dropped whatever the trees say.
HIDDEN = frozenset("script style title template noscript svg iframe object textarea select button head datalist canvas audio video".split())
RAW = frozenset("script style title textarea iframe noscript".split())
#: Shown, but never main text by their very name.
APART = frozenset("nav menu footer aside".split())
#: Of the hidden ones, those that hide the rest of a page when they are never closed; of the others only the tag is dropped then.
SWALLOWS = frozenset("script style".split())
#: A tag closes open ones of its kind; a block closes an open paragraph.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: All up to the tag's end; a quote opens a value after = only, and one that is never closed is a plain character. Possessive, so linear.
REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-label)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""", re.I)
WORDS = re.compile(r"[^\W\d_]+")

GROUPS = {
    "p": "p", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item",
    "table": "table", "tbody": "table", "tr": "table", "td": "table", "th": "table", "article": "article", "main": "article", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form",
    "figure": "figure", "figcaption": "figure", "blockquote": "quote", "pre": "quote", "div": "box", "section": "box", "span": "span", "ins": "span", "body": "root", "html": "root",
}
KINDS = sorted({*GROUPS.values(), "other"})
#: Attribute tokens that hint at a node's part, by feature.
HINTS = {
    "main": "article content main post entry story body text page",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc",
    "edge": "header head masthead banner footer foot bottom copyright legal top",
    "side": "sidebar side aside rail widget widgets related recommended more popular trending tags archive",
    "ad": "ad ads advert adverts advertisement adsense adsbygoogle sponsor sponsored promo promotion dfp banner",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer warning message",
    "form": "form search login register contact input comment reply",
    "comment": "comment comments reply replies respond disqus discussion reader readers feedback review reviews",
    "share": "share sharing social follow twitter facebook like likes print",
}
HINT_OF = {w: [k for k, v in HINTS.items() if w in v.split()] for v in HINTS.values() for w in v.split()}
HINT_NAMES = list(HINTS)
#: Buckets of the hash of any attribute token, in any language; the trees learn which of them tell something.
BUCKETS = 64


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of the markup from left to right; comments and declarations have no name.

    The scanner goes on from the position where the last piece ended, and after a raw element from its end tag, so nothing inside a script or a
    comment is taken for a tag. Each character is looked at a bounded number of times.
    """
    at, n, gone = 0, len(html), set()
    while (start := html.find("<", at)) >= 0:
        c = html[start + 1 : start + 2]
        if c in ("!", "?"):
            if html.startswith("<!--", start):
                short = next((k for k in (">", "->") if html.startswith(k, start + 4)), None)
                end = start + 4 + len(short) if short else html.find("-->", start + 4) + 3
                end = n if end < start + 4 else end
            else:
                end = html.find(">", start) + 1 or n
            yield start, end, "", False, ""
            at = end
            continue
        closing = c == "/"
        name = NAME.match(html, start + 1 + closing)
        if not name:
            if closing:  # </ without a name is a comment
                end = html.find(">", start) + 1 or n
                yield start, end, "", False, ""
                at = end
            else:
                at = start + 1
            continue
        rest = REST.match(html, name.end())
        if not rest:  # a tag that the page ends in
            yield start, n, "", False, ""
            return
        tag, at = name[0].lower(), rest.end()
        if closing or tag not in RAW:
            yield start, at, tag, closing, rest[1]
            continue
        end = None if tag in gone else RAW_END[tag].search(html, at)
        if end:
            at = html.find(">", end.end()) + 1 or n
        else:
            gone.add(tag)
            at = n if tag in SWALLOWS else at
        yield start, at, "", False, ""  # with its content and its end tag


class Page:
    """Block-level nodes of a page in document order, and its pieces of text."""

    def __init__(self, html: str) -> None:
        self.tags, self.attrs, self.parent, self.depth, self.end = ["#"], [""], [-1], [0], [0]
        #: (node, block, text, in a link)
        self.texts: list[tuple[int, int, str, bool]] = []
        stack, links, block, at, n = [0], 0, 0, 0, len(html)
        hidden = 0  # how many open nodes are never shown
        open_tags: dict[str, int] = {}
        solid = [0]  # for each place of the stack the last one up to it that is not inline

        def pop_to(k: int) -> None:
            nonlocal links, hidden
            for i in stack[k:]:
                self.end[i] = len(self.tags)
                hidden -= self.tags[i] in HIDDEN
                open_tags[self.tags[i]] -= 1
            del stack[k:], solid[k:]
            links = 0

        def opened(tag: str, attrs: str) -> None:
            solid.append(len(stack) if tag not in INLINE else solid[-1])
            open_tags[tag] = open_tags.get(tag, 0) + 1
            self._open(tag, attrs, stack)

        for start, end, tag, closing, attrs in tags(html):
            if start > at and not hidden:
                self.texts.append((stack[-1], block, html[at:start], links > 0))
            at = end
            if not tag:
                continue
            if closing:
                if tag in INLINE:
                    if tag == "a":
                        links = max(0, links - 1)
                    elif tag == "span" and self.tags[stack[-1]] == "span":
                        pop_to(len(stack) - 1)
                    continue
                block += 1
                if open_tags.get(tag):
                    pop_to(next(k for k in range(len(stack) - 1, 0, -1) if self.tags[stack[k]] == tag))
                continue
            if tag in INLINE and not (tag == "span" and attrs.strip()):
                links += tag == "a"
                if tag == "span":  # balanced by a node, so that its end does not close another one
                    opened(tag, "")
                continue
            if tag in VOID:
                block += tag in ("br", "hr")
                continue
            if tag != "span":
                block += 1
                closes = CLOSES.get(tag, ())
                k = solid[-1]
                while k > 0:
                    t = self.tags[stack[k]]
                    if t in closes or (t == "p" and tag not in INLINE):
                        pop_to(k)
                        break
                    if not (closes and t == "p"):
                        break
                    k = solid[k - 1]
            if attrs.endswith("/") and tag not in GROUPS:
                continue
            opened(tag, attrs)
            hidden += tag in HIDDEN
        if at < n and not hidden:
            self.texts.append((stack[-1], block, html[at:], links > 0))
        pop_to(1)
        self.end[0] = len(self.tags)

    def _open(self, tag: str, attrs: str, stack: list[int]) -> None:
        self.parent.append(stack[-1])
        self.depth.append(len(stack))
        stack.append(len(self.tags))
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.end.append(0)

    def text(self, keep: np.ndarray) -> str:
        blocks: dict[int, list[str]] = {}
        for node, block, text, _ in self.texts:
            if keep[node]:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join(entities.unescape("".join(parts)).split()) for _, parts in sorted(blocks.items()))
        return "\n".join(x for x in lines if x)


@lru_cache(maxsize=4096)
def hints(attrs: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Numbers of the hints and of the hash buckets of a tag's attribute tokens."""
    of, buckets = set(), set()
    if attrs and "=" in attrs:
        for _, value in ATTRIBUTE.findall(attrs):
            for w in WORDS.findall(value.lower()):
                of.update(HINT_NAMES.index(k) for k in HINT_OF.get(w, ()))
                buckets.add(zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS)
    return tuple(of), tuple(buckets)


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each node of all pages, and the pages' first rows."""
    first = np.cumsum([0, *(len(p.tags) for p in pages)])
    n = int(first[-1])
    parent, end, depth, page = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n), np.empty(n, np.int64)
    kind = np.zeros((n, len(KINDS)))
    hint, bucket = np.zeros((n, len(HINT_NAMES))), np.zeros((n, BUCKETS))
    own, link, links, stops = (np.zeros(n) for _ in range(4))
    for i, (p, at) in enumerate(zip(pages, first.tolist())):
        m = len(p.tags)
        parent[at : at + m] = np.maximum(np.array(p.parent), 0) + at
        end[at : at + m] = np.array(p.end) + at
        depth[at : at + m] = p.depth
        page[at : at + m] = i
        for j, (t, a) in enumerate(zip(p.tags, p.attrs)):
            kind[at + j, KINDS.index(GROUPS.get(t, "other"))] = 1
            if a:
                of, buckets = hints(a)
                hint[at + j, of], bucket[at + j, buckets] = 1, 1
        for node, _, text, in_link in p.texts:
            size = len(text) - text.count(" ") - text.count("\n")
            own[at + node] += size
            stops[at + node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
            if in_link:
                link[at + node] += size
                links[at + node] += 1

    def below(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        return c[end] - c[:-1]

    rows = np.arange(n)
    text, linked, n_links, n_stops, nodes = below(own), below(link), below(links), below(stops), (end - rows).astype(float)
    inside = below(kind)
    total = text[first[:-1]][page]
    before = np.cumsum(own) - own
    before = before - before[first[:-1]][page]
    top = rows == first[:-1][page]
    kids = np.bincount(parent[~top], minlength=n).astype(float)
    kid_text = np.bincount(parent[~top], text[~top], minlength=n)
    order = np.zeros(n)
    counts: dict[int, int] = {}
    for r, q in zip(rows[~top].tolist(), parent[~top].tolist()):
        order[r] = counts.get(q, 0)
        counts[q] = counts.get(q, 0) + 1
    brothers = np.maximum(kids[parent] - 1, 0)
    others = np.maximum(kid_text[parent] - text, 0) / np.maximum(brothers, 1)
    # what stands above: the sums over ancestors, in document order
    above_kind, above_hint = kind.copy(), hint.copy()
    by_depth = np.argsort(depth, kind="stable")
    for at in np.split(by_depth, np.cumsum(np.bincount(depth.astype(np.int64)))[:-1])[1:]:
        above_kind[at] += above_kind[parent[at]]
        above_hint[at] += above_hint[parent[at]]
    lg = np.log1p
    x = [lg(text), lg(own), linked / np.maximum(text, 1), lg(n_links), n_stops / np.maximum(text, 1), lg(n_stops), lg(nodes), text / nodes, lg(inside[:, KINDS.index("p")]), lg(inside[:, KINDS.index("item")]), depth, order / np.maximum(brothers, 1), lg(brothers), text / np.maximum(text[parent], 1), text / np.maximum(total, 1), before / np.maximum(total, 1), lg(others), np.minimum(text / np.maximum(others, 1), 50)]
    return np.column_stack([*x, kind, hint, np.minimum(above_kind, 1), np.minimum(above_hint, 1), np.minimum(below(hint), 1), bucket]), first


class Trees:
    """Gradient-boosted regression trees for log-odds (logistic loss, Newton leaves), on features in quantile bins; each tree sees a share of rows and features."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0, share: float = 0.5, seed: int = 5) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.share, self.seed = rounds, depth, rate, bins, ridge, share, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x).astype(np.int64)
        n, f = binned.shape
        width = self.bins
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(n, self.base)
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        draw = np.random.default_rng(self.seed)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            rows, seen = np.flatnonzero(draw.random(n) < self.share), np.sort(draw.permutation(f)[: max(1, int(f * self.share))])
            flat = binned[np.ix_(rows, seen)] + np.arange(len(seen)) * width
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
            where, part = np.zeros(n, np.int64), {0: np.arange(len(rows))}
            sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def histogram(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                idx, m = flat[mine].ravel(), len(seen)
                return tuple(np.bincount(idx, np.repeat(v[rows[mine]], m), m * width) for v in (g, h))

            for node in range(size):
                mine = part.pop(node, np.zeros(0, np.int64))
                gs, hs = g[rows[mine]].sum(), h[rows[mine]].sum()
                value[node] = -self.rate * gs / (hs + self.ridge)
                if node >= 2**self.depth - 1 or len(mine) < 20:
                    continue
                own = sums.pop(node) if node in sums else histogram(mine)
                hg, hh = (v.reshape(-1, width).cumsum(1) for v in own)
                gain = hg**2 / (hh + self.ridge) + (gs - hg) ** 2 / (hs - hh + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(hh < 1) | (hs - hh < 1)] = 0
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    at, cut[node] = divmod(best, width)
                    feature[node] = seen[at]
                    all_mine = np.flatnonzero(where == node)
                    where[all_mine] = 2 * node + 1 + (binned[all_mine, feature[node]] > cut[node])
                    right = where[rows[mine]] == 2 * node + 2
                    part[2 * node + 1], part[2 * node + 2] = mine[~right], mine[right]
                    if 2 * node + 1 < 2**self.depth - 1:  # one child is counted, the other is the difference
                        few, rest = sorted((2 * node + 1, 2 * node + 2), key=lambda k: len(part[k]))
                        sums[few] = histogram(part[few])
                        sums[rest] = tuple(a - b for a, b in zip(own, sums[few]))
            self.nodes.append((feature, cut, value))
            score += value[where]
        return self

    def _bin(self, x: np.ndarray, used: set[int] | None = None) -> np.ndarray:
        """Bins of the features, or of those that the trees ask for."""
        out = np.zeros(x.shape, np.int16)
        for j, cuts in enumerate(self.cuts):
            if used is None or j in used:
                out[:, j] = np.searchsorted(cuts, x[:, j], side="left")
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x, {int(f) for feature, _, _ in self.nodes for f in feature if f >= 0})
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.nodes:
            where = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[where]
                go = f >= 0
                where = np.where(go, 2 * where + 1 + (binned[rows, f] > cut[where]), where)
            out += value[where]
        return out


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """The set of nodes, closed upwards from the root, with the largest sum of log-odds; nodes never shown, or apart by name, are out."""
    gain = odds.astype(float).copy()
    hidden = [t in HIDDEN or t in APART for t in page.tags]
    for i in range(len(gain) - 1, 0, -1):
        if hidden[i]:
            gain[i] = -np.inf
        elif gain[i] > 0:
            gain[page.parent[i]] += gain[i]
    keep = np.zeros(len(gain), bool)
    keep[0] = True
    for i in range(1, len(gain)):
        keep[i] = keep[page.parent[i]] and gain[i] > 0
    return keep


#: Parts that are never taken for the text of a page where the trees find none.
EDGES = APART | frozenset("header form fieldset address".split())


def best_text(page: Page, odds: np.ndarray) -> str:
    """The text of the decoded nodes. Where that is empty though the page has text outside its edges, the likeliest subtree with text is taken.

    The edges are nodes by name or telling tokens (menus, headers, notices and the like) and nodes of links only, with all that is inside them.
    """
    out = page.text(decode(page, odds))
    if out or not page.texts:
        return out
    n = len(page.tags)
    edge, size, linked = np.zeros(n, bool), np.zeros(n), np.zeros(n)
    main = HINT_NAMES.index("main")
    for i, (t, a) in enumerate(zip(page.tags, page.attrs)):
        of = hints(a)[0]
        edge[i] = t in EDGES or t in HIDDEN or (bool(of) and main not in of) or (i > 0 and edge[page.parent[i]])
    for node, _, text, link in page.texts:
        size[node] += len(text.strip())
        linked[node] += link * len(text.strip())
    # texts of a node itself: those of links only are an edge as well
    own = ~edge & (size > 0) & (linked < size)
    if not own.any():
        return ""
    best = int(np.flatnonzero(own)[np.argmax(odds[own])])
    shifted = np.where(edge, -np.inf, odds - odds[best] + 1.0)
    up = best
    while up > 0:  # the way to the best one is open
        shifted[up] = max(shifted[up], 1.0)
        up = page.parent[up]
    return page.text(decode(page, shifted))


@lru_cache(maxsize=2)
def model(pages: int = 900, seed: int = 17) -> Trees:
    """Trees fitted on pages made by rule; the number of pages bounds the sample."""
    from .html_pages import labelled

    made = labelled(pages, seed)
    parsed = [Page(h) for h, _ in made]
    x, first = features(parsed)
    y = np.zeros(len(x))
    for p, at in zip(parsed, first.tolist()):
        for i in range(len(p.tags) - 1, 0, -1):
            if "data-main" in p.attrs[i]:
                y[at + i] = 1
            if y[at + i]:
                y[at + p.parent[i]] = 1
    return Trees().fit(x, y)


def extract(htmls: list[str | None], trees: Trees) -> list[str]:
    pages = [Page(h or "") for h in htmls]
    if not pages:
        return []
    x, first = features(pages)
    odds = trees.score(x)
    return [best_text(p, odds[a:b]) for p, a, b in zip(pages, first[:-1], first[1:])]


#: Pages whose nodes are scored together.
BATCH = 100


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row.

    A null or empty html, or one without text outside its edges, gives an empty text. Very long pages are read whole, in time linear in their
    length (but for the sorting of nodes by depth). Repeated rows stay repeated; extra columns, also of the result's names, are ignored; an empty table
    gives an empty result.
    """
    arrow_batches(pages.sparkSession)
    trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                s = b.slice(at, BATCH)
                text = extract(s.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").withColumnRenamed("id", id_col)
