"""Operator 9: main text of HTML pages by gradient-boosted trees over DOM nodes.

Every element gets features: its tag, tokens of its class, id and role attributes, depth, text
and link density of its subtree, tag counts, position among and likeness to its siblings. Tokens
enter by two short word lists and by what is learned of each: the log odds, in one of TOKENS hashed
buckets, that elements with the token are article, each page counting once; pages that teach the trees
take them from the other half of the sample. Boosted trees score how likely an element belongs to the article. Decoding is hierarchical: keeping an
element below a dropped one is impossible, so a dynamic programme over the tree picks the
consistent choice of the largest total score. Kept text forms blocks in page order.

There are no labelled pages. The trees learn from weak labels that a teacher gives on a bounded
sample of pages (SAMPLE rows, SAMPLE_BUDGET characters): elements inside <article>, <main> or a
body-of-text attribute, outside boilerplate elements, are article; in a page without such marks, those of the
smallest element that holds most of its text outside links, less what is mostly links. Copies of the sample with
semantic tags or attributes blanked make the trees use density, depth and siblings too.

Edge cases: null and empty html and pages without an article give an empty text; unclosed and
stray tags are repaired as browsers do for heads, paragraphs, list items and table cells; elements
inside svg and math may close themselves; an end tag finds its element at any depth, within its
block; very long and deep pages are parsed whole; of two choices that score alike the shorter text
is kept; repeated rows give repeated rows; without a usable sample (no page has text outside boilerplate) the teacher's own rule decides;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled

SAMPLE, SAMPLE_BUDGET = 300, 16_000_000
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
#: Buckets of attribute tokens; pages that a token must have for its log odds to count by about half.
TOKENS, DOUBT = 4096, 5.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg iframe object head title".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Tags whose start ends an open paragraph; what a start tag ends besides.
ENDS_P = BLOCKS - frozenset(["body", "html", "td", "th", "tr", "caption", "summary"])
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
#: Elements whose content may close itself; what a head holds.
FOREIGN = ("svg", "math")
HEAD = frozenset("head title meta link base basefont script style noscript template".split())
#: Words in tags and attributes that tell boilerplate, and those that tell an article.
BAD = ("nav", "menu", "header", "footer", "sidebar", "aside", "notice", "cookie", "consent", "banner", "ad", "ads", "advert", "advertisement", "sponsor", "promo", "form", "comment", "comments", "respond", "reply", "share", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "subscribe", "newsletter", "login", "search", "widget", "popup", "modal", "pagination", "copyright", "toolbar", "complementary", "contentinfo", "navigation", "alert", "disclaimer", "teaser")
GOOD = ("article", "main", "content", "post", "entry", "story", "text", "articlebody", "body")
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "a", "span", "b", "i", "em", "strong", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "button", "body", "html")
BAD_TAGS = frozenset(["nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "select", "textarea", "label", "fieldset"])
#: Share of the prose of a page without marks that its article holds at least.
MOST_PROSE = 0.6
TOKEN = re.compile(r"[^\W\d_]+")


class Node:
    """An element: tag, attribute tokens, parent's number, and its children and text in order."""

    __slots__ = ("items", "parent", "tag", "tokens")

    def __init__(self, tag: str, tokens: frozenset, parent: int):
        self.tag, self.tokens, self.parent, self.items = tag, tokens, parent, []


class Tree(HTMLParser):
    """Builds the elements of a page in document order; number 0 is a root above all."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("root", frozenset(), -1)]
        self.open = [0]
        #: Open elements of each tag.
        self.held: Counter[str] = Counter()

    def close_to(self, tags: tuple[str, ...], walls: frozenset | tuple[str, ...] = ()) -> None:
        """Close the innermost open element of these tags, and what is open inside it, up to a wall."""
        if not any(self.held[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[k]].tag
            if tag in tags:
                self.held.subtract(self.nodes[i].tag for i in self.open[k:])
                del self.open[k:]
                return
            if tag in walls:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD:
            self.close_to(("head",))
        if tag in ENDS_P:
            self.close_to(("p",), ("table", "button", "article", "section", "div", "td", "li", "blockquote"))
        if tag in ENDS:
            self.close_to(ENDS[tag], WALLS[tag])
        tokens = frozenset(t for name, value in attrs if value and name in ("class", "id", "role", "itemprop", "aria-label") for t in TOKEN.findall(value.lower()))
        self.nodes[self.open[-1]].items.append(len(self.nodes))
        self.nodes.append(Node(tag, tokens, self.open[-1]))
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)
            self.held[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and any(self.held[t] for t in FOREIGN):
            self.held[tag] -= 1
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        """A block or silent element ends at any depth; another within the block that it stands in."""
        self.close_to((tag,), () if tag in BLOCKS or tag in SILENT else BLOCKS | SILENT)

    def handle_data(self, data: str) -> None:
        if self.held["head"] and self.nodes[self.open[-1]].tag == "head" and not data.isspace():
            self.close_to(("head",))
        self.nodes[self.open[-1]].items.append(data)


def tree_of(html: str | None) -> list[Node]:
    parser = Tree()
    parser.feed(html or "")
    parser.close()
    return parser.nodes


def silent(nodes: list[Node]) -> np.ndarray:
    """Whether each node or one above it never shows text."""
    out = np.zeros(len(nodes), bool)
    for i, n in enumerate(nodes[1:], 1):
        out[i] = out[n.parent] or n.tag in SILENT
    return out


@lru_cache(maxsize=65_536)
def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % TOKENS


def token_odds(pages: list[tuple[list[Node], np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each bucket of tokens the log odds of being article, less those of all; pages are nodes, hidden, labels."""
    yes, n = np.zeros(TOKENS), np.zeros(TOKENS)
    for nodes, hidden, y in pages:
        held: dict[int, list[bool]] = {}
        for i, x in enumerate(nodes):
            if not hidden[i]:
                for b in {bucket(t) for t in x.tokens}:
                    held.setdefault(b, []).append(bool(y[i]))
        for b, labels in held.items():
            yes[b] += sum(labels) / len(labels)
            n[b] += 1
    p = (yes.sum() + 1) / (n.sum() + 2)
    return np.log((yes + DOUBT * p) / (n - yes + DOUBT * (1 - p))) - np.log(p / (1 - p))


def features(nodes: list[Node], hidden: np.ndarray, odds: np.ndarray, blank_tags: bool = False, blank_tokens: bool = False) -> np.ndarray:
    """A row of features for each node; odds are those of token buckets."""
    n = len(nodes)
    parent = np.array([max(0, x.parent) for x in nodes])
    own = np.array([0 if h else sum(len(i) for i in x.items if isinstance(i, str) and not i.isspace()) for x, h in zip(nodes, hidden, strict=True)], float)
    tags = ["div" if blank_tags and (x.tag in BAD_TAGS or x.tag in ("article", "main", "section")) else x.tag for x in nodes]
    chars, link, below, ps, lis, marks = own.copy(), np.array([c if t == "a" else 0 for c, t in zip(own, tags, strict=True)], float), np.ones(n), np.array([t == "p" for t in tags], float), np.array([t == "li" for t in tags], float), np.zeros(n)
    for i, x in enumerate(nodes):
        if not hidden[i]:
            marks[i] = sum(s.count(".") + s.count(",") for s in x.items if isinstance(s, str))
    depth, kids, place = np.zeros(n), np.zeros(n), np.zeros(n)
    inherited, learned = np.zeros((n, 4)), np.zeros((n, 4))
    for i in range(1, n):
        p = parent[i]
        depth[i], place[i] = depth[p] + 1, kids[p]
        kids[p] += 1
        t = nodes[i].tokens if not blank_tokens else frozenset()
        own_bad, own_good = (tags[i] in BAD_TAGS) or not t.isdisjoint(BAD), (tags[i] in ("article", "main")) or not t.isdisjoint(GOOD)
        inherited[i] = (max(inherited[p, 0], own_bad), max(inherited[p, 1], own_good), own_bad, own_good)
        told = [odds[bucket(s)] for s in t] or [0.0]
        learned[i] = (min(learned[p, 0], *told), max(learned[p, 1], *told), min(told), max(told))
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (chars, link, below, ps, lis, marks):
            a[p] += a[i]
    all_chars = max(1.0, chars[0])
    tag_no = np.array([TAGS.index(t) if t in TAGS else len(TAGS) for t in tags], float)
    group = np.zeros(n)
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        same[(parent[i], tags[i])] = same.get((parent[i], tags[i]), 0) + 1
    for i in range(1, n):
        group[i] = same[(parent[i], tags[i])]
    cols = [
        tag_no, tag_no[parent], *inherited.T, *learned.T, depth, place, kids[parent] - place, kids, group,
        np.log1p(chars), chars / all_chars, link / np.maximum(chars, 1), np.log1p(below), chars / below, marks / np.maximum(chars, 1) * 100,
        ps, lis, np.log1p(chars[parent]), chars / np.maximum(chars[parent], 1), link[parent] / np.maximum(chars[parent], 1), ps[parent], np.arange(n) / n,
    ]
    return np.stack(cols, 1)


def densest(nodes: list[Node], bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes lie in the smallest element that holds most of a page's prose, and which are mostly links.

    Prose is text outside links and boilerplate. It needs no mark and no word of any language.
    """
    n = len(nodes)
    prose, chars, link = np.zeros(n), np.zeros(n), np.zeros(n)
    linked, inside = np.zeros(n, bool), np.zeros(n, bool)
    for i, x in enumerate(nodes):
        linked[i] = i > 0 and (linked[x.parent] or x.tag == "a")
        size = sum(len(s.strip()) for s in x.items if isinstance(s, str))
        chars[i], link[i], prose[i] = size, size * linked[i], size * (not linked[i] and not bad[i])
    for i in range(n - 1, 0, -1):
        for a in (chars, link, prose):
            a[nodes[i].parent] += a[i]
    at = 0
    for i in range(1, n):  # children follow their parents, so this descends
        if nodes[i].parent == at and prose[i] >= MOST_PROSE * max(prose[0], 1):
            at = i
    for i in range(n):
        inside[i] = i == at or (i > 0 and inside[nodes[i].parent])
    return inside, link > chars / 2


def teacher(nodes: list[Node], hidden: np.ndarray) -> np.ndarray:
    """Weak labels: inside the article and outside boilerplate; above the article the label is 1 too.

    The article is what is marked as one; in a page without marks it is where most prose is, less what is mostly links.
    """
    inside, bad = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes[1:], 1):
        inside[i] = inside[x.parent] or x.tag in ("article", "main") or "articlebody" in x.tokens or ("main" in x.tokens and x.tag != "body")
        own = x.tag in BAD_TAGS or not x.tokens.isdisjoint(BAD)
        bad[i] = bad[x.parent] or own or hidden[i]
    if not inside.any():
        inside, links = densest(nodes, bad)
        for i in range(1, len(nodes)):
            bad[i] |= links[i] & (nodes[i].tag != "a") | bad[nodes[i].parent]
    y = inside & ~bad
    for i in range(len(nodes) - 1, 0, -1):
        if y[i] and not bad[nodes[i].parent]:
            y[nodes[i].parent] = True
    return y


class Boosted:
    """Gradient-boosted trees on binned features, logistic loss; odds of token buckets belong to the features."""

    odds = np.zeros(TOKENS)

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
        binned = self.binned(x)
        score, self.trees = np.zeros(len(x)), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            tree: list[tuple] = []
            at = np.zeros(len(x), int)
            for level in range(DEPTH):
                splits, base = [], 2**level - 1
                for node in range(base, 2 * base + 1):
                    splits.append(self.best(binned[at == node], g[at == node], h[at == node]))
                tree += splits
                j, b = np.array([s[0] for s in splits])[at - base], np.array([s[1] for s in splits])[at - base]
                at = 2 * at + 1 + (binned[np.arange(len(x)), j] > b)
            leaf = at - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            self.trees.append((np.array([t[0] for t in tree]), np.array([t[1] for t in tree]), value))
            score += value[leaf]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    @staticmethod
    def best(binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        """Feature and last left bin of the split of the largest gain."""
        found = (0.0, 0, BINS)
        for j in range(binned.shape[1]):
            gl, hl = np.cumsum(np.bincount(binned[:, j], g, BINS)), np.cumsum(np.bincount(binned[:, j], h, BINS))
            gain = gl**2 / (hl + 1) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + 1) - gl[-1] ** 2 / (hl[-1] + 1)
            b = int(gain.argmax())
            if gain[b] > found[0] + 1e-9:
                found = (float(gain[b]), j, b)
        return found[1:]

    def logits(self, x: np.ndarray) -> np.ndarray:
        binned, rows, out = self.binned(x), np.arange(len(x)), np.zeros(len(x))
        for feature, split, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (binned[rows, feature[at]] > split[at])
            out += value[at - (2**DEPTH - 1)]
        return out


def decode(nodes: list[Node], hidden: np.ndarray, logit: np.ndarray) -> np.ndarray:
    """Kept nodes: the consistent choice of the largest total score; hidden nodes are never kept."""
    score = np.where(hidden, -1e9, logit)
    keep, drop = score.copy(), -score
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = np.zeros(len(nodes), bool)
    kept[0] = True
    for i in range(1, len(nodes)):
        kept[i] = kept[nodes[i].parent] and keep[i] > drop[i]
    return kept


def text_of(nodes: list[Node], kept: np.ndarray) -> str:
    """Blocks of kept text in page order."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        words = " ".join("".join(line).split())
        line.clear()
        if words:
            blocks.append(words)

    todo: list[tuple[int, int]] = [(0, 0)]
    while todo:
        i, k = todo.pop()
        node = nodes[i]
        if k == 0 and node.tag in BLOCKS:
            flush()
        if k == len(node.items):
            if node.tag in BLOCKS:
                flush()
            continue
        todo.append((i, k + 1))
        item = node.items[k]
        if isinstance(item, str):
            line.append(item)
        elif nodes[item].tag == "br":
            line.append(" ")
        elif kept[item]:
            todo.append((item, 0))
        else:
            line.append(" ") if nodes[item].tag not in BLOCKS else flush()
    flush()
    return "\n\n".join(blocks)


def fit(pages: list[str]) -> Boosted | None:
    """Trees learned from the teacher's labels on whole, tag-blanked and token-blanked copies."""
    taught = []
    for html in pages:
        nodes = tree_of(html)
        hidden = silent(nodes)
        y = teacher(nodes, hidden)
        if y.any():
            taught.append((nodes, hidden, y))
    if not taught:
        return None
    xs, ys, ws = [], [], []
    for half in (0, 1):
        odds = token_odds(taught[1 - half :: 2])
        for nodes, hidden, y in taught[half::2]:
            shown = ~hidden
            for tags, tokens, w in ((False, False, 1.0), (True, False, 0.3), (False, True, 0.3)):
                xs.append(features(nodes, hidden, odds, tags, tokens)[shown])
                ys.append(y[shown])
                ws.append(np.full(int(shown.sum()), w))
    model = Boosted(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))
    model.odds = token_odds(taught)
    return model


def extract_all(pages: list[str], model: Boosted | None) -> list[str]:
    """The main text of each page; the trees score the nodes of all pages together."""
    trees = [tree_of(html) for html in pages]
    hidden = [silent(nodes) for nodes in trees]
    if model is None:
        logits = [np.where(teacher(n, h), 1.0, -1.0) for n, h in zip(trees, hidden, strict=True)]
    else:
        scores = model.logits(np.concatenate([features(n, h, model.odds) for n, h in zip(trees, hidden, strict=True)]))
        logits = np.split(scores, np.cumsum([len(n) for n in trees])[:-1])
    out = []
    for nodes, h, logit in zip(trees, hidden, logits, strict=True):
        logit[0] = 1.0
        out.append(text_of(nodes, decode(nodes, h, logit)))
    return out


def extract(html: str | None, model: Boosted | None) -> str:
    """The main text of a page."""
    return extract_all([html or ""], model)[0]


def train(pages: DataFrame) -> Boosted | None:
    """Trees fitted on a sample of pages of any length, in the order of a hash of their ids, within SAMPLE_BUDGET."""
    full = pages.where((F.length("html") > 0) & F.col("page_id").isNotNull())
    ids = full.groupBy("page_id").agg(F.max(F.length("html")).alias("n")).orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE).collect()
    wanted = [r["page_id"] for r in labelled.within(ids, SAMPLE_BUDGET)]
    rows = full.where(F.col("page_id").isin(wanted)).groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").select("html").collect() if wanted else []
    return fit([r["html"] for r in rows])


def with_main_text(pages: DataFrame, model: Boosted | None, name: str = "text") -> DataFrame:
    """pages with the main text of each as a further column."""
    common.small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield pd.Series([text for part in common.slices(html.map(len).tolist(), 300_000) for text in extract_all(html.iloc[part].tolist(), shared.value)], dtype=object)

    return pages.withColumn(name, F.pandas_udf(main_text, "string")(F.coalesce(F.col("html"), F.lit(""))))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_main_text(pages, train(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
