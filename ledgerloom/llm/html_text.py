"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page's block elements are a tree. Each node gets a probability of holding
main text from its tag, attribute tokens, depth, what its subtree and its
siblings hold, and what stands above it. The choice over the whole tree is the
most likely one in which no node is kept below one that is dropped. The trees
are fitted to pages that ``html_seed`` writes, whose main text is known.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.boosting import Boosted, fit
from ledgerloom.llm.scratch import per_process, small_batches

#: Elements that break text into blocks, that hold no text of the page, that have no end tag.
BLOCKS = frozenset("html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main header footer nav aside form fieldset blockquote pre figure figcaption address details summary dialog center hr menu search legend".split())
SKIPPED = frozenset("script style noscript template textarea title select button svg iframe object canvas audio video datalist".split())
#: Of these, those whose content is no markup: it goes on to the end tag of the same name.
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in "script style textarea title iframe".split()}
#: What may be in a head, and skipped elements that may hold one of their own kind.
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_NESTED = frozenset("object svg template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role attributes.
FOR = frozenset("article content post entry story body text main prose page blog news read paragraph chapter".split())
AGAINST = frozenset("nav navbar navigation menu header masthead footer foot sidebar side aside ad ads adbox advert adverts advertisement sponsor sponsored promo promoted banner cookie cookies consent notice gdpr alert popup modal overlay form login signup search subscribe newsletter share sharing social related recommended breadcrumb breadcrumbs widget toolbar pagination pager tags copyright legal disclaimer skip".split())
REMARKS = frozenset("comment comments reply replies discussion disqus respond thread reader readers".split())
_GROUPS = ("article main", "nav menu", "aside", "footer", "header", "form fieldset search legend dialog", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tr td th thead tbody tfoot caption", "section", "blockquote pre figure figcaption", "html body", "div center")
_GROUP_OF = {tag: k for k, tags in enumerate(_GROUPS) for tag in tags.split()}
#: Nodes deeper than this become siblings at this depth, as in browsers.
_DEEPEST = 512

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([A-Za-z][^\s/>\"']*)([^>]*)>", re.S)
_ATTRIBUTES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What an opening tag closes, looked for up to the elements behind the bar.
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "thead": ("thead tbody tfoot tr td th", "table"), "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table")}
_CLOSES = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in _CLOSES.items()}
_IN_P = BLOCKS - frozenset("html body tr td th thead tbody tfoot caption li dt dd legend".split()) | {"li", "dt", "dd"}


@dataclass
class Forest:
    """Block nodes of pages in the order in which they open, and the runs of text in them."""

    tag: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    good: list[int] = field(default_factory=list)
    bad: list[int] = field(default_factory=list)
    remark: list[int] = field(default_factory=list)
    inputs: list[int] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)
    marked: list[bool] = field(default_factory=list)
    run_node: list[int] = field(default_factory=list)
    run_text: list[str] = field(default_factory=list)
    run_link: list[int] = field(default_factory=list)
    run_start: list[int] = field(default_factory=list)

    def _open(self, tag: str, attributes: str, stack: list[int], children: list[int]) -> None:
        node = len(self.tag)
        words = [w.lower() for m in _ATTRIBUTES.finditer(attributes) for w in _WORDS.findall(m[1] or m[2] or m[3] or "")] if "=" in attributes else []
        self.tag.append(_GROUP_OF.get(tag, len(_GROUPS) - 1))
        self.parent.append(stack[-1] if stack else node)
        self.end.append(node + 1)
        self.depth.append(len(stack))
        self.place.append(children[-1] if children else 0)
        self.good.append(sum(w in FOR for w in words))
        self.bad.append(sum(w in AGAINST for w in words))
        self.remark.append(sum(w in REMARKS for w in words))
        self.inputs.append(0)
        self.marked.append("data-main" in attributes)
        if children:
            children[-1] += 1
        children.append(0)
        stack.append(node)

    def add(self, html: str) -> None:
        """The nodes and runs of one page. Its first node stands for the page and its body."""
        self.roots.append(len(self.tag))
        self.run_start.append(len(self.run_node))
        stack: list[int] = []
        names: list[str] = []
        children: list[int] = []
        self._open("body", "", stack, children)
        names.append("body")
        pieces: list[str] = []
        link = links = 0
        at, in_head = 0, False
        #: The skipped element that is open, how many of its kind, where its content begins, what blocks are open in it, and whether it has had any.
        skipping, kinds, begin, inner, had_block = "", 0, 0, Counter(), False
        transparent: set[str] = set()  # kinds of which one had no end on this page: what they hold is text like any other

        def flush() -> None:
            nonlocal links
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.run_node.append(stack[-1])
                    self.run_text.append(text)
                    self.run_link.append(min(links, len(text)))
                pieces.clear()
            links = 0

        def close(to: int) -> None:
            while len(stack) > to:
                self.end[stack.pop()] = len(self.tag)
                names.pop()
                children.pop()

        while True:
            m = _TOKEN.search(html, at)
            if m is None:
                if not (skipping and had_block):
                    break
                transparent.add(skipping)
                skipping, at = "", begin
                continue
            if at < m.start() and not skipping:
                piece = html[at : m.start()]
                if in_head and piece.strip():
                    in_head = False
                if not in_head:
                    pieces.append(unescape(piece) if "&" in piece else piece)
                    links += len(piece) if link else 0
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name, ending, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if name in _RAW_ENDS and not ending and not (skipping == "svg" and attributes.endswith("/")):
                if name == "textarea" and not skipping:
                    self.inputs[stack[-1]] += 1
                if in_head and name not in _IN_HEAD:
                    in_head = False
                raw_end = _RAW_ENDS[name].search(html, at)
                at = raw_end.end() if raw_end else len(html)
                continue
            if skipping:
                if not ending:
                    if name == skipping and name in _NESTED:
                        kinds += not attributes.endswith("/")
                    elif name == skipping and had_block:
                        transparent.add(skipping)
                        skipping, at = "", begin
                    elif name == skipping:  # a second one ends the first
                        begin = at
                    elif name in BLOCKS and name not in VOID:
                        inner[name] += 1
                        had_block = True
                    continue
                if name == skipping:
                    kinds -= 1
                    skipping = skipping if kinds else ""
                    continue
                if inner[name]:
                    inner[name] -= 1
                    continue
                if name not in names and name != "html":
                    continue
                if had_block:  # what stands around it ends, and it had no end: it is read again as if it weren't there
                    transparent.add(skipping)
                    skipping, at = "", begin
                    continue
                skipping = ""
            if name == "head":
                in_head = not ending and len(self.tag) == self.roots[-1] + 1
                continue
            if in_head and name != "html":
                if name in _IN_HEAD and name not in SKIPPED or ending and name not in ("body", "br"):
                    continue
                in_head = name in _IN_HEAD
            if name in SKIPPED and name not in transparent:
                if not ending and not attributes.endswith("/"):
                    skipping, kinds, begin, had_block = name, 1, at, False
                    inner.clear()
                    if name in ("select", "button"):
                        self.inputs[stack[-1]] += 1
                continue
            if name == "a":
                link = 0 if ending else 1
            elif name == "br":
                pieces.append(" ")
            elif name == "input":
                self.inputs[stack[-1]] += 1
            if name == "body" and not ending and len(self.tag) == self.roots[-1] + 1:
                words = [w.lower() for x in _ATTRIBUTES.finditer(attributes) for w in _WORDS.findall(x[1] or x[2] or x[3] or "")]
                self.good[self.roots[-1]] = sum(w in FOR for w in words)
            if name not in BLOCKS or name in ("html", "body"):
                continue
            flush()
            link = 0
            if ending:
                if name in names[1:]:
                    k = len(names) - 1
                    while names[k] != name:
                        k -= 1
                    close(k)
                continue
            if name in _IN_P and names[-1] == "p":
                close(len(stack) - 1)
            if name in _CLOSES:
                closed, stop = _CLOSES[name]
                k = len(names) - 1
                least = 0
                while k > 0 and names[k] not in stop:
                    if names[k] in closed:
                        least = k
                    k -= 1
                if least:
                    close(least)
            if name == "hr":
                continue
            if len(stack) >= _DEEPEST:
                close(_DEEPEST - 1)
            self._open(name, attributes, stack, children)
            names.append(name)
        if at < len(html) and not skipping:  # a head that still is open has no text
            pieces.append(unescape(html[at:]))
        flush()
        close(0)


def features(forest: Forest) -> np.ndarray:
    """A row per node: tag, attribute tokens, depth, subtree and sibling statistics, and what stands above."""
    n = len(forest.tag)
    tag, parent, end, depth, place, good, bad, remark, inputs = (np.array(x, np.int64) for x in (forest.tag, forest.parent, forest.end, forest.depth, forest.place, forest.good, forest.bad, forest.remark, forest.inputs))
    run_node = np.array(forest.run_node, np.int64)
    lengths = np.array([len(t) for t in forest.run_text], np.float64)
    stops = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in forest.run_text], np.float64)
    node = np.arange(n)

    def under(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[end] - total[node]

    def above(flags: np.ndarray) -> np.ndarray:
        """How many of a node's ancestors are flagged."""
        step = np.zeros(n + 1)
        np.add.at(step, node, flags)
        np.add.at(step, end, -flags.astype(np.float64))
        return np.cumsum(step)[:n] - flags

    of_runs = lambda v: np.bincount(run_node, v, n) if len(run_node) else np.zeros(n)
    text, own = under(of_runs(lengths)), of_runs(lengths)
    runs, links, marks = under(of_runs(np.ones(len(run_node)))), under(of_runs(np.array(forest.run_link, np.float64))), under(of_runs(stops))
    nodes, siblings = under(np.ones(n)), np.bincount(parent, minlength=n)[parent]
    page = np.searchsorted(np.array(forest.roots), node, "right") - 1
    root = np.array(forest.roots)[page]
    before = np.concatenate([[0.0], np.cumsum(own)])[node] - np.concatenate([[0.0], np.cumsum(own)])[root]
    shut = np.isin(tag, [1, 2, 3, 4, 5]).astype(np.int64)
    one = lambda a, b: a / np.maximum(b, 1)
    return np.stack([
        tag, tag[parent], good, bad, remark, depth, place, siblings, one(place, siblings), nodes, runs, np.log1p(text), np.log1p(own), one(links, text), one(marks, text), one(text, runs), one(runs, nodes),
        one(text, text[parent]), one(text, text[root]), one(before, text[root]), under(inputs), under((tag == 6).astype(np.int64)), under((tag == 10).astype(np.int64)), under((tag <= 0).astype(np.int64)), under((tag == 7).astype(np.int64)),
        above((tag == 0).astype(np.int64)), above((good > 0).astype(np.int64)), above((bad > 0).astype(np.int64)), above((remark > 0).astype(np.int64)), above(shut), shut, one(text[parent], text[root]), under((bad + remark > 0).astype(np.int64)),
    ], axis=1).astype(np.float64)


def decode(forest: Forest, log_odds: np.ndarray) -> np.ndarray:
    """The most likely choice of kept nodes in which every kept node's parent is kept; pages themselves are kept."""
    yes, no = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    kept, dropped = yes.tolist(), no.tolist()
    parent, n = forest.parent, len(forest.tag)
    better = [False] * n
    for k in range(n - 1, -1, -1):  # children come after their parents
        better[k] = kept[k] > dropped[k]
        if parent[k] != k:
            kept[parent[k]] += max(kept[k], dropped[k])
            dropped[parent[k]] += dropped[k]
    keep = [True] * n
    for k in range(n):
        keep[k] = parent[k] == k or (keep[parent[k]] and better[k])
    return np.array(keep, bool)


def texts(pages: list[str], model: Boosted) -> list[str]:
    """The main text of each page: kept blocks in page order, two line feeds between them."""
    forest = Forest()
    for html in pages:
        forest.add(html)
    if not pages:
        return []
    keep = decode(forest, model.log_odds(features(forest)))
    bounds = [*forest.run_start, len(forest.run_node)]
    return ["\n\n".join(forest.run_text[r] for r in range(a, b) if keep[forest.run_node[r]]) for a, b in zip(bounds, bounds[1:], strict=False)]


def labelled(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of seed pages: whether a node's subtree has an element with ``data-main``."""
    forest = Forest()
    for html in pages:
        forest.add(html)
    total = np.concatenate([[0], np.cumsum(forest.marked)])
    y = total[np.array(forest.end)] > total[np.arange(len(forest.tag))]
    return features(forest), y.astype(np.float64)


def learn(n_pages: int = 800, seed: int = 0) -> Boosted:
    """Trees fitted to ``n_pages`` seed pages; the same seed gives the same trees."""
    from ledgerloom.llm.html_seed import seed_pages

    return fit(*labelled(seed_pages(n_pages, seed)))


def main_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (long, code points) from the whole ``html``.

    A null html is empty; a page without main text has an empty text. Pages are
    handled one by one, so repeated rows have equal results. An empty table
    gives no rows; columns named like the new ones are replaced, others stay.
    """
    small_batches(pages.sparkSession)
    model = model or per_process("html trees", learn)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(texts([h if isinstance(h, str) else "" for h in batch], model), dtype=object)

    extract = F.pandas_udf(run, "string").asNondeterministic()
    found = pages.drop("text", "n_chars").withColumn("text", extract(F.col("html").cast("string")))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
