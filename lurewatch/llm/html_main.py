"""The main text of web pages by a tree-structured graphical model.

Each node of a page's block tree (``dom``) has a hidden label, main text or not.
A node's evidence is a vector of features of its tag, its names and its text;
parent and child are tied by a 2 x 2 potential that depends on the child's kind
of element.  The model is a tree, so the sum-product algorithm is exact: messages
pass from the leaves upward and from the root downward, and their product is the
marginal of each node.  Weights maximise the likelihood of labelled pages
(``page_samples``), by gradients that the same messages give.  A leaf of text
belongs to the main text if its marginal is over one half.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import dom, page_samples
from .common import packed, unpacked, with_row

#: Kinds of elements that share potentials. Plain lists; kind 0 holds all others.
KINDS = ("div section center table tbody tr td th details fieldset", "article", "main", "p pre", "h1 h2 h3 h4 h5 h6",
         "ul ol dl menu", "li dt dd", "nav", "header hgroup", "footer", "aside dialog search",
         "form button select option label legend optgroup", "blockquote", "figure figcaption caption", "html body")
_KIND = {tag: i for i, tags in enumerate(KINDS, 1) for tag in tags.split()} | {"": 0}
#: Words in class, id and role that tell a part's purpose, one group each. Plain lists.
HINTS = (r"\b(ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner)\b", r"nav|menu|breadcrumb|pagination|links\b",
         r"foot|copyright|colophon|bottom", r"head|masthead|brand|top-?bar|\bbanner\b", r"side|widget|related|recommend|most-|trend|popular",
         r"comment|disqus|discuss|repl(y|ies)|respon", r"cookie|consent|gdpr|notice|alert|popup|modal|newsletter|subscri|overlay",
         r"share|social|follow|\btags?\b|byline|meta", r"content|article|post\b|entry|story|main|\btext\b")
_HINTS = [re.compile(h) for h in HINTS]
_KINDS = len(KINDS) + 1
#: Labelled pages to learn from, steps and size of the ascent.
PAGES, STEPS, RATE, RIDGE = 360, 300, 0.2, 1e-3
#: Pages read at a time.
ROWS = 128


class Forest:
    """The trees of several pages side by side, as arrays."""

    def __init__(self, trees: list[list[dom.Node]]):
        sizes = [len(t) for t in trees]
        starts = np.cumsum([0] + sizes)[:-1]
        self.nodes = [n for t in trees for n in t]
        shift = np.repeat(starts, sizes)
        parent = np.array([n.parent for n in self.nodes], np.int64)
        self.parent = np.where(parent >= 0, parent + shift, -1)
        self.kind = np.array([_KIND.get(n.tag, 1) for n in self.nodes], np.int64)
        depth = np.zeros(len(self.nodes), np.int64)
        for i, p in enumerate(self.parent.tolist()):  # parents come first
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []
        self.features = self._features()

    def _features(self) -> np.ndarray:
        n = len(self.nodes)
        sums = np.zeros((n, 4))  # characters, of these linked, leaves, leaves that end a sentence
        for i, node in enumerate(self.nodes):
            if not node.tag:
                sums[i] = len(node.text), min(node.linked, len(node.text)), 1, node.text[-1] in ".!?…"
        own = sums.copy()
        for level in self.levels[:0:-1]:
            np.add.at(sums, self.parent[level], sums[level])
        chars, linked, leaves, ends = sums.T
        leaf = own[:, 2]
        known: dict[str, np.ndarray] = {"": np.zeros(len(HINTS))}
        for node in self.nodes:
            if node.names not in known:
                known[node.names] = np.array([bool(h.search(node.names)) for h in _HINTS], float)
        notice = np.array([not x.tag and "©" in x.text for x in self.nodes], float)
        out = np.zeros((n, _KINDS + len(HINTS) + 7))
        out[np.arange(n), self.kind] = 1
        out[:, _KINDS:_KINDS + len(HINTS)] = [known[x.names] for x in self.nodes] if n else 0
        out[:, -7:] = np.c_[leaf * np.log1p(chars) / 5, (1 - leaf) * np.log1p(chars) / 8, linked / np.maximum(chars, 1),
                            np.log1p(chars / np.maximum(leaves, 1)) / 5, ends / np.maximum(leaves, 1), notice, np.ones(n)]
        return out

    def labels(self) -> np.ndarray:
        """1 where most characters below a node are labelled as main text."""
        text, main = np.zeros(len(self.nodes)), np.zeros(len(self.nodes))
        for i, node in enumerate(self.nodes):
            if not node.tag:
                text[i] = len(node.text)
                main[i] = text[i] * (self.nodes[self.parent[i]].label == "1")
        for level in self.levels[:0:-1]:
            np.add.at(text, self.parent[level], text[level])
            np.add.at(main, self.parent[level], main[level])
        return (2 * main > text).astype(np.int64)

    def marginals(self, weights: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum-product: log marginals of nodes, and the joint of each node and its parent."""
        evidence = np.zeros((len(self.nodes), 2))
        evidence[:, 1] = self.features @ weights
        tie = ties[self.kind]                       # [node, parent's label, own label]
        inward, message = evidence.copy(), np.zeros_like(evidence)
        for level in self.levels[:0:-1]:            # from the leaves upward
            message[level] = np.logaddexp(*(tie[level] + inward[level][:, None, :]).transpose(2, 0, 1))
            np.add.at(inward, self.parent[level], message[level])
        belief = inward.copy()
        joint = np.zeros((len(self.nodes), 2, 2))
        for level in self.levels[1:]:               # from the root downward
            rest = belief[self.parent[level]] - message[level]
            joint[level] = rest[:, :, None] + tie[level] + inward[level][:, None, :]
            belief[level] = np.logaddexp(joint[level][:, 0], joint[level][:, 1])
        belief -= np.logaddexp(belief[:, :1], belief[:, 1:])
        total = np.logaddexp(np.logaddexp(joint[:, 0, 0], joint[:, 0, 1]), np.logaddexp(joint[:, 1, 0], joint[:, 1, 1]))
        return belief, joint - total[:, None, None]


class Model:
    """Weights of the evidence and the potentials between parents and children."""

    def __init__(self, pages: list[str], steps: int = STEPS):
        forest = Forest([dom.read(p) for p in pages])
        y, child = forest.labels(), forest.parent >= 0
        self.weights, self.ties = np.zeros(forest.features.shape[1]), np.zeros((_KINDS, 2, 2))
        pair = np.zeros((len(y), 2, 2))
        pair[child, y[forest.parent[child]], y[child]] = 1
        size = [np.zeros_like(self.weights), np.zeros_like(self.ties)]
        for _ in range(steps):
            belief, joint = forest.marginals(self.weights, self.ties)
            slopes = [forest.features.T @ (y - np.exp(belief[:, 1])) / len(pages) - RIDGE * self.weights,
                      np.zeros_like(self.ties)]
            np.add.at(slopes[1], forest.kind[child], (pair - np.exp(joint))[child] / len(pages))
            slopes[1] -= RIDGE * self.ties
            for value, slope, s in zip((self.weights, self.ties), slopes, size):
                s += slope * slope
                value += RATE * slope / np.sqrt(s + 1e-8)

    def texts(self, pages: list[str]) -> list[str]:
        """The main text of each page."""
        trees = [dom.read(p) for p in pages]
        forest = Forest(trees)
        chosen = forest.marginals(self.weights, self.ties)[0][:, 1] > np.log(0.5)
        out, at = [], 0
        for tree in trees:
            out.append("\n".join(n.text for i, n in enumerate(tree, at) if not n.tag and chosen[i]))
            at += len(tree)
        return out


def fit(pages: int = PAGES, seed: int = 3) -> Model:
    return Model(page_samples.pages(pages, seed))


def extract(pages: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all but ``html``) and ``text`` of each page; a narrow pass over whole pages.

    Blocks have single spaces and are joined by one line feed.  A NULL or empty
    page, and one without main text, gives an empty text.  Broken markup never
    fails; repeated rows get equal texts; an empty table gives no rows.
    """
    carry = [c for c in pages.columns if c != "html"] if carry is None else carry
    row = pages.select(packed(carry), F.col("html").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                texts = model.texts([x or "" for x in part.column("_html").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string())], ["_row", "text"])

    made = row.mapInArrow(run, with_row(row, "text string"))
    return made.select(*unpacked([c for c in carry if c != "text"]), "text")
