"""The main text of web pages by a tree-structured graphical model over their elements.

Every element and every run of text has a hidden label: in the main text or not. Its own features give
a potential, and each parent and child share a potential that depends on the child's kind. Messages
pass up the tree and down again (sum-product), which gives each run of text its exact marginal, and
runs with a marginal over one half are the main text. The weights are those of greatest likelihood on
labelled pages (html_pages.py), fitted on the driver from a fixed number of pages, a parameter.

Defined cases: a null html counts as empty and gives an empty text; a page without main text gives an
empty text; broken markup is read as far as it goes; repeated rows are extracted row by row; columns
other than page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .html_pages import labelled_pages
from .html_tree import Node, parse

#: Pages that the weights are fitted on, steps of the fit, and the weight of the penalty on their squares.
TRAINING_PAGES, STEPS, PENALTY = 400, 160, 0.02

#: Kinds of elements, and of words in their class, id and role.
KINDS = ("text", "article", "main", "section", "div", "p", "heading", "list", "item", "nav", "header", "footer", "aside", "form", "table", "quote", "figure", "page", "other")
_KIND_OF = {"": "text", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "hgroup": "heading", "ul": "list", "ol": "list", "dl": "list", "menu": "list", "li": "item", "dt": "item", "dd": "item", "blockquote": "quote", "pre": "quote", "figcaption": "figure", "html": "page", "body": "page", "center": "div", "search": "form", "dialog": "aside"}
_KIND_OF |= dict.fromkeys("caption thead tbody tfoot tr td th".split(), "table") | dict.fromkeys("fieldset legend select option button".split(), "form")
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs links toc pagination pager",
    "header": "header masthead topbar top banner logo",
    "footer": "footer bottom copyright colophon legal",
    "side": "sidebar side aside widget related recommended more also rail",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion adslot",
    "comment": "comment comments reply replies discussion disqus responses respond reader",
    "notice": "cookie cookies notice alert consent popup modal newsletter subscribe overlay gdpr message toast",
    "share": "share social sharing follow tags meta",
    "form": "form search login signup",
    "main": "article post entry story content main text body page",
}
_NAME_OF = {w: k for k, words in NAMES.items() for w in words.split()}
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("always", *(f"kind {k}" for k in KINDS), *(f"name {k}" for k in NAMES), "words", "words of a text", "linked", "linked text", "all linked", "stops", "copyright", "blank", "top", "shallow", "children", "in p", "in item")
#: Pairs of parent and child share a potential by the child's kind and whether the child's name says something.
PAIRS = len(KINDS) * 2


def _features(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each node, and the number of the potential shared with its parent."""
    n = len(nodes)
    x = np.zeros((n, len(FEATURES)))
    pair = np.zeros(n, dtype=np.int64)
    at = {f: i for i, f in enumerate(FEATURES)}
    words, chars, linked, stops, rights, children = ([0] * n for _ in range(6))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        if not node.tag:
            words[i], chars[i], linked[i] = node.text.count(" ") + 1, max(1, len(node.text) - node.text.count(" ")), node.linked
            stops[i] = sum(map(node.text.count, ".!?"))
            rights[i] = int("©" in node.text or "opyright" in node.text)
        if (p := node.parent) >= 0:
            words[p] += words[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            stops[p] += stops[i]
            rights[p] += rights[i]
            children[p] += 1
    for i, node in enumerate(nodes):
        row, kind = x[i], _KIND_OF.get(node.tag, node.tag)
        kind = kind if kind in KINDS else "other"
        row[0] = 1
        row[at[f"kind {kind}"]] = 1
        named = {_NAME_OF[w] for w in map(str.lower, _NAME_WORDS.findall(node.names)) if w in _NAME_OF}
        for k in named:
            row[at[f"name {k}"]] = 1
        density = linked[i] / chars[i] if chars[i] else 0.0
        row[at["words"]] = np.log1p(words[i]) / 3
        row[at["linked"]] = density
        row[at["stops"]] = min(1.0, 5 * stops[i] / max(words[i], 1))
        row[at["copyright"]] = rights[i] > 0 and node.depth > 2
        row[at["blank"]] = words[i] == 0
        row[at["top"]] = node.depth <= 2
        row[at["shallow"]] = node.depth == 3
        row[at["children"]] = np.log1p(children[i]) / 3
        if not node.tag:
            row[at["words of a text"]] = np.log1p(words[i]) / 3
            row[at["linked text"]] = density
            row[at["all linked"]] = density > 0.9
            above = nodes[node.parent].tag
            row[at["in p"]], row[at["in item"]] = above == "p", above in ("li", "td")
        pair[i] = 2 * KINDS.index(kind) + bool(named - {"main"})
    return x, pair


class Forest:
    """Several trees with their nodes numbered through, passed level by level."""

    def __init__(self, pages: list[list[Node]]):
        made = [_features(p) for p in pages]
        base = np.cumsum([0, *map(len, pages)])
        self.base = base
        self.x = np.concatenate([m[0] for m in made])
        self.pair = np.concatenate([m[1] for m in made])
        self.parent = np.concatenate([np.array([n.parent + b if n.parent >= 0 else -1 for n in p], dtype=np.int64) for p, b in zip(pages, base)])
        depth = np.concatenate([np.array([n.depth for n in p], dtype=np.int64) for p in pages])
        order = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        self.levels = np.split(order, cuts)

    def marginals(self, weights: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-marginals of nodes, marginals of parent and child together, log-normaliser's sum).

        shared[k, a, b] is the log-potential of a parent labelled a over a child labelled b.
        """
        n = len(self.x)
        own = np.zeros((n, 2))
        own[:, 1] = self.x @ weights
        up, sent = own.copy(), np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            sent[level] = np.logaddexp.reduce(shared[self.pair[level]] + up[level][:, None, :], axis=2)
            np.add.at(up, self.parent[level], sent[level])
        roots = self.levels[0]
        total = np.logaddexp.reduce(up[roots], axis=1).sum()
        belief, both = up.copy(), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            above = belief[self.parent[level]] - sent[level]  # the parent without this child
            joint = above[:, :, None] + shared[self.pair[level]] + up[level][:, None, :]
            joint -= np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None]
            both[level] = np.exp(joint)
            belief[level] = np.logaddexp.reduce(joint, axis=1)
        belief[roots] = up[roots] - np.logaddexp.reduce(up[roots], axis=1)[:, None]
        # Below the roots a belief is the marginal itself, as the message from above is in it.
        return belief, both, total


def _labels(nodes: list[Node]) -> np.ndarray:
    y = np.zeros(len(nodes), dtype=np.int64)
    for i, node in enumerate(nodes):
        y[i] = int(node.mark) if node.mark else y[node.parent] if node.parent >= 0 else 0
    return y


@lru_cache(maxsize=4)
def trained(pages: int = TRAINING_PAGES, steps: int = STEPS, penalty: float = PENALTY, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The weights of greatest penalised likelihood, by gradient steps on exact marginals."""
    trees = [parse(p) for p in labelled_pages(pages, seed)]
    forest = Forest(trees)
    y = np.concatenate([_labels(t) for t in trees])
    child = np.concatenate(forest.levels[1:])
    seen = np.zeros((PAIRS, 2, 2))
    np.add.at(seen, (forest.pair[child], y[forest.parent[child]], y[child]), 1)
    wanted = forest.x.T @ y
    theta = np.zeros(len(FEATURES) + 4 * PAIRS)
    first, second, rate = np.zeros_like(theta), np.zeros_like(theta), 0.15
    for step in range(1, steps + 1):
        weights, shared = theta[: len(FEATURES)], theta[len(FEATURES) :].reshape(PAIRS, 2, 2)
        belief, both, _ = forest.marginals(weights, shared)
        expected = np.zeros((PAIRS, 2, 2))
        np.add.at(expected, forest.pair[child], both[child])
        gradient = np.concatenate([wanted - forest.x.T @ np.exp(belief[:, 1]), (seen - expected).ravel()]) / pages - penalty * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8) * (1 - 0.9 * step / steps)
    return theta[: len(FEATURES)], theta[len(FEATURES) :].reshape(PAIRS, 2, 2)


def main_texts(pages: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    trees = [parse(p) for p in pages]
    forest = Forest(trees)
    inside = forest.marginals(*model)[0][:, 1] > np.log(0.5)
    return ["\n\n".join(node.text for i, node in enumerate(tree, int(b)) if not node.tag and inside[i]) for tree, b in zip(trees, forest.base)]


RESULT = "page_id long, url string, text string, n_chars long"


def _extract(model: tuple[np.ndarray, np.ndarray], each: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, each):
                part = batch.slice(at, each)
                texts = main_texts([h.as_py() or "" for h in part.column("html")], model)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> DataFrame:
    """RESULT's columns for every row of pages (page_id, url, html)."""
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(_extract(trained(training_pages)), RESULT)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
