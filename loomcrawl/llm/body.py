"""The body of a page without its furniture (problem 4): a tree-structured graphical model.

Every block of the page's DOM is a variable, content or furniture. Its own evidence is
a sum of learned weights of words, shape, markup and neighbours; parent-child
potentials connect it to the block around it. Sum-product messages go once upward and
once downward and give every block its exact content marginal. A line of main_text
takes the marginal of the block it came from. Weights were trained from labelled pages
by ``train_body``; see there for the labels and the bound of the sample.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcrawl.llm import dom

MODEL = Path(__file__).with_name("body_model.json")
_WORD = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)]*(?:\s|$)")
_SPACE = re.compile(r"\s+")
#: Words that may be the only ones of a teaser or path; kinds of child for the potentials.
KINDS = ("plain", "named", "inner")
CACHE = 200_000
LONG = 30


def squeeze(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def shape(text: str) -> str:
    """Coarse kind of a line, for its neighbours: heading-like, sentence, or text."""
    n = len(text)
    ended = text[-1:] in ".!?…。！？”\"»"
    return "0" if not n else ("S" if n >= 90 else "s" if n >= 45 else "e") if ended else ("t" if n >= 45 else "h")


def text_features(text: str, known: frozenset | set) -> list[str]:
    """Features of a squeezed line. Words outside ``known`` are all alike, digits are one word.

    All words of a line count; pairs of neighbouring words are added for lines of up to
    ``LONG`` words, which all menus, notices and teasers are.
    """
    low = text.lower()
    tokens = _WORD.findall(low)
    if len(tokens) > LONG:
        kinds = set(tokens)
        met = kinds & known
        n = len(tokens)
        unknown = n * (len(kinds) - len(met)) // len(kinds)
        found = ["w:" + w for w in met]
    else:
        words = []
        unknown = 0
        for w in tokens:
            if w[0].isdigit():
                words.append("0")
            elif w in known:
                words.append(w)
            else:
                unknown += 1
                if not words or words[-1] != "~":
                    words.append("~")
        n = len(words)
        found = ["w:" + w for w in set(words)]
        found += {f"b:{a}_{b}" for a, b in zip(words, words[1:])}
        if n <= 10:
            found += {f"t:{a}_{b}_{c}" for a, b, c in zip(words, words[1:], words[2:])}
        found.append("f:" + (words[0] if words else ""))
        found.append("f2:" + "_".join(words[:2]))
        found.append("l:" + (words[-1] if words else ""))
    size = len(low)
    found.append(f"n:{min(n, 4) if n < 5 else 5 + min(5, n // 6)}")
    found.append(f"z:{min(9, size // 20)}")
    found.append(f"o:{min(4, 5 * unknown // max(1, n))}")
    found.append(f"s:{min(4, len(_SENTENCE_END.findall(text)))}")
    found.append("k:" + shape(text))
    if text.isupper():
        found.append("upper")
    return found


class Weights:
    """Trained weights with caches, one per Python worker."""

    def __init__(self, path: str | Path = MODEL):
        model = json.loads(Path(path).read_text())
        self.known = frozenset(model["words"])
        self.tree: dict[str, float] = model["tree"]
        self.alone: dict[str, float] = model["alone"]
        self.pairs = np.array(model["pairs"])
        self.names = frozenset(k[2:] for k in self.tree if k.startswith("c:"))
        self._tree: dict[str, float] = {}
        self._alone: dict[str, float] = {}

    def _score(self, text: str, weights: dict[str, float], cache: dict[str, float]) -> float:
        found = cache.get(text)
        if found is None:
            get = weights.get
            found = sum(get(f, 0.0) for f in text_features(text, self.known))
            if len(text) < 100:
                if len(cache) >= CACHE:
                    cache.clear()
                cache[text] = found
        return found

    def text_score(self, text: str) -> float:
        return self._score(text, self.tree, self._tree)

    def line_content(self, text: str) -> float:
        """Log-odds that a squeezed line is content, from its text alone."""
        return self._score(text, self.alone, self._alone) + self.alone.get("bias", 0.0)


@lru_cache(maxsize=2)
def weights(path: str | Path = MODEL) -> Weights:
    return Weights(path)


def node_features(nodes: list[dom.Node], names: frozenset | set | None = None) -> list[list[str]]:
    """Markup and position features of every node, without those of its own text."""
    heads = [i for i, n in enumerate(nodes) if n.tag == "h1"]
    first = heads[0] if heads else -1
    title = nodes[first].text if heads else ""
    leaves = [i for i, n in enumerate(nodes) if n.text]
    place = {i: k for k, i in enumerate(leaves)}
    kinds = [shape(nodes[i].text) for i in leaves]
    count = len(leaves)
    seen: set[str] = set()
    out = []
    for i, n in enumerate(nodes):
        f = ["g:" + n.tag]
        up = nodes[n.parent] if n.parent >= 0 else n
        f.append("p:" + up.tag)
        if n.names:
            f.append("named")
            f += [("c:" + t) if names is None or t in names else "c:?" for t in n.names.split()]
        if n.text:
            k = place[i]
            f.append("leaf")
            f.append("gp:" + n.tag + "<" + up.tag)
            f.append("lk:" + str(min(4, 4 * n.linked // max(1, len(n.text)))))
            f.append("h1:" + ("none" if first < 0 else "is" if i == first else "before" if i < first else "after"))
            before = kinds[k - 1] if k else "^"
            after = kinds[k + 1] if k + 1 < count else "$"
            f.append("kb:" + before + kinds[k] + after)
            f.append("k2:" + (kinds[k - 2] if k > 1 else "^") + before + kinds[k])
            f.append("k3:" + kinds[k] + after + (kinds[k + 2] if k + 2 < count else "$"))
            if k:
                b = nodes[leaves[k - 1]]
                f.append("sb:" + ("1" if b.names == n.names and b.tag == n.tag else "0") + kinds[k])
            if k + 1 < count:
                b = nodes[leaves[k + 1]]
                f.append("sa:" + ("1" if b.names == n.names and b.tag == n.tag else "0") + kinds[k])
            f.append("end:" + str(min(6, count - 1 - k)))
            f.append("beg:" + str(min(6, k)))
            if title and n.text == title:
                f.append("title")
            if n.text in seen:
                f.append("again")
            seen.add(n.text)
        out.append(f)
    return out


def child_kinds(nodes: list[dom.Node]) -> np.ndarray:
    return np.array([2 if not n.text else 1 if n.names else 0 for n in nodes], np.int64)


def sum_product(unary: np.ndarray, parent: np.ndarray, depth: np.ndarray, kind: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals of many trees at once.

    ``unary`` (n, 2) are log potentials, ``parent`` -1 at roots, ``pairs`` (kind, parent
    label, child label) log potentials. Gives node marginals (n, 2) and the joint of
    each node and its parent (n, 2, 2), both as probabilities.
    """
    up = unary.copy()
    edge = pairs[kind]
    message = np.zeros_like(unary)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)] if len(depth) else []
    for at in reversed(levels):
        at = at[parent[at] >= 0]
        if len(at):
            message[at] = np.logaddexp(edge[at][:, :, 0] + up[at][:, None, 0], edge[at][:, :, 1] + up[at][:, None, 1])
            for label in (0, 1):
                up[:, label] += np.bincount(parent[at], message[at, label], len(up))
    total = up.copy()
    joint = np.zeros((len(up), 2, 2))
    for at in levels:
        at = at[parent[at] >= 0]
        if len(at):
            rest = total[parent[at]] - message[at]
            both = rest[:, :, None] + edge[at] + up[at][:, None, :]
            total[at] = np.logaddexp(both[:, 0], both[:, 1])
            both -= both.max(axis=(1, 2), keepdims=True)
            both = np.exp(both)
            joint[at] = both / both.sum(axis=(1, 2), keepdims=True)
    total -= total.max(axis=1, keepdims=True)
    marginal = np.exp(total)
    return marginal / marginal.sum(axis=1, keepdims=True), joint


def align(lines: list[str], nodes: list[dom.Node]) -> list[int]:
    """Node of each squeezed line, -1 for none; in order, each node used once where possible."""
    where: dict[str, list[int]] = defaultdict(list)
    for i, n in enumerate(nodes):
        if n.text:
            where[n.text].append(i)
    out, last = [], -1
    for line in lines:
        found = where.get(line) if line else None
        if not found:
            out.append(-1)
            continue
        at = next((i for i in found if i > last), found[-1])
        last = max(last, at)
        out.append(at)
    return out


def content_marginals(pages: list[tuple[str | None, bytes | None, str | None]], model: Weights) -> list[list[float]]:
    """For each (main_text, body, content_type) the content marginal of every line, 1.0 for blank ones.

    A line without a block of its own, or of a page without a body, becomes a node under
    the root with the evidence of its text and place.
    """
    unary, parent, depth, kind, places = [], [], [], [], []
    offset = 0
    for main_text, body, content_type in pages:
        lines = [squeeze(x) for x in (main_text or "").split("\n")]
        nodes = dom.read(dom.decode(body, content_type))
        where = align(lines, nodes)
        for k, line in enumerate(lines):
            if line and where[k] < 0:
                nodes.append(dom.Node("p", "", 0, 1, text=line))
                where[k] = len(nodes) - 1
        get = model.tree.get
        bias = get("bias", 0.0)
        for n, f in zip(nodes, node_features(nodes, model.names)):
            unary.append(bias + sum(get(x, 0.0) for x in f) + (model.text_score(n.text) if n.text else 0.0))
        parent.append(np.array([n.parent + offset if n.parent >= 0 else -1 for n in nodes]))
        depth.append(np.array([n.depth for n in nodes]))
        kind.append(child_kinds(nodes))
        places.append([w + offset if w >= 0 else -1 for w in where])
        offset += len(nodes)
    if not pages:
        return []
    score = np.array(unary)
    both = np.stack([-score / 2, score / 2], axis=1)
    marginal, _ = sum_product(both, np.concatenate(parent), np.concatenate(depth), np.concatenate(kind), model.pairs)
    content = marginal[:, 1]
    return [[1.0 if w < 0 else float(content[w]) for w in place] for place in places]


def page_bodies(pages: DataFrame, fetches: DataFrame) -> DataFrame:
    """(page_id, main_text, body, content_type): each page with its latest successful fetch.

    Repeated rows of a page, which has one url, count once; a page without a fetch keeps a
    NULL body.
    """
    good = fetches.where(F.col("body").isNotNull() & F.col("http_status").between(200, 299) & F.col("final_url").isNotNull())
    latest = good.groupBy(F.col("final_url").alias("at")).agg(F.max_by(F.struct("body", "content_type"), F.struct("fetched_at", "fetch_id")).alias("f"))
    # Pages are partitioned once, by url: the collapse of repeated rows and the join share it.
    # Pages without url are spread by their id.
    at = F.coalesce("url", F.concat(F.lit("\0"), F.col("page_id").cast("string")))
    whole = pages.where(F.col("page_id").isNotNull() & F.col("main_text").isNotNull()).select("page_id", at.alias("at"), "main_text")
    unique = whole.repartition("at").dropDuplicates(["at", "page_id"])
    return unique.join(latest, "at", "left").select("page_id", "main_text", "f.body", "f.content_type")


def furniture_lines(pages: DataFrame, fetches: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(page_id, line_no) of the non-blank lines whose content marginal is below ``threshold``.

    NULL and empty texts give no rows; empty tables give none; bodies are read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = weights()
        for frame in batches:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at : at + 500]
                marginals = content_marginals(list(zip(part["main_text"], part["body"], part["content_type"])), model)
                ids, numbers = [], []
                for page_id, line in zip(part["page_id"], marginals):
                    low = [k for k, p in enumerate(line) if p < threshold]
                    ids += [page_id] * len(low)
                    numbers += low
                yield pd.DataFrame({"page_id": np.array(ids, np.int64), "line_no": np.array(numbers, np.int32)})

    return page_bodies(pages, fetches).mapInPandas(run, "page_id bigint, line_no int")


def body_texts(pages: DataFrame, fetches: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(page_id, body_text): each page's main_text without its furniture lines, others as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = weights()
        for frame in batches:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at : at + 500]
                marginals = content_marginals(list(zip(part["main_text"], part["body"], part["content_type"])), model)
                texts = ["\n".join(x for x, p in zip(text.split("\n"), line) if p >= threshold) for text, line in zip(part["main_text"], marginals)]
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(np.int64), "body_text": texts})

    return page_bodies(pages, fetches).mapInPandas(run, "page_id bigint, body_text string")
