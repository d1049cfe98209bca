"""Train the body model from labelled pages: python -m loomcrawl.llm.train_body TABLES_DIR.

Labels come from the pages' own markup. On sites that mark their furniture, a block
that is named by class, id or role, or stands in nav, aside, footer or section, is
furniture; headings and list items are content. A line that is furniture on such sites
has the same label on sites without markup; a line that never is, and does not read
like a teaser, is content. The rest stays unlabelled and is summed out. At most ``MAX_PAGES`` pages are used.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from loomcrawl.llm import body, dom, residue

MAX_PAGES = 5000
MIN_WORD = 6
MIN_FEATURE = 5
ROUNDS = 60
RATE = 0.5
L2 = 2e-4
#: Share of named occurrences from which an unnamed line takes the label furniture.
SHARE = 0.03
_NAME = re.compile(r"\b[A-ZÀ-Ý][\wà-ÿ]*(?:[- _][A-ZÀ-Ý0-9][\wà-ÿ]*)*")
_HOST = re.compile(r"[\w.-]+\.(?:example|test)\b")
_TEASER = re.compile(r"\b(?:notes on an?|an? \w+ year for|and the|inside the|how \w+ \w+ the)\b|^(?:0\. )?x(?: [–-] x)?$|^x: (?:der|die|das|el|la|le|l')\b|^(?:0\. )?x, [^.,]*$", re.I)
_PATH = re.compile(r"^x [›»>/|] |\(0 \w+\)$|^x_0\b|^[^.]* [›»→|] ")
#: A name before a whole title, as notes inside a text are made; teasers never are.
_NOTE = re.compile(r"^[A-ZÀ-Ý][\wà-ÿ]+ [A-ZÀ-Ý][\wà-ÿ]+ – .+(?: – |: |, ).+$")


def pattern_of(text: str) -> str:
    """A line with names and numbers masked, without case."""
    return _NAME.sub("X", _HOST.sub("X", re.sub(r"\d+", "0", text))).lower()


def cues_of(text: str) -> tuple[str, str]:
    """The first two words of a line, and the last two of its masked form."""
    first, last = body._WORD.findall(text.lower()), body._WORD.findall(pattern_of(text))
    return "^" + " ".join(first[:2]), " ".join(last[-2:]) + "$"


def read_pages(folder: str) -> list[tuple]:
    pages = pq.read_table(f"{folder}/parsed_documents.parquet", columns=["page_id", "url", "main_text"]).to_pylist()
    fetches = pq.read_table(f"{folder}/fetch_results.parquet", columns=["final_url", "body", "content_type"]).to_pylist()
    bodies = {f["final_url"]: (f["body"], f["content_type"]) for f in fetches if f["body"]}
    unique = {p["page_id"]: p for p in pages if p["main_text"]}
    return [(k, p["main_text"], *bodies.get(p["url"], (None, None))) for k, p in sorted(unique.items())]


def label_pages(pages: list[tuple]) -> list[tuple[int, list[dom.Node], list[int]]]:
    """(page_id, nodes, labels): 1 content, 0 furniture, -1 unknown."""
    trees = []
    named, bare = Counter(), Counter()
    for_named, for_bare = Counter(), Counter()
    for page_id, text, raw, kind in pages:
        nodes = dom.read(dom.decode(raw, kind))
        where = set(body.align([body.squeeze(x) for x in text.split("\n")], nodes))
        marks = []
        for i, n in enumerate(nodes):
            inside = n
            marked = bool(n.names)
            while inside.parent >= 0 and not marked:
                marked = inside.tag in ("nav", "aside", "footer", "section")
                inside = nodes[inside.parent]
            marks.append(marked)
            if n.text and i in where and n.tag not in ("h1", "h2", "h3"):
                p = pattern_of(n.text)
                (named if marked else bare)[p] += 1
                (for_named if marked else for_bare).update(cues_of(n.text))
        trees.append((page_id, nodes, where, marks))

    def share(cue: str) -> float:
        return for_named[cue] / max(1, for_named[cue] + for_bare[cue]) if for_named[cue] >= 8 else 0.0

    out = []
    for page_id, nodes, where, marks in trees:
        labels = []
        for i, n in enumerate(nodes):
            label = -1
            if n.text and i in where:
                p = pattern_of(n.text)
                if n.tag in ("h1", "h2", "h3"):
                    label = 1
                elif marks[i]:
                    label = 0
                elif n.tag == "li" or _NOTE.search(n.text):
                    label = 1
                elif named[p] >= 2 and named[p] >= SHARE * (named[p] + bare[p]) and (named[p] >= min(20, bare[p]) or not _TEASER.search(p)):
                    label = 0
                elif share(cues_of(n.text)[0]) > 0.2 or share(cues_of(n.text)[1]) > 0.3 or (_PATH.search(p) and len(p.split()) <= 20):
                    label = 0 if not _TEASER.match(p) else -1
                elif named[p] == 0 and (body.shape(n.text) in "Ss" or len(p.split()) > 12 or not _TEASER.search(p)):
                    label = 1
            labels.append(label)
        # Messages, filler and residue stand in place of a body: unmarked ones are content.
        doubtful = [i for i, label in enumerate(labels) if label == 0 and not marks[i]]
        for i, hit in zip(doubtful, residue.line_hits([nodes[i].text for i in doubtful]).any(axis=1)):
            if hit:
                labels[i] = 1
        out.append((page_id, nodes, labels))
    return out


def main(folder: str) -> None:
    pages = read_pages(folder)
    labelled = label_pages(pages)
    train, held = labelled[:MAX_PAGES], labelled[MAX_PAGES : MAX_PAGES + 2000]
    counts = Counter(w for _, nodes, _ in train for n in nodes for w in set(body._WORD.findall(n.text.lower())) if not w[0].isdigit())
    known = {w for w, n in counts.items() if n >= MIN_WORD}
    # Words that occur only with a capital are names, which must not be learned.
    plain = Counter(w for _, nodes, _ in train for n in nodes for k, w in enumerate(body._WORD.findall(n.text)) if w.islower() or not w.isalpha())
    starts = Counter(body._WORD.findall(n.text.lower())[0] for _, nodes, _ in train for n in nodes if n.text and body._WORD.findall(n.text))
    known = {w for w in known if plain[w] or starts[w] >= 40}

    rng = np.random.default_rng(7)

    def rows(part, with_tree: bool):
        out = []
        for _, nodes, labels in part:
            own = body.node_features(nodes)
            out.append([(f if with_tree else []) + (body.text_features(n.text, known) if n.text else []) + ["bias"] for n, f in zip(nodes, own)])
        return out

    features = rows(train, True)
    often = Counter(f for page in features for node in page for f in set(node))
    index = {f: i for i, f in enumerate(sorted(f for f, n in often.items() if n >= MIN_FEATURE))}
    w = np.zeros(len(index))
    pairs = np.zeros((len(body.KINDS), 2, 2))
    pairs[:, 0, 0] = pairs[:, 1, 1] = 0.3
    sums, pair_sums = np.full(len(index), 1e-6), np.full(pairs.shape, 1e-6)

    def pack(part, feats, vocabulary):
        parent, depth, kind, label, ids, node_of, base = [], [], [], [], [], [], 0
        for (_, nodes, labels), page in zip(part, feats):
            parent += [n.parent + base if n.parent >= 0 else -1 for n in nodes]
            depth += [n.depth for n in nodes]
            kind.append(body.child_kinds(nodes))
            label += labels
            for k, f in enumerate(page):
                for x in f:
                    if x in vocabulary:
                        ids.append(vocabulary[x])
                        node_of.append(base + k)
            base += len(nodes)
        return np.array(parent), np.array(depth), np.concatenate(kind), np.array(label), np.array(ids), np.array(node_of)

    size = 200
    batches = [pack(train[i : i + size], features[i : i + size], index) for i in range(0, len(train), size)]
    for _ in range(ROUNDS):
        for b in rng.permutation(len(batches)):
            parent, depth, kind, label, ids, node_of = batches[b]
            score = np.bincount(node_of, w[ids], len(parent))
            unary = np.stack([-score / 2, score / 2], axis=1)
            free, free_joint = body.sum_product(unary, parent, depth, kind, pairs)
            fixed = unary.copy()
            fixed[label == 0, 1] = -50
            fixed[label == 1, 0] = -50
            held_to, held_joint = body.sum_product(fixed, parent, depth, kind, pairs)
            slope = np.bincount(ids, (held_to[:, 1] - free[:, 1])[node_of], len(w)) / size - L2 * w
            sums += slope**2
            w += RATE * slope / np.sqrt(sums)
            change = np.stack([(held_joint - free_joint)[kind == k].sum(axis=0) for k in range(len(pairs))]) / size
            pair_sums += change**2
            pairs += 0.1 * change / np.sqrt(pair_sums)

    text_rows = rows(train, False)
    text_index = {f: i for i, f in enumerate(sorted({f for page in text_rows for node in page for f in node if f in index}))}
    alone = np.zeros(len(text_index))
    total = np.full(len(alone), 1e-6)
    flat = [pack(train[i : i + size], text_rows[i : i + size], text_index) for i in range(0, len(train), size)]
    for _ in range(ROUNDS):
        for b in rng.permutation(len(flat)):
            *_, label, ids, node_of = flat[b]
            p = 1 / (1 + np.exp(-np.bincount(node_of, alone[ids], len(label))))
            slope = np.bincount(ids, np.where(label >= 0, label - p, 0.0)[node_of], len(alone)) / size - L2 * alone
            total += slope**2
            alone += RATE * slope / np.sqrt(total)

    keep = lambda index, w: {f: round(float(w[i]), 4) for f, i in index.items() if abs(w[i]) >= 0.02}
    model = {"words": sorted(known), "pairs": np.round(pairs, 4).tolist(), "tree": keep(index, w), "alone": keep(text_index, alone)}
    body.MODEL.write_text(json.dumps(model, ensure_ascii=False, indent=0))
    print(len(known), "words,", len(model["tree"]), "+", len(model["alone"]), "weights;", body.MODEL.stat().st_size // 1000, "KB")

    for name, part in (("train", train[:1000]), ("held out", held)):
        good = text_good = n = 0
        m = body.Weights()
        for _, nodes, labels in part:
            got = body.node_features(nodes, m.names)
            score = np.array([m.tree.get("bias", 0.0) + sum(m.tree.get(f, 0.0) for f in x) + (m.text_score(k.text) if k.text else 0.0) for k, x in zip(nodes, got)])
            marginal, _ = body.sum_product(np.stack([-score / 2, score / 2], axis=1), np.array([k.parent for k in nodes]), np.array([k.depth for k in nodes]), body.child_kinds(nodes), m.pairs)
            for k, node in enumerate(nodes):
                if labels[k] >= 0:
                    n += 1
                    good += (marginal[k, 1] >= 0.5) == (labels[k] == 1)
                    text_good += (m.line_content(node.text) >= 0) == (labels[k] == 1)
        if n:
            print(f"{name}: {n} labelled lines, tree {good / n:.4f}, text alone {text_good / n:.4f}")


if __name__ == "__main__":
    main(sys.argv[1])
