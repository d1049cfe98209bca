"""Template residue and error-page text (problem 5): character n-gram likelihood ratios.

Four character models (what templates leave, filler, error notices, natural prose) are
fitted to labelled examples. A table of log-likelihood ratios against prose scores
every character of every line; windows of a line localise the residue, and the share of
a page's own text that filler and notices cover excludes it. Scoring is vectorised over
whole batches of pages; nothing is cut off.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcrawl.llm import body
from loomcrawl.llm import residue_examples as examples

ALPHABET = " abcdefghijklmnopqrstuvwxyz0.,:;!?'\"()[]{}<>$%@#=_-/\\|+*…"
SIZE = len(ALPHABET) + 1
CLASSES = ("residue", "filler", "notice")
WINDOW = 24
#: Nats in favour of a class that a window and, on average, each character of the line must reach.
WINDOW_NATS = 9.0
LINE_NATS = np.array([0.25, 0.5, 0.25])
COVERAGE = 0.6
#: What a template leaves in the middle of a sentence, where the mean of a line hides it.
MARK = re.compile(
    r"\{\{[^{}]{0,80}\}\}|\{%[^{}%]{1,80}%\}|~~\s?[A-Z_]{2,40}\s?~~|\b__[A-Z][A-Z_]{1,40}__\b|[$#]\{[^{}]{1,80}\}|%%\s?[\w.]{1,60}\s?%%|<%=?[^<>%]{1,80}%>|@@\s?[\w.]{1,60}\s?@@|\[\[\s?[a-z][a-z0-9_.]*\s?\]\]|\{[a-z][a-z0-9]*(?:[_.][a-z0-9]+)*\}"
    r"|[\[<](?:INSERT|ADD|YOUR|Insert|Your)\b[^\[\]<>]{0,80}[\]>]|\[(?:[A-Z]+ )*(?:NAME|NUMBER|ADDRESS|CITY|TOWN|STREET|PHONE|DATE|EMAIL|TITLE|TEXT|DESCRIPTION|LINK|IMAGE)(?: [A-Z0-9]+)*\]"
    r"|\[object Object\]|\bInvalid Date\b"
    r"|\b(?:[Bb]y|[Ff]or|[Ff]rom|[Hh]ello|[Dd]ear|[Ww]elcome) (?:undefined|NaN|null)\b(?! (?:and void|values?|hypothes[ie]s|pointers?|variables?|objects?|results?))"
)
#: Words around a mark with which a text talks about marks.
TALK = re.compile(
    r"\b(?:placeholders?|templates?|templating|variables?|syntax|mail.merge|JavaScript|swapped for|substitut\w+|(?:field|mark|token|tag|code|string|symbol|expression)s? (?:such as|like|named|called|of the form)|Platzhalter\w*|Vorlagen?|Variablen?|gabarits?|plantillas?|marcador(?:es)?)\b", re.I
)
#: Characters on each side of a mark in which such words count.
AROUND = 80
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of every code point: letters without case and accents, digits alike, others one symbol."""
    table = np.full(0x110000, SIZE - 1, np.uint8)
    for code in range(0x2100):
        c = chr(code)
        low = unicodedata.normalize("NFD", c.lower())[:1]
        low = "0" if c.isdigit() else " " if c.isspace() else {"–": "-", "—": "-", "’": "'", "‘": "'", "“": '"', "”": '"', "·": "|", "»": ">", "«": "<", "›": ">", "‹": "<"}.get(c, low)
        if low in ALPHABET and low:
            table[code] = ALPHABET.index(low)
    table[ord("…")] = ALPHABET.index("…")
    return table


def symbols(text: str) -> np.ndarray:
    return symbol_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def _model(lines: list[str]) -> np.ndarray:
    """Interpolated log probabilities of every 4-gram (last symbol given three)."""
    grams = []
    for line in lines:
        s = np.concatenate([np.zeros(3, np.int64), symbols(" ".join(line.split())).astype(np.int64), np.zeros(1, np.int64)])
        grams.append(((s[:-3] * SIZE + s[1:-2]) * SIZE + s[2:-1]) * SIZE + s[3:])
    four = np.bincount(np.concatenate(grams), minlength=SIZE**4).astype(np.float32).reshape(SIZE, SIZE, SIZE, SIZE)
    lower = np.full((1, 1, 1, SIZE), 1 / SIZE, np.float32)
    for counts, weight in ((four.sum(axis=(0, 1, 2), keepdims=True), 2.0), (four.sum(axis=(0, 1), keepdims=True), 2.0), (four.sum(axis=0, keepdims=True), 1.5), (four, 1.0)):
        total = counts.sum(axis=-1, keepdims=True)
        kinds = (counts > 0).sum(axis=-1, keepdims=True) * weight + 1e-6
        lower = (counts + kinds * lower) / (total + kinds)
    return np.log(lower).reshape(-1)


@lru_cache(maxsize=1)
def ratios() -> np.ndarray:
    """(class, 4-gram): log-likelihood ratio of each class against prose."""
    read = lambda text: [x for x in text.split("\n") if x.strip()]
    prose = _model(read(examples.PROSE))
    return np.stack([_model(read(t)) - prose for t in (examples.RESIDUE, examples.FILLER, examples.NOTICE)])


def score_lines(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each squeezed line and class: the best window's nats, and nats per character of the line."""
    if not lines:
        return np.zeros((0, 3)), np.zeros((0, 3))
    text = "   " + "\n   ".join(lines) + "\n"
    s = symbols(text).astype(np.int64)
    gram = ((s[:-3] * SIZE + s[1:-2]) * SIZE + s[2:-1]) * SIZE + s[3:]
    lengths = np.array([len(x) for x in lines])
    starts = np.concatenate([[0], np.cumsum(lengths + 4)])[:-1]  # first gram of a line predicts its first symbol
    table = ratios()
    window, rate = np.zeros((len(lines), 3)), np.zeros((len(lines), 3))
    for k in range(3):
        sums = np.concatenate([[0.0], np.cumsum(table[k][gram], dtype=np.float64)])
        ends = starts + lengths + 1
        total = sums[np.minimum(ends, len(sums) - 1)] - sums[starts]
        rate[:, k] = total / (lengths + 1)
        span = sums[WINDOW:] - sums[:-WINDOW] if len(sums) > WINDOW else np.zeros(1)
        # Windows may not leave their line: mask those that start within WINDOW of its end.
        best = total.copy()
        long_lines = np.flatnonzero(lengths + 1 > WINDOW)
        if len(long_lines):
            inside = np.full(len(sums) + 1, -np.inf)
            owner = np.repeat(np.arange(len(lines)), lengths + 4)[: len(span)]
            ok = np.arange(len(span)) + WINDOW <= ends[owner]
            inside[: len(span)] = np.where(ok, span, -np.inf)
            best[long_lines] = np.maximum.reduceat(inside, starts)[long_lines]
        window[:, k] = best
    return window, rate


def _hits(lines: list[str], window: np.ndarray, rate: np.ndarray) -> np.ndarray:
    hit = (window >= WINDOW_NATS) & (rate >= LINE_NATS)
    # A short line cannot gather many nats; it must be clear in every character.
    lengths = np.array([len(x) for x in lines]) if lines else np.zeros(0)
    return hit | ((rate >= 0.9) & (lengths[:, None] <= 16) & (window >= 3.5))


def line_hits(lines: list[str]) -> np.ndarray:
    """For each squeezed line and class whether the line reads as of the class."""
    return _hits(lines, *score_lines(lines))


def inner_residue(lines: list[str]) -> np.ndarray:
    """For each squeezed line whether a part of it was left by a template.

    A part is a mark that the text around it does not talk about, or one of several
    sentences that by itself reads as residue, again without such talk around it.
    """
    out = np.zeros(len(lines), bool)
    parts, owner = [], []
    for k, line in enumerate(lines):
        for m in MARK.finditer(line):
            if not TALK.search(line[max(0, m.start() - AROUND) : m.start()] + " \0 " + line[m.end() : m.end() + AROUND]):
                out[k] = True
                break
        else:
            pieces = _SENTENCE.split(line)
            if len(pieces) > 1:
                parts += pieces
                owner += [k] * len(pieces)
    window, rate = score_lines(parts)
    hit = _hits(parts, window, rate)[:, 0] & (rate.argmax(axis=1) == 0) if parts else np.zeros(0, bool)
    # A short sentence in a paragraph is too little to go by.
    out[[k for k, h, x in zip(owner, hit, parts) if h and len(x) > WINDOW and not TALK.search(lines[k])]] = True
    return out


def judge_pages(pages: list[tuple[str | None, str | None]]) -> list[tuple[bool, bool, bool]]:
    """(residue, filler, notice) of each (title, main_text).

    Residue: a line of the title or text that reads as left by a template, or has a part
    that does, however long the line is. Filler and
    notice: such lines cover at least ``COVERAGE`` of the text without furniture and title.
    """
    lines, owner, kind = [], [], []
    for k, (title, text) in enumerate(pages):
        title = body.squeeze(title or "")
        if title:
            lines.append(title)
            owner.append(k)
            kind.append(0)
            head = title.rsplit(" | ", 1)[0]
            if head != title:
                lines.append(head)
                owner.append(k)
                kind.append(0)
        for line in (text or "").split("\n"):
            line = body.squeeze(line)
            if line:
                lines.append(line)
                owner.append(k)
                kind.append(1)
    window, rate = score_lines(lines)
    hit = _hits(lines, window, rate)
    best = rate.argmax(axis=1) if len(lines) else np.zeros(0, int)
    owner, kind = np.array(owner, int), np.array(kind, int)
    # Lines of filler and notices count as such, whatever marks they quote.
    left = inner_residue(lines) & ~(hit & (np.arange(3) == best[:, None]))[:, 1:].any(axis=1) if len(lines) else np.zeros(0, bool)
    out = [(False, False, False)] * len(pages)
    model = body.weights()
    for k in np.unique(owner[hit.any(axis=1) | left]):
        at = np.flatnonzero(owner == k)
        residue = bool((hit[at, 0] & (best[at] == 0)).any() or left[at].any())
        titles = {lines[i] for i in at if kind[i] == 0}
        own = filler = notice = 0
        for i in at:
            if kind[i] == 0 or (lines[i] in titles and not hit[i].any()):
                continue
            # Beside a clear line, a line counts as soon as it is likelier filler or notice than prose.
            bad = hit[i].any() or (rate[i, 1:].max() > 0 and hit[at, 1:].any())
            if not bad and model.line_content(lines[i]) < 0:
                continue
            own += len(lines[i])
            if bad:
                filler += len(lines[i]) * (best[i] == 1)
                notice += len(lines[i]) * (best[i] != 1)
        covered = own and (filler + notice) / own >= COVERAGE
        out[k] = (residue, bool(covered and filler >= notice), bool(covered and notice > filler))
    return out


def mostly_residue(text: str) -> bool:
    """Whether lines left by a template are more than half of a text without furniture.

    Beside a clear one, a line counts as soon as it is likelier residue than prose.
    """
    lines = [x for x in map(body.squeeze, text.split("\n")) if x]
    window, rate = score_lines(lines)
    clear = _hits(lines, window, rate)[:, 0] & (rate.argmax(axis=1) == 0) if lines else np.zeros(0, bool)
    left = clear | (clear.any() & (rate[:, 0] > 0))
    model = body.weights()
    own = sum(len(x) for x, bad in zip(lines, left) if bad or model.line_content(x) >= 0)
    return 2 * sum(len(x) for x, bad in zip(lines, left) if bad) > own


def residue_pages(pages: DataFrame) -> DataFrame:
    """(page_id, is_residue, is_filler, is_notice) of the pages to leave out.

    Rows are judged where they lie and the few verdicts are collapsed: rows of one page are
    one, flagged by any of them. Pages without title and text are never among them.
    """
    rows = pages.where(F.col("page_id").isNotNull()).select("page_id", "title", "main_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), 400):
                part = frame.iloc[at : at + 400]
                found = np.array(judge_pages(list(zip(part["title"], part["main_text"]))), bool).reshape(-1, 3)
                keep = found.any(axis=1)
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(np.int64)[keep], "is_residue": found[keep, 0], "is_filler": found[keep, 1], "is_notice": found[keep, 2]})

    judged = rows.mapInPandas(run, "page_id bigint, is_residue boolean, is_filler boolean, is_notice boolean")
    return judged.groupBy("page_id").agg(*[F.bool_or(c).alias(c) for c in ("is_residue", "is_filler", "is_notice")])


def clean_pages(pages: DataFrame) -> DataFrame:
    """The pages without those of :func:`residue_pages`; other columns stay as they are."""
    return pages.join(residue_pages(pages).select("page_id"), "page_id", "left_anti")
