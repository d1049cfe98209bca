"""Splitting oversized items at natural boundaries (problem 10).

Each place between two tokens has a strength: end of a paragraph, line, sentence,
clause or word, or none of these. A sparse table over the strengths answers which is
the strongest cut in a window of permissible lengths, the rightmost of equal ones. The
next piece starts a fixed number of tokens before the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcrawl.llm.tokens import RANKS, encode, token_bytes

LIMIT = 1024
OVERLAP = 64
SCHEMA = "doc_id bigint, piece_no int, start_char int, end_char int, n_tokens int, piece string"

_SENTENCE = np.array([ord(c) for c in ".!?…。！？؟।"], np.uint32)
_CLAUSE = np.array([ord(c) for c in ",;:、，；：)]»”"], np.uint32)
_WIDE_END = np.array([ord(c) for c in "。！？、，；：…"], np.uint32)


class StrongestCut:
    """Sparse table of range maxima: level k holds the best index of each run of 2**k."""

    def __init__(self, strength: np.ndarray):
        self.strength = strength
        self.levels = [np.arange(len(strength))]
        while (1 << len(self.levels)) <= len(strength):
            half = 1 << (len(self.levels) - 1)
            a, b = self.levels[-1][:-half], self.levels[-1][half:]
            self.levels.append(np.where(strength[b] >= strength[a], b, a))

    def query(self, low: int, high: int) -> int:
        """Index of the greatest strength in [low, high], the rightmost of equal ones."""
        k = (high - low + 1).bit_length() - 1
        a, b = self.levels[k][low], self.levels[k][high - (1 << k) + 1]
        return int(b if self.strength[b] > self.strength[a] or (self.strength[b] == self.strength[a] and b >= a) else a)


def boundary_strengths(text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strength and character offset of every token boundary; ``ends`` are byte offsets from 0 to the end.

    0: inside a character, 1: inside a word, 2: word, 3: clause, 4: sentence, 5: line, 6: paragraph.
    """
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    heads = (raw & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(heads)])[ends]
    whole = np.ones(len(ends), bool)
    inner = ends < len(raw)
    whole[inner] = heads[ends[inner]]
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = np.isin(code, np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)) | ((code >= 0x2000) & (code <= 0x200A))
    at = np.clip(chars, 1, max(1, len(code) - 1)) if len(code) > 1 else np.ones(len(chars), np.int64)
    strength = np.ones(len(ends), np.int8)
    if len(code) > 1:
        last, following = code[at - 1], code[at]
        gap = blank[at]
        strength[blank[at - 1] | gap] = 2
        strength[(np.isin(last, _CLAUSE) & gap) | np.isin(last, _WIDE_END)] = 3
        strength[np.isin(last, _SENTENCE) & (gap | np.isin(last, _WIDE_END))] = 4
        newline = last == 10
        strength[newline] = 5
        before = code[np.maximum(at - 2, 0)]
        wide = np.where(before == 13, code[np.maximum(at - 3, 0)], before)
        strength[newline & (wide == 10) & (following != 10) & (following != 13)] = 6
    strength[~whole] = 0
    return strength, chars


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = RANKS) -> list[tuple[int, int, int]]:
    """Pieces (start, end, tokens) of a text, in characters; one piece when it is not too long.

    Every piece has at most ``limit`` tokens when it is tokenized by itself. Neighbours
    share ``overlap`` tokens of the whole text, more only where that would start inside
    a character. Pieces follow each other and cover the whole text.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    tokens = encode(text, tokenizer)
    total = len(tokens)
    if total <= limit:
        return [(0, len(text), total)]
    ends = np.concatenate([[0], np.cumsum(token_bytes(tokenizer)[np.asarray(tokens)])])
    strength, chars = boundary_strengths(text, ends)
    cuts = StrongestCut(strength)
    pieces, start = [], 0
    while True:
        high = min(start + limit, total)
        while True:
            low = min(start + max(overlap + 1, (high - start) // 2), high)
            cut = total if high == total else cuts.query(low, high)
            while not strength[cut] and cut > start + 1:
                cut -= 1
            size = len(encode(text[chars[start] : chars[cut]], tokenizer))
            if size <= limit or cut <= start + overlap + 1:
                break
            high = max(cut - (size - limit), start + overlap + 1)
        pieces.append((int(chars[start]), int(chars[cut]), size))
        if cut == total:
            return pieces
        following = cut - overlap
        while not strength[following] and following > start + 1:
            following -= 1
        start = max(following, start + 1)


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, tokenizer: str = RANKS) -> DataFrame:
    """Pieces of the documents of more than ``limit`` tokens, with their place in the text.

    No token is shorter than a byte, so texts of at most ``limit`` bytes are left out
    before any tokenizing. NULL, empty and short texts give no rows. Repeated rows are
    split each for itself. Extra columns are dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                found = split_text(text, limit, overlap, tokenizer)
                if len(found) > 1:
                    rows += [(doc_id, k, a, b, n, text[a:b]) for k, (a, b, n) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "start_char", "end_char", "n_tokens", "piece"])

    long_texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.octet_length("text") > limit)
    return long_texts.mapInPandas(run, SCHEMA)
