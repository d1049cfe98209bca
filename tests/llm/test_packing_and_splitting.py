from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcrawl.llm import packing, splitting, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no tokenizer files here")


def test_best_pattern_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        capacity = 12
        price, most = np.where(rng.random(capacity + 1) < 0.6, rng.random(capacity + 1), 0.0), rng.integers(0, 4, capacity + 1)
        price[0] = 0
        best = {0: 0.0}
        for s in range(1, capacity + 1):
            for _ in range(int(most[s])):
                for room, v in list(best.items()):
                    if room + s <= capacity and price[s] > 0:
                        best[room + s] = max(best.get(room + s, 0.0), v + price[s])
        got = packing.best_pattern(price, most, capacity)
        assert sum(s * n for s, n in got.items()) <= capacity and all(n <= most[s] for s, n in got.items())
        assert sum(price[s] * n for s, n in got.items()) == pytest.approx(max(best.values()))


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_item(seed):
    rng = np.random.default_rng(seed)
    counts = rng.poisson(3 if seed else 400, 101)
    counts[0] = 0
    packed = packing.pack_histogram(counts, 100)
    plan = packed.plan
    held = Counter()
    for pattern, n in plan:
        assert 0 < sum(s * k for s, k in pattern.items()) <= 100 and n > 0
        for s, k in pattern.items():
            held[s] += k * n
    assert all(held[s] == counts[s] for s in range(101))
    least = -(-int((counts * np.arange(101)).sum()) // 100)
    assert least <= packed.bound <= packed.n_containers <= min(packed.n_best_fit, max(least + 2, 1.03 * least))
    assert 0 <= packed.n_program <= packed.n_containers
    assert packing.pack_histogram(np.zeros(101, int), 100).plan == []


def long_tailed(n, seed):
    """Token counts like those of texts: many short, few long, tails cut into full containers before."""
    rng = np.random.default_rng(seed)
    return np.bincount(np.minimum(2048, rng.lognormal(5.9, 0.9, n).astype(int) + 1), minlength=2049)


@pytest.mark.parametrize("n", [100, 1000, 10_000])
def test_program_is_no_worse_than_best_fit(n):
    counts = long_tailed(n, n)
    packed = packing.pack_histogram(counts, 2048)
    assert packed.bound <= packed.n_containers <= packed.n_best_fit
    assert packed.n_containers <= 1.001 * packed.bound + 1 and packed.n_program > 0.3 * packed.n_containers


def test_lower_bound_holds():
    """Prices of items over half a container show what the volume does not."""
    counts = np.zeros(101, int)
    counts[60], counts[70] = 50, 20
    _, bound = packing.solve_configuration_lp(counts.astype(float), 100, 1.0)
    packed = packing.pack_histogram(counts, 100)
    assert 44 <= bound <= 70 and packed.n_containers == 70


def test_pack_table(shared):
    rng = np.random.default_rng(9)
    sizes = [(i, int(x)) for i, x in enumerate(rng.integers(0, 90, 500))] + [(1000 + i, 37) for i in range(300)] + [(5000, 1234), (5001, 200), (5002, 100), (5003, 0)]
    df = shared.createDataFrame(sizes + sizes[:5], "doc_id bigint, n_tokens int").withColumn("size", F.lit("clash")).withColumn("shard", F.lit(0))
    rows = packing.pack(df, 100, 3).collect()
    used = Counter()
    for r in rows:
        used[r.container] += r.n_tokens
    assert max(used.values()) <= 100 and min(r.container for r in rows) >= 0
    want = Counter()
    for d, n in sizes + sizes[:5]:
        want[d] += n
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
    assert got == +want or {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert sorted(r.piece_no for r in rows if r.doc_id == 5000) == list(range(13))
    assert all(r.piece_no == 0 for r in rows if r.doc_id < 5000)
    report = packing.fill_report(packing.pack(df, 100, 3), 100).first()
    counts = np.bincount([n for d, n in sizes + sizes[:5] if d < 5000], minlength=101)
    plain = sum(n for _, n in packing.best_fit(counts, 100)) + 13 + 2 + 1  # the long ones have their own
    assert report.least <= report.n_containers <= plain + 2
    assert packing.pack(df.limit(0), 100).count() == 0


def test_sizes_of_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "<|endoftext|>"), (5, "日本語")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in packing.document_sizes(df).collect()}
    assert got[1] == got[2] == 0 and got[3] == 2 and got[4] > 1 and got[5] > 0


def test_strongest_cut():
    rng = np.random.default_rng(4)
    s = rng.integers(0, 7, 300).astype(np.int8)
    cuts = splitting.StrongestCut(s)
    for _ in range(500):
        low = int(rng.integers(0, 300))
        high = int(rng.integers(low, 300))
        assert cuts.query(low, high) == max(range(low, high + 1), key=lambda i: (s[i], i))


TEXTS = {
    "prose": "\n\n".join(" ".join(f"Sentence {i} of part {k} is here, with a clause." for i in range(12)) for k in range(30)),
    "no breaks": "abcdefghij" * 3000,
    "wide": "これは長い文章です。改行もありません" * 300,
    "emoji": "👩‍👩‍👧‍👦" * 800,
    "blank": " \n" * 5000,
    "crlf": "line one\r\nline two\r\n\r\n" * 400,
    "hashes": "".join(f"{i * 7919:x}" for i in range(4000)),
}


@pytest.mark.parametrize("name", TEXTS)
def test_pieces_cover_the_text(name):
    text, limit, overlap = TEXTS[name], 100, 10
    pieces = splitting.split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and len(pieces) > 1
    for start, end, n in pieces:
        assert start < end and n == len(tokens.encode(text[start:end])) <= limit
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b < d or (a < c <= b and d == len(text))


def test_cuts_are_natural():
    text = TEXTS["prose"]
    pieces = splitting.split_text(text, 300, 10)
    assert all(text[:end].endswith("\n\n") for _, end, _ in pieces[:-1])
    with pytest.raises(ValueError):
        splitting.split_text(text, 100, 50)


def test_split_table(spark):
    rows = [(1, TEXTS["prose"]), (2, None), (3, ""), (4, "short"), (5, TEXTS["wide"]), (1, TEXTS["prose"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("piece", F.lit("clash")).withColumn("piece_no", F.lit(0))
    got = splitting.split_documents(df, 200, 20).collect()
    assert {r.doc_id for r in got} == {1, 5}
    parts = [r for r in got if r.doc_id == 5]
    whole = ""
    for r in sorted(parts, key=lambda r: r.piece_no):
        assert r.start_char <= len(whole)
        whole = whole[: r.start_char] + r.piece
    assert whole == TEXTS["wide"]
    assert splitting.split_documents(df.limit(0)).count() == 0
