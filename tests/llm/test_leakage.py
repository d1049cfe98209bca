from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from loomcrawl.llm import leakage


def brute(docs, items):
    grams = lambda t: (lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)})(re.findall(r"[^\W_]+", (t or "").lower()))
    held = [(i, grams(t)) for i, t in items if i is not None]
    return sorted({(d, i) for d, t in docs if d is not None for i, g in held if grams(t) & g})


def tables():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([5, 12, 13, 20, 40])))) for i in range(30)]
    items += [(50, items[3][1]), (51, None), (52, ""), (None, items[5][1]), (53, "same " * 30), (54, "Straße " + " ".join(words[:13]))]
    docs = []
    for d in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 80)))
        if d % 3 == 0:
            part = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, max(1, len(part)))
            text += " -- " + ", ".join(part[a : a + rng.randrange(5, 30)]).upper() + ". " + text
        docs.append((d, text))
    docs += [(200, None), (201, ""), (202, "same " * 400), (203, "W0, w1 w2\nW3 w4-w5 w6 w7 w8 w9 w10 w11 w12"), (None, items[3][1])]
    docs += [(300 + k, items[4][1] * 2) for k in range(60)] + [(400, " ".join(words * 3000))]
    return docs + docs[:4], items


def test_against_brute_force(shared):
    docs, items = tables()
    d = shared.createDataFrame(docs, "doc_id bigint, text string").withColumn("shingle", F.lit("clash")).withColumn("pos", F.lit(1)).withColumn("window", F.lit(1))
    i = shared.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1)).withColumn("n", F.lit(1))
    got = sorted((r.doc_id, r.item_id) for r in leakage.leaked_items(d, i).collect())
    assert got == brute(docs, items) and len(got) > 60
    assert leakage.leaked_items(d.limit(0), i).count() == 0
    assert leakage.leaked_items(d, i.limit(0)).count() == 0


def test_two_texts_of_one_document_are_not_joined(shared):
    words = [f"q{i}" for i in range(20)]
    docs = shared.createDataFrame([(1, " ".join(words[:12])), (1, "x " * 20 + " ".join(words[8:20]))], "doc_id bigint, text string")
    items = shared.createDataFrame([(9, " ".join(words))], "item_id bigint, text string")
    assert leakage.leaked_items(docs, items).count() == 0


def test_items_in_several_blocks(shared):
    docs, items = tables()
    d, i = shared.createDataFrame(docs, "doc_id bigint, text string"), shared.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in leakage.leaked_items(d, i, block_chars=2000).collect())
    assert got == brute(docs, items)


def test_words_are_those_of_the_pattern():
    texts = ["Ünïted 3rd-party x_y", "", "İstanbul ΣΊΣΥΦΟΣ end", "٣٤ ½ 日本 é", "a"]
    words = leakage.Words(texts)
    got = [(int(o), words.text[a:b]) for o, a, b in zip(words.owner, words.start, words.end)]
    import regex

    assert got == [(k, w) for k, t in enumerate(texts) for w in regex.findall(r"[\p{L}\p{N}]+", t.lower())]
    same = leakage.Words(["one two three four five", "six one TWO three four five"])
    assert same.shingle[same.whole][0] == same.shingle[same.whole][-1]
