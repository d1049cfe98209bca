"""Keyword-stuffed and link-list pages (problem 7).

Each page's text without furniture is measured: share of function words, excess share of
the most frequent word, word pair and word triple, of repeated lines, of link texts,
separators per word, and of words in whole sentences. The thresholds are set per language
from the distribution over all pages of that language. A page is spam when it lacks
function words and sentences and shows one of the other marks, or when word pairs repeat
beyond anything prose does. A page whose language is not among those known has no
function words to lack: its sentences alone speak for it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcrawl.llm import body, residue
from loomcrawl.session import materialize

#: Frequent function words, fixed; languages beyond these are ``xx``.
FUNCTION_WORDS = {
    "en": "the a an and of to in is was were that it for on with as at by from this but not be are had have has its which they their or one all there when after before who what where than then into over out up so if will would can could no yet still since once nobody until every among both most near beside behind although",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wurden hatten hatte weil obwohl damit niemand nun",
    "fr": "le la les de des un une et à en du que est dans qui ce il au pour pas ne sur par plus se avec tout mais on sont ont a été aux ou son sa ses comme depuis leur cette selon près pendant sans après avant personne était d' l' n'",
    "es": "el la los las de del y en que un una a se por con para su al es lo como más pero sus le ya o fue este ha sí porque esta entre cuando muy sin sobre también hasta hay donde quien desde nos durante uno ni contra otros nadie según aunque cerca sigue tras antes",
    "it": "il lo la i gli le di del della dei delle e in che un una a per con su da dal dalla è non si come più ma anche al alla nel nella sono ha hanno era questo questa o se quando dopo prima senza tra fra ogni ancora dove chi",
    "pt": "o a os as de do da dos das e em que um uma no na nos nas por para com não se mais como mas ao à foi é são tem ser ou quando muito já também até pelo pela isso este esta entre depois sem mesmo ainda onde quem",
    "nl": "de het een en van in is dat op te met voor niet zijn aan er om ook als bij maar door naar uit over nog worden werd wordt dan of ze hij was had hebben heeft deze dit tot na toen waar wie geen omdat onder tegen",
    "pl": "i w na z do nie się to że jest o jak ale po za od przez dla tak już tylko jego jej ich przy oraz lub być był była było są które który która gdy bez pod nad przed aby czy może też",
    "sv": "och i att det som en på är av för med till den har de inte om ett men var sig från så vid man kan när där efter eller hade också under över ut nu än alla utan mellan sedan blev",
    "da": "og i at det som en på er af for med til den har de ikke om et men var sig fra så ved man kan når hvor efter eller havde også under over ud nu end alle uden mellem siden blev",
    "fi": "ja on ei se että oli joka mutta myös kun niin ovat hän kuin tai sen jos vain ole olivat jo nyt sitä sekä mukaan ennen jälkeen kanssa vielä",
    "cs": "a v na se je že z do o s to i pro za od k po jako ale by tak když který která které jsou byl byla bylo nebo jen při před mezi podle také už jeho",
    "ro": "și în de la a cu pe un o nu din pentru care este că mai sau dar după ca fost sunt prin între când fără până dintre această acest",
    "tr": "ve bir bu da de için ile çok olan olarak daha ama gibi kadar sonra o ne her en değil ya veya olduğu ancak var",
}
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LANGUAGES = {w: tuple(k for k, s in _SETS.items() if w in s) for w in frozenset().union(*_SETS.values())}
_WORD = re.compile(r"[^\W\d_]+(?:'(?!\w{3}))?|\d+")
_SEPARATOR = re.compile(r"[,|·#;/•*]|\s[-–]\s")
_END = re.compile(r"[.!?…。！？][\"'”’»)]*(?:\s|$)")
#: Deviations from the median of the language at which a share is out of range.
DEVIATIONS = 8.0
#: Share of words in sentences from which a page is no list, and distance from the median
#: from which repeated pairs are stuffing.
LIST_SENTENCES = 0.3
LEAST_STUFFED = 0.2
PERCENTILES = (0.25, 0.5, 0.75)
MEASURES = ("function", "top_word", "top_pair", "top_three", "repeated", "linked", "separators", "sentences")
SCHEMA = "page_id bigint, lang string, n_words int, " + ", ".join(f"{m} double" for m in MEASURES) + ", is_residue boolean"


def language_of(lines: list[list[str]]) -> str:
    """Language with most evidence from different function words, ``xx`` where fewer than three were met.

    A word that several languages have is divided among them.
    """
    hits: Counter = Counter()
    evidence = dict.fromkeys(_SETS, 0.0)
    for w in {w for words in lines for w in words}:
        having = _LANGUAGES.get(w, ())
        for k in having:
            hits[k] += 1
            evidence[k] += 1 / len(having)
    best = max(_SETS, key=lambda k: (evidence[k], k))
    return best if hits[best] >= 3 else "xx"


def linked_words(words: list[str], links: set[tuple[str, ...]]) -> int:
    """Words that stand in a link text, each position once; the longest text at a place counts."""
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for link in links:
        by_first.setdefault(link[0], []).append(link)
    for found in by_first.values():
        found.sort(key=len, reverse=True)
    at = n = 0
    while at < len(words):
        size = next((len(x) for x in by_first.get(words[at], ()) if tuple(words[at : at + len(x)]) == x), 0)
        n += size
        at += size or 1
    return n


def _excess(grams) -> int:
    """Occurrences of the most frequent gram beyond its second: said twice is not yet repeated."""
    return max(0, max(Counter(grams).values(), default=0) - 2)


def measure(text: str, anchors: list[str], model: body.Weights) -> tuple | None:
    """(lang, n_words, *MEASURES) of a page, None where it has no content words.

    Shares of repeated grams count repetitions only, so a short text that repeats nothing
    has none, whatever its length.
    """
    lines = [x for x in (" ".join(x.split()) for x in text.split("\n")) if x]
    low = [x.lower() for x in lines]
    split = [_WORD.findall(x) for x in low]
    lang = language_of(split)
    common = _SETS.get(lang, frozenset())
    own = [k for k, x in enumerate(lines) if model.line_content(x) >= 0]
    words = [w for k in own for w in split[k]]
    n = len(words)
    if not n:
        return None
    plain = [w if w not in common else None for w in words]
    pairs = ((a, b) for a, b in zip(plain, plain[1:]) if a and b)
    threes = ((a, b, c) for a, b, c in zip(plain, plain[1:], plain[2:]) if a and b and c)
    links = {tuple(w) for w in (_WORD.findall(a.lower()) for a in anchors if a) if w}
    texts = [low[k] for k in own]
    in_sentences = 0
    for k in own:
        w = split[k]
        if w and _END.search(lines[k]) and (lang == "xx" or sum(t in common for t in w) >= 0.2 * len(w)):
            in_sentences += len(w)
    return (
        lang,
        n,
        plain.count(None) / n,
        _excess(w for w in plain if w) / n,
        2 * _excess(pairs) / n,
        3 * _excess(threes) / n,
        1 - len(set(texts)) / len(texts),
        linked_words(words, links) / n if links else 0.0,
        len(_SEPARATOR.findall("\n".join(texts))) / n,
        in_sentences / n,
    )


def page_measures(pages: DataFrame) -> DataFrame:
    """One row of measures per page with content words.

    Rows are measured where they lie, and the measures of repeated rows are collapsed.
    Whether a text is filler, an error notice or a template's leftovers, which problem 5
    names, is asked only of pages that :func:`spam_pages` can name at all.
    """
    rows_in = pages.where(F.col("page_id").isNotNull() & F.col("main_text").isNotNull()).select("page_id", "main_text", F.transform("outlinks", lambda x: x["anchor_text"]).alias("anchors"))
    sentences, pair = (3 + MEASURES.index(m) - 1 for m in ("sentences", "top_pair"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = body.weights()
        for frame in batches:
            rows = []
            for page_id, text, anchors in zip(frame["page_id"], frame["main_text"], frame["anchors"]):
                found = measure(text, list(anchors) if anchors is not None else [], model)
                if found:
                    possible = found[sentences] < LIST_SENTENCES or found[pair] > LEAST_STUFFED
                    rows.append((page_id, *found, possible and (any(residue.judge_pages([(None, text)])[0][1:]) or residue.mostly_residue(text))))
            yield pd.DataFrame(rows, columns=["page_id", "lang", "n_words", *MEASURES, "is_residue"])

    return rows_in.mapInPandas(run, SCHEMA).dropDuplicates(["page_id"])


def language_ranges(measures: DataFrame) -> DataFrame:
    """Quartiles of every measure per language, and over all pages for the language ``xx``."""
    cuts = [F.percentile_approx(m, F.array(*[F.lit(p) for p in PERCENTILES]), 10_000).alias(f"q_{m}") for m in MEASURES]
    own = measures.where(F.col("lang") != "xx").groupBy("lang").agg(*cuts)
    return own.unionByName(measures.agg(*cuts).withColumn("lang", F.lit("xx")))


def _beyond(name: str, least: float, sign: int) -> Column:
    """Whether a measure is out of its language's range, upward (1) or downward (-1).

    ``least`` is the least distance from the median that counts.
    """
    q = F.col(f"q_{name}")
    width = F.greatest(DEVIATIONS * (q[2] - q[0]) / 2, F.lit(least))
    return F.col(name) > q[1] + width if sign > 0 else F.col(name) < q[1] - width


def spam_pages(pages: DataFrame) -> DataFrame:
    """(page_id, lang, is_list, is_stuffed) of keyword-stuffed and link-list pages.

    List: few function words (where the language is known), hardly a sentence, and either a
    word, pair or triple far too frequent, or separators, or repeated lines, or link texts
    in place of text. Stuffed: one word pair is more frequent than any prose of the language
    has it. Pages without own words, with only filler or an error notice, or whose own text
    is for the most part left by a template are never among them. Rows of one page, which
    has one text, count once; an empty table gives no rows.
    """
    measures = materialize(page_measures(pages), "page-measures")
    ranged = measures.join(F.broadcast(language_ranges(measures)), "lang")  # one row per language
    repeats = _beyond("top_pair", 0.06, 1) | _beyond("top_word", 0.06, 1) | _beyond("top_three", 0.06, 1)
    marks = repeats | _beyond("separators", 0.15, 1) | _beyond("repeated", 0.3, 1) | (F.col("linked") > 0.5)
    is_list = ((F.col("lang") == "xx") | _beyond("function", 0.15, -1)) & (F.col("sentences") < LIST_SENTENCES) & marks
    is_stuffed = _beyond("top_pair", LEAST_STUFFED, 1) & _beyond("top_word", 0.06, 1)
    judged = ranged.where(~F.col("is_residue")).select("page_id", "lang", is_list.alias("is_list"), is_stuffed.alias("is_stuffed"))
    return judged.where(F.col("is_list") | F.col("is_stuffed"))
