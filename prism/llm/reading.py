"""Reading level of texts: a familiar-word formula over prose.

Level of difficulty = a * (share of words outside the familiar list) + b * (words a sentence) + c, where the
familiar list holds the words of the highest document frequency in the corpus itself. Headings, list items
and code are not prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prism.session import cut

#: A word is familiar if it stands in at least this share of the texts that have prose. The list is the only thing that
#: goes to every task; it holds at most (mean number of distinct words of a text) / FAMILIAR words at any size of corpus.
FAMILIAR = 0.2
#: Fixed weights of the published familiar-word formula (share in per cent, words a sentence, constant).
WEIGHTS = (0.1579, 0.0496, 3.6365)

#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = frozenset(
    "e.g i.e eg ie etc cf vs viz al approx resp ca fig figs no nos vol ed eds pp sec ch eq ref mr mrs ms dr prof sr jr st inc ltd co corp dept est "
    "z.b d.h u.a u.u o.ä bzw usw ggf vgl ca evtl inkl bspw abb nr str p.ex c.-à-d env max min p.ej ej pág sr sra dra ud uds a.m p.m u.s u.k v ver rev".split()
)
WORD = re.compile(r"[^\W\d_]+")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEAD = re.compile(r"^ {0,3}#{1,6}(?:\s|$)")
_UNDERLINE = re.compile(r"^ {0,3}(?:=+|-+)\s*$")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,9}[.)])(?:\s+|$)")
_RULE = re.compile(r"^ {0,3}(?:(?:\*\s*){3,}|(?:_\s*){3,}|(?:-\s*){3,})$")
_SPAN = re.compile(r"(`+)(?:(?!\1).)+?\1")
_LINK = re.compile(r"!?\[([^\]]*)\]\([^)\s]*(?:\s[^)]*)?\)|<?https?://[^\s>)]+>?")
_END = re.compile(r"[.!?…]+(?=[\"'”’»)\]*_]*(?:\s|$))[\"'”’»)\]*_]*")
_BEFORE = re.compile(r"(\S+)$")


def prose(text: str) -> list[str]:
    """The paragraphs of prose in a text, each on one line."""
    out: list[str] = []
    now: list[str] = []
    fence, item, blank = "", False, True

    def close() -> None:
        if now:
            out.append(" ".join(now))
            now.clear()

    for line in text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if fence:
            if re.match(rf"^ {{0,3}}{fence[0]}{{{len(fence)},}}\s*$", line):
                fence = ""
            continue
        if m := _FENCE.match(line):
            close()
            fence, item, blank = m[1], False, False
            continue
        if not line.strip():
            close()
            blank = True
            continue
        indented = line.startswith("    ") or line.startswith("\t")
        if now and _UNDERLINE.match(line):
            now.clear()
            blank = False
            continue
        if _HEAD.match(line) or _RULE.match(line):
            close()
            item = blank = False
            continue
        if _ITEM.match(line) and not (indented and not item and blank):
            close()
            item, blank = True, False
            continue
        if item and not (blank and not line[0].isspace()):
            blank = False
            continue
        item = False
        if indented and not now:
            blank = blank and not now
            continue
        blank = False
        s = line.strip()
        if s.startswith("|") and s.endswith("|"):
            close()
            continue
        now.append(s.lstrip("> "))
    close()
    return [re.sub(r"\s+", " ", _LINK.sub(lambda m: m[1] or " ", _SPAN.sub(" ", p))) for p in out]


def sentences(paragraph: str) -> list[str]:
    """The sentences of a paragraph. The dots of abbreviations, versions and initials end none."""
    out, at = [], 0
    for m in _END.finditer(paragraph):
        rest = paragraph[m.end() :].lstrip()
        if m[0].startswith(".") and not m[0].startswith(".."):
            w = _BEFORE.search(paragraph[at : m.start()])
            w = w[1].lstrip("(['\"*_").lower() if w else ""
            if rest and (w in ABBREVIATIONS and (w != "etc" or not rest[0].isupper()) or len(w) == 1 and w.isalpha() and w not in "iao" or rest[0].islower()):
                continue
        elif m[0] in ("…", "...") and rest and rest[0].islower():
            continue
        out.append(paragraph[at : m.end()])
        at = m.end()
    out.append(paragraph[at:])
    return [s for s in out if WORD.search(s)]


_STATS = "doc_id long, n_words long, n_sentences long, n_letters long, words array<string>, counts array<int>"


def measure(docs: DataFrame) -> DataFrame:
    """Counts of the prose of each text and its distinct words (lower case) with their counts. Null is empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                n_s = n_l = n_w = 0
                seen: dict[str, int] = {}
                for p in prose(text or ""):
                    n_s += len(sentences(p))
                    for w in WORD.findall(p):
                        n_w += 1
                        n_l += len(w)
                        w = w.lower()
                        seen[w] = seen.get(w, 0) + 1
                rows.append((doc, n_w, n_s, n_l, list(seen), list(seen.values())))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_sentences", "n_letters", "words", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, _STATS)


def familiar_words(measured: DataFrame, share: float = FAMILIAR) -> list[str]:
    """The words that stand in at least ``share`` of the texts with prose."""
    texts = measured.where("n_words > 0").count()
    df = measured.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in df.where(F.col("n") >= share * texts).orderBy("w").collect()]


def reading_level(docs: DataFrame, share: float = FAMILIAR) -> DataFrame:
    """(doc_id, n_words, n_sentences, words_per_sentence, letters_per_word, unfamiliar_share, score) of every text.

    Texts without prose (null, blank, only code) have null averages and score. Repeated ids give as many rows.
    """
    measured = cut(measure(docs))
    known = frozenset(familiar_words(measured, share))

    @F.pandas_udf(T.LongType())
    def strange(words: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([sum(int(c) for w, c in zip(ws, cs, strict=True) if w not in known) for ws, cs in zip(words, counts, strict=True)])

    strange_share = F.col("_strange") / F.col("n_words")
    per = F.col("n_words") / F.greatest("n_sentences", F.lit(1))
    score = WEIGHTS[0] * 100 * strange_share + WEIGHTS[1] * per + F.when(strange_share > 0.05, WEIGHTS[2]).otherwise(0.0)
    some = F.col("n_words") > 0
    return measured.withColumn("_strange", strange("words", "counts")).select(
        "doc_id",
        "n_words",
        "n_sentences",
        F.when(some, per).alias("words_per_sentence"),
        F.when(some, F.col("n_letters") / F.col("n_words")).alias("letters_per_word"),
        F.when(some, strange_share).alias("unfamiliar_share"),
        F.when(some, score).alias("score"),
    )


def fit_levels(levels: DataFrame, labels: DataFrame) -> tuple[float, float, float]:
    """Least squares of the mean label of each text on share and sentence length, from sums over all labelled texts."""
    one = labels.where("doc_id is not null and level between 1 and 5").distinct().groupBy("doc_id").agg(F.avg("level").alias("y"))
    j = levels.where("score is not null").join(one, "doc_id").select(F.col("unfamiliar_share").alias("a"), F.col("words_per_sentence").alias("b"), "y")
    names = {"n": F.count("*"), **{x: F.sum(x) for x in "aby"}, **{x + y: F.sum(F.col(x) * F.col(y)) for x, y in ("aa", "ab", "bb", "ay", "by")}}
    s = j.agg(*[v.alias(k) for k, v in names.items()]).first()
    if not s["n"]:
        return 3.0, 0.0, 0.0
    import numpy as np

    m = np.array([[s["n"], s["a"], s["b"]], [s["a"], s["aa"], s["ab"]], [s["b"], s["ab"], s["bb"]]], dtype=float)
    return tuple(float(x) for x in np.linalg.lstsq(m, np.array([s["y"], s["ay"], s["by"]], dtype=float), rcond=None)[0])


def levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """reading_level with ``level`` (1 easy to 5 demanding), fitted to the labels; null where there is no prose."""
    base = cut(reading_level(docs))
    c, a, b = fit_levels(base, labels)
    raw = F.round(c + a * F.col("unfamiliar_share") + b * F.col("words_per_sentence"))
    return base.withColumn("level", F.when(raw.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), raw.cast("int")))))

