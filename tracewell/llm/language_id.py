"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle).

A text's profile is its PROFILE most frequent n-grams of 1 to 3 characters, in order of frequency; words are runs of
letters, lower-cased, with a blank on either side. A language's profile is the same over its training documents. The
out-of-place distance of a text to a language sums, over the text's n-grams, how far each one's rank is from its rank in
the language, PROFILE for those that it lacks. The nearest language is the prediction; ties go to the smaller name.

The score is 1 minus the distance over the largest possible distance. Profiles are small (PROFILE n-grams a language), and
prediction is one pass over whole texts without a shuffle.

Defined results: a null or empty text, or one without letters, is `und` with score 0, and so is every text if no language
was learned; null languages are not learned; repeated rows are predicted alike; a null doc_id is not held out and not
learned from; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import held_out, learnable, map_texts, read_table

PROFILE = 400
#: Documents that a language's profile is counted over, at most.
MAX_TRAIN = 2_000
_BLANK = ord(" ")


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as integers (21 bits a character), and how often each occurs."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kinds, back = np.unique(code, return_inverse=True)
    letter = np.fromiter((chr(c).isalpha() for c in kinds), bool, len(kinds))[back]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.where(letter, code, _BLANK)
    keep = letter | np.r_[False, letter[:-1]]  # one blank after each word
    c = np.r_[_BLANK, c[keep], _BLANK]
    two, three = c[:-1] << 21 | c[1:], (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    two, three = two[(c[:-1] != _BLANK) | (c[1:] != _BLANK)], three[c[1:-1] != _BLANK]
    return np.unique(np.concatenate([c[c != _BLANK], two, three]), return_counts=True)


def top(grams: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, the most frequent first; ties by value."""
    if len(grams) > most:  # everything above the border, then as many at it as fit
        border = -np.partition(-counts, most - 1)[most - 1]
        grams, counts = grams[counts >= border], counts[counts >= border]
    return grams[np.lexsort((grams, -counts))[:most]]


def fit(docs: DataFrame, max_train: int = MAX_TRAIN, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """docs(doc_id, text, lang) -> the profile of each language, counted on at most max_train of its documents each."""
    h = F.xxhash64("doc_id", F.lit(5))
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang", h.alias("h"))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, 1.5 * max_train / v))]), F.col("lang"))
    rows = rows.where(F.shiftrightunsigned("h", 11) / F.lit(float(2**53)) < share)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= max_train)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(lang, *gram_counts(text)) for lang, text in zip(pdf["lang"], pdf["text"], strict=True)]
            if found:
                yield pd.DataFrame({"lang": np.repeat([x[0] for x in found], [len(x[1]) for x in found]), "gram": np.concatenate([x[1] for x in found]), "n": np.concatenate([x[2] for x in found])}).groupby(["lang", "gram"], as_index=False).sum()

    grams = rows.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = grams.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= profile)
    found: dict[str, list] = {}
    for r in grams.orderBy("lang", "r").collect():
        found.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in sorted(found.items())}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], profile: int = PROFILE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score, from the whole text."""
    names = sorted(profiles)
    known = np.unique(np.concatenate([profiles[k] for k in names])) if names else np.empty(0, np.int64)
    ranks = np.full((len(names), len(known) + 1), -1, np.int64)  # the last column: n-grams that no language has
    for i, k in enumerate(names):
        ranks[i, np.searchsorted(known, profiles[k])] = np.arange(len(profiles[k]))

    def one(text: str | None) -> tuple[str, float]:
        own = top(*gram_counts(text or ""), profile)
        if not len(own) or not names:
            return "und", 0.0
        at = np.searchsorted(known, own)
        at = np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == own), at, len(known))
        there = ranks[:, at]
        away = np.where(there < 0, profile, np.abs(there - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(away))
        return names[best], 1.0 - float(away[best]) / (profile * len(own))

    def work(texts: list[str | None]) -> list[list]:
        found = [one(t) for t in texts]
        return [[x[0] for x in found], [x[1] for x in found]]

    out = map_texts(docs.select("doc_id", "text"), "text", "lang_pred string, score double", lambda: work)
    return out.select("row.doc_id", "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, fit(docs.where(learnable(F.col("doc_id")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
