"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Text and lexicon are folded alike: lower case, letters that look like Latin ones,
digits and signs that stand for letters.  The lexicon starts from common insults and
is extended by words and stems of the labelled rows; each entry weighs its log odds of
standing in a toxic line.  A hit counts as a whole word (a stem as its beginning) only,
and not inside an exception phrase.  The sum of weights is divided by the logarithm of the text's length and
turned into a probability by a logistic model, together with the heaviest hit.

Matching runs in Arrow batches where the texts are; only the lexicon (bounded by
`WORDS`) goes to the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlet.llm.common import held_out, ship, stage
from martlet.llm.rules import training_rows

ship(__name__)

SAMPLE = 10_000      # labelled rows to learn from
WORDS = 500          # learned entries at most
LEAST_LINES = 8      # different toxic lines a learned entry stands in,
LEAST_ODDS = 3.0     # its log odds,
LEAST_HERE = 2       # and lines of rows that nothing else explains
PRIOR = 3.0          # weight of an insult that the labelled rows lack

# Insults the lexicon starts from.
INSULTS = ["bastard", "clown", "crap", "cretin", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron",
           "pathetic", "scum", "stupid", "trash", "vermin", "worthless"]
# Phrases in which such a word insults nobody.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "trash collection", "garbage can", "garbage collection", "garbage collector", "garbage truck",
              "clown fish", "clown car", "class clown", "pond scum", "jerk chicken", "fool proof", "idiot proof", "loser bracket", "dumb terminal",
              "dumb bell", "crap shoot"]
# Letters of other scripts that look like a Latin one.
LOOKALIKES = {"a": "аɑα", "b": "бв", "c": "сϲ", "d": "ԁ", "e": "еёєε", "g": "ɡց", "h": "һ", "i": "іїιӏ", "j": "ј", "k": "кκ", "m": "м", "n": "пη",
              "o": "оοσө", "p": "рρ", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уүγ", "z": "ᴢ"}
# Digits and signs that stand for letters; l and i fold together, as 1 stands for both.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "i"}

FOLD = str.maketrans({c: latin for latin, like in LOOKALIKES.items() for c in like} | DIGITS | {c: None for c in "­​‌‍⁠﻿"})
SIGN = re.compile(r"(?<=[^\W_])[@$!|€£]+(?=[^\W_])")
SPACE = re.compile(r"\s+")
# Full-width ASCII folds like ASCII.
FOLD |= {0xFEE0 + c: DIGITS.get(chr(c).lower(), chr(c).lower()) for c in range(0x21, 0x7F)}


def fold(text: str) -> str:
    """The text as it is compared: same words, one spelling."""
    text = text.lower()
    if any(s in text for s in SIGNS):
        text = SIGN.sub(lambda m: "".join(SIGNS[c] for c in m.group()), text)
    return SPACE.sub(" ", text.translate(FOLD))


def _automaton(weights: dict[str, float], exceptions: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for entry, weight in [*weights.items(), *[(e, None) for e in exceptions]]:
        text = fold(entry.removesuffix("*"))
        found.add_word(text, (len(text), weight, entry.endswith("*")))
    if len(found):
        found.make_automaton()
    return found


def weigh(text: str, automaton: ahocorasick.Automaton) -> tuple[float, float]:
    """Sum and maximum of the weights of the lexicon's words in the text; every hit counts, those inside exceptions do not."""
    if not text or not len(automaton):
        return 0.0, 0.0
    folded = fold(text)
    hits, spared, size = [], [], len(folded)
    for end, (length, weight, stem) in automaton.iter(folded):
        start = end - length + 1
        if (start and folded[start - 1].isalnum()) or (not stem and end + 1 < size and folded[end + 1].isalnum()):
            continue
        (spared if weight is None else hits).append((start, end, weight))
    if not spared:
        return math.fsum(w for _, _, w in hits), max((w for _, _, w in hits), default=0.0)
    total, at = [0.0], 0
    spared.sort()
    for start, end, weight in sorted(hits):
        while at < len(spared) and spared[at][1] < start:
            at += 1
        if not (at < len(spared) and spared[at][0] <= start and end <= spared[at][1]):
            total.append(weight)
    return math.fsum(total), max(total)


def weight_of(weights: dict[str, float], exceptions: list[str]):
    """A column function: {total, top} of the weighted hits of a text column.  Tasks build the automaton once."""

    @F.pandas_udf("struct<total: double, top: double>")
    def summed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(weights, exceptions)
        for texts in batches:
            yield pd.DataFrame([weigh(t, automaton) for t in texts], columns=["total", "top"], dtype="float64")

    return summed


def evidence(hits: Column, text: Column) -> list[Column]:
    """The sum of weights by the logarithm of the text's length, and the heaviest hit."""
    return [hits["total"] / F.log(F.length(F.coalesce(text, F.lit(""))) / 6.0 + math.e), hits["top"]]


def _entries(words: Column) -> Column:
    """What a line offers the lexicon: its words, and their stems of 4 to 8 letters with a star."""
    def stems(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    return F.array_distinct(F.concat(words, *[stems(n) for n in range(4, 9)]))


def learn_lexicon(labelled: DataFrame, insults: list[str], most: int = WORDS) -> dict[str, float]:
    """Entries and weights; `stem*` stands for all words that begin so.  `labelled` has text and label (0.0 or 1.0).

    A line counts once, however often copies repeat it.  Insults come first.  Then the
    entries that best mark the toxic rows not explained so far are added, again and
    again; so words that merely stand near an insult are not learned.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("line"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))
    lines = stage(labelled.select(F.xxhash64("text").alias("row"), "label", F.explode(F.split("text", "\n")).alias("line"))
                  .groupBy("line").agg(F.max("label").alias("label"), F.min("row").alias("row")).select("label", "row", words.alias("words")))
    toxic = stage(lines.filter("label > 0").select("row", _entries(F.col("words")).alias("entries")))
    clean = lines.filter("label = 0")
    n_clean, n_toxic = clean.count(), toxic.count()

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.explode("entries").alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias(name))

    def odds(count: Column, of: Column | int) -> Column:
        return F.log((count + 0.5) / (of + F.lit(1.0))) - F.log((F.coalesce("clean", F.lit(0)) + 0.5) / (n_clean + 1.0))

    likely = counted(toxic, "toxic").filter((F.col("toxic") >= LEAST_LINES) | F.col("entry").isin(insults))
    likely = stage(likely.join(counted(clean.select(_entries(F.col("words")).alias("entries")), "clean"), "entry", "left"))
    told = {r["entry"]: max(r["odds"], 0.0) for r in likely.filter(F.col("entry").isin(insults)).select("entry", odds(F.col("toxic"), n_toxic).alias("odds")).collect()}
    weights = {w: told.get(w, PRIOR) for w in insults}
    strong = stage(likely.withColumn("odds", odds(F.col("toxic"), n_toxic)).filter((F.col("odds") >= LEAST_ODDS) & ~F.col("entry").isin(insults)))
    rest, new = toxic, list(insults)
    # The best entry of each beginning is added in a round; others of that beginning are judged on what it leaves.
    best_first = W.partitionBy(F.substring("entry", 1, 4)).orderBy(F.desc(F.col("here") * F.col("odds")), F.desc(F.length("entry")), "entry")
    while new and len(weights) < len(insults) + most:
        explained = rest.filter(F.arrays_overlap("entries", F.array(*[F.lit(e) for e in new]))).select("row").distinct()
        rest = stage(rest.join(explained, "row", "left_anti"))
        ranked = counted(rest, "here").filter(F.col("here") >= LEAST_HERE).join(strong, "entry").withColumn("place", F.row_number().over(best_first))
        found = ranked.filter("place = 1").orderBy(F.desc("here"), "entry").limit(most).collect()
        new = [r["entry"] for r in found]
        weights |= {r["entry"]: r["odds"] for r in found}
    return weights


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most: int = SAMPLE,
                   insults: list[str] = INSULTS, exceptions: list[str] = EXCEPTIONS) -> DataFrame:
    """doc_id, held_out, score, predicted and weight (the weighted hits) for every row of `docs`, from its text alone.

    Null and empty texts have no hits and get the score of no hits.  Rows without id
    count as not held out.  Repeated rows are scored alike.  Without labels of both
    classes the logistic model is fixed: no hits score 0.05, one hit of the prior
    weight in a line scores above one half.  An empty table gives no rows.
    """
    labelled = stage(training_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), labels, "toxic", most).drop("doc_id"))
    rows, ones = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    both = ones not in (0, rows)
    weights = learn_lexicon(labelled, insults) if both else dict.fromkeys(insults, PRIOR)
    weigher = weight_of(weights, exceptions)
    slopes, intercept = [4.0, 0.5], math.log(0.05 / 0.95)
    if both:
        weighed = stage(labelled.select("label", "text", weigher("text").alias("hits")))
        fitted = weighed.select("label", array_to_vector(F.array(*evidence(F.col("hits"), F.col("text")))).alias("x"))
        model = LogisticRegression(featuresCol="x", labelCol="label", regParam=1e-3, maxIter=100).fit(fitted)
        slopes, intercept = [float(c) for c in model.coefficients], float(model.intercept)
    scored = docs.select("doc_id", "text", weigher(F.coalesce("text", F.lit(""))).alias("hits"))
    z = F.lit(intercept)
    for slope, x in zip(slopes, evidence(F.col("hits"), F.col("text"))):
        z = z + F.lit(slope) * x
    return (scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1.0 / (1.0 + F.exp(-z))).alias("score"), F.col("hits.total").alias("weight"))
            .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
            .select("doc_id", "held_out", "score", "predicted", "weight"))
