"""Benchmark decontamination: short test items inside long documents.

An item is contained in a document if the document has at least 80 % of the item's
different word shingles (five words).  A MinHash signature of a long document says
little about a short item, so the search is made for containment and not for
resemblance: items are partitioned by their number of shingles (powers of two), and
an item's sketch is its smallest shingle hashes, as many as the largest item of its
partition may miss, plus one.  A document that has 80 % of the item then holds at
least one hash of the sketch, whatever the document's length: no pair is lost.
Documents with too few shingles for an item are not compared with it.  Candidates
are verified by counting the item's shingles, as text, in the document.

An item is an id with its text: rows that repeat an id (or have none) with other
texts are items of their own from the sketch to the verification.

Shingles are hashed in Arrow batches where the texts are.  While the sketches are at
most `SENT` hashes, and the items have at most `WORDS` different words, both go to the
tasks: runs of words that no item has are not hashed at all, and a document gives back
only the hashes it shares with the sketches.  Beyond that it gives all its hashes, and
they meet the sketches in a shuffled join.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import kept_in_worker, sent, ship, stage

ship(__name__)

SHINGLE, SHARE = 5, 0.8
SENT = 2_000_000   # hashes sent to the tasks at most (16 MB)
TOKEN = re.compile(r"\w+")
MEMO = 1_000_000   # word hashes a task remembers
WORDS = 300_000    # different words of items sent to the tasks at most
SOME = 1_000_000   # characters of documents looked at at once


class WordHashes(dict):
    """Hash of a word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return TOKEN.findall(text.lower()) if text else []


def run_hashes(words: list[str], n: int, memo: WordHashes) -> np.ndarray:
    """A 64-bit hash of each run of n words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    runs = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        runs = (runs ^ h[k:len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    return runs


def _among(hashes: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    if known is None or not known.size:
        return np.ones(hashes.size, bool) if known is None else np.zeros(hashes.size, bool)
    at = np.searchsorted(known, hashes)
    at[at == known.size] = 0
    return known[at] == hashes


class ItemWords(dict):
    """Numbers of the words of all items, from 1 on; any other word is 0."""

    def __init__(self, words: list[str]):
        super().__init__((w, i + 1) for i, w in enumerate(words))
        self.hashes = np.fromiter(chain([0], map(xxhash.xxh64_intdigest, words)), np.uint64, len(words) + 1)

    def __missing__(self, word: str) -> int:
        return 0

    def runs(self, numbers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n item words stand side by side, and the hashes of these runs (as by run_hashes)."""
        known = np.cumsum(np.append(0, numbers > 0))
        at = np.flatnonzero(known[n:] - known[:-n] == n) if numbers.size >= n else np.empty(0, np.int64)
        runs = np.zeros(at.size, np.uint64)
        for k in range(n):
            runs = (runs ^ self.hashes[numbers[at + k]]) * np.uint64(0x9E3779B97F4A7C15)
            runs ^= runs >> np.uint64(29)
        return at, runs


def found_in(texts: list[str], sizes: list[int], words: ItemWords, listed: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per text its number of runs, and its different hashes among `listed`; all texts at once."""
    cut = [tokens(t) for t in texts]
    lengths = np.array([len(c) for c in cut], np.int64)
    # A gap after each text keeps runs apart.
    numbers = np.fromiter(chain.from_iterable(chain(map(words.__getitem__, c), (0,)) for c in cut), np.int64, int(lengths.sum()) + len(texts))
    ends = np.cumsum(lengths + 1)
    owners, found = [], []
    for n in sizes:
        at, runs = words.runs(numbers, n)
        hit = _among(runs, listed)
        owners.append(np.searchsorted(ends, at[hit], "right"))
        found.append(runs[hit])
    owner, found = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1]))[:owner.size]
    owner, found = owner[new], found[new].view(np.int64)
    return sum(np.maximum(lengths - n + 1, 0) for n in sizes), np.split(found, np.searchsorted(owner, np.arange(1, len(texts))))


def matched_hashes(sizes: list[int], known, item_words):
    """Column function: {runs, hs} of a text, its number of runs and its different hashes among `known`.

    Runs of a text that hold a word of no item can't be an item's and aren't hashed.
    `known` and `item_words` are broadcasts; where the items are too many for that, both
    are None and all hashes are given.
    """
    run = uuid.uuid4().hex

    @F.pandas_udf("struct<runs: long, hs: array<long>>")
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if known is None:
            memo = WordHashes()
            for texts in batches:
                hs = [np.concatenate([run_hashes(words, n, memo) for n in sizes]) for words in map(tokens, texts)]
                yield pd.DataFrame({"runs": [h.size for h in hs], "hs": [np.unique(h).view(np.int64) for h in hs]})
        else:
            words = kept_in_worker("item words", run, lambda: ItemWords(item_words.value))
            for texts in batches:
                parts = [found_in(some, sizes, words, known.value) for some in some_at_once(texts.tolist())]
                yield pd.DataFrame({"runs": np.concatenate([runs for runs, _ in parts] or [np.empty(0, np.int64)]), "hs": [h for _, hs in parts for h in hs]})

    return matched


def some_at_once(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, about SOME characters together."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size > SOME:
            yield some
            some, size = [], 0
    if some:
        yield some


def matched_texts(sizes: list[int], known):
    """Column function: the different runs of a text, words joined by a space, whose hash is among `known`."""

    @F.pandas_udf("array<string>")
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo, listed = WordHashes(), known.value if known else None
        for texts in batches:
            found = []
            for text in texts:
                words = tokens(text)
                found.append(list({" ".join(words[i:i + n]) for n in sizes for i in np.flatnonzero(_among(run_hashes(words, n, memo), listed))}))
            yield pd.Series(found)

    return matched


def item_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo = WordHashes()
    for items in batches:
        rows = []
        for item, k, text in zip(items["item_id"], items["k"], items["text"]):
            words = tokens(text)
            n = min(SHINGLE, len(words))
            if n:
                hs = run_hashes(words, n, memo).view(np.int64)
                rows += [(item, k, n, s, int(h)) for s, h in {" ".join(words[i:i + n]): h for i, h in enumerate(hs)}.items()]
        yield pd.DataFrame(rows, columns=["item_id", "k", "n", "s", "h"])


def needed(n: Column, share: float) -> Column:
    """The least number of n shingles that is a share of at least `share`."""
    return F.ceil(n * F.lit(share).cast("decimal(9,6)")).cast("long")


def sketch(listed: DataFrame, share: float) -> DataFrame:
    """(item_id, k, need, h): the smallest hashes of each item, in unsigned order.  `listed` has item_id, k (hash of its text), q (its shingles) and h."""
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))
    upper = (F.pow(F.lit(2.0), F.floor(F.log2(F.col("q").cast("double"))) + 1) - 1).cast("long")
    per = listed.select("item_id", "k", "q", (upper - needed(upper, share) + 1).cast("int").alias("depth"), unsigned.alias("u"))
    per = per.groupBy("item_id", "k", "q", "depth").agg(F.sort_array(F.collect_set("u")).alias("us"))
    smallest = per.select("item_id", "k", needed(F.col("q"), share).alias("need"), F.explode(F.slice("us", F.lit(1), F.col("depth"))).alias("u"))
    return smallest.select("item_id", "k", "need", F.col("u").bitwiseXOR(F.lit(-(1 << 63))).alias("h"))


def _pairs(docs: DataFrame, items: DataFrame, share: float, most_sent: int) -> DataFrame:
    """(doc_id, t, item_id, q, found) of each text of a document and text of an item in it; t is the hash of the document's text."""
    id_type = items.schema["item_id"].dataType.simpleString()
    known = items.select("item_id", F.xxhash64("text").alias("k"), "text")
    shingles = known.mapInPandas(item_shingles, f"item_id {id_type}, k long, n int, s string, h long").distinct()
    shingles = stage(shingles)
    sizes = [r["n"] for r in shingles.select("n").distinct().orderBy("n").collect()] or [SHINGLE]   # at most five
    counted = shingles.groupBy("item_id", "k").agg(F.countDistinct("s").alias("q"))
    same = F.col("item_id").eqNullSafe(F.col("__item")) & (F.col("k") == F.col("__k"))
    listed = stage(shingles.join(counted.withColumnsRenamed({"item_id": "__item", "k": "__k"}), same).drop("__item", "__k"))
    sketches = stage(sketch(listed, share))
    known_to = sent(sketches, most_sent)

    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.xxhash64(text).alias("t"), text.alias("text"))
    words = listed.select(F.explode(F.split("s", " ")).alias("word")).distinct()
    few = [r["word"] for r in words.limit(WORDS + 1).collect()]
    item_words = docs.sparkSession.sparkContext.broadcast(few) if len(few) <= WORDS else None
    hashed = keyed.select("doc_id", "t", matched_hashes(sizes, known_to if item_words else None, item_words if known_to else None)("text").alias("m"))
    hits = hashed.select("doc_id", "t", "m.runs", F.explode("m.hs").alias("h")).join(sketches, "h").filter("runs >= need")
    candidates = stage(hits.select(F.col("doc_id").alias("c_id"), F.col("t").alias("c_t"), F.col("item_id").alias("c_item"), F.col("k").alias("c_k")).distinct())

    which = candidates.select("c_id", "c_t").distinct()
    texts = keyed.join(which, keyed["doc_id"].eqNullSafe(which["c_id"]) & (keyed["t"] == which["c_t"]), "left_semi").distinct()
    held = texts.select("doc_id", "t", F.explode(matched_texts(sizes, sent(listed, most_sent))("text")).alias("s"))
    found = held.join(listed.select("item_id", "k", "s", "q").distinct(), "s").groupBy("doc_id", "t", "item_id", "k", "q").agg(F.count(F.lit(1)).alias("found"))
    pair = (found["doc_id"].eqNullSafe(candidates["c_id"]) & (found["t"] == candidates["c_t"])
            & found["item_id"].eqNullSafe(candidates["c_item"]) & (found["k"] == candidates["c_k"]))
    return found.join(candidates, pair, "left_semi").filter(F.col("found") >= needed(F.col("q"), share)).select("doc_id", "t", "item_id", "q", "found")


def contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, most_sent: int = SENT) -> DataFrame:
    """(doc_id, t) of the documents that hold an item, t being the hash of the text (null as empty)."""
    return _pairs(docs, items, share, most_sent).select("doc_id", "t").distinct()


def contained_items(docs: DataFrame, items: DataFrame, share: float = SHARE, most_sent: int = SENT) -> DataFrame:
    """doc_id, item_id, shingles (of the item), found (of them in the document), containment: pairs of at least `share`.

    An item of fewer than five words is one shingle of all its words; an item without
    words is in no document.  Null texts have no words.  Rows that repeat an id with
    its text are one; of an id with several texts, on either side, the best is given.
    Null ids are given as null.  An empty table on either side gives no rows.  `docs`
    needs doc_id and text, `items` item_id and text.
    """
    share_of = (F.col("found") / F.col("q")).alias("containment")
    best = _pairs(docs, items, share, most_sent).groupBy("doc_id", "item_id").agg(F.max(F.struct(share_of, "found", "q")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.q").alias("shingles"), "best.found", "best.containment")
