"""Phrase collocations: frequent phrases scored by the weakest cut between their words.

Counting goes order by order over tokenised batches:

1. Words are counted exactly.  This also gives the mass of phrases that can follow.
2. Phrases of two words, then those of three and four, are summed up by Misra-Gries
   summaries.  A phrase is a 64-bit hash here.  Each task sends its counts to hash
   partitions; a partition keeps a summary that takes in the tasks' counts one after the
   other and, when it outgrows its capacity, subtracts the same amount from all entries
   and drops those that reach zero.  The capacity exceeds the partition's expected mass
   divided by the threshold, and a summary grows rather than subtract `threshold` or more
   in all; so every phrase of that frequency survives, and one survives only if its
   count and what was subtracted reach the threshold.
3. A second pass counts the survivors exactly, by their text.

A phrase is frequent only if its parts are, so words that are rare, and then pairs that
did not survive, keep longer phrases out of the summaries.  Survivors go to the tasks as
a sieve of at most `SIEVE` bits, whatever their number; a false hit costs counting, never
a result, as rare phrases go after the exact count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.llm.common import ship, stage

ship(__name__)

LONGEST = 4
THRESHOLD = 30          # occurrences of a candidate at least
INSIDE = 80             # percent of a phrase's occurrences that must lie inside a longer one for it to be dropped
TOP = 2000
SIEVE = 1 << 28         # bits of a sieve at most (32 MB)
SHARES = 64             # parts in which a lang's phrases are first ranked
CELL = 1 << 15          # bits of a sieve's cell
CAPACITY = 500_000      # entries a summary is planned for
HELD = 2_000_000        # hashes a task adds up before it sends them on
SOME = 4_000_000        # bytes tokenised at once
FACTOR, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
# Kinds of bytes: 0 in a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


class Tokens:
    """The words of some texts: numbers of (lang, word), and runs of words within a piece."""

    def __init__(self, langs: list[str], texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]   # bytes: A-Z only
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        kind = KIND[data]
        edge = np.flatnonzero(np.diff(kind == 0, prepend=False))
        start, end = edge[::2], edge[1::2]                                  # the last byte is a break
        breaks = np.append(0, np.cumsum(kind == 2, dtype=np.int32))
        self.piece = breaks[start]
        text_end = np.cumsum([len(r) + 1 for r in raw])
        known = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
        self.langs = list(known)
        lang = np.array([known[x] for x in langs], np.int64)[np.searchsorted(text_end, start, "right")]
        offsets = np.append(0, np.cumsum(end - start)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), start.size, [None, pa.py_buffer(offsets), pa.py_buffer(data[kind == 0])]).dictionary_encode()
        spelled = words.dictionary.to_pylist()
        key, self.word = np.unique(lang * len(spelled) + words.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
        of_lang, of_word = np.divmod(key, max(1, len(spelled)))
        self.spelled = [spelled[i] for i in of_word.tolist()]               # of each number
        self.lang = of_lang
        seeds = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 1) for x in self.langs]
        self.hash = np.fromiter((xxhash.xxh64_intdigest(w, seeds[i]) for w, i in zip(self.spelled, of_lang.tolist())), np.uint64, len(key))

    def runs(self, n: int, allowed: np.ndarray | None = None) -> np.ndarray:
        """Where phrases of n words begin; with `allowed` (per place and n - 1) only those whose two parts of n - 1 words are allowed."""
        at = np.arange(max(0, self.word.size - n + 1))
        fits = self.piece[at] == self.piece[at + n - 1]
        if allowed is not None:
            fits &= allowed[at] & allowed[at + 1]
        return at[fits]

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        h = np.full(at.size, n, np.uint64)
        for k in range(n):
            h = (h ^ self.hash[self.word[at + k]]) * FACTOR
            h ^= h >> TURN
        return h

    def counted(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """One place of each different phrase, and how often it is there; compared word by word."""
        if not at.size:
            return at, at
        first, second = (self.word[at + min(k, n - 1)] * len(self.spelled) + self.word[at + min(k + 1, n - 1)] for k in (0, 2))
        order = np.lexsort((second, first)) if n > 2 else np.argsort(first, kind="stable")
        new = np.append(True, (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0))
        begin = np.flatnonzero(new)
        return at[order[begin]], np.diff(np.append(begin, at.size))


def some_at_once(batch: pa.RecordBatch) -> Iterator[Tokens]:
    langs, texts, size = [], [], 0
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        langs.append(lang), texts.append(text)
        size += len(text)
        if size > SOME:
            yield Tokens(langs, texts)
            langs, texts, size = [], [], 0
    if texts:
        yield Tokens(langs, texts)


class Sieve:
    """Membership of hashes with false hits: one bit each in a table of a power of two of bits; no table lets all through."""

    def __init__(self, bits: int, table: np.ndarray | None):
        self.bits, self.table = bits, table

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.ones(hashes.size, bool)
        at = (hashes & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def sieve_of(hashes: DataFrame) -> tuple[int, bytes]:
    """Bits and their table for the long column h; built in Spark cell by cell, so that only bits reach the driver."""
    n = hashes.count()
    bits = CELL
    while bits < SIEVE and bits < 16 * n:
        bits *= 2
    spot = F.col("h").bitwiseAND(F.lit(bits - 1))
    cells = hashes.select(F.shiftright(spot, 15).alias("cell"), spot.bitwiseAND(F.lit(CELL - 1)).alias("bit")).groupBy("cell").agg(F.bitmap_construct_agg("bit").alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for row in cells.toLocalIterator():   # at most SIEVE / CELL rows of 4 KB
        table[row["cell"] * CELL // 8:(row["cell"] + 1) * CELL // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits, table.tobytes()


def _tested(tokens: Tokens, sieves: dict[int, Sieve], n: int) -> np.ndarray | None:
    """Per place, whether the phrase of n words there may be frequent; built up from single words."""
    allowed = None
    for k in range(1, n + 1):
        if k in sieves:
            at = tokens.runs(k, allowed)
            passed = at[sieves[k](tokens.hashes(at, k))]
            allowed = np.zeros(tokens.word.size + 1, bool)
            allowed[passed] = True
        elif k > 1:
            at = tokens.runs(k, allowed)
            allowed = np.zeros(tokens.word.size + 1, bool)
            allowed[at] = True
    return allowed


def _read(sent: dict) -> dict[int, Sieve]:
    return {n: Sieve(bits, np.frombuffer(table, np.uint8)) for n, (bits, table) in sent.value.items()} if sent else {}


def _exact(sent, orders: list[int]):
    """lang, n, phrase and its occurrences in a batch, of phrases that pass the sieves."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = _read(sent)
        for batch in batches:
            for tokens in some_at_once(batch):
                for n in orders:
                    allowed = _tested(tokens, sieves, n)
                    at, times = tokens.counted(tokens.runs(n) if allowed is None else np.flatnonzero(allowed), n)
                    spelled = tokens.spelled
                    rows = zip(*[tokens.word[at + k].tolist() for k in range(n)])
                    phrases = [b" ".join([spelled[i] for i in row]) for row in rows]
                    langs = pa.array(tokens.langs, pa.string()).take(pa.array(tokens.lang[tokens.word[at]]))
                    yield pa.RecordBatch.from_arrays([langs, pa.array(np.full(at.size, n, np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(times)], ["lang", "n", "phrase", "f"])

    return counted


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])[:h.size])
    return h[begin], np.add.reduceat(c, begin) if begin.size else c


def _sent_on(sent, orders: list[int]):
    """Hashes of the phrases of a task that may be frequent, with their occurrences."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves, hashes, counts, size = _read(sent), [], [], 0
        for batch in batches:
            for tokens in some_at_once(batch):
                for n in orders:
                    parts = _tested(tokens, {k: s for k, s in sieves.items() if k < n}, n - 1)
                    h, c = np.unique(tokens.hashes(tokens.runs(n, parts), n), return_counts=True)
                    hashes.append(h), counts.append(c)
                    size += h.size
                if size > HELD:
                    h, c = summed(hashes, counts)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])
                    hashes, counts, size = [], [], 0
        if size:
            h, c = summed(hashes, counts)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    return hashed


class Summary:
    """A Misra-Gries summary: counts too low by at most `lost`, which stays under the threshold."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.lost = capacity, threshold, 0
        self.h, self.c = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, hashes: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.h, self.c = summed([self.h, *hashes], [self.c, *counts])
        if self.h.size > self.capacity:
            over = int(np.partition(self.c, self.h.size - self.capacity - 1)[self.h.size - self.capacity - 1])
            over = min(over, self.threshold - 1 - self.lost)
            left = self.c > over
            self.lost, self.h, self.c = self.lost + over, self.h[left], self.c[left] - over

    def survivors(self) -> np.ndarray:
        return self.h[self.c + self.lost >= self.threshold]


def _merged(capacity: int, threshold: int):
    """What survives in a hash partition."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, hashes, counts, size = Summary(capacity, threshold), [], [], 0
        for batch in batches:
            hashes.append(np.asarray(batch.column("h"))), counts.append(np.asarray(batch.column("c")))
            size += batch.num_rows
            if size > capacity:
                summary.add(hashes, counts)
                hashes, counts, size = [], [], 0
        summary.add(hashes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(summary.survivors())], ["h"])

    return merge


def frequent(docs: DataFrame, threshold: int = THRESHOLD, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(lang, n, phrase, f) of the words and phrases of at least `threshold` occurrences, and (lang, n) with all words of each lang."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "lang string, n int, phrase string, f long"
    all_words = stage(texts.mapInArrow(_exact(None, [1]), schema).groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")))
    totals = stage(all_words.groupBy("lang").agg(F.sum("f").alias("n")))
    words = all_words.where(F.col("f") >= threshold)
    mass = totals.agg(F.sum("n")).first()[0] or 0          # no more phrases of one length than words

    hash_words = words.select("lang", "phrase").mapInArrow(_word_hashes, "h long")
    sieves = {1: sieve_of(hash_words)}
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * mass // (threshold * capacity)))
    for orders in ([2], list(range(3, LONGEST + 1))):
        room = max(1024, 2 * len(orders) * mass // (partitions * threshold) + 1)
        sent = spark.sparkContext.broadcast(sieves)
        found = texts.mapInArrow(_sent_on(sent, orders), "h long, c long").repartition(partitions, "h").mapInArrow(_merged(room, threshold), "h long")
        found = sieve_of(stage(found))
        sieves = sieves | {n: found for n in orders}
    sent = spark.sparkContext.broadcast(sieves)
    counted = texts.mapInArrow(_exact(sent, list(range(2, LONGEST + 1))), schema).groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
    return stage(words.unionByName(counted.where(F.col("f") >= threshold))), totals


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seeds: dict[str, int] = {}
        h = []
        for lang, word in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
            if lang not in seeds:
                seeds[lang] = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 1)
            h.append(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seeds[lang]))
        mixed = (np.uint64(1) ^ np.array(h, np.uint64)) * FACTOR
        yield pa.RecordBatch.from_arrays([pa.array((mixed ^ (mixed >> TURN)).view(np.int64))], ["h"])


def collocations(docs: DataFrame, threshold: int = THRESHOLD, inside: int = INSIDE, top: int = TOP, capacity: int = CAPACITY, salts: int = 16) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first `top` phrases of two to four words.

    a is the phrase's frequency, l and r those of its two parts at the cut of lowest
    score floor(2000000 a / (l + r)), n all words of the lang.  A phrase inside a longer
    frequent one that has `inside` percent of its occurrences is left out.  Rows without
    lang count as `und`, null texts as empty; repeated rows count each.  Texts are read
    whole.  An empty table, or one without frequent phrases, gives no rows.  Columns
    other than lang and text are not looked at.
    """
    counted, totals = frequent(docs, threshold, capacity)
    phrases = counted.where("n > 1").withColumn("w", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "n", "w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    left, right = F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), F.array_join(F.slice("w", F.col("k") + 1, F.col("n") - F.col("k")), " ")
    # Common words are parts of very many phrases: their counts are there once for each salt.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int")
    spread = F.when(F.col("n") == 1, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))
    known = counted.where(F.col("n") < LONGEST).select("lang", "phrase", "f", F.explode(spread).alias("salt"))
    asked = cuts.select("lang", "phrase", "a", "k", left.alias("left"), right.alias("right"),
                        F.when(F.col("k") == 1, salt).otherwise(-1).alias("left_salt"), F.when(F.col("n") - F.col("k") == 1, salt).otherwise(-1).alias("right_salt"))
    for side, name in (("left", "l"), ("right", "r")):
        part = known.select("lang", F.col("phrase").alias(side), F.col("salt").alias(f"{side}_salt"), F.col("f").alias(name))
        asked = asked.join(part, ["lang", side, f"{side}_salt"])
    scored = asked.select("lang", "phrase", "a", "l", "r", "k", F.expr("CAST((CAST(a AS DECIMAL(28,0)) * 2000000BD) DIV (CAST(l AS DECIMAL(28,0)) + r) AS BIGINT)").alias("score"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = phrases.where("n > 2").select("lang", "w", "n", F.col("f").alias("outer"), F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("m"))
    inner = longer.select("lang", "w", "m", "outer", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("s"))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("s"), F.col("m")), " ").alias("phrase"), "outer").groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    held = (F.col("outer").cast("decimal(38,0)") * 100) >= (F.col("a").cast("decimal(38,0)") * inside)
    kept = weakest.join(inner, ["lang", "phrase"], "left").where(F.col("outer").isNull() | ~held)
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    # A lang's phrases are cut at `top` in SHARES parts first, so that its last sort sees a bounded number of them.
    shared = kept.select("lang", "phrase", "a", "cut", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share"))
    in_share = Window.partitionBy("lang", "share").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    few = shared.withColumn("place", F.row_number().over(in_share)).where(F.col("place") <= top)
    best = few.select("lang", "phrase", "a", "cut", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
