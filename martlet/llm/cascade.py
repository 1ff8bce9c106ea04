"""URL filters: exact membership of keys by a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 the other keys of the corpus that level 1
lets through by mistake, level 3 the listed keys that level 2 lets through, and so
on, until a level lets nothing through by mistake.  Over the key universe that the
cascade was fitted on the answer is exact; it is a column expression over constant
bits, so judging a URL needs no join.

What reaches the driver are the bits of the filters.  Their number is proportional
to the number of listed keys (and to the logarithm of the universe's), not to the
corpus; a list whose filter would exceed `MOST_BYTES` is refused, not cut.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import lower_ascii, stage

LANE = 7                       # bits used of a byte, so that each byte is one ASCII character
MOST_BYTES = 64 * 1024 * 1024  # of one filter


class Bloom:
    """The bits of one level, kept as a constant of the plan."""

    def __init__(self, level: int, keys: int, rate: float):
        self.level = level
        self.hashes = max(1, math.ceil(-math.log2(rate)))
        self.width = max(64, math.ceil(1.45 * max(1, keys) * self.hashes))
        if self.width / LANE > MOST_BYTES:
            raise ValueError(f"{keys} keys need {self.width / LANE:.0f} bytes of filter; the bound is {MOST_BYTES}")
        self.bits = bytearray(math.ceil(self.width / LANE))

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.level), F.lit(i)), F.lit(self.width)) for i in range(self.hashes)]

    def fill(self, keys: DataFrame) -> Bloom:
        """Sets the bits of the keys: one row per byte of the filter comes back, however many keys there are."""
        p = F.explode(F.array(*self.positions(F.col("key")))).alias("p")
        byte = F.floor(F.col("p") / LANE).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(LANE)]), (F.col("p") % LANE + 1).cast("int"))
        for row in keys.select(p).groupBy(byte.alias("byte")).agg(F.bit_or(mask).alias("mask")).collect():
            self.bits[row["byte"]] = row["mask"]
        return self

    def holds(self, key: Column) -> Column:
        bits, found = F.lit(bytes(self.bits)), F.lit(True)
        for p in self.positions(key):
            char = F.substring(bits, (F.floor(p / LANE) + 1).cast("int"), F.lit(1)).cast("string")
            found = found & (F.getbit(F.ascii(char), (p % LANE).cast("int")) == 1)
        return found


class Cascade:
    def __init__(self, levels: Sequence[Bloom]):
        self.levels = list(levels)

    @classmethod
    def fit(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """Filters for the keys of `listed` among those of `universe`; both have one column, key.

        Listed keys that the universe lacks are encoded too.  Null keys are never
        listed.  Repeated keys count once.  Without listed keys nothing is a member.
        """
        listed = stage(listed.select("key").filter("key IS NOT NULL").distinct())
        others = stage(universe.select("key").filter("key IS NOT NULL").distinct().join(listed, "key", "left_anti"))
        n_in, n_out = listed.count(), others.count()
        levels: list[Bloom] = []
        inside, outside = listed, others
        while n_in:
            # The first level is as fine as makes about 0.7 mistakes a listed key; the next ones halve.
            rate = min(0.5, max(1e-6, 0.7 * n_in / n_out)) if n_out and not levels else 0.5
            level = Bloom(len(levels) + 1, n_in, rate).fill(inside)
            levels.append(level)
            mistaken = stage(outside.filter(level.holds(F.col("key"))))
            inside, outside, n_in = mistaken, inside, mistaken.count()
        return cls(levels)

    def holds(self, key: Column) -> Column:
        """True for listed keys: the first level that lacks the key decides."""
        answer = F.lit(bool(len(self.levels) % 2))
        for level in reversed(self.levels):
            answer = F.when(level.holds(key), answer).otherwise(F.lit(level.level % 2 == 0))
        return F.coalesce(answer, F.lit(False))


def host_of(url: Column) -> Column:
    """From after the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_and_parents(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def candidate_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Every rule text (host with path) that would fit the URL, longest first; none for an empty host."""
    starts = F.array_distinct(F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull()))
    pairs = F.flatten(F.transform(host_and_parents(host), lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    longest = F.transform(pairs, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(longest), lambda x: x["key"]))


def judge(pages: DataFrame, rules: DataFrame, listed_words: Sequence[str]) -> DataFrame:
    """page_id, host, path, rule, verdict and listed (whether the host is on the derived list) of every page.

    `rules` has host, path and verdict ('block' or 'allow'); a rule fits its host and
    all subdomains if the path starts with the rule's, and the longest rule text wins
    (a rule text that is both allowed and blocked is blocked).  Where no rule fits, the
    method decides: a host is on the list, and so blocked, if a label of it, split at
    hyphens, holds one of `listed_words`.  Membership in all three lists (rules that
    block, rules that allow, listed hosts) is asked of cascades fitted on every key the
    pages have.  Null or malformed URLs have empty host and path, fit no rule and are
    allowed.  One row per input row; an empty table gives none.  Of `pages`, page_id and
    url are read.  The distinct path lengths of the rules come to the driver (at most the
    length of the longest path).
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    texts = rules.select(F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("key"), "verdict",
                         F.length(F.coalesce("path", F.lit(""))).alias("n"))
    lengths = sorted(r["n"] for r in texts.select("n").distinct().collect()) or [0]
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = stage(urls.select(F.explode(keys).alias("key")).distinct())
    blocked = Cascade.fit(texts.filter("verdict = 'block'"), universe)
    allowed = Cascade.fit(texts.filter("verdict = 'allow'"), universe)
    hosts = stage(urls.select(F.col("host").alias("key")).distinct())
    tokens = F.split(F.col("key"), r"[.-]")
    listed = Cascade.fit(hosts.filter(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in listed_words]))), hosts)

    marked = F.transform(keys, lambda k: F.when(blocked.holds(k), F.struct(k.alias("rule"), F.lit("block").alias("verdict")))
                         .when(allowed.holds(k), F.struct(k.alias("rule"), F.lit("allow").alias("verdict"))))
    first = F.get(F.filter(marked, lambda m: m.isNotNull()), F.lit(0))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return (urls.withColumn("first", first).withColumn("listed", listed.holds(F.col("host")))
            .select("page_id", "host", "path", F.col("first.rule").alias("rule"),
                    F.coalesce(F.col("first.verdict"), method).alias("verdict"), "listed"))
