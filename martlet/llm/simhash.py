"""SimHash near-duplicates: fingerprints of word shingles, linked by pigeonhole blocks.

Fingerprints that differ in at most `DISTANCE` = 3 of 64 bits agree on at least three
of six blocks.  Each distinct fingerprint is filed under its 20 choices of three
blocks (32 bits or so); those that meet under a key are compared.  Copies share a
fingerprint and are filed once.

A key with few fingerprints is joined with itself.  Under a key with many (a large
group of near copies) no pairs are made: one task searches the group from link to
link and gives a spanning forest of it, which has the same components.  Beyond
`GROUP` fingerprints the key is first refined by blocks of its free bits, which
leaves at most 2**17 different fingerprints to a task, however large the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.llm.common import ship, stage
from martlet.llm.components import components

ship(__name__)

DISTANCE, SHINGLE = 3, 3
PAIRED = 64      # up to so many fingerprints under a key are compared by a join
GROUP = 16_384   # beyond so many the key is refined
CHUNK = 100_000  # shingles counted at a time
digest = xxhash.xxh64_digest


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(bits: list[int]) -> list[int]:
    """All choices of three of six blocks of the given bit positions, as masks."""
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(bits, 6)]
    return [a | b | c for a, b, c in combinations(blocks, 3)]


KEYS = _masks(list(range(64)))
FINER = [[m | f for f in _masks([b for b in range(64) if not m >> b & 1])] for m in KEYS]


def fingerprint_of(text: str | None) -> int:
    """The 64 bits of a text; a bit is set if more than half the shingles' XXH64 (seed 42) have it.

    Words are the runs between ASCII white space, A-Z in lower case; shingles are runs
    of three words, space-joined, or all words if there are fewer.  No words: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: ASCII letters and white space only
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42) if words else 0
    counts, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for at in range(0, n, CHUNK):
        part = words[at:at + CHUNK + SHINGLE - 1]
        runs = map(b" ".join, zip(*[part[k:] for k in range(SHINGLE)]))
        digests = b"".join([digest(run, 42) for run in runs])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and t (hash of the text) of every row; null and blank texts have fingerprint 0."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", fingerprint(text).alias("fp"), F.xxhash64(text).alias("t"))


def _filed(prints: DataFrame) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(KEYS)])
    return prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.part", "k.key")


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    """Edges that span each set of fingerprints connected by links of at most DISTANCE bits.

    Each fingerprint is compared only with those not reached yet, so a closely knit
    group costs little more than its size.
    """
    left = np.unique(group["fp"].to_numpy(np.int64))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            node = queue.pop()
            near = np.bitwise_count(left ^ node) <= DISTANCE
            if near.any():
                reached, left = left[near], left[~near]
                found.append((np.full(reached.size, node), reached))
                queue.extend(reached)
    node, other = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (zip(*found) if found else ((), ())))
    return pd.DataFrame({"node": node, "other": other})


def links(prints: DataFrame, paired: int = PAIRED, group: int = GROUP) -> DataFrame:
    """Edges (node, other) between different fingerprints of the column fp, at most DISTANCE bits apart.

    All such pairs that meet under a key of at most `paired` fingerprints, and under
    larger keys a spanning forest; so the components are those of all pairs.
    """
    prints = stage(prints.select("fp").distinct())
    filed = _filed(prints)
    shared = stage(filed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = stage(filed.join(shared, ["part", "key"]))
    few, many, most = (members.filter(c) for c in (f"n <= {paired}", f"n > {paired} AND n <= {group}", f"n > {max(group, paired)}"))
    left, right = few.select("part", "key", F.col("fp").alias("node")), few.select("part", "key", F.col("fp").alias("other"))
    pairs = left.join(right, ["part", "key"]).filter(f"node < other AND bit_count(node ^ other) <= {DISTANCE}").select("node", "other")
    finer = F.element_at(F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in FINER]), F.col("part") + 1)
    refined = most.select("fp", "part", F.posexplode(finer).alias("choice", "mask")).select(
        "fp", (F.col("part") * 20 + F.col("choice") + 1000).cast("int").alias("part"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    grouped = many.select("fp", F.col("part").cast("int").alias("part"), "key").unionByName(refined)
    spans = grouped.groupBy("part", "key").applyInPandas(_forest, "node long, other long")
    return pairs.unionByName(spans)


def document_groups(docs: DataFrame, paired: int = PAIRED, group: int = GROUP) -> DataFrame:
    """doc_id, t (hash of the text), fp, root and component_id of every document.

    root, a fingerprint, names the component also where component_id doesn't: rows that
    repeat an id with other texts can be in several components.
    """
    prints = stage(fingerprints(docs))
    roots = components(links(prints, paired, group))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    nodes = stage(nodes.withColumn("root", F.coalesce("root", "fp")))
    firsts = stage(nodes.groupBy("root").agg(F.min("first").alias("component_id")))
    groups = stage(nodes.join(firsts, "root").select("fp", "root", "component_id"))
    return prints.join(groups, "fp").select("doc_id", "t", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, paired: int = PAIRED, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    component_id is the smallest doc_id reachable over links, the document's own
    included.  Documents without words have fingerprint zero and link like any other.
    Null ids take part in links but are never a component_id (null if a component has
    no other id).  One row per input row; an empty table gives none.
    """
    groups = document_groups(docs, paired, group)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
