import random
import re

import pytest
import xxhash

from martlet.llm import simhash
from martlet.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("limits", [(64, 16_384), (1, 10**6), (2, 4)])
def test_groups_equal_brute_force_whichever_way_keys_are_handled(spark, limits):
    random.seed(3)
    words = [f"w{i}É" for i in range(300)]
    texts = []
    for g in range(25):
        base = [random.choice(words) for _ in range(random.choice([1, 2, 3, 40, 400]))]
        for _ in range(random.choice([1, 2, 12])):
            copy = list(base)
            if len(copy) > 100:
                copy[random.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += [None, "", " \t", "One Two", "one two"]
    prints = [plain_fingerprint(t) for t in texts]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(7)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, *limits).collect()}
    groups = plain_groups(list(range(len(texts))), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert got == {i: (f"{p:016x}", groups[i]) for i, p in enumerate(prints)}


def test_null_ids_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "lonely")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(7, 7), (500, 500)]
    random.seed(1)
    random.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "node long, other long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {i: 1000 for i in range(1001, 1400)}
