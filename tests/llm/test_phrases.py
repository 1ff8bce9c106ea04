import random
import re
from collections import Counter

import numpy as np
import pytest

from martlet.llm import phrases


def plain(rows, threshold, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            ws = [w for w in re.split(r"[ \t]", piece) if w]
            n[lang] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i:i + m])] += 1
    found = {k: v for k, v in f.items() if v >= threshold}
    out = []
    for (lang, ws), a in found.items():
        if len(ws) > 1:
            score, k = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws)))
            if not any(o == lang and len(x) > len(ws) and any(x[i:i + len(ws)] == ws for i in range(len(x))) and 100 * b >= 80 * a for (o, x), b in found.items()):
                out.append((lang, -score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    rows, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def sample():
    random.seed(11)
    words = ["New", "york", "city", "of", "the", "Éa", "ÉA", "x", "y\xa0z", "日本", "don't", "<*>", "a\x1cb"]
    texts = []
    for i in range(250):
        body = [random.choice(words) + random.choice(["", "", "", "", ",", ".", " \t", "\n", "!?"]) for _ in range(random.randrange(30))]
        texts.append((random.choice(["en", "fr", None, "und", ""]), " ".join(body) + random.choice(["", " new York city hall"])))
    return texts + [("en", None), (None, ""), ("en", " \t ..;"), ("long", "one two three four " * 3000), ("fr", "solo")] + [("hot", "same words again and again")] * 50


@pytest.mark.parametrize("capacity, some", [(500_000, 4_000_000), (1000, 3000)])
def test_equal_to_brute_force(spark, monkeypatch, capacity, some):
    monkeypatch.setattr(phrases, "SOME", some)
    monkeypatch.setattr(phrases, "HELD", 2_000_000 if capacity > 1000 else 50)
    rows = sample()
    # Columns that clash with inner names do no harm.
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "lang string, text string, n int, phrase string, h int").repartition(3)
    for threshold in (3, 30):
        got = sorted(tuple(r) for r in phrases.collocations(docs, threshold=threshold, capacity=capacity).collect())
        assert got == plain(rows, threshold) and len(got) > 3


def test_first_of_each_lang_and_empty_tables(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = phrases.collocations(docs, threshold=3, top=4).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 3, top=4)
    assert phrases.collocations(docs.limit(0)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None)], docs.schema)).collect() == []


def test_a_summary_keeps_every_frequent_hash():
    rng = np.random.default_rng(2)
    stream = np.concatenate([np.repeat(np.arange(40), 30), rng.integers(1000, 100_000, 60_000)])
    rng.shuffle(stream)
    mass, threshold = stream.size, 30
    capacity = mass // threshold + 1
    summary = phrases.Summary(capacity, threshold)
    for part in np.array_split(stream, 37):
        h, c = np.unique(part, return_counts=True)
        summary.add([h], [c])
        assert summary.h.size <= capacity
    true = Counter(stream.tolist())
    survivors = set(summary.survivors().tolist())
    assert {h for h, n in true.items() if n >= threshold} <= survivors and 0 < summary.lost < threshold
    # With less room than the mass asks for it grows instead of losing one.
    small = phrases.Summary(10, threshold)
    for part in np.array_split(stream, 37):
        h, c = np.unique(part, return_counts=True)
        small.add([h], [c])
    assert {h for h, n in true.items() if n >= threshold} <= set(small.survivors().tolist()) and small.lost < threshold


def test_a_sieve_lets_through_all_it_was_made_of(spark):
    made = spark.range(100_000).selectExpr("xxhash64(id) AS h")
    bits, table = phrases.sieve_of(made)
    sieve = phrases.Sieve(bits, np.frombuffer(table, np.uint8))
    assert sieve(np.array([r.h for r in made.collect()], np.int64).view(np.uint64)).all()
    others = np.array([r.h for r in spark.range(10**6, 10**6 + 50_000).selectExpr("xxhash64(id) AS h").collect()], np.int64).view(np.uint64)
    assert sieve(others).mean() < 0.1
