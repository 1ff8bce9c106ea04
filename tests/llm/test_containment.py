import random
import re

import pytest

from martlet.llm import containment


def plain(docs, items, share):
    def shingles(text, n=None):
        words = re.findall(r"\w+", (text or "").lower())
        n = n or min(5, len(words))
        return n, {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()

    found = {}
    for item, text in items:
        n, own = shingles(text)
        for doc, body in docs:
            hit = len(own & shingles(body, n)[1]) if own else 0
            if own and hit >= share * len(own) - 1e-9:
                found[doc, item] = (len(own), hit)
    return found


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_equal_to_brute_force(spark, sent):
    random.seed(5)
    word = lambda: random.choice("abcdefghijklmnopqrstuvwxyzéü") + str(random.randrange(30))
    items = [(i, " ".join(word() for _ in range(random.choice([2, 4, 5, 9, 20, 60])))) for i in range(30)] + [(30, None), (31, "!?"), (32, "a0 a0 a0 a0 a0 a0 a0")]
    docs = []
    for d in range(120):
        body = [word() for _ in range(random.choice([0, 3, 50, 900]))]
        words = random.choice(items[:30])[1].split()
        if d % 2:
            if d % 4 == 1:
                words[len(words) // 2] = "other"
            body[len(body) // 2:len(body) // 2] = [w.upper() + random.choice(["", "!", " —"]) for w in words]
        docs.append((d, " ".join(body)))
    docs += [(500, None), (501, "a0 " * 9)]
    # Columns that clash with inner names do no harm.
    docs_df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, t int, h int")
    items_df = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, q int")
    got = {(r["doc_id"], r["item_id"]): (r["shingles"], r["found"]) for r in containment.contained_items(docs_df, items_df, most_sent=sent).collect()}
    assert got == plain(docs, items, 0.8) and len(got) > 20


def test_empty_sides(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert len(containment.contained_items(docs, items).collect()) == 1
    assert containment.contained_items(docs.limit(0), items).collect() == []
    assert containment.contained_items(docs, items.limit(0)).collect() == []
    assert len(containment.contained_items(docs.union(docs), items.union(items)).collect()) == 1


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_texts_that_share_an_item_id_or_have_none_are_items_of_their_own(spark, sent):
    texts = [" ".join(f"{name}{i}" for i in range(20)) for name in "abcd"]
    items = spark.createDataFrame([(0, texts[0]), (0, texts[1]), (None, texts[2]), (None, texts[3])], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)] + [(9, texts[0][:-20] + texts[1][:20])], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["shingles"], r["found"]) for r in containment.contained_items(docs, items, most_sent=sent).collect()}
    assert got == {(0, 0, 16, 16), (1, 0, 16, 16), (2, None, 16, 16), (3, None, 16, 16)}


def test_runs_of_item_words_hash_as_before():
    import numpy as np
    items = ["one two three four five six", "zwei drei", "a"]
    words = containment.ItemWords(sorted({w for t in items for w in t.split()}))
    texts = ["one two three four five six seven one two three four five", "", "zwei drei zwei drei", "a b a", "x " * 50 + "one two three four five", "six"]
    memo = containment.WordHashes()
    listed = np.sort(np.concatenate([containment.run_hashes(t.split(), n, memo) for t in items for n in (1, 2, 5)]))
    runs, hs = containment.found_in(texts, [1, 2, 5], words, listed)
    for text, n_runs, found in zip(texts, runs, hs):
        own = np.concatenate([containment.run_hashes(containment.tokens(text), n, memo) for n in (1, 2, 5)])
        assert n_runs == own.size and sorted(found.view(np.uint64).tolist()) == sorted(set(own[np.isin(own, listed)].tolist()))


def test_very_long_texts(spark):
    words = [f"w{i % 977}x{i % 13}" for i in range(400_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:30])), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words[250_000:250_040]))], "item_id long, text string")
    assert [(r["doc_id"], r["found"]) for r in containment.contained_items(docs, items).collect()] == [(1, 36)]
