import hashlib
import re

import pytest

from martlet.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
HARD = ["a@b.com_x@y.com 1.2.3.4.5.6.7.8 256.1.1.1 +1 (017) 555-7713", None, "", "9" * 3000, "a" * 20000, "x." * 9000 + "@", "ab@c" + ".d" * 9000,
        "é ü+49 170 1234567-8. 4111 1111 1111 1111 ß 4111-1111-1111-1111", "+1+2+3 ( ( " * 500, "1.2.3..4.5.6.7 a@b a@b.c@d.e %@-.-",
        "0001.02.3.0255 300.300.300.300.1.1.1", "4 1 " * 900, "\U0001F600 a@b.co \U0001F600 1.1.1.1"]


def plain(text):
    def luhn(digits):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0

    found = []
    for place, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits),
                    "phone": 10 <= len(digits) <= 15}[kind]:
                found.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(found)]


@pytest.mark.parametrize("given", ["hard", "documents"])
def test_base_spans_equal_plain_python(spark, given):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string") if given == "hard" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    got = pii.find_private(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in base) for k in PATTERNS]
        spans = [s for s in r["spans"].split(",") if s]
        assert [s for s in spans if s.split(":")[0] in PATTERNS] == base and len(spans) == len(base) + r["n_added"]


def test_keys_are_added_and_prose_is_left_alone(spark):
    keys = [f"token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" follows" for i in range(30)]
    clean = [f"Version 4.{i} of page {i} came in 20{i:02d}, see chapter 12/{i}." for i in range(30)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_private(spark.createDataFrame(list(enumerate(keys + clean)), "doc_id long, text string")).collect()}
    assert all(got[i] == "secret:9:49" for i in range(30)) and not any(got[i] for i in range(30, 60))


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.c", "x", "y"), (1, "a@b.c", "x", "y")], "doc_id long, text string, base string, seen string")
    assert [r["spans"] for r in pii.find_private(docs).collect()] == ["email:0:5"] * 2
    assert pii.find_private(docs.limit(0)).collect() == []


def test_em_tells_a_good_labeler_from_noise():
    import random

    random.seed(2)
    patterns = {}
    for _ in range(4000):
        private = random.random() < 0.3
        votes = tuple((1 if (private if random.random() < good else not private) else -1) for good in (0.95, 0.9, 0.5))
        patterns[votes] = patterns.get(votes, 0) + 1
    share, _, post = pii.reliabilities(patterns)
    assert abs(share - 0.3) < 0.06 and post[1, 1, -1] > 0.9 and post[-1, -1, 1] < 0.1
