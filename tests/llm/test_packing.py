import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from martlet.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Don't stop, I'll GO!! snake_case 12½ x² ¡Hola señor!", "日本語 ΣΊΣΥΦΟΣ ﬁ é́ İstanbul", "<|endoftext|> <|startoftext|>x", "a\x1cb\x85c\xa0d e  \t\n f", "🤖👩‍👩‍👧", "́ alone"]


def expected(rows, capacity):
    tokenizer, out = Tokenizer.from_file(PATH), []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            out.append((str(doc), k // capacity, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    return sorted(out)


def check(found, rows, capacity):
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected(rows, capacity)
    held = {}
    for r in found:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), math.ceil(sum(r.length for r in found) / capacity)


@pytest.mark.parametrize("bucket", [20_000, 3])
def test_pieces_fill_sequences_without_gaps(spark, monkeypatch, bucket):
    monkeypatch.setattr(packing, "BUCKET", bucket)
    monkeypatch.setattr(packing, "BLOCK", 7)
    random.seed(3)
    words = [w for t in ODD for w in t.split(" ")] + ["the", "of", "and,", "Pack;", "unbelievable", "x1y2"]
    rows = [(i, " ".join(random.choice(words) for _ in range(random.randrange(60)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, None), (2000, ""), (2000, " \n"), (3000, "long words " * 400)]
    rows += [(None, "the same text without id")] * 40 + [(5, "one id")] * 3 + [(5, "other text")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, number int, copies int").repartition(3)
    used, least = check(packing.pack(docs, PATH, capacity=64).collect(), rows, 64)
    assert least <= used <= least * 1.03 + 1


def test_words_of_usual_letters_are_read_as_the_tokenizer_reads_them():
    words = packing.Words(PATH)
    assert words.fast is not None
    names = sorted(words.tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
    byte = packing.byte_of_char()
    decoded = [bytes(byte[c] for c in n.removesuffix("</w>")).decode("utf-8", "ignore") for n, _ in names]
    tried = [w for w in decoded if packing.USUAL.fullmatch(w)] + [a + b for a, b in zip(decoded[::7], decoded[3::7]) if packing.USUAL.fullmatch(a + b)]
    assert len(tried) > 40_000
    assert [list(x) for x in words.read(tried)] == [e.ids for e in words.tokenizer.encode_batch(tried, add_special_tokens=False)]


def test_plan_holds_the_histogram_and_beats_plain_best_fit():
    rng = np.random.default_rng(1)
    for shape in (rng.poisson(20, 513), rng.poisson(np.linspace(300, 0.1, 513)), np.where(np.arange(513) % 97 == 0, 1000, 0), np.eye(513, dtype=int)[200] * 10**9):
        counts = shape.astype(np.int64)
        counts[0] = 0
        made, held = packing.plan(counts, 512), np.zeros(513, np.int64)
        for repeats, parts in made:
            assert sum(n * m for n, m in parts) <= 512
            for n, m in parts:
                held[n] += repeats * m
        assert (held == counts).all()
        # A plan may be two sequences in a thousand worse than best fit, where few patterns fit whole.
        assert sum(r for r, _ in made) <= 1.002 * sum(r for r, _ in packing.best_fit(counts.copy(), 512)) + 1
    assert packing.plan(np.zeros(513, np.int64), 512) == []


def test_empty_table_and_no_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).collect() == []
    (row,) = packing.pack(spark.createDataFrame([(1, None)], docs.schema), PATH).collect()
    assert tuple(row) == (1, 0, 0, 1, zlib.crc32(b"\0\0\0\0"), 0, 0)
