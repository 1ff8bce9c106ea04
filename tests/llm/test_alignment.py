import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from martlet.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox, jumping over 12 lazy dogs' tails!", "The quick brown fox; again", None, "", " ", "   leading and trailing   ",
    "tabs\tand\nlines \n\n mixed  \t spaces \r\n", "naïve café Größe señor", "日本語のテキスト と emoji 👩‍👩‍👧 ok", "literal ▁ piece mark", "a▁b",
    "<|endoftext|> and </s> <s> <unk> <0x41> are text", "x" * 300, "\x00 nul and \x1c\x1d odd \x85 blanks\xa0here wide", "é combining ﬁ ligature ①",
    "The quick brown fox, jumping over 12 lazy dogs' tails!", "don't we'll THEY'RE I'm", "½ ² 3³ IV Ⅳ", "word", "word\n", "\nword",
]


def plain(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    chars = {c: bytes([n]) for c, n in alignment.byte_of_char().items()}

    def of_a(i):
        return b"".join(chars[c] for c in a.id_to_token(i))

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    def spans(ids, of):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(of(i))))
            at = out[-1][2]
        return out

    rows, docs = [], {}
    for text in texts:
        x, y = [], []
        if text:
            x, y = spans(a.encode(" " + text, add_special_tokens=False).ids, of_a), spans(b.encode(text), of_b)
            whole = (" " + text).encode()
            if b"".join(of_a(i) for i, *_ in x) != whole or b"".join(of_b(i) for i, *_ in y) != whole:
                x, y = [], []
        links = [(i, j) for i, s, e in x for j, t, f in y if s < f and t < e]
        cuts = sorted({e for *_, e in x} & {f for *_, f in y})
        groups, start = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, s, e in x if start <= s < cut) + "|" + ",".join(str(j) for j, t, f in y if start <= t < cut))
            start = cut
        rows.append((len(x), len(y), links, groups))
        for pair in set(links):
            docs[pair] = docs.get(pair, 0) + 1
    top = {}
    for (i, _), n in docs.items():
        top[i] = max(top.get(i, 0), n)
    return [(n_a, n_b, len(groups), len(links), sum(docs[p] == top[p[0]] for p in links), sum(docs[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for n_a, n_b, links, groups in rows]


@pytest.mark.parametrize("sent", [4_000_000, 0])
@pytest.mark.parametrize("segment", [1_000_000, 40])
def test_equal_to_brute_force(spark, monkeypatch, sent, segment):
    monkeypatch.setattr(alignment, "SEGMENT", segment)
    monkeypatch.setattr(alignment, "KEPT", 300_000 if segment > 40 else 5)
    # Columns that clash with inner names do no harm; one id is repeated, one is missing.
    rows = [(i if i not in (3, 4) else None, t, 1, "t", 2) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair int, t string, docs int").coalesce(2)
    found = alignment.align(docs, A, B, most_sent=sent).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, tuple(r)[1:]) for r in found)
    assert got == sorted((r[0] if r[0] is not None else -1, p) for r, p in zip(rows, plain(TEXTS)))
    assert [r.n_a for r in found if r.doc_id in (2, 9, 10)] == [0, 0, 0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.align(docs, A, B).collect() == [] and alignment.align(docs, A, B).schema["doc_id"].dataType.simpleString() == "string"
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([("a", None)], docs.schema), A, B).collect()] == [("a", 0, 0, 0, 0, 0, 0, "")]


def test_pointers_reach_the_terminal_token_of_long_chains():
    import numpy as np
    ends_a, ends_b = np.array([2, 4, 6, 8, 9, 12]), np.array([1, 3, 5, 7, 9, 10, 12])
    label = alignment.terminals(ends_a, ends_b)
    assert label.tolist() == [10] * 5 + [12] + [10] * 5 + [12, 12]
    n = 5000   # one chain: tokens of two bytes, those of B one byte off
    label = alignment.terminals(np.append(np.arange(2, 2 * n + 1, 2), 2 * n + 1), np.append(1, np.arange(3, 2 * n + 2, 2)))
    assert np.unique(label).tolist() == [2 * n + 1]


def test_both_libraries_read_vocabulary_a_alike():
    v = alignment.Vocabulary(A, B)
    for text in TEXTS:
        if text and not alignment.UNUSUAL.search(text):
            assert v.fast.encode_ordinary(" " + text) == v.a.encode(" " + text, add_special_tokens=False).ids
