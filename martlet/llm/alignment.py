"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes.

Tokenizer A (byte-level BPE) and tokenizer B (pieces with byte fallback) both read a
space and the text.  Each token points to the farthest-right token of the other kind
that overlaps it; where both end on one byte, the B token points to itself.  Doubling
the pointers (succ = succ[succ]) until nothing changes brings every token to the
terminal token of its component, which labels the groups.  Links are the pairs of an A
and a B token whose bytes overlap: one for each stretch between two token ends.

Neither tokenizer lets a token reach over the start of a run of white space, so a text
is cut before each space that follows a visible character, and equal cuts ("chunks")
are encoded and aligned once while a Python worker remembers them.  `Vocabulary` refuses a B model for which this
does not hold.

Pass one counts per pair of ids the documents that hold it linked, pre-aggregated per
batch.  Pass two reads the counts: while they are at most `SENT` pairs they go to the
tasks; beyond that the documents' links meet them in a shuffled join.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.llm.common import kept_in_worker, ship, stage

ship(__name__)

SENT = 4_000_000       # counted pairs sent to the tasks at most (70 MB)
SEGMENT = 1_000_000    # characters cut into chunks at a time
UNIT = 64              # chunks encoded at once
KEPT = 300_000         # chunks a Python worker remembers, at most so many and
KEPT_BYTES = 32 << 20  # so many bytes of them
CUT = re.compile(r"(?<=\S)(?= )")
BLANK_BEFORE = re.compile(r"\s ")
UNUSUAL = re.compile(r"[^\x00-\u024F]")
# Fixed value: how byte-level vocabularies of this kind split a text.
A_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: visible Latin-1 ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    escaped = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(escaped[1], 16)]) if escaped else piece.replace("▁", " ").encode()


class Vocabulary:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        chars, names = byte_of_char(), self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes_a[i] = bytes(chars[c] for c in name)
        # The same vocabulary in a faster library, for letters on which all versions of Unicode agree.
        self.fast = tiktoken.Encoding("a", pat_str=A_PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.bytes_a) if t}, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces of B reach over the start of white space: texts can't be cut there")
        self.bytes_b = [b"\xff\xfe" * 4 if self.b.is_unknown(i) or self.b.is_control(i) else piece_bytes(p) for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id("▁")
        names = [str(i).encode() for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.comma, self.bar, self.semicolon = (np.array([n + sign for n in names], object) for sign in (b",", b"|", b";"))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space; B adds that space itself."""
        a = [self.a.encode(t, add_special_tokens=False).ids if UNUSUAL.search(t) else self.fast.encode_ordinary(t) for t in texts]
        return a, [ids or [self.blank] for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]

    def given_back(self, a: list[int], b: list[int], text: str) -> bool:
        return b"".join([self.bytes_a[i] for i in a]) == b"".join([self.bytes_b[i] for i in b]) == text.encode()

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all chunks, the bytes of each, and whether its bytes differ; such a chunk has no ids and no bytes.

        Chunks are encoded some at once, which gives the same tokens as one by one.
        """
        units = [chunks[i:i + UNIT] for i in range(0, len(chunks), UNIT)]
        # The end of a text may be white space, which would run into the next chunk's.
        units = [x for u in units for x in ([[c] for c in u] if any(c[-1].isspace() for c in u) else [u])]
        a, b = self.encode(["".join(u) for u in units])
        sizes, differs, start = np.array([len(c.encode()) for c in chunks], np.int64), np.zeros(len(chunks), np.int64), 0
        for k, unit in enumerate(units):
            if not self.given_back(a[k], b[k], "".join(unit)):
                alone = list(zip(*self.encode(unit)))
                fine = [self.given_back(x, y, c) for (x, y), c in zip(alone, unit)]
                a[k], b[k] = ([i for ids, ok in zip(alone, fine) if ok for i in ids[side]] for side in (0, 1))
                differs[start:start + len(unit)] = ~np.array(fine)
            start += len(unit)
        sizes[differs > 0] = 0
        ids_a, ids_b = (np.array(list(chain.from_iterable(x)), np.int64) for x in (a, b))
        return ids_a, ids_b, sizes, differs


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each token, A's before B's, the terminal token of its component; ends are those of tokens laid without gaps over the same bytes."""
    n = ends_a.size
    to_a = np.searchsorted(ends_a, ends_b)
    own = np.arange(n, n + ends_b.size)
    succ = np.concatenate([n + np.searchsorted(ends_b, ends_a), np.where(ends_a[to_a] > ends_b, to_a, own)])
    while not np.array_equal(further := succ[succ], succ):
        succ = further
    return succ


class Numbered(dict):
    """Numbers what is asked for in the order of asking."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Chunks:
    """Aligned chunks a Python worker remembers: numbers per chunk, and its links or (with `grouped`) the text of its groups."""

    def __init__(self, vocabulary: Vocabulary, grouped: bool, counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.v, self.grouped, self.counts = vocabulary, grouped, counts
        self.clear()

    def clear(self) -> None:
        self.at = Numbered()
        self.groups: list[bytes] = []
        self.pairs = np.empty(0, np.int64)          # links of all chunks, one after the other
        self.ends = np.zeros(1, np.int64)           # where a chunk's links end
        self.numbers = np.zeros((0, 7), np.int64)   # a, b, groups, links, best links, counts of links, 1 if the bytes differ
        self.size = 0

    def indices(self, chunks: list[str]) -> np.ndarray:
        """Numbers of chunks, each given without the space it begins with."""
        found = np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))
        if len(self.at) > len(self.numbers):
            self.learn([f" {c}" for c in islice(self.at, len(self.numbers), None)])
        return found

    def forget(self) -> None:
        """Called between segments."""
        if len(self.at) > KEPT or self.size > KEPT_BYTES:
            self.clear()

    def learn(self, chunks: list[str]) -> None:
        v = self.v
        ids_a, ids_b, sizes, differs = v.encode_chunks(chunks)
        bounds = np.cumsum(sizes)
        ends_a, ends_b = np.cumsum(v.len_a[ids_a]), np.cumsum(v.len_b[ids_b])
        label = terminals(ends_a, ends_b)
        cut = np.zeros(int(bounds[-1]) + 1, bool)
        cut[ends_a] = cut[ends_b] = True
        stretch = np.flatnonzero(cut)
        last = np.flatnonzero(label[ids_a.size:] == np.arange(ids_a.size, label.size))   # B tokens that end a group, one a group
        pairs = ids_a[np.searchsorted(ends_a, stretch)] * len(v.bytes_b) + ids_b[np.searchsorted(ends_b, stretch)]
        to_a, to_b, to_groups, to_links = (np.searchsorted(ends, bounds, "right") for ends in (ends_a, ends_b, ends_b[last], stretch))
        best = summed = np.zeros(pairs.size + 1, np.int64)
        if self.counts is not None and pairs.size:
            known, docs, is_best = self.counts
            at = np.searchsorted(known, pairs)
            best, summed = (np.concatenate([[0], np.cumsum(x[at].astype(np.int64))]) for x in (is_best, docs))
        per = [np.diff(x, prepend=0) for x in (to_a, to_b, to_groups, to_links, best[to_links], summed[to_links])]
        if self.grouped:
            self.write(ids_a, ids_b, *np.split(np.searchsorted(last, label - ids_a.size), [ids_a.size]), (to_a + to_b).tolist())
        else:
            self.pairs, self.ends = np.concatenate([self.pairs, pairs]), np.concatenate([self.ends, self.ends[-1] + to_links])
        self.numbers = np.concatenate([self.numbers, np.stack([*per, differs], axis=1)])
        self.size += int(sizes.sum())

    def write(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, ends: list[int]) -> None:
        """Appends "a1,a2|b1;" of each chunk: within a group A's ids, a bar, B's ids, a semicolon."""
        final_a, final_b = (np.append(g[1:] != g[:-1], True)[:g.size] for g in (group_a, group_b))
        words = np.empty(ids_a.size + ids_b.size, object)
        words[np.arange(ids_a.size) + np.searchsorted(group_b, group_a)] = np.where(final_a, self.v.bar[ids_a], self.v.comma[ids_a])
        words[np.arange(ids_b.size) + np.searchsorted(group_a, group_b, "right")] = np.where(final_b, self.v.semicolon[ids_b], self.v.comma[ids_b])
        words, start = words.tolist(), 0
        for end in ends:
            self.groups.append(b"".join(words[start:end]))
            start = end

    def links_of(self, indices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links of the chunks, and how many each has."""
        n = self.ends[indices + 1] - self.ends[indices]
        first = np.repeat(self.ends[indices] - np.cumsum(n) + n, n)
        return self.pairs[first + np.arange(first.size)], n


def segments(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(number of the text, space and text cut before a space), at most SEGMENT characters together where a space allows it."""
    some, size = [], 0
    for i, text in enumerate(texts):
        text, start = f" {text}" if text else "", 0
        while start < len(text):
            found = CUT.search(text, start + SEGMENT) if len(text) - start > SEGMENT else None
            end = found.start() if found else len(text)
            if some and size + end - start > SEGMENT:
                yield some
                some, size = [], 0
            some.append((i, text[start:end]))
            size += end - start
            start = end
    if some:
        yield some


class Aligned:
    """What the texts of a batch add up to: `numbers` per text as in Chunks, and the digests of their groups or their links."""

    def __init__(self, texts: list[str | None], chunks: Chunks):
        self.numbers = np.zeros((len(texts), 7), np.int64)
        digests = [hashlib.sha256() for _ in texts]
        begun, found, width = set(), [], len(chunks.v.bytes_a) * len(chunks.v.bytes_b)
        for some in segments(texts):
            cut = [text[1:].split(" ") if not BLANK_BEFORE.search(text) else [c[1:] for c in CUT.split(text)] for _, text in some]
            sizes, owners = np.array([len(c) for c in cut]), np.array([i for i, _ in some])   # a text is there once a segment
            indices = chunks.indices([c for x in cut for c in x])
            self.numbers[owners] += np.add.reduceat(chunks.numbers[indices], np.cumsum(sizes) - sizes)
            if chunks.grouped:
                start, groups = 0, chunks.groups
                for i, n in zip(owners.tolist(), sizes.tolist()):
                    said = b"".join([groups[k] for k in indices[start:start + n].tolist()])
                    digests[i].update((b";" if i in begun and said else b"") + said[:-1])
                    if said:
                        begun.add(i)
                    start += n
            else:
                pairs, n = chunks.links_of(indices)
                found.append(np.unique(np.repeat(np.repeat(owners, sizes), n) * width + pairs, return_counts=True))
            chunks.forget()
        bad = self.numbers[:, 6] > 0
        self.numbers[bad] = 0
        if chunks.grouped:
            self.digests = [d.hexdigest() if n else "" for d, n in zip(digests, self.numbers[:, 0].tolist())]
        else:
            keys = np.concatenate([k for k, _ in found] or [np.empty(0, np.int64)])
            times = np.concatenate([n for _, n in found] or [np.empty(0, np.int64)])
            if len(found) > 1:   # a long text's segments meet again
                order = np.argsort(keys, kind="stable")
                keys, times = keys[order], times[order]
                start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:keys.size])
                keys, times = keys[start], np.add.reduceat(times, start)
            self.owner, self.pair = np.divmod(keys, width)
            good = ~bad[self.owner]
            self.owner, self.pair, self.times = self.owner[good], self.pair[good], times[good]


def remembered(path_a: str, path_b: str, grouped: bool, counts=None, run: str = "") -> Chunks:
    """The chunks of this Python worker, for the tasks of one pass; `run` tells one set of counts from another."""
    vocabulary = kept_in_worker("vocabulary", (path_a, path_b), lambda: Vocabulary(path_a, path_b))
    return kept_in_worker("chunks", (path_a, path_b, grouped, run, KEPT), lambda: Chunks(vocabulary, grouped, counts.value if counts else None))


def _pairs_of(path_a: str, path_b: str):
    """Per batch, how many texts hold each pair of ids linked."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = remembered(path_a, path_b, False)
        for batch in batches:
            pair, docs = np.unique(Aligned(batch.column("text").to_pylist(), chunks).pair, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(docs)], ["pair", "docs"])

    return counted


def _rows_of(path_a: str, path_b: str, counts):
    """Per text its numbers; with `counts` (a broadcast) also n_best and count_sum."""
    run = uuid.uuid4().hex

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = remembered(path_a, path_b, True, counts, run)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = Aligned(texts, chunks)
            n = [pa.array(rows.numbers[:, k]) for k in range(6)]
            columns = {"doc_id": batch.column("doc_id"), "n_a": n[0], "n_b": n[1], "n_groups": n[2], "n_links": n[3], "groups_sha256": pa.array(rows.digests, pa.string())}
            last = {"n_best": n[4], "count_sum": n[5]} if counts else {"t": pa.array([hashlib.sha256(t.encode()).hexdigest() if t else None for t in texts], pa.string())}
            yield pa.RecordBatch.from_pydict(columns | last)

    return aligned


def _links_of(path_a: str, path_b: str):
    """Per batch and text (by its hash), the links of all rows that hold it."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = remembered(path_a, path_b, False)
        for batch in batches:
            times: dict[str, int] = {}
            for text in batch.column("text").to_pylist():
                times[text] = times.get(text, 0) + 1
            rows = Aligned(list(times), chunks)
            keys = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in times], pa.string())
            links = rows.times * np.fromiter(times.values(), np.int64, len(times))[rows.owner]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows.owner)), pa.array(rows.pair), pa.array(links)], ["t", "pair", "links"])

    return linked


def align(docs: DataFrame, path_a: str, path_b: str, most_sent: int = SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of `docs`.

    A pair's count is the number of rows of `docs` that hold it linked; n_best are the
    links whose count is the highest of their A id, ties included; count_sum adds the
    counts of all links.  Null and empty texts, and texts that one of the tokenizers
    does not give back byte by byte, have no tokens: zeros, and an empty digest.
    Repeated rows and ids count each; null ids are kept; an empty table gives none.
    A text of any length is read whole, segment by segment.  Columns other than doc_id
    and text are not looked at.
    """
    texts = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    held = texts.where("text != ''").select("text").mapInArrow(_pairs_of(path_a, path_b), "pair long, docs long")
    width = len(Vocabulary(path_a, path_b).bytes_b)
    counted = stage(held.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.expr(f"pair DIV {width}")))
    # One A id has at most as many pairs as B has ids.
    counted = counted.select("pair", "docs", (F.col("docs") == F.max("docs").over(Window.partitionBy("a"))).alias("best"))
    if counted.count() <= most_sent:
        table = counted.toPandas().sort_values("pair")
        counts = docs.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["docs"].to_numpy(np.int64), table["best"].to_numpy(bool)))
        rows = texts.mapInArrow(_rows_of(path_a, path_b, counts), f"doc_id {id_type}, {COLUMNS}, n_best long, count_sum long")
    else:
        # Rows of equal text have equal links: summed over them all, then shared out.
        plain = texts.mapInArrow(_rows_of(path_a, path_b, None), f"doc_id {id_type}, {COLUMNS}, t string")
        links = texts.where("text != ''").select("text").mapInArrow(_links_of(path_a, path_b), "t string, pair long, links long")
        sums = links.join(counted, "pair").groupBy("t").agg(
            F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("all_best"), F.sum(F.col("links") * F.col("docs")).alias("all_counts"))
        alike = texts.where("text != ''").groupBy(F.sha2("text", 256).alias("t")).agg(F.count(F.lit(1)).alias("rows"))
        shares = stage(sums.join(alike, "t").selectExpr("t", "all_best DIV rows AS n_best", "all_counts DIV rows AS count_sum"))
        rows = plain.join(shares, "t", "left").fillna(0, ["n_best", "count_sum"])
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
