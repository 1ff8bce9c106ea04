"""Best-fit packing by patterns: documents into sequences of a fixed number of tokens.

1. Every text is encoded once; ids beyond the capacity are cut into pieces.  What goes
   on is one narrow row per piece.
2. The pieces are counted by length: a histogram of at most `capacity` numbers, whatever
   the number of documents.  This alone goes to the driver.
3. Patterns are the choices of up to three lengths that fill a sequence to the last
   token.  Non-negative least squares fits how often each is used to the histogram;
   the repeats are rounded down to what is there.
4. What is left of the histogram goes by best fit, longest first: each length into the
   sequences with the least room that takes it, else into new ones.  Sequences alike
   are handled as one with a number of repeats, so this too is work on the histogram.
5. The plan gives each length its slots, numbered from 0.  Pieces of a length are
   numbered in Spark by running counts over buckets, and the number finds the slot.

Numbers of a length are dealt over `buckets` that grow with the table, so a third of
all pieces may have one length; rows alike in all columns are one row with a count.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlet.llm.alignment import byte_of_char
from martlet.llm.common import kept_in_worker, ship, stage

ship(__name__)

CAPACITY = 2048
BUCKET = 20_000     # pieces numbered by one window, about
BLOCK = 1_000       # copies of one row written out at a time
KEPT = 250_000      # words a Python worker remembers at most
SOME = 1_000_000    # characters encoded at once
ROUNDS = 20         # of the fit at most
BLANK = re.compile(r"[\x20\x09-\x0D]+")
# White space in Python alone, or beyond ASCII: texts with these are cut at ASCII white space only.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Characters on whose class, lower case and normal form all versions of Unicode agree.
USUAL = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u024f]+")
# Fixed value: how the tokenizer splits a text, and the same over usual characters for Python.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼½¾]+|[\\d²³¹¼½¾]|(?:[^\\s\\w]|_)+")
MARK = b"\xff"       # stands for the end of a word; no byte of UTF-8


def fast_encoder(tokenizer):
    """Function from the bytes of a word's part and MARK to ids, where the tokenizer is a byte-level BPE with word ends as expected; else None."""
    import tiktoken

    told = json.loads(tokenizer.to_str())
    model, names = told["model"], tokenizer.get_vocab(with_added_tokens=False)
    steps = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
    first = ((told["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    merged = ["".join(pair if isinstance(pair, list) else pair.split(" ")) for pair in model.get("merges", [])]
    if (steps != ["NFC", "Replace", "Lowercase"] or first.get("pattern") != {"Regex": SPLIT} or model.get("end_of_word_suffix") != "</w>"
            or any(names.get(name) != 512 + i for i, name in enumerate(merged))):
        return None
    chars, ranks = byte_of_char(), {}
    for name, i in names.items():
        ends = name.endswith("</w>")
        ranks[bytes(chars[c] for c in (name[:-4] if ends else name)) + (MARK if ends else b"")] = i
    return tiktoken.Encoding("words", pat_str=r"[^\x{10FFFF}]*", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Words(dict):
    """Number of a word (text between white space), and the ids of the words numbered.

    The tokenizer drops white space, so that a text's ids are those of its words.
    Words of usual letters are read by a faster library from the same vocabulary.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = fast_encoder(self.tokenizer)
        self.forget()

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.unread.append(word)
        return number

    def forget(self) -> None:
        self.clear()
        self.unread: list[str] = []
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def read(self, words: list[str]) -> list[list[int]]:
        usual = [self.fast is not None and bool(USUAL.fullmatch(w)) and "<|" not in w for w in words]
        slow = iter(self.tokenizer.encode_batch_fast([w for w, u in zip(words, usual) if not u], add_special_tokens=False))
        return [[i for part in PARTS.findall(w.lower()) for i in self.fast(part.encode() + MARK)] if u else next(slow).ids for w, u in zip(words, usual)]

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, and how many each has."""
        cut = [BLANK.split(text) if ODD.search(text) else text.split() for text in texts]
        sizes = np.array([len(words) for words in cut], np.int64)
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        if self.unread:
            read = self.read(self.unread)
            self.ids = np.concatenate([self.ids, np.array(list(chain.from_iterable(read)), "<u4")])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(ids) for ids in read])])
            self.unread = []
        n = self.ends[numbers + 1] - self.ends[numbers]
        to = np.cumsum(n)
        found = self.ids[np.repeat(self.ends[numbers] - to + n, n) + np.arange(int(to[-1]) if to.size else 0)]
        if len(self) > KEPT:
            self.forget()
        return found, np.diff(np.append(0, to)[np.cumsum(sizes)], prepend=0)


def some_at_once(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, about SOME characters together; null as empty."""
    some, size = [], 0
    for text in texts:
        some.append(text or "")
        size += len(some[-1])
        if size > SOME:
            yield some
            some, size = [], 0
    if some:
        yield some


def _pieces_of(path: str, capacity: int, end: int):
    """One row per piece of a document: its place, length and the CRC-32 of its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = kept_in_worker("words", (path, KEPT), lambda: Words(path)), np.array([end], "<u4")
        for batch in batches:
            rows, starts, lengths, crcs, row = [], [], [], [], 0
            for some in some_at_once(batch.column("text").to_pylist()):
                ids, sizes = words.ids_of(some)
                begin = 0
                for size in sizes.tolist():
                    own = np.append(ids[begin:begin + size], last).tobytes()
                    for start in range(0, size + 1, capacity):
                        length = min(capacity, size + 1 - start)
                        rows.append(row), starts.append(start), lengths.append(length), crcs.append(zlib.crc32(own[4 * start:4 * (start + length)]))
                    begin, row = begin + size, row + 1
            start = np.array(starts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array((start // capacity).astype(np.int32)), pa.array(start),
                 pa.array(np.array(lengths, np.int64)), pa.array(np.array(crcs, np.int64))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Choices of two or three of the lengths that add up to the capacity, ascending in a row; pairs begin with 0."""
    there = np.zeros(capacity + 1, bool)
    there[0] = there[lengths] = True
    small = np.concatenate([[0], lengths])
    i, j = np.meshgrid(small, lengths, indexing="ij")
    i, j = i[i <= j], j[i <= j]
    k = capacity - i - j
    fits = (k >= j) & there[np.maximum(k, 0)]
    return np.stack([i[fits], j[fits], k[fits]], axis=1)


def solve(chosen: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weighted least squares: repeats of the chosen patterns, of either sign."""
    n = len(chosen)
    length, column = chosen.ravel(), np.repeat(np.arange(n), 3)
    order = np.argsort(length, kind="stable")
    length, column = length[order], column[order]
    # Patterns that share a length meet in the normal equations: all pairs within each run of one length.
    begin, end = np.searchsorted(length, length), np.searchsorted(length, length, "right")
    first = np.repeat(np.arange(length.size), end - begin)
    second = np.arange(first.size) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + begin[first]
    gram = np.bincount(column[first] * n + column[second], weight[length[first]] ** 2, n * n).reshape(n, n)
    gram[np.diag_indices(n)] += 1e-6
    return np.linalg.solve(gram, np.bincount(column, weight[length] ** 2 * counts[length], n))


def fit(found: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares by an active set: rows of `found` in use and their repeats, so that their lengths add up to `counts`.

    Each round takes in the patterns whose lengths lack most, a few per length, and
    solves the normal equations of the patterns in use; those that come out negative
    leave.  Short lengths weigh less, as what is left of them is easily placed.
    """
    size = counts.size
    weight = 0.05 + np.arange(size) / size
    weight[0] = 0.0
    used = np.empty(0, np.int64)
    times = np.empty(0)
    rest, best, stalled = counts * weight, np.inf, 0
    parts = found.T
    scale = np.sqrt((weight[parts] ** 2).sum(axis=0))
    for _ in range(rounds):
        gain = (weight[parts] * rest[parts]).sum(axis=0) / scale
        gain[used] = -1.0
        taken, new = np.zeros(size, np.int64), []
        order = np.argsort(-gain, kind="stable")[:20 * size]
        for at in order[gain[order] > 1e-9 * max(1.0, counts.max())].tolist():
            lengths = found[at][found[at] > 0]
            if (taken[lengths] < 1).all():
                taken[lengths] += 1
                new.append(at)
        if not new:
            break
        used = np.concatenate([used, np.array(new, np.int64)])
        while used.size:
            times = solve(found[used], weight, counts)
            if (times > 0).all():
                break
            used = used[times > 0]
        if not used.size:
            break
        rest = (counts - np.bincount(found[used].ravel(), np.repeat(times, 3), size)) * weight
        error = float(np.abs(rest).sum())
        stalled = 0 if error < 0.98 * best else stalled + 1
        best = min(best, error)
        if stalled > 2 or error < 1e-3 * float((counts * weight).sum()):
            break
    return found[used], times if used.size else np.empty(0)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repeats, [(length, how many)]) of the sequences that hold counts[n] pieces of each length n."""
    left = counts.astype(np.int64).copy()
    made: list[tuple[int, list[tuple[int, int]]]] = []
    if left[capacity]:
        made.append((int(left[capacity]), [(capacity, 1)]))
        left[capacity] = 0
    lengths = np.flatnonzero(left)
    found = patterns(lengths, capacity) if lengths.size else np.empty((0, 3), np.int64)
    if len(found):
        chosen, times = fit(found, left[:capacity].astype(float))
        for at in np.argsort(-times, kind="stable").tolist():
            parts = [int(n) for n in chosen[at] if n]
            need = {n: parts.count(n) for n in parts}
            repeats = min(int(times[at] + 1e-6), *(int(left[n]) // m for n, m in need.items()))
            if repeats > 0:
                made.append((repeats, sorted(need.items(), reverse=True)))
                for n, m in need.items():
                    left[n] -= repeats * m
    return made + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Longest pieces first, each into the sequence with the least room that takes it, else into a new one."""
    rooms: list[int] = []                                                # ascending
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}      # room -> (repeats, contents)
    made: list[tuple[int, list[tuple[int, int]]]] = []

    def put(room: int, repeats: int, held: list[tuple[int, int]]) -> None:
        if room == 0:
            made.append((repeats, held))
        else:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((repeats, held))

    for length in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[length])
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                repeats, held = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, repeats, held = capacity, todo, []
            each = min(room // length, todo)
            full = min(repeats, todo // each)
            if repeats > full and held:
                put(room, repeats - full, held)
            put(room - each * length, full, [*held, (length, each)])
            todo -= full * each
    return made + [x for room in rooms for x in open_[room]]


def slots(made: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Per length where its slots begin (capacity + 2 places), and rows of slots: first number, first sequence, offset, pieces per sequence."""
    rows: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
    numbered, sequence = [0] * (capacity + 1), 0
    for repeats, held in made:
        offset = 0
        for length, each in held:
            rows[length].append((numbered[length], sequence, offset, each))
            numbered[length] += repeats * each
            offset += length * each
        sequence += repeats
    begins = np.cumsum([0, *map(len, rows)])
    return begins, np.array([r for per in rows for r in per] or np.empty((0, 4)), np.int64).reshape(-1, 4)


def _placed(planned):
    """sequence_id and offset of numbered pieces."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, rows = planned.value
        length_of = np.repeat(np.arange(begins.size - 1), np.diff(begins))
        most = int(rows[:, 0].max(initial=0)) + 1
        for batch in batches:
            length, number = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "number"))
            at = np.empty(length.size, np.int64)
            for n in np.unique(length):       # at most as many lengths as the capacity
                own = length == n
                at[own] = begins[n] + np.searchsorted(rows[begins[n]:begins[n + 1], 0], number[own], "right") - 1
            first, sequence, offset, each = rows[at].T
            turn, place_in = np.divmod(number - first, each)
            columns = {c: batch.column(c) for c in batch.schema.names if c != "number"}
            yield pa.RecordBatch.from_pydict(columns | {"sequence_id": pa.array(sequence + turn), "offset": pa.array(offset + place_in * length)})

    return place


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A document is its text's ids and the id `end`; null and empty texts are that id
    alone.  Only documents longer than `capacity` are cut.  Rows that repeat an id or
    all columns are documents each; null ids are kept; an empty table gives no rows.
    Texts of any length are read whole.  Columns other than doc_id and text are not
    looked at.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut = docs.select("doc_id", "text").mapInArrow(_pieces_of(path, capacity, end), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")
    alike = stage(cut.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")))
    histogram = alike.groupBy("length").agg(F.sum("copies").alias("n")).collect()   # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    planned = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity), capacity))

    buckets = max(1, int(counts.max()) // BUCKET)
    dealt = alike.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    per_bucket = dealt.groupBy("length", "bucket").agg(F.sum("copies").alias("n"))
    # The window over buckets of a length sees one row per bucket.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    bases = per_bucket.select("length", "bucket", before.alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy(*columns)
    ahead = dealt.withColumn("ahead", F.sum("copies").over(own) - F.col("copies"))
    first = ahead.join(bases, ["length", "bucket"]).select(*columns, "copies", (F.col("base") + F.col("ahead")).alias("first"))
    # Copies of one row take consecutive numbers, written out block by block.
    blocks = first.select(*columns, "copies", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) DIV {BLOCK}"))).alias("block"))
    if alike.where(F.col("copies") > BLOCK).limit(1).count():
        blocks = blocks.repartition(F.col("first"), F.col("block"))
    numbers = F.sequence(F.col("first") + F.col("block") * BLOCK, F.col("first") + F.least(F.col("copies"), (F.col("block") + 1) * BLOCK) - 1)
    numbered = blocks.select(*columns, F.explode(numbers).alias("number"))
    return numbered.mapInArrow(_placed(planned), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
