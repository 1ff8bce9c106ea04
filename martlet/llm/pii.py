"""Personal data by weak supervision.

Four kinds are found by pattern (`BASE`) and always reported.  Other runs of
characters that hold a digit or an at sign, and overlap no such span, are candidates.
Labelers vote on each candidate: private, not private, or no opinion.  Expectation
maximisation over all candidates of the corpus estimates how reliable each labeler is
and how likely each pattern of votes is private; a logistic span classifier over the
shape of the candidate is trained on these probabilities.  It is compiled into a
column expression, and what it accepts is added to the spans.

Everything per text or candidate is an SQL function.  The driver sees one row per
pattern of votes and features, of which there are at most 3**4 * 2**8.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import stage

KINDS = ["email", "ip", "card", "phone"]
# Linear-time forms of the four patterns: a match starts where a run starts or where the last match ended, and never gives back.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}   # without it there is no match
GAP = r"\x20\x09-\x0D"
RUN = rf"(?<![^{GAP}])(?=[^{GAP}]{{7}})[^{GAP}0-9@]*+[0-9@][^{GAP}]*+"
EDGE = "\"'`.,;:!?()[]{}<>#$%&*|=~^"
BEFORE = 24   # characters before a candidate that labelers see

# Words before a private value, and before a number that is none.
PRIVATE_WORDS = ["account", "apikey", "auth", "bearer", "card", "contact", "fax", "iban", "key", "mobile", "passport", "passwd", "password", "phone",
                 "pwd", "secret", "ssn", "tel", "token", "whatsapp"]
PUBLIC_WORDS = ["chapter", "copyright", "doi", "equation", "figure", "isbn", "issn", "page", "pages", "rfc", "section", "table", "version", "volume", "year"]


def _holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: F.concat(F.lit("0"), F.substring(F.ltrim(p, F.lit("0")), 1, 4)).cast("int") <= 255
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _located(text: Column, pattern: str) -> Column:
    """The matches of a pattern, leftmost and not overlapping: start, end (code points, exclusive), text and what stands before."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(pieces.alias("piece"), matches.alias("match"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string,before:string>>")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        found = F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("text"), F.right(x["piece"], F.lit(BEFORE)).alias("before")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["match"].isNull(), done["out"]).otherwise(F.concat(done["out"], found)).alias("out"))

    spans = F.aggregate(parts, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), step, lambda done: done["out"])
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _base(text: Column) -> Column:
    """All base spans, by start and then kind: start, kind (its place in KINDS), end."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def of_kind(place: int, kind: str) -> Column:
        held = F.filter(_located(text, BASE[kind]), lambda s: _holds(kind, s["text"]))
        spans = F.transform(held, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("kind"), s["end"].alias("end")))
        return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(none) if kind in NEEDS else spans

    return F.array_sort(F.concat(*[of_kind(i, k) for i, k in enumerate(KINDS)]))


def _candidates(text: Column) -> Column:
    def trimmed(s: Column) -> Column:
        body = F.ltrim(s["text"], F.lit(EDGE))
        start = s["start"] + F.length(s["text"]) - F.length(body)
        kept = F.rtrim(body, F.lit(EDGE))
        return F.struct(start.alias("start"), (start + F.length(kept)).alias("end"), kept.alias("text"),
                        F.concat(s["before"], F.substring(s["text"], F.lit(1), F.length(s["text"]) - F.length(body))).alias("before"))

    return F.filter(F.transform(_located(text, RUN), trimmed), lambda s: F.length(s["text"]) >= 7)


def _features(text: Column, before: Column) -> dict[str, Column]:
    """What the classifier sees of a candidate, each true or false."""
    letters, digits = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit("[0-9]"))
    return {
        "key": (F.length(text) >= 20) & (letters > 0) & (digits > 3) & ~text.rlike("[^A-Za-z0-9_+=-]"),
        "long_number": digits.between(13, 19) & ~text.rlike("[^0-9-]"),
        "number": ~text.rlike("[^0-9.,-]"),
        "phone": text.rlike(r"^\(?[0-9]{3,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}$"),
        "address": text.rlike(r"^[^@]+@[^@]+$"),
        "assigned": before.rlike(r"[=:][\x20\"']*$"),
        "path": text.rlike("[/\\\\]"),
        "many_digits": digits * 2 > F.length(text),
    }


FEATURES = ["key", "long_number", "number", "phone", "address", "assigned", "path", "many_digits"]


def _votes(text: Column, before: Column) -> list[Column]:
    """1: private, -1: not, 0: no opinion; regex, gazetteer, context and spread."""
    f = _features(text, before)
    word = F.lower(F.regexp_extract(before, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    kinds = F.size(F.array_distinct(F.split(text, "")))
    said = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    return [
        said(f["key"] | f["long_number"] | f["phone"], (f["number"] & ~f["long_number"]) | text.rlike(r"^[0-9]{1,4}[-/.:][0-9]{1,2}[-/.:][0-9]{1,4}")),
        said(word.isin(PRIVATE_WORDS), word.isin(PUBLIC_WORDS)),
        said(f["assigned"] & ~f["path"], f["path"] | text.rlike("^[vV][0-9]")),
        said((F.length(text) >= 12) & (kinds >= 6), kinds < 4),
    ]


def reliabilities(patterns: dict[tuple[int, ...], float], rounds: int = 100, smooth: float = 1.0) -> tuple[float, list, dict[tuple[int, ...], float]]:
    """EM over vote patterns and their counts: the share of private ones, P(vote | class) of each labeler, P(private | pattern).

    Starts from the majority of the votes; a labeler's votes are independent given the
    class.  Smoothing keeps a labeler that never votes from deciding anything.
    """
    post = {p: min(0.9, max(0.1, 0.5 + 0.4 * sum(p) / max(1, sum(map(abs, p))))) for p in patterns}
    total, width = sum(patterns.values()), len(next(iter(patterns), ()))
    prior, tables = 0.5, []
    for _ in range(rounds):
        private = sum(n * post[p] for p, n in patterns.items())
        prior = (private + smooth) / (total + 2 * smooth)
        tables = []
        for i in range(width):
            of = {(v, y): smooth for v in (-1, 0, 1) for y in (0, 1)}
            for p, n in patterns.items():
                of[p[i], 1] += n * post[p]
                of[p[i], 0] += n * (1 - post[p])
            # A vote for private counts as such: no labeler is taken to vote against what it says.
            sums = {y: sum(of[v, y] for v in (-1, 0, 1)) for y in (0, 1)}
            odds = {v: math.log(of[v, 1] / sums[1]) - math.log(of[v, 0] / sums[0]) for v in (-1, 0, 1)}
            tables.append({-1: min(odds[-1], 0.0), 0: 0.0 if odds[-1] == 0 else odds[0], 1: max(odds[1], 0.0)})
        new = {p: 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(t[v] for t, v in zip(tables, p))))) for p in patterns}
        change = max((abs(new[p] - post[p]) for p in patterns), default=0.0)
        post = new
        if change < 1e-9:
            break
    return prior, tables, post


def logistic(rows: list[tuple[tuple[int, ...], float, float]], ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Intercept and weights by Newton's method; rows are (features, probability of one, count)."""
    x = np.array([[1.0, *f] for f, _, _ in rows])
    y, n = np.array([p for _, p, _ in rows]), np.array([c for _, _, c in rows])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def find_private(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of `docs`.

    spans lists kind:start:end (code points, end exclusive) by start, comma-joined: the
    base kinds, and the added kinds secret (letters and digits), number (digits) and
    handle (with an at sign).  Null text is empty text and has no spans.  Repeated rows
    are rows of their own.  An empty table gives no rows; without candidates nothing is
    added.  Of `docs`, doc_id and text are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", _base(text).alias("base"), _candidates(text).alias("seen"))
    free = F.filter("seen", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
    found = stage(found.select("doc_id", "base", free.alias("seen")))

    one = found.select(F.explode("seen").alias("c")).select("c.text", "c.before")
    votes, features = _votes(F.col("text"), F.col("before")), _features(F.col("text"), F.col("before"))
    coded = one.select(F.array(*votes).alias("votes"), F.array(*[features[f].cast("int") for f in FEATURES]).alias("features"))
    patterns = [(tuple(r["votes"]), tuple(r["features"]), r["n"]) for r in coded.groupBy("votes", "features").agg(F.count(F.lit(1)).alias("n")).collect()]
    if patterns:
        counts: dict[tuple[int, ...], float] = {}
        for v, _, n in sorted(patterns):
            counts[v] = counts.get(v, 0.0) + n
        post = reliabilities(counts)[2]
        w = logistic([(f, post[v], n) for v, f, n in sorted(patterns)])
        cut = math.log(threshold / (1 - threshold))

        def private(c: Column) -> Column:
            shape, z = _features(c["text"], c["before"]), F.lit(float(w[0]))
            for name, weight in zip(FEATURES, w[1:]):
                z = z + F.when(shape[name], F.lit(float(weight))).otherwise(F.lit(0.0))
            return z > cut

        accepted = F.filter("seen", private)
    else:
        accepted = F.filter("seen", lambda c: F.lit(False))

    kind_of = lambda c: F.when(F.contains(c["text"], F.lit("@")), len(KINDS) + 2).when(c["text"].rlike("[A-Za-z]"), len(KINDS)).otherwise(len(KINDS) + 1)
    added = F.transform(accepted, lambda c: F.struct(c["start"].alias("start"), kind_of(c).alias("kind"), c["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in [*KINDS, "secret", "number", "handle"]])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count_of = lambda i: F.size(F.filter("base", lambda b: b["kind"] == i)).cast("long")
    counted = [count_of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return (found.withColumn("added", added)
            .select("doc_id", *counted, F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                    said(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added")))
