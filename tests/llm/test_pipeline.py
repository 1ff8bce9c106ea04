import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from martlet.llm import containment, linetree, mixing, queries, rules, simhash  # noqa: E402
from martlet.llm.common import stage  # noqa: E402
from martlet.llm.oracle import SQL  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_every_query_is_one_of_the_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14)) and set(SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    ran = con.execute(SQL[name])
    names = [c[0] for c in ran.description]
    key = lambda row: str(row)
    theirs = sorted([tuple(r[names.index(c)] for c in sorted(names)) for r in ran.fetchall()], key=key)
    ours = queries.QUERIES[name](spark, FOLDER)
    assert sorted(ours.columns) == sorted(names)
    assert sorted([tuple(r[c] for c in sorted(names)) for r in ours.collect()], key=key) == theirs


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumnRenamed("lang", "size")   # a name that clashes with the last stage's
    before = docs
    for name, work in corpus_pipeline.STAGES:
        after = stage(work(spark, before, FOLDER))
        ids = {r["doc_id"] for r in before.select("doc_id").collect()}
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert kept <= ids and after.count() == len(kept)
        if name != "mixing":
            assert after.dtypes == before.dtypes
        if name == "quality":
            scores = rules.score_quality(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            assert kept == {r["doc_id"] for r in scores.filter("predicted = 1").collect()}
        elif name == "lines":
            texts = {r["doc_id"]: r["text"] for r in linetree.drop_lines(before).collect()}
            assert {r["doc_id"]: r["text"] for r in after.collect()} == {i: t for i, t in texts.items() if i in kept}
            assert all(not texts[i].strip() for i in ids - kept)
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        elif name == "near_duplicates":
            assert kept == {r["component_id"] for r in simhash.near_duplicates(before).collect()}
        elif name == "benchmark":
            leaks = containment.contained_items(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
            assert kept == ids - {r["doc_id"] for r in leaks.collect()}
        else:
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
            assert {r["doc_id"]: r["copies"] for r in after.collect()} == {i: c for i, c in copies.items() if c}
        before = after


def test_odd_rows_pass(spark):
    """Nulls in any column, empty texts, repeated rows, extra columns, and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, taken string"
    body = "Of the rain that fell on the long road there was little left by the time the men came home to eat and sleep."
    rows = [(1, body, None, None, None, "x"), (1, body, None, None, None, "x"), (2, body, "en", "s", 5, None), (None, None, None, None, None, None),
            (3, "", "en", "s", 0, "x"), (4, "A wholly other text about ships and the sea, told by one who was there in the winter.", "en", "s", 9, "x")]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, work in corpus_pipeline.STAGES:
            out = stage(work(spark, docs, FOLDER))
            if name == "near_duplicates" and docs.count():
                ids = [r["doc_id"] for r in out.collect()]
                assert ids.count(1) == 1 and 2 not in ids and 4 in ids
            if name != "mixing":
                docs_next = out
                assert out.columns == docs.columns
                if name not in ("quality", "lines"):
                    docs = docs_next


def test_benchmark_and_mixing_decide_rows_without_id_or_with_a_repeated_one_each(spark, tmp_path):
    passage = " ".join(f"item{i}" for i in range(20))
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, f"clean words number {'abcdefgh'[i % 8] * (i + 1)} " + "and more " * (i % 7), "s" if i % 2 else None) for i in range(60)]
    clean += [(7, "one clean text of this id", "s"), (None, None, "s")]
    docs = spark.createDataFrame([*clean, (None, f"a {passage} b", "s"), (7, f"c {passage} d", None)], "doc_id long, text string, source string")
    left = stage(corpus_pipeline.benchmark(spark, docs, str(tmp_path)))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, left.collect())) == sorted(map(str, clean))

    out = corpus_pipeline.mix(spark, left, str(tmp_path)).collect()
    words = {c: 0 for c in ("s", None)}
    sizes = {(d, t, s): len((t or "").split()) for d, t, s in clean}
    totals = {s: sum(n for (_, _, of), n in sizes.items() if of == s) for s in words}
    for r in out:
        assert r["size"] == sizes[r["doc_id"], r["text"], r["source"]] and r["source_size"] == totals[r["source"]] and r["taken"] == r["size"] * r["copies"]
        words[r["source"]] += r["taken"]
    targets = {r["source"]: r["target"] for r in out}
    assert 0 < len(out) < len(clean) and all(abs(words[s] - targets[s]) <= max(sizes.values()) for s in words)


def test_near_duplicates_lose_no_text_under_a_repeated_id_and_rerun_alike(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(30)) for w in ("anna", "bert", "carl"))
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "w"), (2, a, "q"), (2, c, "z"), (None, b, "q"), (None, "no other one like it", "q"), (None, "no other one like it", "p"), (3, a, "q")]
    stays = [(1, a, "w"), (1, b, "x"), (2, c, "z"), (None, "no other one like it", "p")]
    for turn in (1, -1):
        docs = spark.createDataFrame(rows[::turn], "doc_id long, text string, source string")
        assert sorted(map(str, map(tuple, corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()))) == sorted(map(str, stays))
