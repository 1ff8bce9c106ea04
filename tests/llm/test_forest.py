import numpy as np
import pytest
from pyspark.sql import functions as F

from martlet.llm import forest, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, k=20):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], dtype=np.float32).astype(float)
    out = {}
    for q in ids[ids % 20 == 0]:
        s = x @ x[np.searchsorted(ids, q)]
        out[q] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def answers(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in got.items()}


def test_small_tables_are_answered_exactly(spark):
    rng = np.random.default_rng(1)
    vectors = {i: (rng.standard_normal(8) * (1 + i % 5)).tolist() for i in range(200)}
    for i in range(0, 200, 7):
        vectors[i] = vectors[0]          # one vector many times
    odd = [(1000, None, 1), (1020, [0.0] * 8, 1), (1040, [float("nan")] + [1.0] * 7, 1), (1060, [float("inf")] + [1.0] * 7, 1), (1080, [1.0, 2.0], 1),
           (1100, [None] + [1.0] * 7, 1), (None, [1.0] * 8, 1)]
    rows = [(i, v, 0) for i, v in vectors.items()] + [(3, vectors[3], 9)] + odd
    got = answers(forest.neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    expected = brute(vectors)
    assert set(got) == set(expected)
    for q, best in expected.items():
        assert [r for r, *_ in got[q]] == list(range(1, 21))
        assert [v for _, v, _ in got[q]] == [v for v, _ in best]
        assert np.allclose([s for *_, s in got[q]], [s for _, s in best], rtol=0, atol=1e-9)


def test_fewer_candidates_than_asked_and_none(spark):
    few = spark.createDataFrame([(20, [1.0, 0.0], 0), (21, [0.5, 0.5], 0), (22, [-1.0, 0.0], 0)], SCHEMA)
    assert [(v, s) for _, v, s in answers(forest.neighbours(few, F.col("vec_id") % 20 == 0))[20]] == [(21, 0.5), (22, -1.0)]
    assert forest.neighbours(few.filter("vec_id = 20"), F.col("vec_id") % 20 == 0).collect() == []
    assert forest.neighbours(few.limit(0), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("searched", [3000])
def test_recall_on_clustered_vectors_with_a_fixed_search(spark, searched):
    """Where vectors have structure, a fixed number of searched classes does; leaves are split over several tasks."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 24)) * 3
    vectors = {i: (centres[i % 60] + rng.standard_normal(24) * 0.5).tolist() for i in range(6000)}
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], SCHEMA)
    got = answers(forest.neighbours(df, F.col("vec_id") % 20 == 0, leaf=64, searched=searched, share=0.0, block=50))
    expected = brute(vectors)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in best}) for q, best in expected.items())
    assert hits / (20 * len(expected)) >= 0.9


def test_recall_on_the_given_embeddings(spark):
    folder = "/root/testdata/sf0.01"
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got, expected = answers(queries.op2_projection_forest(spark, folder)), brute(vectors)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in best}) for q, best in expected.items())
    assert hits / sum(map(len, expected.values())) >= 0.9


def test_a_fitted_forest_reaches_tasks_without_this_package(tmp_path):
    import subprocess
    import sys
    from pyspark import cloudpickle
    model = forest.fit(np.random.default_rng(0).normal(size=(200, 8)), 5.0, 3, 2, 1)
    (tmp_path / "model").write_bytes(cloudpickle.dumps(model))
    code = "import pickle, numpy as np; f = pickle.load(open('model', 'rb')); print(f.leaves(f.lengthened(np.ones((3, 8)), query=False), 0).shape)"
    done = subprocess.run([sys.executable, "-P", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True)
    assert done.stdout.strip() == "(3,)", done.stderr
