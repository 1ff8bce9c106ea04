from pyspark.sql import functions as F

from martlet.llm import queries, rules, toxicity
from martlet.llm.common import held_out

FOLDER = "/root/testdata/sf0.01"


def accuracy(spark, scored, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select(F.col("doc_id").alias("d"), label)
    both = scored.filter("held_out").join(labels, F.col("doc_id") == F.col("d")).collect()
    right = sum(r["predicted"] == r[label] for r in both)
    return right / len(both), len(both)


def test_quality_on_the_held_out_fold(spark):
    scored = queries.op9_rule_ensemble(spark, FOLDER)
    share, n = accuracy(spark, scored, "quality")
    assert n > 50 and share >= 0.95
    assert scored.count() == 1000 and scored.filter("score < 0 OR score > 1 OR score IS NULL OR predicted <> cast(score >= 0.3 as int)").isEmpty()


def test_toxicity_on_the_held_out_fold(spark):
    scored = queries.op7_toxic_lexicon(spark, FOLDER)
    share, n = accuracy(spark, scored, "toxic")
    assert n > 50 and share >= 0.95
    assert scored.count() == 1000 and scored.filter("score < 0 OR score > 1 OR score IS NULL OR predicted <> cast(score >= 0.5 as int)").isEmpty()


def test_folding_exceptions_and_word_bounds():
    found = toxicity._automaton({"idiot": 3.0, "loser": 2.0, "trash": 1.0, "scum": 1.0, "vequ*": 2.0}, toxicity.EXCEPTIONS)
    total = lambda text: toxicity.weigh(text, found)[0]
    assert total("You 1D10T!") == total("ид idіоt") == total("ＩＤＩＯＴ") == total("i​diot") == total("idi0t###") == 3.0
    assert total("l0$er") == 2.0 and total("idiotic widiot") == 0.0 and total("vequais, Vequé avequ") == 4.0
    assert total("put it in the trash can") == 0.0 and total("trash can and trash") == 1.0 and total("pond  scum") == 0.0
    assert total("") == 0.0 and toxicity.weigh("idiot", toxicity._automaton({}, [])) == (0.0, 0.0)
    assert toxicity.weigh("idiot scum", found) == (4.0, 3.0)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    """Turning every held-out label round changes no score."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumns({c: F.when(held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for score in (rules.score_quality, toxicity.score_toxicity):
        a, b = ({r["doc_id"]: round(r["score"], 9) for r in score(docs, x).collect()} for x in (labels, turned))
        assert a == b


def test_no_labels_one_class_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "you idiot", "x"), (2, "you idiot", "x"), (3, "ok", "x")], "doc_id long, text string, label string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 1) for i in range(9)] + [(None, 0, 0), (1, None, None)], none.schema)
    for labels in (none, one):
        assert all(0 < r["score"] < 1 for r in rules.score_quality(docs, labels).collect())
        by_id = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, labels).collect()}
        assert by_id == {1: 0, None: 0, 2: 1, 3: 0}
    assert rules.score_quality(docs.limit(0), one).collect() == [] == toxicity.score_toxicity(docs.limit(0), one).collect()


def test_rules_say_what_their_columns_say(spark):
    rule = rules.Rule((("bars", True, 0.1), ("distinct", False, 0.5)))
    assert rule.text() == "bars <= 0.1 and distinct > 0.5"
    stats = rules.with_statistics(spark.createDataFrame([(1, "a b c d"), (2, "a a a a"), (3, "a | b |"), (4, None)], "doc_id long, text string"))
    assert {r["doc_id"] for r in stats.filter(rule.column()).collect()} == {1}


def test_statistics_are_computed_once_per_document(spark):
    """The quality stage filters on the score above the statistics, not with a copy of them for each term."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    kept = rules.keep_good(docs, labels)
    spark.conf.set("spark.sql.debug.maxToStringFields", "5000")
    try:
        assert kept._jdf.queryExecution().executedPlan().toString().count("array_distinct") == 1
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rules.score_quality(docs, labels).filter("predicted = 1").collect()}
