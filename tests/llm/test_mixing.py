from martlet.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def rows(spark, given):
    return [r.asDict() for r in mixing.mix(spark.createDataFrame(given, SCHEMA)).collect()]


def test_targets_stop_at_three_times_and_the_excess_is_shared(spark):
    """Weights 1, 2, 3, 1 over sources of 10, 10, 1000 and 5 words (null last); the second stops at 30, the last at 15."""
    given = ([(i, "w", "a", "x") for i in range(10)] + [(i, "w", "b", None) for i in range(100, 110)]
             + [(i, "w w w w w", "c", None) for i in range(200, 400)] + [(500, "w w w w w", None, None)])
    got = {r["source"]: r for r in rows(spark, given)}
    total, stops, weight = 1025.0, {"a": 30.0, "b": 30.0, "c": 3000.0, None: 15.0}, {"a": 1, "b": 2, "c": 3, None: 1}
    target = {}
    while True:
        open_ = [s for s in stops if s not in target]
        share = (total - sum(target.values())) / sum(weight[s] for s in open_)
        above = [s for s in open_ if share * weight[s] > stops[s]]
        if not above:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: stops[s] for s in above}
    assert {s: round(r["target"], 9) for s, r in got.items()} == {s: round(v, 9) for s, v in target.items()}


def test_words_taken_come_near_the_target_and_reruns_agree(spark):
    given = [(i, "word " * (i % 37 + 1), f"s{min(i % 7, 3)}", None) for i in range(3000)]
    first, again = rows(spark, given), rows(spark, list(reversed(given)))
    key = lambda r: r["doc_id"]
    assert sorted(first, key=key) == sorted(again, key=key)
    for s in {r["source"] for r in first}:
        own = [r for r in first if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 37
        assert sum(r["size"] for r in own) == own[0]["source_size"]
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in first)


def test_nulls_repeats_and_empty(spark):
    got = rows(spark, [(1, None, None, "x"), (None, "a b", None, "x"), (2, "", "s", "x"), (3, "a b c", "s", "x"), (3, "a b c", "s", "x")])
    assert len(got) == 5 and {r["size"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert rows(spark, []) == []
    assert [r["target"] for r in rows(spark, [(1, None, "a", None)])] == [0.0]
