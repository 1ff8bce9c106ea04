from martlet.llm import linetree


def cleaned(spark, given, **more):
    df = spark.createDataFrame([(*g, "x") for g in given], "doc_id long, text string, pos string")
    return sorted(((r["doc_id"], r["text"], r["__lines"], r["__dropped"]) for r in linetree.drop_lines(df, **more).collect()), key=str)


def test_variable_fields_are_generalised_and_one_document_keeps_the_line(spark):
    line = "Posted by {} in the archive of the town at {}"
    names = ["anna", "bert", "carl", "dora", "emil"]
    given = [(i, f"own words of number {'abcde'[i]} here\n" + line.format(n, 1900 + i)) for i, n in enumerate(names)]
    assert [(t.count("\n"), d) for _, t, _, d in cleaned(spark, given)] == [(1, 0), (0, 1), (0, 1), (0, 1), (0, 1)]


def test_prose_with_a_common_beginning_stays(spark):
    given = [(i, f"In the end {w} came {w}x with {w}y over {w}z hills") for i, w in enumerate(["ab", "cd", "ef", "gh", "ij", "kl"])]
    assert all(d == 0 for *_, d in cleaned(spark, given))


def test_nulls_blanks_repeats_and_empty(spark):
    given = [(1, None), (2, ""), (3, "\n\n"), (4, "same old line\nz"), (4, "same old line\nz"), (5, "same  old line \ny"), (6, "same old line"), (None, "same old line\nx")]
    assert cleaned(spark, given) == sorted([(1, None, 0, 0), (2, "", 1, 0), (3, "\n\n", 3, 0), (4, "same old line\nz", 2, 0), (4, "same old line\nz", 2, 0),
                                            (5, "y", 2, 1), (6, "", 1, 1), (None, "x", 2, 1)], key=str)
    assert cleaned(spark, []) == []
    # Two documents are too few; lines that only rows without id share stay.
    assert all(d == 0 for *_, d in cleaned(spark, [(1, "a b c d"), (2, "a b c d")]))
    assert all(d == 0 for *_, d in cleaned(spark, [(None, f"a b c d\n{i}q{i}") for i in "klm"]))


def test_a_line_of_very_many_documents(spark):
    given = [(i, f"the shared line of all\n{'abcdefghij'[i % 10] * (i // 10 + 1)} alone") for i in range(300)]
    got = cleaned(spark, given)
    assert sum(d for *_, d in got) == 299
