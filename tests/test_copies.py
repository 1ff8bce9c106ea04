"""Later copies, also when a third of all rows are copies of one."""

import pytest
from pyspark.sql import functions as F

from martlet.functions.copies import mark_later_copies


def brute_force(rows, key, first):
    seen, out = set(), {}
    for row in sorted(rows, key=first):
        out[row[0]] = key(row) in seen
        seen.add(key(row))
    return out


@pytest.mark.parametrize("lanes", [1, 3, 4096])
def test_hot_group_and_nulls(spark, lanes):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}", None if i % 7 == 0 else i % 2, 600 - i) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, a string, b int, seq int")
    marked = mark_later_copies(df, ["a", "b"], ["seq", "id"], "copy", lanes)
    assert marked.columns == ["id", "a", "b", "seq", "copy"]
    assert {r.id: r.copy for r in marked.collect()} == brute_force(rows, lambda r: r[1:3], lambda r: (r[3], r[0]))


def test_no_lane_holds_the_hot_group(spark):
    """Before the final comparison the hot group is spread over many window partitions."""
    df = spark.range(3000).selectExpr("id", "id DIV 3000 AS a")
    marked = mark_later_copies(df, ["a"], ["id"], "copy", 64)
    assert marked.where("NOT copy").count() == 1
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" in plan and "__lane" in plan and "__contender" in plan


def test_stored_rows_are_sieved_first(spark, tmp_path):
    """Only rows whose content may come again meet the windows; the flags are those of all rows."""
    from martlet.functions.copies import mark_later_copies_stored
    from martlet.sources.writers import stage
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 500}", None if i % 7 == 0 else i % 2, 600 - i) for i in range(600)]
    kept = []

    def keep(df, what):
        kept.append(what)
        return stage(df, str(tmp_path / what))

    df = keep(spark.createDataFrame(rows, "id int, a string, b int, seq int"), "rows")
    marked = mark_later_copies_stored(df, ["a", "b"], ["seq", "id"], "copy", keep)
    assert {r.id: r.copy for r in marked.collect()} == brute_force(rows, lambda r: r[1:3], lambda r: (r[3], r[0]))
    contents = [r[1:3] for r in rows]
    assert spark.read.parquet(str(tmp_path / "repeated")).count() == sum(contents.count(c) > 1 for c in set(contents))
    single = keep(df.dropDuplicates(["a", "b"]), "single")
    assert mark_later_copies_stored(single, ["a", "b"], ["seq", "id"], "copy", lambda d, w: stage(d, str(tmp_path / f"s_{w}"))).where("copy").count() == 0


def test_members_of_a_bitmap(spark):
    from martlet.functions.bits import cells_of, mark_members
    numbers = [-32769, -32768, -1, 0, 7, 8, 32767, 32768, 2**40 + 5]
    asked = sorted({n + d for n in numbers for d in (-1, 0, 1)} | set(numbers))
    df = spark.createDataFrame([(n,) for n in asked] + [(None,)], "n bigint")
    cells = cells_of(spark.createDataFrame([(n,) for n in numbers] + [(None,)], "n bigint"), F.col("n"))
    got = {r.n: r.found for r in mark_members(df, df["n"], cells, "found").collect()}
    assert got == {**{n: n in numbers for n in asked}, None: False}
