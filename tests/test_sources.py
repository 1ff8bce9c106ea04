import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from conftest import rows_of
from martlet.operators import quality
from martlet.plans.session import shared_folder
from martlet.sources import readers, writers
from martlet.sources.schemas import RAW

HEADERS = {name: ",".join(schema.names) for name, schema in RAW.items()}


def write(folder, name, *lines):
    (folder / f"{name}.csv").write_text("\n".join([HEADERS[name], *lines]) + "\n")


@pytest.fixture
def files(tmp_path):
    write(tmp_path, "customers", "1, Ann ,30,Pune,South,2024-01-01,", "2,Bob,40,Pune,North,not-a-date,", "1,Late,30,Pune,South,2024-01-01,")
    write(tmp_path, "products", "1,pen,Office,Ink,1.00,2.50")
    write(tmp_path, "orders", "a,1,1,2024-02-01,1,2.50,1.00,0.00,1.50,South,Card,2,Returned",
          "b,2,1,2024-02-01,1,2.50,1.00,0.00,1.50,South,Card,2,Returned", "c,1,1,2024-03-01,2,,1.00,0.10,1.50,South,,2,Returned")
    return str(tmp_path)


def test_csv_keeps_types_and_place_of_ingest(spark, files):
    tables = readers.read_star(spark, files)
    assert dict(tables["orders"].dtypes)["revenue"] == "decimal(12,2)"
    assert dict(tables["customers"].dtypes)["signup_date"] == "string"
    audit = quality.audit_customers(tables["customers"], __import__("datetime").date(2026, 1, 1))
    assert rows_of(audit.cleaned(), "customer_id", "name") == [(1, "Ann")]  # the first of the two in file order
    missing = quality.missing_counts(tables["orders"], RAW["orders"].names)
    assert dict(rows_of(missing)) == {"revenue": 1, "payment_method": 1}


def test_load_twice_adds_nothing(spark, files, tmp_path):
    from datetime import date
    tables = readers.read_star(spark, files)
    star = quality.audit_star(tables["customers"], tables["products"], tables["orders"], date(2026, 1, 1))
    target = str(tmp_path / "store")
    clean = {a.table: a.cleaned() for a in star}
    expected = {"customers": 1, "products": 1, "orders": 2}
    for _ in range(2):
        assert rows_of(writers.append_cleaned(spark, clean, target)) == [(name, n, 0) for name, n in expected.items()]
    stored = readers.read_cleaned(spark, target, "orders")
    assert sorted(r.order_id for r in stored.collect()) == ["a", "c"]
    assert list((tmp_path / "store" / "orders").glob("batch=*/order_month=2024-03-01"))
    pruned = readers.read_stored(spark, target, "orders").where("order_month = DATE '2024-03-01'")
    assert "PartitionFilters: [isnotnull(order_month" in pruned._jdf.queryExecution().executedPlan().toString()


def test_quality_outputs_come_from_the_stored_audit(spark, files, tmp_path):
    from datetime import date
    tables = readers.read_star(spark, files)
    star = quality.audit_star(tables["customers"], tables["products"], tables["orders"], date(2026, 1, 1))
    out = writers.write_quality_outputs(spark, star, str(tmp_path / "out"))
    assert out["rejected/products"].count() == 0  # written with its schema although empty
    assert {r.row: r.reasons for r in out["rejected/orders"].select(F.col("order_id").alias("row"), "reasons").collect()} == {
        "b": ["orphan_customer"]}
    assert {(r.table_name, r.quality_score_pct) for r in out["quality_report"].collect()} == {
        ("customers", 33.33), ("products", 100.0), ("orders", 66.67)}
    direct = {tuple(r) for r in quality.transformation_log(star).collect()}
    assert {tuple(r) for r in out["transformation_log"].collect()} == direct


def test_judged_rows_are_counted_while_they_are_written(spark, files, tmp_path):
    from datetime import date
    raw = readers.read_star(spark, files)
    for name, tables in (("given", raw), ("empty", {n: df.where("false") for n, df in raw.items()})):
        direct = quality.audit_star(tables["customers"], tables["products"], tables["orders"], date(2026, 1, 1))
        judged = writers.judge(direct, str(tmp_path / name))
        for one, other in zip(judged, direct):
            assert one.counts().first().asDict() == other.counts().first().asDict()
            assert "Scan parquet" not in one.counts()._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, one.rows.collect())) == sorted(map(str, other.rows.collect()))
        plan = judged.orders.cleaned()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_conflicting_keys_stay_out_of_the_store(spark, files, tmp_path):
    from datetime import date
    tables = readers.read_star(spark, files)
    star = quality.audit_star(tables["customers"], tables["products"], tables["orders"], date(2026, 1, 1))
    target = str(tmp_path / "store")
    clean = {a.table: a.cleaned() for a in star}
    row = clean["orders"].where("order_id = 'a'")
    twice = clean["orders"].unionByName(row).unionByName(row.withColumns({"order_id": F.lit("z")})).unionByName(
        row.withColumns({"order_id": F.lit("z"), "quantity": F.lit(9)}))
    got = {r.table_name: (r.stored_rows, r.conflicts) for r in writers.append_cleaned(spark, clean | {"orders": twice}, target).collect()}
    assert got == {"customers": (1, 0), "products": (1, 0), "orders": (2, 1)}
    changed = clean["orders"].withColumn("quantity", F.col("quantity") + 1).where("order_id = 'c'")
    got = {r.table_name: (r.stored_rows, r.conflicts) for r in writers.append_cleaned(spark, clean | {"orders": changed}, target).collect()}
    assert got["orders"] == (2, 1)
    assert sorted((r.row_key, r.kind) for r in writers.conflicts(spark, target).collect()) == [("c", "differs_from_store"), ("z", "differs_in_batch")]


def test_load_report_of_repeated_and_changed_batches(spark, files, tmp_path):
    from datetime import date
    from pathlib import Path
    from martlet.plans import batch
    out = str(tmp_path / "loaded")

    def loaded():
        rows = batch.load(spark, files, out, date(2026, 1, 1), quality.VALID_REGIONS).collect()
        return {r.table_name: (r.expected, r.actual, r.status, r.orphans, r.total_revenue) for r in rows}

    first = loaded()
    assert first["orders"][:4] == (2, 2, "OK", 0) and float(first["orders"][4]) == 2.5 and first["customers"] == (1, 1, "OK", None, None)
    assert loaded() == first
    orders = Path(files) / "orders.csv"
    orders.write_text(orders.read_text().replace("a,1,1,2024-02-01,1,", "a,1,1,2024-02-01,7,"))
    assert loaded()["orders"][:3] == (2, 1, "MISMATCH")


def test_csv_as_people_write_it(spark, files, tmp_path):
    """Reordered columns, doubled quotes, line breaks in quotes, text in number columns, padded text."""
    from pathlib import Path
    folder = Path(files)
    (folder / "customers.csv").write_text(
        "city,customer_id,name,region,signup_date,age,extra\n"
        'Paris,1,"Ann ""A"" B, C",South,2024-01-01,30,x\n'
        '"Two\nlines",2,Bob,South,2024-01-01,33.0,x\n'
        "Pune,3,  Cid ,South,2024-01-01,abc,x\n")
    customers = readers.read_star(spark, files)["customers"]
    got = {r.customer_id: (r.name, r.city, r.age, r.customer_segment, r.unreadable) for r in customers.collect()}
    assert got == {1: ('Ann "A" B, C', "Paris", 30, None, []), 2: ("Bob", "Two\nlines", 33, None, []), 3: ("  Cid ", "Pune", None, None, ["age"])}
    audit = quality.audit_customers(customers, __import__("datetime").date(2026, 1, 1))
    assert rows_of(audit.rejected(), "customer_id", "reasons") == [(3, ["unreadable_value"])]
    assert ("*", "flag_unreadable_value", 1) in rows_of(audit.log(), "column_name", "action", "rows_affected")
    back = str(tmp_path / "back")
    writers.write_csv_star({"customers": customers.drop("seq", "unreadable"), "products": readers.read_star(spark, files)["products"].drop("seq", "unreadable"),
                            "orders": readers.read_star(spark, files)["orders"].drop("seq", "unreadable")}, back)
    names = RAW["customers"].names
    assert sorted(rows_of(readers.read_star(spark, back)["customers"], *names), key=str) == sorted(rows_of(customers, *names), key=str)


def test_missing_table_and_foreign_files(spark, tmp_path):
    with pytest.raises(AnalysisException):
        readers.read_cleaned(spark, str(tmp_path), "orders")
    with pytest.raises(ValueError):
        readers.read_cleaned(spark, str(tmp_path), "secrets")
    with pytest.raises(ValueError):
        readers.profile_upload(spark, "orders.xlsx")


def test_profile_and_preview(spark, files):
    profile = {r.column_name: (r.data_type, r.missing, r.rows) for r in readers.profile_upload(spark, f"{files}/orders.csv").collect()}
    assert profile["revenue"] == ("double", 1, 3) and profile["quantity"] == ("int", 0, 3)
    assert readers.preview_upload(spark, f"{files}/orders.csv", 2).count() == 2


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, **settings):
        self.sparkContext, self.conf = Context(master), settings


def test_shared_folder_is_the_one_the_session_names():
    named = Session("yarn", **{"spark.checkpoint.dir": "hdfs://place/x/"})
    assert shared_folder(named) == "hdfs://place/x"
    with pytest.raises(RuntimeError):
        shared_folder(Session("yarn"))
    local = Session("local[2]")
    assert shared_folder(local) == shared_folder(local)


AWKWARD = ["plain", "a,b", 'say ""hi""', "two\nlines", "crlf\r\ninside", "\n\n", '""', "", " padded ", "é日本", "x" * 50, '"",""\n', "end\r"]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("block", [150, 1 << 20])
def test_split_reading_equals_one_task(spark, tmp_path, ending, block):
    """Records cut at every place by small blocks: quotes, breaks and empty lines as one task reads them."""
    import random
    from martlet.sources.records import read_split
    random.seed(block)
    (tmp_path / "in.csv").mkdir()
    for part in range(2):
        rows = ["id,text,more"]
        for i in range(40):
            values = [random.choice(AWKWARD) for _ in range(2)]
            rows.append(",".join([str(part * 100 + i), *[f'"{v}"' if any(c in v for c in ',"\n\r') else v for v in values]]))
            rows += [""] * random.choice([0, 0, 0, 1])
        (tmp_path / "in.csv" / f"part-{part}.csv").write_bytes(ending.join(rows).encode() + (ending.encode() if part else b""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    expected = sorted(map(tuple, spark.read.options(**readers.CSV, multiLine="true").csv(f"{tmp_path}/in.csv").collect()), key=str)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        split = read_split(spark, f"{tmp_path}/in.csv", readers.CSV)
        rows = split.collect()
        assert sorted([(r.id, r.text, r.more) for r in rows], key=str) == expected and len(expected) == 80
        ordered = sorted(rows, key=lambda r: (r.seq.file, r.seq.block, r.seq.row))
        assert [int(r.id) for r in ordered] == sorted(int(r.id) for r in rows)   # places of ingest follow the files
        if block < 1 << 20:
            assert len({(r.seq.file, r.seq.block) for r in rows}) > 9                # many blocks hold beginnings
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    from martlet.sources.records import read_split
    text = "id,text\n" + "".join(f'{i},"line {i}\nbreak"\n' for i in range(60_000))
    (tmp_path / "big.csv").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        split = read_split(spark, f"{tmp_path}/big.csv", readers.CSV)
        assert spark.read.option("lineSep", "\n").text(f"{tmp_path}/big.csv").rdd.getNumPartitions() > 15
        got = split.agg(F.count("*"), F.sum("id"), F.count_if(F.col("text") == F.concat(F.lit("line "), "id", F.lit("\nbreak")))).first()
        assert tuple(got) == (60_000, 60_000 * 59_999 // 2, 60_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_without_breaks_in_quotes_nothing_is_shuffled(spark, files):
    plan = readers.read_star(spark, files)["orders"]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_a_header_with_other_names_is_an_error(spark, tmp_path):
    from martlet.sources.records import read_split
    (tmp_path / "in.csv").mkdir()
    (tmp_path / "in.csv" / "a.csv").write_text("id,text\n1,x\n")
    (tmp_path / "in.csv" / "b.csv").write_text("text,id\ny,2\n")
    with pytest.raises(Exception, match="header is not"):
        read_split(spark, f"{tmp_path}/in.csv", readers.CSV).collect()


def test_types_of_uploaded_columns(spark, tmp_path):
    (tmp_path / "up.csv").write_text("a,b,c,d,e,f,g\n1,5000000000,1.5,2024-01-02,true,,x\n,2,3,2024-02-03,FALSE,,1\n")
    got = {r.column_name: (r.data_type, r.missing, r.rows) for r in readers.profile_upload(spark, f"{tmp_path}/up.csv").collect()}
    assert got == {"a": ("int", 1, 2), "b": ("bigint", 0, 2), "c": ("double", 0, 2), "d": ("date", 0, 2), "e": ("boolean", 0, 2), "f": ("string", 2, 2), "g": ("string", 0, 2)}


def _shop_batch(shop, first, n):
    """Customers and products 1 to 3, and orders numbered from `first` on."""
    return {"customers": shop.customers((1,), (2,), (3,)), "products": shop.products((1, "pen", "Office"), (2, "cup", "Home"), (3, "hat", "Wear")),
            "orders": shop.sales(*[{"order_id": f"{first + i:06d}", "customer_id": 1 + i % 3, "product_id": 1 + i % 3, "order_date": f"2024-0{1 + i % 3}-01"} for i in range(n)])}


def test_a_batch_stopped_between_two_tables_is_stored_in_whole_by_the_next_run(spark, shop, tmp_path, monkeypatch):
    target = str(tmp_path / "store")
    writers.append_cleaned(spark, _shop_batch(shop, 0, 10), target)
    real, calls = writers.stage, []

    def stopped(df, path):
        calls.append(path)
        if path.endswith("/orders/decided"):
            raise RuntimeError("stopped")
        return real(df, path)

    monkeypatch.setattr(writers, "stage", stopped)
    later = _shop_batch(shop, 100, 10) | {"customers": shop.customers((1,), (4,))}
    with pytest.raises(RuntimeError, match="stopped"):
        writers.append_cleaned(spark, later, target)
    # Its customers are written, yet nobody sees them.
    assert len(list((tmp_path / "store" / "customers").glob("batch=*"))) == 2
    assert readers.read_cleaned(spark, target, "customers").count() == 3 and readers.read_cleaned(spark, target, "orders").count() == 10
    monkeypatch.setattr(writers, "stage", real)
    for _ in range(2):
        got = {r.table_name: (r.stored_rows, r.conflicts) for r in writers.append_cleaned(spark, later, target).collect()}
        assert got == {"customers": (4, 0), "products": (3, 0), "orders": (20, 0)}
    assert readers.read_cleaned(spark, target, "customers").select("customer_id").distinct().count() == 4


def test_a_batch_reads_only_keys_it_may_meet(spark, shop, tmp_path):
    target = str(tmp_path / "store")
    for first in (0, 10_000, 20_000):
        writers.append_cleaned(spark, _shop_batch(shop, first, 300), target)
    held = writers.stored_keys(spark, target, "orders", "010000", "010299")
    rows = held.collect()
    assert {r.row_key for r in rows} == {f"{10_000 + i:06d}" for i in range(300)}
    plan = held._jdf.queryExecution().executedPlan()
    assert "GreaterThanOrEqual(row_key,010000)" in plan.toString() and "revenue" not in plan.toString()
    scan = plan
    while scan.children().size():
        scan = scan.children().apply(0)
    # Of 900 stored keys the files of the other batches give no row.
    assert scan.metrics().get("numOutputRows").get().value() <= 300


def test_types_are_judged_as_by_plain_casts(spark):
    """Only texts that look like a number are cast to one; the verdict is that of casting every text."""
    texts = ["", "1", "-5", "+5", "1.0", "1.", ".5", ".", "12 ", " 12", "12\n", "12\x7f", "5\x85", "5\u2028", "1e5", "1d", "1.5D", "nan", "-Infinity", "+inf",
             "0x1p3", "999999999", "9999999999", "99999999999999999999", "1996-01-02", "1996-13-40", "1996-01-02 10:11", "TRUE", "yes", "1-URGENT", "٠١"]
    looks = {"date": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "timestamp": r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[T ][0-9:.]+", "boolean": r"(?i)^(true|false)$"}
    text = F.col("text")
    plainly = sum((F.when((F.when(text.rlike(looks[k]), text) if k in looks else text).try_cast(k).isNull(), 1 << i).otherwise(0)
                   for i, k in enumerate(readers.TYPES)), F.lit(0))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.select("text", readers._unread(text).alias("n"), plainly.alias("o")).where("n != o").collect() == []
    assert spark.sql("SELECT CAST(NULL AS STRING) AS text").select(readers._unread(text)).first()[0] is None


def test_records_without_quotes_are_cut_and_not_parsed(spark, tmp_path):
    from martlet.sources import records
    with open(tmp_path / "in.csv", "w", newline="") as f:
        f.write('a,b,c\n1,,x y\n , \t,\n"q,1",2,3\n4,5\n6,7,8,9\n"a\nb","say ""x""",\n,,\n')
    split = records.read_split(spark, f"{tmp_path}/in.csv", readers.CSV)
    whole = spark.read.options(**readers.CSV, multiLine="true").csv(f"{tmp_path}/in.csv")
    assert sorted(rows_of(split, "a", "b", "c"), key=str) == sorted(rows_of(whole), key=str)
    assert "split(" in split._jdf.queryExecution().optimizedPlan().toString()
