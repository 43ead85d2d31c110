import pytest
from pyspark.sql import functions as F

from tabloom.operators import profile as pf
from tabloom.plans import queries_profile as qp
from tabloom.sources import csv, store

MESSY = 'a,b,a\n1,é,3\n2,x\n3,x,y,\n4,x,y,z\n"5\n5",NA,"q""z,w"\n6,,n/a\n'


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_messy_csv(spark, tmp_path, encoding):
    path = tmp_path / "messy.csv"
    path.write_bytes(MESSY.encode(encoding))
    df = csv.read_csv(spark, str(path))
    assert df.columns == ["a", "b", "a.1"]
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted([("1", "é", "3"), ("2", "x", None), ("5\n5", None, 'q"z,w'), ("6", None, None)], key=repr) or \
        set(got) == {("1", "é", "3"), ("2", "x", None), ("5\n5", None, 'q"z,w'), ("6", None, None)}


def test_type_inference(spark):
    df = spark.createDataFrame(
        [("1", "1", None, "True", "x", "1.5"), ("2", None, None, "False", "2", "1d")],
        "i string, f string, empty string, b string, s string, j string")
    typed = csv.infer_types(df)
    assert [t for _, t in typed.dtypes] == ["bigint", "double", "double", "boolean", "string", "string"]


def test_stages_follow_what_they_are_made_from(spark, tmp_path):
    """A stage is reused if its name, settings and all stages before it are the same, and only then."""
    folder, made = store.ResultStore(spark, str(tmp_path / "r")), []

    def run(source, size, rule):
        def first():
            made.append("first")
            return spark.range(size), {"n": size}

        def second():
            made.append("second")
            return a.table.where(rule)

        a = folder.stage("first", first, [source], size)
        b = folder.stage("second", second, [a], rule)
        c = folder.stage("third", lambda: (None, {"rule": rule}), [b])
        got, made[:] = list(made), []
        return got, b.table.count(), a.records, c.records, (a.reused, b.reused, c.reused)

    assert run("x", 3, "id > 0") == (["first", "second"], 2, {"n": 3}, {"rule": "id > 0"}, (False, False, False))
    assert run("x", 3, "id > 0") == ([], 2, {"n": 3}, {"rule": "id > 0"}, (True, True, True))
    assert run("x", 3, "id > 1") == (["second"], 1, {"n": 3}, {"rule": "id > 1"}, (True, False, False))
    assert run("y", 3, "id > 0")[0] == ["first", "second"]
    assert run("x", 3, "id > 0")[0] == []


def test_a_stage_without_manifest_is_made_again(spark, tmp_path):
    folder = store.ResultStore(spark, str(tmp_path / "r"))
    with pytest.raises(ZeroDivisionError):
        folder.stage("s", lambda: spark.range(1 // 0))
    assert not folder.stage("s", lambda: spark.range(2)).reused
    assert folder.stage("s", lambda: spark.range(9)).table.count() == 2


def test_digests_of_inputs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "a int, `b.c` string")
    same = store.table_digest(df.repartition(3)) == store.table_digest(df.orderBy("a"))
    others = [df.limit(2), df.withColumnRenamed("a", "z"), df.union(df), df.where("a = 1"), df.limit(0)]
    assert same and store.table_digest(df) not in {store.table_digest(x) for x in others}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("a\n1\n")
    first = store.files_digest(spark, str(tmp_path / "in"))
    assert store.files_digest(spark, str(tmp_path / "in")) == first
    (tmp_path / "in" / "2.csv").write_text("a\n1\n")
    assert store.files_digest(spark, str(tmp_path / "in")) != first


def test_type_states_add_up(spark):
    """Types of parts and of all of them; a part that lacks a column counts as missing cells."""
    parts = [
        spark.createDataFrame([("1", "1", "true", "1")], "a string, b string, c string, d string"),
        spark.createDataFrame([("2", "1.5", "false"), ("3", "x", "true")], "a string, b string, c string"),
    ]
    states = parts[0].withColumn("p", F.lit("x")), parts[1].withColumn("p", F.lit("y"))
    states = csv.type_states(states[0], "p").unionByName(csv.type_states(states[1], "p"))
    got = {(r["part"], r["column"]): r["type"] for r in states.select("part", "column", csv.type_rule().alias("type")).collect()}
    assert got[("x", "b")] == "long" and got[("y", "b")] == "string" and got[("y", "c")] == "boolean"
    whole = {r["column"]: r["type"] for r in csv.merged_states(states).select("column", csv.type_rule().alias("type")).collect()}
    assert whole == {"a": "long", "b": "string", "c": "boolean", "d": "double"}
    union = {r["column"]: r["type"] for r in csv.column_types(parts[0].unionByName(parts[1], allowMissingColumns=True)).collect()}
    assert whole == union


def test_corpus_round_trip(spark, tmp_path):
    tables = {"sales": spark.createDataFrame([(1, "x")], "price int, customer string"), "none": spark.createDataFrame([], "a int")}
    store.write_corpus(pf.title_corpus(tables), str(tmp_path / "c"))
    rows = store.read_corpus(spark, str(tmp_path / "c")).collect()
    assert len(rows) == 1
    assert rows[0]["csv_data_summary"].startswith("Columns: price, customer. Rows: 1. Contains numeric")


def test_csv_export_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"q'), (None, "x")], "a string, b string")
    csv.write_csv(df.coalesce(1), str(tmp_path / "out"))
    assert {tuple(r) for r in csv.read_csv(spark, str(tmp_path / "out")).collect()} == {("a,b", 'q"q'), (None, "x")}


def test_domain_keeps_rule_order(spark):
    df = spark.createDataFrame([("mental health student",), ("a roadmap",), ("nothing here",), ("MENTAL",), (None,)], "t string")
    got = [r["domain"] for r in pf.with_domain(df, "t").collect()]
    assert got == ["Education", "Marketing", "General", "Mental Health", "General"]
    titles = [r["title"] for r in pf.with_title(pf.with_domain(df, "t").select(F.col("domain"))).collect()]
    # "Mental Health" meets the earlier rule for "health"
    assert titles[3].startswith("Hospital Patient Record")


def test_csv_can_be_counted_and_takes_long_fields(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text('a,b\n1,2\n3,"' + "x," * 25_000 + '",5\n6,"' + 'y""' * 25_000 + '"\n')
    df = csv.read_csv(spark, str(path))
    assert df.count() == 2
    assert sorted((r["a"], len(r["b"])) for r in df.collect()) == [("1", 1), ("6", 50_000)]


def test_csv_files_with_other_headers(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "f" / "2.csv").write_text("b,a\n4,3\n")
    (tmp_path / "f" / "3.csv").write_text("c,a\n6,5\n")
    rows = {tuple(r) for r in csv.read_csv(spark, str(tmp_path / "f")).select("a", "b", "c").collect()}
    assert rows == {("1", "2", None), ("3", "4", None), ("5", None, "6")}


def test_kinds_of_files_are_found_without_sorting_lines(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "1.csv").write_text('a,b\n1,"2\n"\n')
    (tmp_path / "f" / "2.csv").write_bytes("a,b\né,4\n".encode("latin-1"))
    (tmp_path / "f" / "3.csv").write_text("b,a\n4,3\n")
    found = csv._kinds(spark, str(tmp_path / "f"))
    assert "Sort" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r["file"][-5]: r for r in found.collect()}
    assert [(rows[f]["valid"], rows[f]["wrapped"]) for f in "123"] == [(True, True), (False, False), (True, False)]
    assert rows["1"]["header"] == rows["2"]["header"] != rows["3"]["header"]


def test_messy_files_grow_in_number_and_lines_are_made_last(spark, tmp_path):
    """Rows for which the shuffle partitions alone would make too few files, and one of each kind of line."""
    n = 16_384
    rows = spark.range(n).selectExpr(
        "id AS c_custkey", "concat('c', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey",
        "element_at(array('MACHINERY', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD', 'FURNITURE'), CAST(IF(id < 5, id, 3 + id % 3 % 2) + 1 AS INT)) AS c_mktsegment")
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = qp.csv_tolerant_read(spark, str(tmp_path))
        assert len(got.inputFiles()) == 8  # two headers
        cells = {r["c_custkey"]: tuple(r)[1:] for r in got.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(cells) == n - 2 and not {"1", "2"} & set(cells)
    assert cells["0"] == ("c0", None, None) and cells["3"] == ("c3", "HOUSEHOLD", None)
    assert cells["4"] == ('Doe, "c4"\né', "FURNITURE", "4") and cells["7"] == ('Doe, "c7"\né', "FURNITURE", "7")
    plan = qp.messy_lines(rows, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS value" in plan and "AS value" not in plan[plan.index("Sort ["):]
