import pytest

from tabloom.operators import cleaning as cl
from tabloom.operators import profile as pf


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        (i, f"user-{i:05d}", f"2024-01-{i % 28 + 1:02d}", "abcdefgh" if i % 2 else "hgfedcba", f"some good words {i}", 5.0, None, i % 7)
        for i in range(200)
    ]
    return spark.createDataFrame(
        rows, "k long, order_code string, day_date string, flag string, note string, same double, empty string, x int")


def test_profile_types(spark, mixed):
    got = {r["column"]: r for r in pf.profile(mixed, ["k"]).collect()}
    kinds = {c: r["dtype"] for c, r in got.items()}
    assert kinds == {
        "k": "numeric", "order_code": "categorical", "day_date": "datetime", "flag": "categorical",
        "note": "categorical", "same": "numeric", "empty": "numeric", "x": "numeric"}
    assert got["order_code"]["sample_values"] == [f"user-{i:05d}" for i in range(5)]
    assert got["empty"]["sample_values"] == [] and got["empty"]["unique"] == 0


def test_id_scores(spark, mixed):
    got = {r["column"]: r for r in cl.id_scores(mixed, ["k"]).collect()}
    assert got["k"]["is_id"] and got["order_code"]["is_id"]
    assert not got["note"]["is_id"] and got["note"]["text_like"]
    assert got["flag"]["is_id"]          # uniform length, plain, 8 long: known false positive
    assert got["day_date"]["is_id"]      # ISO dates look like identifiers
    assert not got["x"]["is_id"] and not got["empty"]["is_id"]


def test_decisions(spark, mixed):
    facts = [r.asDict() for r in cl.id_scores(mixed, ["k"]).collect()]
    dropped = cl.decide_drops(facts, {"flag"})
    assert dropped == {"k": "identifier", "order_code": "identifier", "same": "constant", "empty": "constant"}
    assert cl.datetime_columns(facts, dropped) == ["day_date"]


def test_clean_flags_dropped_primary_when_unprotected(spark, mixed):
    from tabloom.settings import Settings

    _, dropped, record = cl.clean(mixed, ["k"], "t", "flag", "x", "classification", cfg=Settings(protect_targets=False))
    assert dropped["flag"] == "identifier" and record["needs_review"]
    assert record["secondary"] == ["x"]


def test_collapse_at_the_edge(spark):
    fifty = spark.createDataFrame([(f"c{i:02d}",) for i in range(50)] * 2, "y string")
    assert cl.collapse_rare_classes(fifty, "y").select("y").distinct().count() == 50
    more = fifty.unionByName(spark.createDataFrame([("zz",)] * 3 + [(None,)], "y string"))
    got = {r["y"]: r["count"] for r in cl.collapse_rare_classes(more, "y").groupBy("y").count().collect()}
    # ties go to the smaller value
    assert got == {"zz": 3, **{f"c{i:02d}": 2 for i in range(9)}, "__OTHER__": 83}


def test_first_seen_codes(spark):
    rows = [(3, "b"), (1, "c"), (2, None), (5, "a"), (4, "c")]
    df = spark.createDataFrame(rows, "k int, y string").repartition(4)
    got = {r["k"]: r["y"] for r in cl.encode_first_seen(df, "y", ["k"]).collect()}
    assert got == {1: 0, 2: None, 3: 1, 4: 0, 5: 2}
    two = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (0, 9, "z"), (2, 0, "y")], "k int, turn int, y string")
    got = {(r["k"], r["turn"]): r["y"] for r in cl.encode_first_seen(two, "y", ["k", "turn"]).collect()}
    assert got == {(0, 9): 0, (1, 1): 1, (1, 2): 2, (2, 0): 1}


def test_epoch_units(spark):
    df = spark.createDataFrame([(1704067200,), (1704153600,), (None,)] + [(1704067200,)] * 60, "at long")
    fixed = cl.repair_numeric_datetime(df, {"at": "s"})
    assert dict(fixed.dtypes)["at"] == "timestamp_ntz"
    assert str(fixed.first()["at"]) == "2024-01-01 00:00:00"
    assert dict(cl.repair_numeric_datetime(df.limit(3), {"at": "s"}).dtypes)["at"] == "bigint"


def test_target_validation():
    assert cl.validate_targets(["a", "b", "c", "d"], "a", ["b", "c", "d"], "regression") == ["b", "c"]
    for bad in (("z", [], "regression"), ("a", ["a"], "regression"), ("a", [], "ranking"), ("a", ["q"], "classification")):
        with pytest.raises(ValueError):
            cl.validate_targets(["a", "b"], *bad)


def test_single_day_time_column_goes(spark):
    df = spark.createDataFrame([(f"2024-01-01 0{i % 9}:00:00", f"2024-01-0{i % 9 + 1}", i) for i in range(20)],
                               "load_time string, ship_date string, x int")
    assert dict(cl.normalize_datetimes(df).dtypes) == {"ship_date": "timestamp_ntz", "x": "int"}


def test_flags_are_numbers(spark):
    from tabloom.operators import features as ft

    df = spark.createDataFrame([(True, "x"), (False, "y"), (None, "x")], "b boolean, s string")
    assert {r["column"]: r["dtype"] for r in pf.profile(df).collect()} == {"b": "numeric", "s": "categorical"}
    assert ft.classify(df) == {"b": "numeric", "s": "categorical"}
    assert sorted(r[0] for r in ft.median_fill(df, ["b"]).select("b").collect()) == [0.0, 0.5, 1.0]


def test_first_values_beyond_the_head(spark, monkeypatch):
    """Columns that are null at the beginning, and keys that repeat at the border of the first rows."""
    from tabloom.operators import profile as pf

    rows = [(i // 3, None if i < 90 else f"v{i:03d}", f"w{(97 * i) % 100:02d}") for i in range(100)]
    df = spark.createDataFrame(rows, "k int, late string, w string").repartition(4)
    want = {r["column"]: r["sample_values"] for r in pf.first_values(df, ["k"]).collect()}
    monkeypatch.setattr(pf, "HEAD_ROWS", 7)
    assert {r["column"]: r["sample_values"] for r in pf.first_values(df, ["k"]).collect()} == want
    assert want["late"] == ["v090", "v091", "v092", "v093", "v094"]


def test_codes_with_a_string_row_key(spark):
    df = spark.createDataFrame([(f"r{i:03d}", f"t{(i * 7) % 40}" if i % 5 else None) for i in range(300)], "key string, y string").repartition(5)
    got = {r["key"]: r["y"] for r in cl.encode_first_seen(df, "y", ["key"]).collect()}
    codes = {}
    for i in range(300):
        if i % 5:
            codes.setdefault(f"t{(i * 7) % 40}", len(codes))
    assert got == {f"r{i:03d}": codes[f"t{(i * 7) % 40}"] if i % 5 else None for i in range(300)}
