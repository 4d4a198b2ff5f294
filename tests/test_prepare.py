import pytest
from pyspark.sql import functions as F

from panelweave import (
    apply_corrections,
    blank_to_null,
    cast_failures,
    cast_measures,
    delete_by_key,
    derive_ratio,
    distinct_values,
    drop_materialized,
    materialize,
    missing_audit,
    missing_by_group,
    read_raw,
    rename_columns,
    write_panel,
)


def test_read_raw_csv_and_back(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('k,a b,v\n1,,2.50\n2,"",x\n3, ,0\n')
    raw = read_raw(spark, str(path), ["k", "a b", "v"])
    assert {t for _, t in raw.dtypes} == {"string"}
    # A space is a value; both spellings of empty are missing.
    assert missing_audit(raw).first().asDict() == {"k": 0, "a b": 2, "v": 0}
    write_panel(rename_columns(raw, {"a b": "a"}), str(tmp_path / "out"), partition_by=["k"])
    back = read_raw(spark, str(tmp_path / "out"), ["v", "k"], fmt="parquet")
    assert sorted(tuple(r) for r in back.collect()) == [("0", "3"), ("2.50", "1"), ("x", "2")]
    with pytest.raises(ValueError):
        read_raw(spark, str(path))


def test_rename_frees_a_name(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rename_columns(df, {"a": "b", "b": "c"}).columns == ["b", "c"]
    with pytest.raises(ValueError):
        rename_columns(df, {"z": "y"})


def test_blank_cast_and_losses(spark):
    df = spark.createDataFrame([("",), (None,), ("0",), (" ",), ("100.5",), ("83.456",)], "v string")
    assert missing_audit(df).first().v == 2
    types = {"v": "decimal(4,2)", "extra": "double"}
    cast = cast_measures(blank_to_null(df, ["v"]), types).collect()
    assert [None if r.v is None else float(r.v) for r in cast] == [None, None, 0, None, None, 83.46]
    assert all(r.extra is None for r in cast)
    assert cast_failures(df, {"v": "decimal(4,2)"}).first().v == 2  # the space and 100.5
    assert blank_to_null(df, ["v"], trim=True).filter("v IS NULL").count() == 3


def test_zero_is_data_unless_asked(spark):
    df = spark.createDataFrame([(0.0,), (None,), (1.0,)], "v double")
    assert missing_audit(df).first().v == 1
    assert missing_audit(df, zero_is_missing=True).first().v == 2
    assert blank_to_null(df, ["v"]).filter("v IS NULL").count() == 1
    assert blank_to_null(df, ["v"], zero_is_missing=True).filter("v IS NULL").count() == 2


def test_missing_by_group_and_categories(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None), ("b", None)], "e string, v double")
    assert [tuple(r) for r in missing_by_group(df, "e", "v").collect()] == [
        ("b", 1),
        ("c", 1),
        ("a", 0),
    ]
    assert {tuple(r) for r in distinct_values(df, "e").collect()} == {("a", 1), ("b", 2), ("c", 1)}


def test_apply_corrections(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, "x"), (3, 5.0, "y")], "k int, v double, s string")
    fixes = spark.createDataFrame([(1, 9.0, 2.0), (2, 8.0, 0.0)], "k int, v double, top double")
    always = apply_corrections(df, fixes, "k", {"v": "fix_v", "s": F.lit("z")})
    assert sorted(tuple(r) for r in always.collect()) == [(1, 9.0, "z"), (2, 8.0, "z"), (3, 5.0, "y")]
    gaps = apply_corrections(df, fixes, "k", {"v": "fix_v"}, only_null=True)
    assert sorted(tuple(r)[:2] for r in gaps.collect()) == [(1, 1.0), (2, 8.0), (3, 5.0)]
    low = apply_corrections(df, fixes, "k", {"v": "fix_v"}, when="v < fix_top")
    assert {r.k: r.v for r in low.collect()} == {1: 9.0, 2: None, 3: 5.0}


def test_repeated_fix_fails(spark):
    df = spark.createDataFrame([(1, 1.0)], "k int, v double")
    with pytest.raises(Exception, match="not unique"):
        apply_corrections(df, df.union(df), "k", {"v": "fix_v"}).collect()


def test_delete_by_key(spark):
    df = spark.range(5)
    assert delete_by_key(df, df.filter("id % 2 = 0"), "id").count() == 2


def test_ratio(spark):
    df = spark.createDataFrame([(50.0, 1000.0), (100.0, 50.0), (1.0, 0.0)], "n double, d double")
    rows = derive_ratio(df, "n", "d", "r").collect()
    assert [r.r for r in rows] == [5.0, 200.0, None]
    assert [r.r_overflow for r in rows] == [False, True, None]


def test_materialized_snapshot(spark):
    for persist in (False, True):
        kept = materialize(spark.range(3), "snap", persist)
        assert spark.sql("SELECT count(*) FROM snap").first()[0] == kept.count() == 3
        drop_materialized(spark, "snap", "never_there")
        assert not spark.catalog.tableExists("snap")
