"""Lines that do not fit are set aside, counted and bounded; all others are read."""

import pytest

from panelweave import read_raw, read_with_quarantine


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def raw(tmp_path):
    (tmp_path / "raw").mkdir()
    return tmp_path / "raw"


def test_bad_lines_are_set_aside_with_their_files(spark, raw, tmp_path):
    path = write(raw, one="a,b\n1,2\n3,4,5\n", two="a,b\n6\n\n7,\n")
    read = read_with_quarantine(spark, path, ["a", "b"], str(tmp_path / "q"), 2)
    assert read.columns == ["a", "b"] and rows(read) == [("1", "2"), ("7", None)] and read.count() == 2
    aside = spark.read.parquet(str(tmp_path / "q"))
    assert aside.columns == ["file", "line"]
    assert sorted((r.file.rsplit("/")[-1], r.line) for r in aside.collect()) == [("one.csv", "3,4,5"), ("two.csv", "6")]


def test_more_than_allowed_fails_after_they_are_stored(spark, raw, tmp_path):
    path = write(raw, one="a,b\n1,2\n3,4,5\n6\n")
    with pytest.raises(ValueError, match="2 bad lines, 1 are allowed"):
        read_with_quarantine(spark, path, ["a", "b"], str(tmp_path / "q"), 1)
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2


def test_without_bad_lines_it_reads_as_read_raw(spark, raw, tmp_path):
    path = write(raw, one='a,b\n1,"x, y"\n1,"x, y"\n,\u00e9 z\n')
    read = read_with_quarantine(spark, path, ["a", "b"], str(tmp_path / "q"), 0)
    plain = read_raw(spark, path, ["a", "b"])
    assert read.schema == plain.schema and read.exceptAll(plain).isEmpty() and plain.exceptAll(read).isEmpty()
    assert spark.read.parquet(str(tmp_path / "q")).count() == 0


def test_empty_files_clashing_names_and_no_header(spark, raw, tmp_path):
    path = write(raw, one="_file,_bad_line\n")
    assert read_with_quarantine(spark, path, ["_file", "_bad_line"], str(tmp_path / "q"), 0).count() == 0
    path = write(raw, one="1,2\n3\n")
    read = read_with_quarantine(spark, path, ["__File", "is_bad"], str(tmp_path / "r"), 1, header=False)
    assert rows(read) == [("1", "2")]


def test_other_names_in_the_header_are_an_error(spark, raw, tmp_path):
    path = write(raw, one="a,c\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_with_quarantine(spark, path, ["a", "b"], str(tmp_path / "q"), 9)


def test_orc_is_read_as_text(spark, tmp_path):
    stored = spark.createDataFrame([(1, 2.5, None), (None, 0.1, True)], "k long, v double, f boolean")
    stored.write.orc(str(tmp_path / "o"))
    read = read_raw(spark, str(tmp_path / "o"), ["v", "f", "k"], fmt="orc")
    assert read.dtypes == [("v", "string"), ("f", "string"), ("k", "string")]
    assert sorted(map(str, read.collect())) == ["Row(v='0.1', f='true', k=None)", "Row(v='2.5', f=None, k='1')"]
    assert read_raw(spark, str(tmp_path / "o"), fmt="orc").columns == ["k", "v", "f"]
