"""CSV files that do not fit their declaration."""

import datetime as dt

import pytest

from loanward.sources.delimited import read_declared_csv
from loanward.sources.schemas import DeclaredColumn as D

DECLARED = [D("id", "BIGINT"), D("code", "VARCHAR(3)"), D("amount", "DECIMAL(10,2)"), D("day", "DATE"), D("gone", "INT")]
LINES = ["day,id,note,amount,code", "2024-01-02,1,x,10.5,abc", "2024-13-02,2,,n/a,abcd", "soon,3.7,y,,a",
         "2024-02-03,4,z,7,ab,extra,fields", "2024-02-04,5", ',6,"a,b", 8 ,"q""r"', "2024-03-01,99999999999999999999,w,1e3,"]


@pytest.fixture
def load(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join(LINES) + "\n")
    return read_declared_csv(spark, str(tmp_path), DECLARED)


def test_rows_are_typed_and_malformed_lines_are_marked(load):
    assert load.rows.dtypes == [("id", "bigint"), ("code", "string"), ("amount", "double"), ("day", "date"), ("gone", "int"),
                                ("_malformed", "string")]
    got = {r.id: r for r in load.rows.collect() if r._malformed is None and r.id}
    assert set(got) == {1, 2, 6}
    assert (got[1].amount, got[1].day, got[1].code, got[1].gone) == (10.5, dt.date(2024, 1, 2), "abc", None)
    assert (got[2].amount, got[2].day) == (None, None) and (got[6].amount, got[6].code) == (8.0, 'q"r')
    assert {r._malformed for r in load.rows.collect()} == {None, LINES[4], LINES[5]}


def test_malformed_lines_are_seen_whatever_is_asked_for(load):
    assert load.rows.filter("_malformed IS NOT NULL").select("id").count() == 2
    assert load.rows.filter("_malformed IS NULL").count() == 5


def test_faults_by_column(load):
    got = {r.column_name: (r.presence, r.filled, r.bad, r.too_long) for r in load.faults().collect()}
    assert got == {"*": ("PRESENT", 7, 2, 0), "id": ("PRESENT", 5, 2, 0), "code": ("PRESENT", 4, 0, 1), "amount": ("PRESENT", 4, 1, 0),
                   "day": ("PRESENT", 4, 2, 0), "gone": ("MISSING", 0, 0, 0), "note": ("EXTRA", 4, 0, 0)}


def test_files_without_rows_and_repeated_names(spark, tmp_path):
    (tmp_path / "none.csv").write_text("id,code\n")
    empty = read_declared_csv(spark, str(tmp_path / "none.csv"), DECLARED)
    assert empty.rows.count() == 0 and {r.filled for r in empty.faults().collect()} == {0}
    (tmp_path / "nothing.csv").write_text("")
    assert read_declared_csv(spark, str(tmp_path / "nothing.csv"), DECLARED).rows.count() == 0
    (tmp_path / "twice.csv").write_text("id,id\n1,2\n")
    with pytest.raises(ValueError, match="id"):
        read_declared_csv(spark, str(tmp_path / "twice.csv"), DECLARED)
