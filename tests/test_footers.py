import contextlib
import datetime as dt
import io

from shelfcast.sources.footers import (
    latest_in_files,
    newest_in_files,
    newest_plan,
    trailing_months_in_files,
)

DAYS = ["2025-01-31", "2025-03-31", "2025-04-30", "2025-04-30"]


def stored(spark, path, days=DAYS):
    rows = [(dt.date.fromisoformat(d) if d else None, i, d) for i, d in enumerate(days)]
    spark.createDataFrame(rows, "day date, n int, word string").repartition(3).write.parquet(path)
    return path


def test_newest_date_comes_from_the_footers(spark, tmp_path):
    path = stored(spark, str(tmp_path / "t"), [*DAYS, None])
    assert newest_in_files(spark, path, "day") == dt.date(2025, 4, 30)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        newest_plan(spark, path, "day").explain("formatted")
    assert "PushedAggregation: [MAX(day)]" in text.getvalue()
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


def test_text_is_read_by_column(spark, tmp_path):
    assert newest_in_files(spark, stored(spark, str(tmp_path / "t")), "word") == "2025-04-30"


def test_rows_of_the_latest_date_and_of_trailing_months(spark, tmp_path):
    path = stored(spark, str(tmp_path / "t"), [*DAYS, None])
    assert sorted(r.n for r in latest_in_files(spark, path, "day").collect()) == [2, 3]
    assert sorted(r.n for r in trailing_months_in_files(spark, path, 1, "day").collect()) == [1, 2, 3]


def test_nothing_but_nulls_or_no_rows(spark, tmp_path):
    for name, days in (("nulls", [None, None]), ("empty", [])):
        path = stored(spark, str(tmp_path / name), days)
        assert newest_in_files(spark, path, "day") is None
        assert latest_in_files(spark, path, "day").count() == 0
        assert trailing_months_in_files(spark, path, 3, "day").count() == 0
