"""Exports from an embedded database: bound parameters, ranges of dates, sessions, universes."""

import datetime as dt
import uuid

import pytest

from tesspan.sources import export

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"
ROWS = [
    ("600519.SH", dt.date(2024, 1, d), 1.0 * d, 0.0, 5.0, False, "it's") for d in range(1, 11)
] + [("600001.SH", dt.date(2024, 1, 3), 1.0, 0.0, 5.0, True, "b"), ("60000x.SH", dt.date(2024, 1, 3), 1.0, 0.0, 5.0, False, "b"), ("830799.BJ", dt.date(2024, 1, 4), 1.0, 0.0, 5.0, None, "c"), ("002594.SZ", dt.date(2024, 2, 1), 1.0, 0.0, 5.0, None, "d")]
TEXT = "SELECT ts_code, trade_date, \"CLOSE\", pct_chg, vol, is_st FROM Q WHERE trade_date >= :start_date"


@pytest.fixture(scope="module")
def url(spark):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    at = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    df = spark.createDataFrame(ROWS, "TS_CODE string, TRADE_DATE date, CLOSE double, PCT_CHG double, VOL double, IS_ST boolean, NAME string")
    df.write.format("jdbc").option("url", at).option("dbtable", "Q").option("driver", DRIVER).option("createTableColumnTypes", "TS_CODE VARCHAR(16), NAME VARCHAR(64)").save()
    spark.createDataFrame([(0,)], "N int").write.format("jdbc").option("url", at).option("dbtable", "SESSIONS").option("driver", DRIVER).save()
    return at


def codes(df):
    return sorted({r.ts_code for r in df.collect()})


def test_universes_and_ranges(spark, url):
    get = lambda universe, parts=4, **more: export.export_panel(spark, url, TEXT, dt.date(2024, 1, 1), dt.date(2024, 1, 31), universe, parts=parts, driver=DRIVER, **more)
    assert codes(get("main_board_non_st")) == ["600519.SH"]
    assert codes(get("main_board")) == ["600001.SH", "600519.SH"]
    assert codes(get("exclude_bse")) == ["600001.SH", "60000x.SH", "600519.SH"]
    assert codes(get("all")) == ["600001.SH", "60000x.SH", "600519.SH", "830799.BJ"]
    for parts in (1, 4, 31, 400):
        df = get("main_board_non_st", parts)
        assert df.rdd.getNumPartitions() == min(parts, 31) and sorted(r.trade_date.day for r in df.collect()) == list(range(1, 11))
    per = [n for n in get("main_board_non_st", 31).rdd.glom().map(len).collect()]
    assert per == [1] * 10 + [0] * 21  # a part for each day
    with pytest.raises(ValueError):
        get("moon")


def test_every_session_begins_with_the_statement(spark, url):
    count = lambda: spark.read.format("jdbc").option("url", url).option("query", "SELECT COUNT(*) AS C FROM SESSIONS").option("driver", DRIVER).load().first()[0]
    before = count()
    df = export.export_panel(spark, url, TEXT, dt.date(2024, 1, 1), dt.date(2024, 1, 31), "all", parts=5, driver=DRIVER, read_only="INSERT INTO SESSIONS VALUES (1)")
    assert df.count() == 13 and count() >= before + 5
    assert export.READ_ONLY["jdbc:postgresql:"].endswith("READ ONLY")


def test_parameters(spark, url):
    text = "SELECT ts_code, trade_date, \"CLOSE\", pct_chg, vol FROM Q WHERE name = :name AND '::name :x' <> :name -- it's :nothing\n AND vol IN :vols /* :no */"
    df = export.export_panel(spark, url, text, dt.date(2024, 1, 1), dt.date(2024, 12, 31), "all", {"name": "it's", "vols": [5.0, 6]}, driver=DRIVER)
    assert df.count() == 10
    evil = {"name": "x' OR '1' = '1", "vols": [5.0]}
    assert export.export_panel(spark, url, text, dt.date(2024, 1, 1), dt.date(2024, 12, 31), "all", evil, driver=DRIVER).count() == 0


@pytest.mark.parametrize(
    "text, values",
    [("SELECT :a", {}), ("SELECT 1", {"a": 1}), ("DELETE FROM Q", {}), ("SELECT 1; DROP TABLE Q", {}), ("SELECT :a", {"a": object()}), ("SELECT :a", {"a": "back\\slash"}), ("SELECT :a", {"a": float("nan")}), ("SELECT :a", {"a": []}), ("UPDATE Q SET vol = 1 -- SELECT", {})],
)
def test_what_is_refused(text, values):
    with pytest.raises(ValueError):
        export.bound(text, values)


def test_binding():
    got = export.bound("with q as (select :d::date, ':d', \":d\", $$ :d $$ from t where x = :x and y is :n) select :b, :t from q ; ", {"d": dt.date(2024, 1, 2), "x": -3, "n": None, "b": True, "t": dt.datetime(2024, 1, 2, 3)})
    assert got == "with q as (select CAST('2024-01-02' AS DATE)::date, ':d', \":d\", $$ :d $$ from t where x = -3 and y is NULL) select TRUE, CAST('2024-01-02 03:00:00' AS TIMESTAMP) from q"


def test_missing_columns_and_dates(spark, url):
    with pytest.raises(ValueError, match="pct_chg, vol"):
        export.export_panel(spark, url, 'SELECT ts_code, trade_date, "CLOSE" FROM Q', dt.date(2024, 1, 1), dt.date(2024, 1, 2), "all", driver=DRIVER)
    with pytest.raises(ValueError):
        export.date_ranges(dt.date(2024, 1, 2), dt.date(2024, 1, 1), 3)
    with pytest.raises(ValueError):
        export.export_panel(spark, url, TEXT, dt.date(2024, 1, 1), dt.date(2024, 1, 2), "all", {"start_date": "x"}, driver=DRIVER)
