"""Panels wider than the registered ones, and the made-up panel."""

import numpy as np
import pytest

from tesspan.operators import factors, loader, rules
from tesspan.sources.panel import enriched, line_item_panel, synthetic_prices, synthetic_training

SF = "/root/testdata/sf0.001"


def test_made_up_panel_is_whole_and_the_same_each_time(spark):
    a, b = synthetic_prices(spark, 30, 25), synthetic_prices(spark, 30, 25)
    assert a.count() == 750 and a.select("stock_code", "trade_date").distinct().count() == 750
    assert not a.exceptAll(b).count() and a.where("high < greatest(open, close) OR low > least(open, close) OR weekday(trade_date) > 4").count() == 0
    got = loader.PanelLoader(spark, "").prepared(synthetic_training(a, 3), universe="all_a", forward_period=5)
    assert got.count() == 750 and got.where("fwd_ret <> 0").count() == 600


def test_ranks_of_a_wide_day(spark):
    """Every stock of a large cross-section: a daily rank against numpy."""
    df = enriched(synthetic_prices(spark, 700, 3))
    got = factors.compute(df, ["alpha033"]).toPandas().merge(df.select("stock_code", "trade_date", "open", "close").toPandas(), on=["stock_code", "trade_date"])
    for _, day in got.groupby("trade_date"):
        x = (day.open / day.close - 1).to_numpy()
        assert len(day) == 700
        assert day.alpha033.to_numpy() == pytest.approx((np.argsort(np.argsort(x)) + 1) / 700)


def test_every_supplier_as_a_stock(spark):
    wide = line_item_panel(spark, SF, stocks=None)
    assert wide.select("stock_code").distinct().count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().count()


def test_capped_picks_of_a_skewed_day(spark):
    """A day with one industry of nearly all stocks."""
    df = synthetic_prices(spark, 2000, 1).selectExpr("trade_date", "stock_code AS ts_code", "close AS score", "CASE WHEN hash(stock_code) % 20 = 0 THEN abs(hash(stock_code)) % 7 ELSE 9 END AS industry_code")
    got = rules.capped_top_k(df, 50).toPandas()
    assert len(got) == 50 and (got.industry_code == 9).sum() == 15


def test_the_grid_reads_the_line_items_once(spark):
    """They are read when its panel is written, not again for each use of the grid."""
    from tesspan.queries.base import grid

    assert not [f for f in grid(spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]
