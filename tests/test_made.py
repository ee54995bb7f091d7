"""The made-up panel: what its series are like."""

import numpy as np

from tesspan.operators.loader import PanelLoader
from tesspan.sources.made import made_panel
from tesspan.sources.panel import synthetic_prices


def test_series(spark):
    got = made_panel(synthetic_prices(spark, 150, 400).select("stock_code", "trade_date"), ["alpha_000", "alpha_001"])
    df = got.orderBy("ts_code", "trade_date").toPandas()
    assert len(df) == 150 * 400
    before = df.groupby("ts_code")["alpha_000"].shift(1)
    known = before.notna()
    assert abs(np.corrcoef(df["alpha_000"][known], before[known])[0, 1] - 0.3) < 0.01
    assert abs(np.corrcoef(df["alpha_000"], df["alpha_001"])[0, 1]) < 0.02
    by_day = df.groupby("trade_date")["alpha_000"]
    assert by_day.mean().abs().max() < 1e-9 and (by_day.std(ddof=0) - 1).abs().max() < 1e-6
    assert df["pct_chg"].abs().max() <= 0.098 and 0.016 < df["pct_chg"].std() < 0.02
    assert 0.003 < (df["vol"] == 0).mean() < 0.007 and df["close"].min() >= 1
    one = df[df["ts_code"] == df["ts_code"][0]]
    assert np.allclose(one["close"].to_numpy()[1:] / one["close"].to_numpy()[:-1] - 1, one["pct_chg"].to_numpy()[1:])
    assert (one["days_since_ipo"].diff().dropna() == 1).all() and one["is_st"].nunique() == 1
    stocks = df.groupby("ts_code").first()
    assert 0.01 < stocks["is_st"].mean() < 0.1 and set(stocks["industry_code"]) <= set(range(1, 11)) and stocks["industry_code"].nunique() == 10
    assert (stocks["name"].str.startswith("*ST") == stocks["is_st"]).all()
    assert PanelLoader(spark, "").prepared(got, universe="all_a").count() == 150 * 400
    assert made_panel(synthetic_prices(spark, 3, 5).select("stock_code", "trade_date").limit(0), ["alpha_000"]).count() == 0
