"""The alpha family: published price-volume formulas over one stock-by-day panel.

ts_ functions look back over a stock's rows, cs_ functions across a day's stocks.
"""

from __future__ import annotations

#: Terms that several formulas share.
TERMS = {
}

#: Id, category, direction, quality (0 ok, 1 best effort, 2 stub), formula.
# fmt: off
FORMULAS = [
    ("alpha001", "volatility", "reverse", 0, "cs_rank(ts_argmax(signed_power(IF(returns < 0, ts_std(returns, 20), close), 2.0), 5)) - 0.5"),
    ("alpha002", "volume_price", "reverse", 0, "-1.0 * ts_corr(cs_rank(delta(log(volume), 2)), cs_rank((close - open) / open), 6)"),
    ("alpha003", "volume_price", "reverse", 0, "-1.0 * ts_corr(cs_rank(open), cs_rank(volume), 10)"),
    ("alpha004", "mean_reversion", "reverse", 0, "-1.0 * ts_rank_int(cs_rank(low), 9)"),
    ("alpha005", "volume_price", "reverse", 0, "cs_rank(open - (ts_sum(vwap, 10) / 10.0)) * (-1.0 * abs(cs_rank(close - vwap)))"),
    ("alpha006", "volume_price", "reverse", 0, "-1.0 * ts_corr(open, volume, 10)"),
    ("alpha007", "momentum", "reverse", 0, "IF(adv20 < volume, (-1.0 * ts_rank(abs(delta(close, 7)), 60)) * sign(delta(close, 7)), -1.0)"),
    ("alpha008", "momentum", "reverse", 0, "-1.0 * cs_rank((ts_sum(open, 5) * ts_sum(returns, 5)) - delay(ts_sum(open, 5) * ts_sum(returns, 5), 10))"),
    ("alpha009", "momentum", "reverse", 0, "IF(ts_min(delta(close, 1), 5) > 0.0, delta(close, 1), IF(ts_max(delta(close, 1), 5) < 0.0, delta(close, 1), -1.0 * delta(close, 1)))"),
    ("alpha010", "momentum", "reverse", 0, "cs_rank(IF(ts_min(delta(close, 1), 4) > 0.0, delta(close, 1), IF(ts_max(delta(close, 1), 4) < 0.0, delta(close, 1), -1.0 * delta(close, 1))))"),
    ("alpha011", "industry_neutral", "reverse", 0, "(cs_rank(ts_max(vwap - close, 3)) + cs_rank(ts_min(vwap - close, 3))) * cs_rank(delta(volume, 3))"),
    ("alpha012", "volume_price", "reverse", 0, "sign(delta(volume, 1)) * (-1.0 * delta(close, 1))"),
    ("alpha013", "volume_price", "reverse", 0, "-1.0 * cs_rank(ts_cov(cs_rank(close), cs_rank(volume), 5))"),
    ("alpha014", "volume_price", "reverse", 0, "(-1.0 * cs_rank(delta(returns, 3))) * ts_corr(open, volume, 10)"),
    ("alpha015", "volume_price", "reverse", 0, "-1.0 * ts_sum(cs_rank(fill_null(fill_nan(ts_corr(cs_rank(high), cs_rank(volume), 3), 0.0), 0.0)), 3)"),
    ("alpha016", "industry_neutral", "reverse", 0, "-1.0 * cs_rank(ts_cov(cs_rank(high), cs_rank(volume), 5))"),
    ("alpha017", "momentum", "reverse", 0, "((-1.0 * cs_rank(ts_rank(close, 10))) * cs_rank(delta(delta(close, 1), 1))) * cs_rank(ts_rank(volume / adv20, 5))"),
    ("alpha018", "volatility", "reverse", 0, "-1.0 * cs_rank((ts_std(abs(close - open), 5) + (close - open)) + ts_corr_safe(close, open, 10))"),
    ("alpha019", "momentum", "reverse", 0, "(-1.0 * sign((close - delay(close, 7)) + delta(close, 7))) * (1.0 + cs_rank(1.0 + ts_sum(returns, 250)))"),
    ("alpha020", "industry_neutral", "reverse", 0, "((-1.0 * cs_rank(open - delay(high, 1))) * cs_rank(open - delay(close, 1))) * cs_rank(open - delay(low, 1))"),
    ("alpha021", "adv_extended", "reverse", 0, "IF((ts_mean(close, 8) + ts_std(close, 8)) < ts_mean(close, 2), -1.0, IF(ts_mean(close, 2) < (ts_mean(close, 8) - ts_std(close, 8)), 1.0, IF((volume / adv20) >= 1.0, 1.0, -1.0)))"),
    ("alpha022", "volume_price", "reverse", 0, "(-1.0 * byStock(ts_corr(high, volume, 5) - shift(ts_corr(high, volume, 5), 5))) * cs_rank(ts_std(close, 20))"),
    ("alpha023", "breakout", "reverse", 1, "IF((ts_sum(high, 20) / 20.0) < high, -1.0 * delta(high, 2), 0.0)"),
    ("alpha024", "cap_weighted", "reverse", 0, "IF((delta(ts_mean(close, 100), 100) / delay(close, 100)) <= 0.05, -1.0 * (close - ts_min(close, 100)), -1.0 * delta(close, 3))"),
    ("alpha025", "volume_price", "reverse", 0, "cs_rank((((-1.0 * returns) * adv20) * vwap) * (high - close))"),
    ("alpha026", "volume_price", "reverse", 0, "-1.0 * ts_max(ts_corr(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)"),
    ("alpha027", "industry_neutral", "reverse", 0, "IF(cs_rank(ts_sum(ts_corr(cs_rank(volume), cs_rank(vwap), 6), 2) / 2.0) > 0.5, -1.0, 1.0)"),
    ("alpha028", "volume_price", "reverse", 0, "cs_scale((ts_corr(adv20, low, 5) + ((high + low) / 2.0)) - close)"),
    ("alpha029", "industry_neutral", "reverse", 0, "ts_min(cs_rank(cs_rank(cs_scale(log(clip(ts_sum(ts_min(cs_rank(cs_rank(-1.0 * cs_rank(delta(close - 1.0, 5)))), 2), 1), 1e-12))))), 5) + ts_rank(delay(-1.0 * returns, 6), 5)"),
    ("alpha030", "industry_neutral", "reverse", 0, "((1.0 - cs_rank((sign(delta(close, 1)) + sign(delay(delta(close, 1), 1))) + sign(delay(delta(close, 1), 2)))) * ts_sum(volume, 5)) / ts_sum(volume, 20)"),
    ("alpha031", "industry_neutral", "reverse", 1, "(cs_rank(cs_rank(cs_rank(ts_decay_linear(-1.0 * cs_rank(cs_rank(delta(close, 10))), 10)))) + cs_rank(-1.0 * delta(close, 3))) + sign(cs_scale(ts_corr(adv20, low, 12)))"),
    ("alpha032", "mean_reversion", "reverse", 0, "cs_scale((ts_sum(close, 7) / 7.0) - close) + (20.0 * cs_scale(ts_corr_safe(vwap, delay(close, 5), 230)))"),
    ("alpha033", "mean_reversion", "reverse", 0, "cs_rank((open / close) - 1.0)"),
    ("alpha034", "volatility", "reverse", 0, "cs_rank((2.0 - cs_rank(IF(is_finite(ts_std(returns, 2) / ts_std(returns, 5)), ts_std(returns, 2) / ts_std(returns, 5), 1.0))) - cs_rank(delta(close, 1)))"),
    ("alpha035", "volume_price", "reverse", 0, "(ts_rank(volume, 32) * (1.0 - ts_rank((close + high) - low, 16))) * (1.0 - ts_rank(returns, 32))"),
    ("alpha036", "industry_neutral", "reverse", 0, "((((2.21 * cs_rank(ts_corr(close - open, delay(volume, 1), 15))) + (0.7 * cs_rank(open - close))) + (0.73 * cs_rank(ts_rank(delay(-1.0 * returns, 6), 5)))) + cs_rank(abs(ts_corr(vwap, adv20, 6)))) + (0.6 * cs_rank((ts_mean(close, 200) - open) * (close - open)))"),
    ("alpha037", "mean_reversion", "reverse", 0, "cs_rank(ts_corr_safe(delay(open - close, 1), close, 200)) + cs_rank(open - close)"),
    ("alpha038", "momentum", "reverse", 0, "(-1.0 * cs_rank(ts_rank(close, 10))) * cs_rank(close / open)"),
    ("alpha039", "industry_neutral", "reverse", 0, "(-1.0 * cs_rank(delta(close, 7) * (1.0 - cs_rank(ts_decay_linear(volume / adv20, 9))))) * (1.0 + cs_rank(ts_sum(returns, 250)))"),
    ("alpha040", "volatility", "reverse", 0, "(-1.0 * cs_rank(ts_std(high, 10))) * ts_corr_safe(high, volume, 10)"),
    ("alpha041", "mean_reversion", "reverse", 0, "sqrt(high * low) - vwap"),
    ("alpha042", "mean_reversion", "reverse", 0, "cs_rank(vwap - close) / cs_rank(vwap + close)"),
    ("alpha043", "volume_price", "reverse", 0, "ts_rank(volume / adv20, 20) * ts_rank(-1.0 * delta(close, 7), 8)"),
    ("alpha044", "volume_price", "reverse", 0, "-1.0 * ts_corr(high, cs_rank(volume), 5)"),
    ("alpha045", "momentum", "reverse", 0, "(-1.0 * (cs_rank(ts_sum(delay(close, 5), 20) / 20.0) * ts_corr(close, volume, 2))) * cs_rank(ts_corr(ts_sum(close, 5), ts_sum(close, 20), 2))"),
    ("alpha046", "momentum", "reverse", 0, "IF((((delay(close, 20) - delay(close, 10)) / 10.0) - ((delay(close, 10) - close) / 10.0)) > 0.25, -1.0, IF((((delay(close, 20) - delay(close, 10)) / 10.0) - ((delay(close, 10) - close) / 10.0)) < 0.0, 1.0, -1.0 * (close - delay(close, 1))))"),
    ("alpha047", "industry_neutral", "reverse", 0, "(((cs_rank(1.0 / close) * volume) / adv20) * ((high * cs_rank(high - close)) / ts_mean(high, 5))) - cs_rank(vwap - delay(vwap, 5))"),
    ("alpha048", "industry_neutral", "reverse", 0, "ind_neutralize((ts_corr(delta(close, 1), delta(delay(close, 1), 1), 250) * delta(close, 1)) / close, sub_industry) / ts_sum((delta(close, 1) / delay(close, 1)) ^ 2.0, 250)"),
    ("alpha049", "industry_neutral", "reverse", 0, "IF((((delay(close, 20) - delay(close, 10)) / 10.0) - ((delay(close, 10) - close) / 10.0)) < -0.1, 1.0, -1.0 * delta(close, 1))"),
    ("alpha050", "industry_neutral", "reverse", 0, "-1.0 * ts_max(cs_rank(ts_corr(cs_rank(volume), cs_rank(vwap), 5)), 5)"),
    ("alpha051", "momentum", "reverse", 0, "IF((((delay(close, 20) - delay(close, 10)) / 10.0) - ((delay(close, 10) - close) / 10.0)) < -0.05, 1.0, -1.0 * (close - delay(close, 1)))"),
    ("alpha052", "momentum", "reverse", 0, "(((-1.0 * ts_min(low, 5)) + delay(ts_min(low, 5), 5)) * cs_rank((ts_sum(returns, 240) - ts_sum(returns, 20)) / 220.0)) * ts_rank(volume, 5)"),
    ("alpha053", "mean_reversion", "reverse", 0, "-1.0 * delta(((close - low) - (high - close)) / IF((close - low) == 0.0, 0.0001, close - low), 9)"),
    ("alpha054", "breakout", "reverse", 0, "((-1.0 * (low - close)) * (open ^ 5)) / ((low - high) * (close ^ 5))"),
    ("alpha055", "volume_price", "reverse", 0, "-1.0 * ts_corr(cs_rank((close - ts_min(low, 12)) / (ts_max(high, 12) - ts_min(low, 12))), cs_rank(volume), 6)"),
    ("alpha056", "cap_weighted", "reverse", 0, "(-1.0 * cs_rank(ts_sum(returns, 10) / ts_sum(ts_sum(returns, 2), 3))) * cs_rank(returns * cap)"),
    ("alpha057", "mean_reversion", "reverse", 0, "(-1.0 * (close - vwap)) / ts_decay_linear(cs_rank(ts_argmax_last(close, 30)), 2)"),
    ("alpha058", "industry_neutral", "reverse", 0, "-1.0 * ts_rank(ts_decay_linear(ts_corr(ind_neutralize(vwap, industry), volume, 4), 8), 6)"),
    ("alpha059", "industry_neutral", "reverse", 0, "-1.0 * ts_rank(ts_decay_linear(ts_corr(ind_neutralize((vwap * 0.728317) + (vwap * (1.0 - 0.728317)), industry), volume, 4), 16), 8)"),
    ("alpha060", "volume_price", "reverse", 0, "-1.0 * ((2.0 * cs_scale(cs_rank((((close - low) - (high - close)) / (high - low)) * volume))) - cs_scale(cs_rank(ts_argmax(close, 10))))"),
    ("alpha061", "adv_extended", "reverse", 0, "cs_rank(vwap - ts_min(vwap, 16)) < cs_rank(ts_corr(vwap, adv180, 18))"),
    ("alpha062", "industry_neutral", "reverse", 0, "(cs_rank(ts_corr(vwap, ts_sum(adv20, 22), 10)) < cs_rank((cs_rank(open) + cs_rank(open)) < (cs_rank((high + low) / 2.0) + cs_rank(high)))) * -1.0"),
    ("alpha063", "industry_neutral", "reverse", 0, "(cs_rank(ts_decay_linear(delta(ind_neutralize(close, industry), 2), 8)) - cs_rank(ts_decay_linear(ts_corr((vwap * 0.318108) + (open * (1.0 - 0.318108)), ts_sum(adv180, 37), 14), 12))) * -1.0"),
    ("alpha064", "adv_extended", "reverse", 0, "(cs_rank(ts_corr(ts_sum((open * 0.178404) + (low * (1.0 - 0.178404)), 13), ts_sum(adv120, 13), 17)) < cs_rank(((((high + low) / 2.0) * 0.178404) + (vwap * (1.0 - 0.178404))) - byStock(shift((((high + low) / 2.0) * 0.178404) + (vwap * (1.0 - 0.178404)), 4)))) * -1.0"),
    ("alpha065", "volume_price", "reverse", 0, "IF(cs_rank(ts_corr((open * 0.0078) + (vwap * 0.9922), ts_sum(adv60, 9), 6)) < cs_rank(open - ts_min(open, 14)), -1.0, 1.0)"),
    ("alpha066", "industry_neutral", "reverse", 0, "(cs_rank(ts_decay_linear(delta(vwap, 4), 7)) + ts_rank(ts_decay_linear((((low * 0.96633) + (low * (1.0 - 0.96633))) - vwap) / (open - ((high + low) / 2.0)), 11), 7)) * -1.0"),
    ("alpha067", "industry_neutral", "reverse", 0, "(cs_rank(high - ts_min(high, 2)) ^ cs_rank(ts_corr(ind_neutralize(vwap, industry), ind_neutralize(adv20, sub_industry), 6))) * -1.0"),
    ("alpha068", "volume_price", "reverse", 1, "IF(ts_rank(ts_corr(cs_rank(high), cs_rank(adv15), 9), 14) < cs_rank(delta((close * 0.518) + (low * 0.482), 1)), -1.0, 1.0)"),
    ("alpha069", "industry_neutral", "reverse", 0, "(cs_rank(ts_max(delta(ind_neutralize(vwap, industry), 3), 5)) ^ ts_rank(ts_corr((close * 0.490655) + (vwap * (1.0 - 0.490655)), adv20, 5), 9)) * -1.0"),
    ("alpha070", "industry_neutral", "reverse", 0, "(cs_rank(delta(vwap, 1)) ^ ts_rank(ts_corr(ind_neutralize(close, industry), adv50, 18), 18)) * -1.0"),
    ("alpha071", "volume_price", "reverse", 0, "MAX(ts_rank(ts_decay_linear(ts_corr(ts_rank(close, 3), ts_rank(adv180, 12), 18), 4), 16), ts_rank(ts_decay_linear(cs_rank(((low + open) - vwap) - vwap) ^ 2, 16), 4))"),
    ("alpha072", "volume_price", "reverse", 0, "cs_rank(ts_decay_linear(ts_corr((high + low) / 2.0, adv40, 9), 10)) / cs_rank(ts_decay_linear(ts_corr(ts_rank(vwap, 4), ts_rank(volume, 19), 7), 3))"),
    ("alpha073", "volume_price", "reverse", 0, "-1.0 * MAX(cs_rank(ts_decay_linear(delta(vwap, 5), 3)), ts_rank(ts_decay_linear((-1.0 * delta((open * 0.147155) + (low * 0.852845), 2)) / ((open * 0.147155) + (low * 0.852845)), 3), 17))"),
    ("alpha074", "volume_price", "reverse", 0, "IF(cs_rank(ts_corr(close, ts_sum(adv30, 37), 15)) < cs_rank(ts_corr(cs_rank((high * 0.0261) + (vwap * 0.9739)), cs_rank(volume), 11)), -1.0, 0.0)"),
    ("alpha075", "adv_extended", "reverse", 0, "cs_rank(ts_corr(vwap, volume, 4)) < cs_rank(ts_corr(cs_rank(low), cs_rank(adv50), 12))"),
    ("alpha076", "industry_neutral", "reverse", 1, "MAX(cs_rank(ts_decay_linear(delta(vwap, 1), 12)), ts_rank(ts_decay_linear(ts_rank(ts_corr(ind_neutralize(low, industry), adv81, 8), 20), 17), 19)) * -1.0"),
    ("alpha077", "volume_price", "reverse", 0, "MIN(cs_rank(ts_decay_linear(((((high + low) / 2.0) + high) - vwap) - high, 20)), cs_rank(ts_decay_linear(ts_corr((high + low) / 2.0, adv40, 3), 6)))"),
    ("alpha078", "volume_price", "reverse", 0, "power(cs_rank(ts_corr(ts_sum((low * 0.352) + (vwap * 0.648), 20), ts_sum(adv40, 20), 7)), cs_rank(ts_corr(cs_rank(vwap), cs_rank(volume), 6)))"),
    ("alpha079", "industry_neutral", "reverse", 1, "cs_rank(delta(ind_neutralize((close * 0.60733) + (open * (1.0 - 0.60733)), industry), 1)) < cs_rank(ts_corr(ts_rank(vwap, 4), ts_rank(adv150, 9), 15))"),
    ("alpha080", "industry_neutral", "reverse", 0, "(cs_rank(sign(delta(ind_neutralize((open * 0.868128) + (high * (1.0 - 0.868128)), industry), 4))) ^ ts_rank(ts_corr(high, adv15, 5), 6)) * -1.0"),
    ("alpha081", "volume_price", "reverse", 0, "IF(cs_rank(log(ts_product(cs_rank(cs_rank(ts_corr(vwap, ts_sum(adv10, 50), 8) ^ 4)), 15))) < cs_rank(ts_corr(cs_rank(vwap), cs_rank(volume), 5)), -1.0, 0.0)"),
    ("alpha082", "industry_neutral", "reverse", 1, "MIN(cs_rank(ts_decay_linear(delta(open, 1), 15)), ts_rank(ts_decay_linear(ts_corr(ind_neutralize(volume, industry), (open * 0.634196) + (open * (1.0 - 0.634196)), 17), 7), 13)) * -1.0"),
    ("alpha083", "volume_price", "reverse", 0, "(cs_rank(delay((high - low) / (ts_sum(close, 5) / 5.0), 2)) * cs_rank(cs_rank(volume))) / (((high - low) / (ts_sum(close, 5) / 5.0)) / (vwap - close))"),
    ("alpha084", "momentum", "reverse", 0, "signed_power(ts_rank(vwap - ts_max(vwap, 15), 21), 1.0)"),
    ("alpha085", "volume_price", "reverse", 0, "power(cs_rank(ts_corr((high * 0.876) + (close * 0.124), adv30, 10)), cs_rank(ts_corr(ts_rank((high + low) / 2.0, 4), ts_rank(volume, 10), 7)))"),
    ("alpha086", "industry_neutral", "reverse", 0, "(ts_rank(ts_corr(close, ts_sum(adv20, 15), 6), 20) < cs_rank((open + close) - (vwap + open))) * -1.0"),
    ("alpha087", "industry_neutral", "reverse", 1, "MAX(cs_rank(ts_decay_linear(delta((close * 0.369701) + (vwap * (1.0 - 0.369701)), 2), 3)), ts_rank(ts_decay_linear(abs(ts_corr(ind_neutralize(adv81, industry), close, 13)), 5), 14)) * -1.0"),
    ("alpha088", "volume_price", "reverse", 0, "MIN(cs_rank(ts_decay_linear(((cs_rank(open) + cs_rank(low)) - cs_rank(high)) - cs_rank(close), 8)), ts_rank(ts_decay_linear(ts_corr(ts_rank(close, 8), ts_rank(adv60, 21), 8), 7), 3))"),
    ("alpha089", "industry_neutral", "reverse", 1, "ts_rank(ts_decay_linear(ts_corr((low * 0.967285) + (low * (1.0 - 0.967285)), adv15, 7), 6), 4) - ts_rank(ts_decay_linear(delta(ind_neutralize(vwap, industry), 3), 10), 15)"),
    ("alpha090", "industry_neutral", "reverse", 1, "(cs_rank(close - ts_max(close, 5)) ^ ts_rank(ts_corr(ind_neutralize(adv40, sub_industry), low, 5), 3)) * -1.0"),
    ("alpha091", "industry_neutral", "reverse", 0, "(ts_rank(ts_decay_linear(ts_decay_linear(ts_corr(ind_neutralize(close, industry), volume, 10), 16), 4), 5) - cs_rank(ts_decay_linear(ts_corr(vwap, adv30, 4), 3))) * -1.0"),
    ("alpha092", "technical", "reverse", 0, "MIN(ts_rank(ts_decay_linear(IF((((high + low) / 2.0) + close) < (low + open), 1.0, 0.0), 15), 19), ts_rank(ts_decay_linear(ts_corr(cs_rank(low), cs_rank(adv30), 8), 7), 7))"),
    ("alpha093", "industry_neutral", "reverse", 1, "ts_rank(ts_decay_linear(ts_corr(ind_neutralize(vwap, industry), adv81, 17), 20), 8) / cs_rank(ts_decay_linear(delta((close * 0.524434) + (vwap * (1.0 - 0.524434)), 3), 16))"),
    ("alpha094", "volume_price", "reverse", 1, "-1.0 * power(cs_rank(vwap - ts_min(vwap, 12)), ts_rank(ts_corr(ts_rank(vwap, 20), ts_rank(adv60, 4), 18), 3))"),
    ("alpha095", "breakout", "reverse", 0, "IF(cs_rank(open - ts_min(open, 12)) < ts_rank(cs_rank(ts_corr(ts_sum((high + low) / 2.0, 19), ts_sum(adv40, 19), 13)) ^ 5, 12), 1.0, 0.0)"),
    ("alpha096", "industry_neutral", "reverse", 0, "MAX(ts_rank(ts_decay_linear(ts_corr(cs_rank(vwap), cs_rank(volume), 4), 4), 8), ts_rank(ts_decay_linear(ts_argmax(ts_corr(ts_rank(close, 7), ts_rank(adv60, 4), 4), 13), 14), 13)) * -1.0"),
    ("alpha097", "industry_neutral", "reverse", 1, "(cs_rank(ts_decay_linear(delta(ind_neutralize((low * 0.721001) + (vwap * (1.0 - 0.721001)), industry), 3), 20)) - ts_rank(ts_decay_linear(ts_rank(ts_corr(ts_rank(low, 8), ts_rank(adv60, 17), 5), 19), 16), 7)) * -1.0"),
    ("alpha098", "industry_neutral", "reverse", 0, "cs_rank(ts_decay_linear(ts_corr(vwap, ts_sum(adv5, 26), 5), 7)) - cs_rank(ts_decay_linear(ts_rank(ts_argmin(ts_corr(cs_rank(open), cs_rank(adv15), 21), 9), 7), 8))"),
    ("alpha099", "volume_price", "reverse", 0, "IF(cs_rank(ts_corr(ts_sum((high + low) / 2.0, 19), ts_sum(adv60, 19), 8)) < cs_rank(ts_corr(low, volume, 6)), -1.0, 0.0)"),
    ("alpha100", "industry_neutral", "reverse", 1, "-1.0 * (((1.5 * cs_scale(ind_neutralize(ind_neutralize(cs_rank((((close - low) - (high - close)) / (high - low)) * volume), sub_industry), sub_industry))) - cs_scale(ind_neutralize(ts_corr(close, cs_rank(adv20), 5) - cs_rank(ts_argmin(close, 30)), sub_industry))) * (volume / adv20))"),
    ("alpha101", "mean_reversion", "reverse", 0, "(close - open) / ((high - low) + 0.001)"),
    ("alpha_custom_argmax_recent", "momentum", "reverse", 0, "1.0 - cs_rank(ts_argmax(close, 20))"),
    ("alpha_custom_argmin_recent", "mean_reversion", "reverse", 0, "cs_rank(ts_argmin_last(close, 20))"),
    ("alpha_custom_decaylinear_mom", "momentum", "reverse", 0, "cs_rank(ts_decay_linear(returns, 10))"),
    ("alpha_custom_kurt_filter", "volatility", "reverse", 0, "-1.0 * cs_rank(ts_kurt(returns, 20))"),
    ("alpha_custom_skew_reversal", "volatility", "reverse", 0, "-1.0 * cs_rank(ts_skew(returns, 20))"),
    ("alpha_custom_zscore_5d", "mean_reversion", "reverse", 0, "-1.0 * ts_zscore(close, 5)"),
]
# fmt: on
