"""The gtja family: published short-period price-volume formulas over one stock-by-day panel.

rank and dailyMean work across a day's stocks, all other functions over a stock's rows.
"""

from __future__ import annotations

#: Terms that several formulas share.
TERMS = {
    "true_range": "MAX(MAX(high - low, abs(high - delay(close, 1))), abs(low - delay(close, 1)))",
    "up_range": "IF(open <= delay(open, 1), 0.0, MAX(high - open, open - delay(open, 1)))",
    "down_range": "IF(open >= delay(open, 1), 0.0, MAX(open - low, open - delay(open, 1)))",
    "gap_range": "MAX(abs(high - delay(high, 1)), abs(low - delay(low, 1)))",
    "higher": "(high + low) >= (delay(high, 1) + delay(low, 1))",
    "lower": "(high + low) <= (delay(high, 1) + delay(low, 1))",
    "typical": "((high + low) + close) / 3.0",
    "rise": "high - delay(high, 1)",
    "fall": "delay(low, 1) - low",
    "minus_di": "(sum(IF((fall > 0) & (fall > rise), fall, 0.0), 14) * 100.0) / sum(true_range, 14)",
    "plus_di": "(sum(IF((rise > 0) & (rise > fall), rise, 0.0), 14) * 100.0) / sum(true_range, 14)",
}

#: Id, category, direction, quality (0 ok, 1 best effort, 2 stub), formula.
# fmt: off
FORMULAS = [
    ("gtja_001", "volume_price", "reverse", 0, "-1.0 * corr(rank(delta(log(volume), 1)), rank((close - open) / open), 6)"),
    ("gtja_002", "mean_reversion", "reverse", 0, "-1.0 * delta(((close - low) - (high - close)) / (high - low), 1)"),
    ("gtja_003", "volume_price", "normal", 0, "sum(IF((close > delay(close, 1)) | (close < delay(close, 1)), close - IF(close > delay(close, 1), MIN(low, delay(close, 1)), MAX(high, delay(close, 1))), 0.0), 6)"),
    ("gtja_004", "mean_reversion", "normal", 0, "IF((mean(close, 8) + std(close, 8)) < mean(close, 2), -1.0, IF(mean(close, 2) < (mean(close, 8) - std(close, 8)), 1.0, IF((volume / mean(volume, 20)) >= 1.0, 1.0, -1.0)))"),
    ("gtja_005", "volume_price", "reverse", 1, "-1.0 * ts_max(corr(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)"),
    ("gtja_006", "momentum", "reverse", 0, "-1.0 * rank(sign(delta((open * 0.85) + (high * 0.15), 4)))"),
    ("gtja_007", "volume_price", "normal", 0, "(rank(ts_max(vwap - close, 3)) + rank(ts_min(vwap - close, 3))) * rank(delta(volume, 3))"),
    ("gtja_008", "momentum", "reverse", 0, "rank(delta(((-1.0 * (high + low)) * 0.1) + (vwap * 0.8), 4))"),
    ("gtja_009", "volume_price", "normal", 0, "sma((((high + low) / 2.0) - ((delay(high, 1) + delay(low, 1)) / 2.0)) * ((high - low) / volume), 7, 2)"),
    ("gtja_010", "volatility", "reverse", 0, "rank(MAX(IF(returns < 0.0, std(returns, 20), close) * IF(returns < 0.0, std(returns, 20), close), 5.0))"),
    ("gtja_011", "volume_price", "normal", 0, "sum(((((2.0 * close) - low) - high) / (high - low)) * volume, 6)"),
    ("gtja_012", "mean_reversion", "reverse", 0, "rank(open - mean(vwap, 10)) * (-1.0 * rank(abs(close - vwap)))"),
    ("gtja_013", "mean_reversion", "normal", 0, "((high * low) ^ 0.5) - vwap"),
    ("gtja_014", "momentum", "normal", 0, "delta(close, 5)"),
    ("gtja_015", "momentum", "normal", 0, "(open / delay(close, 1)) - 1.0"),
    ("gtja_016", "volume_price", "reverse", 0, "-1.0 * ts_max(rank(corr(rank(volume), rank(vwap), 5)), 5)"),
    ("gtja_017", "momentum", "reverse", 0, "rank(vwap - ts_max(vwap, 15)) ^ delta(close, 5)"),
    ("gtja_018", "momentum", "normal", 0, "close / delay(close, 5)"),
    ("gtja_019", "mean_reversion", "normal", 0, "IF(vwap < delay(vwap, 6), (vwap - delay(vwap, 6)) / delay(vwap, 6), (vwap - delay(vwap, 6)) / vwap)"),
    ("gtja_020", "momentum", "normal", 0, "((vwap - delay(vwap, 6)) / delay(vwap, 6)) * 100.0"),
    ("gtja_021", "momentum", "reverse", 1, "regbeta(mean(vwap, 6), row_index, 6)"),
    ("gtja_022", "mean_reversion", "reverse", 0, "sma(((vwap - mean(vwap, 6)) / mean(vwap, 6)) - delay((vwap - mean(vwap, 6)) / mean(vwap, 6), 3), 12, 1)"),
    ("gtja_023", "volatility", "normal", 0, "(sma(IF(vwap > delay(vwap, 1), std(vwap, 20), 0.0), 20, 1) / (sma(IF(vwap > delay(vwap, 1), std(vwap, 20), 0.0), 20, 1) + sma(IF(~(vwap > delay(vwap, 1)), std(vwap, 20), 0.0), 20, 1))) * 100.0"),
    ("gtja_024", "momentum", "normal", 0, "sma(vwap - delay(vwap, 5), 5, 1)"),
    ("gtja_025", "momentum", "reverse", 0, "((-1.0 * rank(delta(vwap, 7))) * rank(sma(volume / mean(volume, 20), 9, 1))) * (1.0 + rank(sum(returns, 150)))"),
    ("gtja_026", "mean_reversion", "normal", 0, "(mean(close, 12) - close) + corr(vwap, delay(close, 5), 200)"),
    ("gtja_027", "momentum", "normal", 0, "sma((((vwap / delay(vwap, 3)) - 1.0) * 100.0) + (((vwap / delay(vwap, 6)) - 1.0) * 100.0), 12, 1)"),
    ("gtja_028", "momentum", "normal", 0, "(3.0 * sma(((close - ts_min(low, 9)) / (ts_max(high, 9) - ts_min(low, 9))) * 100.0, 3, 1)) - (2.0 * sma(sma(((close - ts_min(low, 9)) / (ts_max(high, 9) - ts_min(low, 9))) * 100.0, 3, 1), 3, 1))"),
    ("gtja_029", "volume_price", "normal", 0, "((vwap - delay(vwap, 6)) / delay(vwap, 6)) * log(volume)"),
    ("gtja_030", "volatility", "normal", 2, "(close * 0.0) + NaN"),
    ("gtja_031", "mean_reversion", "reverse", 0, "((vwap - mean(vwap, 12)) / mean(vwap, 12)) * 100.0"),
    ("gtja_032", "volume_price", "reverse", 0, "-1.0 * sum(rank(corr(rank(high), rank(volume), 3)), 3)"),
    ("gtja_033", "volume_price", "normal", 1, "(((-1.0 * ts_min(low, 5)) + delay(ts_min(low, 5), 5)) * rank(sum(returns, 240) - sum(returns, 20))) * delay(rank(amount / cap), 5)"),
    ("gtja_034", "mean_reversion", "reverse", 0, "mean(vwap, 12) / vwap"),
    ("gtja_035", "volume_price", "reverse", 0, "MIN(rank(sma(delta(open, 1), 15, 1)), rank(sma(corr(volume, (open * 0.65) + (close * 0.35), 17), 7, 1))) * -1.0"),
    ("gtja_036", "volume_price", "normal", 0, "rank(sum(corr(rank(volume), rank(vwap), 6), 2))"),
    ("gtja_037", "momentum", "reverse", 0, "-1.0 * rank((sum(open, 5) * sum((vwap / delay(vwap, 1)) - 1.0, 5)) - delay(sum(open, 5) * sum((vwap / delay(vwap, 1)) - 1.0, 5), 10))"),
    ("gtja_038", "mean_reversion", "reverse", 0, "IF(mean(high, 20) < high, -1.0 * delta(high, 2), 0.0)"),
    ("gtja_039", "momentum", "reverse", 0, "(rank(decay_linear(delta(close, 2), 8)) - rank(decay_linear(corr((vwap * 0.3) + (open * 0.7), sum(mean(volume, 180), 37), 14), 12))) * -1.0"),
    ("gtja_040", "volume_price", "normal", 0, "(sum(IF(vwap > delay(vwap, 1), volume, 0.0), 26) / sum(IF(~(vwap > delay(vwap, 1)), volume, 0.0), 26)) * 100.0"),
    ("gtja_041", "momentum", "reverse", 0, "rank(ts_max(delta(vwap, 3), 5)) * -1.0"),
    ("gtja_042", "volume_price", "reverse", 0, "(-1.0 * rank(std(high, 10))) * corr(high, volume, 10)"),
    ("gtja_043", "volume_price", "normal", 0, "sum(IF(vwap > delay(vwap, 1), volume, -volume), 6)"),
    ("gtja_044", "volume_price", "normal", 0, "ts_rank(decay_linear(corr(low, mean(volume, 10), 7), 6), 4) + ts_rank(decay_linear(delta(vwap, 3), 10), 15)"),
    ("gtja_045", "volume_price", "reverse", 0, "rank(delta((close * 0.6) + (open * 0.4), 1)) * corr(vwap, mean(volume, 150), 15)"),
    ("gtja_046", "mean_reversion", "reverse", 0, "(((mean(close, 3) + mean(close, 6)) + mean(close, 12)) + mean(close, 24)) / (4.0 * close)"),
    ("gtja_047", "mean_reversion", "reverse", 0, "sma(((ts_max(high, 6) - close) / (ts_max(high, 6) - ts_min(low, 6))) * 100.0, 9, 1)"),
    ("gtja_048", "momentum", "reverse", 0, "(rank((sign(delta(close, 1)) + sign(delta(delay(close, 1), 1))) + sign(delta(delay(close, 2), 1))) * sum(volume, 5)) / sum(volume, 20)"),
    ("gtja_049", "volatility", "reverse", 0, "sumif(gap_range, 12, ~(higher)) / (sumif(gap_range, 12, ~(higher)) + sumif(gap_range, 12, higher))"),
    ("gtja_050", "volatility", "reverse", 1, "(sumif(gap_range, 12, ~(lower)) - sumif(gap_range, 12, ~(higher))) / ((sumif(gap_range, 12, ~(lower)) + sumif(gap_range, 12, ~(higher))) + 1e-07)"),
    ("gtja_051", "volatility", "reverse", 1, "sumif(gap_range, 12, ~(lower)) / ((sumif(gap_range, 12, ~(lower)) + sumif(gap_range, 12, ~(higher))) + 1e-07)"),
    ("gtja_052", "momentum", "normal", 0, "(sum(MAX(high - delay(typical, 1), 0.0), 26) / sum(MAX(delay(typical, 1) - low, 0.0), 26)) * 100.0"),
    ("gtja_053", "momentum", "normal", 0, "(sum(close > delay(close, 1), 12) / 12.0) * 100.0"),
    ("gtja_054", "volatility", "reverse", 0, "-1.0 * rank(std(abs(close - open) + (close - open), 10) + corr(close, open, 10))"),
    ("gtja_055", "momentum", "normal", 1, "sum(((16.0 * ((((close - delay(close, 1)) + ((close - open) / 2.0)) + delay(close, 1)) - delay(open, 1))) / IF((abs(high - delay(close, 1)) > abs(low - delay(close, 1))) & (abs(high - delay(close, 1)) > abs(high - delay(low, 1))), (abs(high - delay(close, 1)) + (abs(low - delay(close, 1)) / 2.0)) + (abs(delay(close, 1) - delay(open, 1)) / 4.0), IF((abs(low - delay(close, 1)) > abs(high - delay(low, 1))) & (abs(low - delay(close, 1)) > abs(high - delay(close, 1))), (abs(low - delay(close, 1)) + (abs(high - delay(close, 1)) / 2.0)) + (abs(delay(close, 1) - delay(open, 1)) / 4.0), abs(high - delay(low, 1)) + (abs(delay(close, 1) - delay(open, 1)) / 4.0)))) * MAX(abs(high - delay(close, 1)), abs(low - delay(close, 1))), 20)"),
    ("gtja_056", "volume_price", "reverse", 0, "rank(open - ts_min(open, 12)) < rank(rank(corr(sum((high + low) / 2.0, 19), sum(mean(volume, 40), 19), 13)) ^ 5.0)"),
    ("gtja_057", "momentum", "normal", 0, "sma(((close - ts_min(low, 9)) / (ts_max(high, 9) - ts_min(low, 9))) * 100.0, 3, 1)"),
    ("gtja_058", "momentum", "normal", 0, "(sum(vwap > delay(vwap, 1), 20) / 20.0) * 100.0"),
    ("gtja_059", "volume_price", "reverse", 0, "sum(IF(vwap != delay(vwap, 1), vwap - IF(vwap > delay(vwap, 1), MIN(low, delay(vwap, 1)), MAX(high, delay(vwap, 1))), 0.0), 20)"),
    ("gtja_060", "volume_price", "normal", 0, "sum((((close - low) - (high - close)) / (high - low)) * volume, 20)"),
    ("gtja_061", "volume_price", "reverse", 0, "MAX(rank(decay_linear(delta(vwap, 1), 12)), rank(decay_linear(rank(corr(low, mean(volume, 80), 8)), 17)))"),
    ("gtja_062", "volume_price", "reverse", 1, "-1.0 * corr(high, rank(amount / cap), 5)"),
    ("gtja_063", "momentum", "normal", 0, "(sma(MAX(vwap - delay(vwap, 1), 0.0), 6, 1) / sma(abs(vwap - delay(vwap, 1)), 6, 1)) * 100.0"),
    ("gtja_064", "volume_price", "reverse", 0, "MAX(rank(decay_linear(corr(rank(vwap), rank(volume), 4), 4)), rank(decay_linear(ts_max(corr(rank(close), rank(mean(volume, 60)), 4), 13), 14)))"),
    ("gtja_065", "mean_reversion", "reverse", 0, "mean(close, 6) / close"),
    ("gtja_066", "mean_reversion", "reverse", 0, "((close - mean(close, 6)) / mean(close, 6)) * 100.0"),
    ("gtja_067", "momentum", "normal", 0, "(sma(MAX(close - delay(close, 1), 0.0), 24, 1) / sma(abs(close - delay(close, 1)), 24, 1)) * 100.0"),
    ("gtja_068", "volume_price", "normal", 0, "sma(((((high + low) / 2.0) - ((delay(high, 1) + delay(low, 1)) / 2.0)) * (high - low)) / volume, 15, 2)"),
    ("gtja_069", "momentum", "normal", 1, "IF(sum(up_range, 20) > sum(down_range, 20), (sum(up_range, 20) - sum(down_range, 20)) / sum(up_range, 20), IF(sum(up_range, 20) == sum(down_range, 20), 0.0, (sum(up_range, 20) - sum(down_range, 20)) / sum(down_range, 20)))"),
    ("gtja_070", "volatility", "normal", 0, "std(amount, 6)"),
    ("gtja_071", "mean_reversion", "reverse", 0, "((close - mean(close, 24)) / mean(close, 24)) * 100.0"),
    ("gtja_072", "mean_reversion", "reverse", 0, "sma(((ts_max(high, 6) - close) / (ts_max(high, 6) - ts_min(low, 6))) * 100.0, 15, 1)"),
    ("gtja_073", "volume_price", "reverse", 1, "(-1.0 * ts_rank(decay_linear(decay_linear(corr(close, volume, 10), 16), 4), 5)) - rank(decay_linear(corr(vwap, mean(volume, 30), 4), 3))"),
    ("gtja_074", "volume_price", "normal", 0, "rank(corr(sum((low * 0.35) + (vwap * 0.65), 20), sum(mean(volume, 40), 20), 7)) + rank(corr(rank(vwap), rank(volume), 6))"),
    ("gtja_075", "momentum", "normal", 0, "sum((close > open) & (dailyMean(returns) < 0.0), 50) / sum((close != open) & (dailyMean(returns) < 0.0), 50)"),
    ("gtja_076", "volatility", "reverse", 0, "std(abs((close / delay(close, 1)) - 1.0) / volume, 20) / mean(abs((close / delay(close, 1)) - 1.0) / volume, 20)"),
    ("gtja_077", "volume_price", "reverse", 0, "MIN(rank(decay_linear((((high + low) / 2.0) + high) - (vwap + high), 20)), rank(decay_linear(corr((high + low) / 2.0, mean(volume, 40), 3), 6)))"),
    ("gtja_078", "mean_reversion", "normal", 0, "(typical - mean(typical, 12)) / (0.015 * mean(abs(close - mean(typical, 12)), 12))"),
    ("gtja_079", "momentum", "normal", 0, "(sma(MAX(close - delay(close, 1), 0.0), 12, 1) / sma(abs(close - delay(close, 1)), 12, 1)) * 100.0"),
    ("gtja_080", "volume_price", "normal", 0, "((volume - delay(volume, 5)) / delay(volume, 5)) * 100.0"),
    ("gtja_081", "volume_price", "normal", 0, "sma(volume, 21, 2)"),
    ("gtja_082", "mean_reversion", "reverse", 0, "sma(((ts_max(high, 6) - close) / (ts_max(high, 6) - ts_min(low, 6))) * 100.0, 20, 1)"),
    ("gtja_083", "volume_price", "reverse", 0, "-1.0 * rank(covariance(rank(high), rank(volume), 5))"),
    ("gtja_084", "volume_price", "normal", 0, "sum(IF(close > delay(close, 1), volume, IF(close < delay(close, 1), -volume, 0.0)), 20)"),
    ("gtja_085", "momentum", "reverse", 0, "ts_rank(volume / mean(volume, 20), 20) * ts_rank(-1.0 * delta(close, 7), 8)"),
    ("gtja_086", "momentum", "reverse", 0, "IF((((delay(close, 20) - delay(close, 10)) / 10.0) - ((delay(close, 10) - close) / 10.0)) > 0.25, -1.0, IF((((delay(close, 20) - delay(close, 10)) / 10.0) - ((delay(close, 10) - close) / 10.0)) < 0.0, 1.0, -1.0 * (close - delay(close, 1))))"),
    ("gtja_087", "volume_price", "reverse", 0, "(rank(decay_linear(delta(vwap, 4), 7)) + ts_rank(decay_linear((((low * 0.9) + (low * 0.1)) - vwap) / ((open - ((high + low) / 2.0)) + 1e-07), 11), 7)) * -1.0"),
    ("gtja_088", "momentum", "normal", 0, "((close - delay(close, 20)) / delay(close, 20)) * 100.0"),
    ("gtja_089", "momentum", "normal", 0, "2.0 * ((sma(close, 13, 2) - sma(close, 27, 2)) - sma(sma(close, 13, 2) - sma(close, 27, 2), 10, 2))"),
    ("gtja_090", "volume_price", "reverse", 0, "-1.0 * rank(corr(rank(vwap), rank(volume), 5))"),
    ("gtja_091", "volume_price", "reverse", 0, "(rank(close - ts_max(close, 5)) * rank(corr(mean(volume, 40), low, 5))) * -1.0"),
    ("gtja_092", "volume_price", "reverse", 0, "MAX(rank(decay_linear(delta((close * 0.35) + (vwap * 0.65), 2), 3)), ts_rank(decay_linear(abs(corr(mean(volume, 180), close, 13)), 5), 15)) * -1.0"),
    ("gtja_093", "volatility", "normal", 0, "sum(down_range, 20)"),
    ("gtja_094", "volume_price", "normal", 0, "sum(IF(close > delay(close, 1), volume, IF(close < delay(close, 1), -volume, 0.0)), 30)"),
    ("gtja_095", "volatility", "normal", 0, "std(amount, 20)"),
    ("gtja_096", "momentum", "normal", 0, "sma(sma(((close - ts_min(low, 9)) / (ts_max(high, 9) - ts_min(low, 9))) * 100.0, 3, 1), 3, 1)"),
    ("gtja_097", "volatility", "normal", 0, "std(volume, 10)"),
    ("gtja_098", "momentum", "reverse", 0, "IF((delta(sum(close, 100) / 100.0, 100) / delay(close, 100)) <= 0.05, -1.0 * (close - ts_min(close, 100)), -1.0 * delta(close, 3))"),
    ("gtja_099", "volume_price", "reverse", 0, "-1.0 * rank(covariance(rank(close), rank(volume), 5))"),
    ("gtja_100", "volatility", "normal", 0, "std(volume, 20)"),
    ("gtja_101", "correlation", "reverse", 0, "null_safe((rank(corr(close, sum(mean(volume, 30), 37), 15)) < rank(corr(rank((high * 0.1) + (vwap * 0.9)), rank(volume), 11))) * -1.0)"),
    ("gtja_102", "volume", "normal", 0, "(sma(IF(is_null(volume - delay(volume, 1)), null, IF((volume - delay(volume, 1)) > 0, volume - delay(volume, 1), 0.0)), 6, 1) / sma(abs(volume - delay(volume, 1)), 6, 1)) * 100.0"),
    ("gtja_103", "momentum", "normal", 0, "((20.0 - lowday(low, 20)) / 20.0) * 100.0"),
    ("gtja_104", "correlation", "reverse", 0, "(-1.0 * delta(corr(high, volume, 5), 5)) * rank(std(close, 20))"),
    ("gtja_105", "correlation", "reverse", 0, "-1.0 * corr(rank(open), rank(volume), 10)"),
    ("gtja_106", "momentum", "normal", 0, "close - delay(close, 20)"),
    ("gtja_107", "momentum", "reverse", 0, "((-1.0 * rank(open - delay(high, 1))) * rank(open - delay(close, 1))) * rank(open - delay(low, 1))"),
    ("gtja_108", "correlation", "reverse", 0, "(rank(high - ts_min(high, 2)) ^ rank(corr(vwap, mean(volume, 120), 6))) * -1.0"),
    ("gtja_109", "volatility", "normal", 0, "sma(high - low, 10, 2) / sma(sma(high - low, 10, 2), 10, 2)"),
    ("gtja_110", "momentum", "normal", 0, "(sum(IF((high - delay(close, 1)) > 0, high - delay(close, 1), 0.0), 20) / sum(IF((delay(close, 1) - low) > 0, delay(close, 1) - low, 0.0), 20)) * 100.0"),
    ("gtja_111", "volume", "normal", 0, "sma(volume * (((close - low) - (high - close)) / (high - low)), 11, 2) - sma(volume * (((close - low) - (high - close)) / (high - low)), 4, 2)"),
    ("gtja_112", "momentum", "normal", 0, "((sum(IF((close - delay(close, 1)) > 0, close - delay(close, 1), 0.0), 12) - sum(IF((close - delay(close, 1)) < 0, -(close - delay(close, 1)), 0.0), 12)) / (sum(IF((close - delay(close, 1)) > 0, close - delay(close, 1), 0.0), 12) + sum(IF((close - delay(close, 1)) < 0, -(close - delay(close, 1)), 0.0), 12))) * 100.0"),
    ("gtja_113", "correlation", "reverse", 0, "((-1.0 * rank(sum(delay(close, 5), 20) / 20.0)) * corr(close, volume, 20)) * rank(corr(sum(close, 5), sum(close, 20), 20))"),
    ("gtja_114", "volatility", "normal", 0, "(rank(delay((high - low) / mean(close, 5), 2)) * rank(rank(volume))) / (((high - low) / mean(close, 5)) / ((vwap - close) + 1e-07))"),
    ("gtja_115", "correlation", "normal", 0, "rank(corr((high * 0.9) + (close * 0.1), mean(volume, 30), 10)) ^ rank(corr(ts_rank((high + low) / 2.0, 4), ts_rank(volume, 10), 7))"),
    ("gtja_116", "momentum", "normal", 0, "regbeta(close, row_index, 20)"),
    ("gtja_117", "momentum", "normal", 0, "(ts_rank(volume, 32) * (1.0 - ts_rank((close + high) - low, 16))) * (1.0 - ts_rank((close / delay(close, 1)) - 1.0, 32))"),
    ("gtja_118", "volatility", "normal", 0, "(sum(high - open, 20) / sum(open - low, 20)) * 100.0"),
    ("gtja_119", "correlation", "normal", 0, "rank(decay_linear(corr(vwap, sum(mean(volume, 5), 26), 5), 7)) - rank(decay_linear(ts_rank(ts_min(corr(rank(open), rank(mean(volume, 15)), 21), 9), 7), 8))"),
    ("gtja_120", "volume", "normal", 0, "rank(vwap - close) / rank(vwap + close)"),
    ("gtja_121", "correlation", "reverse", 1, "(rank(vwap - ts_min(vwap, 12)) ^ ts_rank(corr(ts_rank(vwap, 20), ts_rank(mean(volume, 60), 2), 18), 3)) * -1.0"),
    ("gtja_122", "momentum", "normal", 0, "(sma(sma(sma(log(close), 13, 2), 13, 2), 13, 2) - delay(sma(sma(sma(log(close), 13, 2), 13, 2), 13, 2), 1)) / delay(sma(sma(sma(log(close), 13, 2), 13, 2), 13, 2), 1)"),
    ("gtja_123", "correlation", "reverse", 0, "IF(is_null(rank(corr(sum((high + low) / 2.0, 20), sum(mean(volume, 60), 20), 9))) | is_null(rank(corr(low, volume, 6))), null, (rank(corr(sum((high + low) / 2.0, 20), sum(mean(volume, 60), 20), 9)) < rank(corr(low, volume, 6))) * -1.0)"),
    ("gtja_124", "volume", "normal", 0, "(close - vwap) / decay_linear(rank(ts_max(close, 30)), 2)"),
    ("gtja_125", "correlation", "normal", 0, "rank(decay_linear(corr(vwap, mean(volume, 80), 17), 20)) / rank(decay_linear(delta((close + vwap) / 2.0, 3), 16))"),
    ("gtja_126", "price", "normal", 0, "((close + high) + low) / 3.0"),
    ("gtja_127", "volatility", "normal", 0, "mean(((100.0 * (close - ts_max(close, 12))) / ts_max(close, 12)) ^ 2, 12) ^ 0.5"),
    ("gtja_128", "volume", "normal", 0, "100.0 - (100.0 / (1.0 + (sum(IF(is_null(delay(typical, 1)), null, IF(typical > delay(typical, 1), typical * volume, 0.0)), 14) / (sum(IF(is_null(delay(typical, 1)), null, IF(~(typical > delay(typical, 1)), typical * volume, 0.0)), 14) + 1e-07))))"),
    ("gtja_129", "momentum", "reverse", 0, "sum(IF((close - delay(close, 1)) < 0, abs(close - delay(close, 1)), 0.0), 12)"),
    ("gtja_130", "correlation", "normal", 0, "rank(decay_linear(corr((high + low) / 2.0, mean(volume, 40), 9), 10)) / rank(decay_linear(corr(rank(vwap), rank(volume), 7), 3))"),
    ("gtja_131", "correlation", "normal", 1, "rank(delta(vwap, 1)) ^ ts_rank(corr(close, mean(volume, 50), 18), 18)"),
    ("gtja_132", "volume", "normal", 0, "mean(amount, 20)"),
    ("gtja_133", "momentum", "normal", 0, "(((20.0 - highday(high, 20)) / 20.0) * 100.0) - (((20.0 - lowday(low, 20)) / 20.0) * 100.0)"),
    ("gtja_134", "volume", "normal", 0, "((close - delay(close, 12)) / delay(close, 12)) * volume"),
    ("gtja_135", "momentum", "normal", 0, "sma(delay(close / delay(close, 20), 1), 20, 1)"),
    ("gtja_136", "momentum", "reverse", 0, "(-1.0 * rank(delta((close / delay(close, 1)) - 1.0, 3))) * corr(open, volume, 10)"),
    ("gtja_137", "volatility", "normal", 0, "((16.0 * ((((close - delay(close, 1)) + ((close - open) / 2.0)) + delay(close, 1)) - delay(open, 1))) / (IF((abs(high - delay(close, 1)) > abs(low - delay(close, 1))) & (abs(high - delay(close, 1)) > abs(high - delay(low, 1))), (abs(high - delay(close, 1)) + (abs(low - delay(close, 1)) / 2.0)) + (abs(delay(close, 1) - delay(open, 1)) / 4.0), IF((abs(low - delay(close, 1)) > abs(high - delay(low, 1))) & (abs(low - delay(close, 1)) > abs(high - delay(close, 1))), (abs(low - delay(close, 1)) + (abs(high - delay(close, 1)) / 2.0)) + (abs(delay(close, 1) - delay(open, 1)) / 4.0), abs(high - delay(low, 1)) + (abs(delay(close, 1) - delay(open, 1)) / 4.0))) + 1e-07)) * IF(abs(high - delay(close, 1)) > abs(low - delay(close, 1)), abs(high - delay(close, 1)), abs(low - delay(close, 1)))"),
    ("gtja_138", "correlation", "reverse", 0, "(rank(decay_linear(delta((low * 0.7) + (vwap * 0.3), 3), 20)) - ts_rank(decay_linear(ts_rank(corr(ts_rank(low, 8), ts_rank(mean(volume, 60), 17), 5), 19), 16), 7)) * -1.0"),
    ("gtja_139", "correlation", "reverse", 0, "-1.0 * corr(open, volume, 10)"),
    ("gtja_140", "correlation", "normal", 0, "MIN(rank(decay_linear(((rank(open) + rank(low)) - rank(high)) - rank(close), 8)), ts_rank(decay_linear(corr(ts_rank(close, 8), ts_rank(mean(volume, 60), 20), 8), 7), 3))"),
    ("gtja_141", "correlation", "reverse", 0, "rank(corr(rank(high), rank(mean(volume, 15)), 9)) * -1.0"),
    ("gtja_142", "momentum", "reverse", 0, "((-1.0 * rank(ts_rank(close, 10))) * rank(delta(delta(close, 1), 1))) * rank(ts_rank(volume / mean(volume, 20), 5))"),
    ("gtja_143", "momentum", "normal", 2, "null"),
    ("gtja_144", "volatility", "normal", 0, "sum(IF(close < delay(close, 1), abs((close / delay(close, 1)) - 1.0) / log(amount), 0.0), 20) / count(close < delay(close, 1), 20)"),
    ("gtja_145", "volume", "normal", 0, "((mean(volume, 9) - mean(volume, 26)) / mean(volume, 12)) * 100.0"),
    ("gtja_146", "momentum", "normal", 0, "(mean(((close - delay(close, 1)) / delay(close, 1)) - sma((close - delay(close, 1)) / delay(close, 1), 61, 2), 20) * (((close - delay(close, 1)) / delay(close, 1)) - sma((close - delay(close, 1)) / delay(close, 1), 61, 2))) / sma((((close - delay(close, 1)) / delay(close, 1)) - (((close - delay(close, 1)) / delay(close, 1)) - sma((close - delay(close, 1)) / delay(close, 1), 61, 2))) ^ 2, 61, 2)"),
    ("gtja_147", "momentum", "normal", 0, "regbeta(mean(close, 12), row_index, 12)"),
    ("gtja_148", "correlation", "reverse", 0, "IF(is_null(rank(corr(open, sum(mean(volume, 60), 9), 6))) | is_null(rank(open - ts_min(open, 14))), null, (rank(corr(open, sum(mean(volume, 60), 9), 6)) < rank(open - ts_min(open, 14))) * -1.0)"),
    ("gtja_149", "benchmark", "normal", 0, "regbeta((close / delay(close, 1)) - 1.0, dailyMean((close / delay(close, 1)) - 1.0), 252)"),
    ("gtja_150", "volume", "normal", 0, "(((close + high) + low) / 3.0) * log(volume)"),
    ("gtja_151", "momentum", "normal", 1, "sma(close - delay(close, 20), 20, 1)"),
    ("gtja_152", "momentum", "normal", 0, "sma(mean(delay(sma(delay(close / delay(close, 9), 1), 9, 1), 1), 12) - mean(delay(sma(delay(close / delay(close, 9), 1), 9, 1), 1), 26), 9, 1)"),
    ("gtja_153", "momentum", "normal", 0, "(((mean(close, 3) + mean(close, 6)) + mean(close, 12)) + mean(close, 24)) / 4.0"),
    ("gtja_154", "correlation", "normal", 0, "IF(is_null(vwap - ts_min(vwap, 16)) | is_null(corr(vwap, mean(volume, 180), 18)), null, IF((vwap - ts_min(vwap, 16)) < corr(vwap, mean(volume, 180), 18), 1.0, -1.0))"),
    ("gtja_155", "volume", "normal", 0, "(sma(volume, 13, 2) - sma(volume, 27, 2)) - sma(sma(volume, 13, 2) - sma(volume, 27, 2), 10, 2)"),
    ("gtja_156", "momentum", "reverse", 0, "MAX(rank(decay_linear(vwap - delay(vwap, 5), 3)), rank(decay_linear(-delta((open * 0.15) + (low * 0.85), 2) / ((open * 0.15) + (low * 0.85)), 3))) * -1.0"),
    ("gtja_157", "momentum", "normal", 0, "ts_min(rank(rank(log(sum(ts_min(rank(rank(-1.0 * rank(delta(close - 1.0, 5)))), 2), 1)))), 5) + ts_rank(delay(-1.0 * ((close / delay(close, 1)) - 1.0), 6), 5)"),
    ("gtja_158", "volatility", "normal", 0, "((high - sma(close, 15, 2)) - (low - sma(close, 15, 2))) / close"),
    ("gtja_159", "momentum", "normal", 0, "((((((close - sum(MIN(low, delay(close, 1)), 6)) / sum(MAX(high, delay(close, 1)) - MIN(low, delay(close, 1)), 6)) * 288.0) + (((close - sum(MIN(low, delay(close, 1)), 12)) / sum(MAX(high, delay(close, 1)) - MIN(low, delay(close, 1)), 12)) * 144.0)) + (((close - sum(MIN(low, delay(close, 1)), 24)) / sum(MAX(high, delay(close, 1)) - MIN(low, delay(close, 1)), 24)) * 144.0)) * 100.0) / 504.0"),
    ("gtja_160", "volatility", "normal", 0, "sma(IF(is_null(delay(close, 1)) | is_null(std(close, 20)), null, IF(close <= delay(close, 1), std(close, 20), 0.0)), 20, 1)"),
    ("gtja_161", "volatility", "normal", 0, "mean(MAX(MAX(high - low, abs(delay(close, 1) - high)), abs(delay(close, 1) - low)), 12)"),
    ("gtja_162", "momentum", "normal", 0, "(((sma(IF((close - delay(close, 1)) > 0, close - delay(close, 1), 0.0), 12, 1) / sma(abs(close - delay(close, 1)), 12, 1)) * 100.0) - ts_min((sma(IF((close - delay(close, 1)) > 0, close - delay(close, 1), 0.0), 12, 1) / sma(abs(close - delay(close, 1)), 12, 1)) * 100.0, 12)) / (ts_max((sma(IF((close - delay(close, 1)) > 0, close - delay(close, 1), 0.0), 12, 1) / sma(abs(close - delay(close, 1)), 12, 1)) * 100.0, 12) - ts_min((sma(IF((close - delay(close, 1)) > 0, close - delay(close, 1), 0.0), 12, 1) / sma(abs(close - delay(close, 1)), 12, 1)) * 100.0, 12))"),
    ("gtja_163", "momentum", "reverse", 0, "rank((((-1.0 * ((close / delay(close, 1)) - 1.0)) * mean(volume, 20)) * vwap) * (high - close))"),
    ("gtja_164", "momentum", "normal", 0, "sma(IF(close > delay(close, 1), 1.0 / (close - delay(close, 1)), 1.0) - ((ts_min(IF(close > delay(close, 1), 1.0 / (close - delay(close, 1)), 1.0), 12) / (high - low)) * 100.0), 13, 2)"),
    ("gtja_165", "volatility", "normal", 1, "ts_max(sum(close - mean(close, 48), 48), 48) - (ts_min(sum(close - mean(close, 48), 48), 48) / std(close, 48))"),
    ("gtja_166", "momentum", "normal", 1, "(5.0 * sum(((close / delay(close, 1)) - 1.0) - mean((close / delay(close, 1)) - 1.0, 20), 20)) / (sum(mean(close / delay(close, 1), 20) ^ 2, 20) ^ 1.5)"),
    ("gtja_167", "momentum", "normal", 0, "sum(IF((close - delay(close, 1)) > 0, close - delay(close, 1), 0.0), 12)"),
    ("gtja_168", "volume", "reverse", 0, "(-1.0 * volume) / mean(volume, 20)"),
    ("gtja_169", "momentum", "normal", 0, "sma(mean(delay(sma(close - delay(close, 1), 9, 1), 1), 12) - mean(delay(sma(close - delay(close, 1), 9, 1), 1), 26), 10, 1)"),
    ("gtja_170", "volume", "normal", 0, "(((rank(1.0 / close) * volume) / mean(volume, 20)) * ((high * rank(high - close)) / (sum(high, 5) / 5.0))) - rank(vwap - delay(vwap, 5))"),
    ("gtja_171", "momentum", "reverse", 0, "((-1.0 * (low - close)) * (open ^ 5)) / (((close - high) + 1e-07) * (close ^ 5))"),
    ("gtja_172", "momentum", "normal", 0, "mean((abs(minus_di - plus_di) / (minus_di + plus_di)) * 100.0, 6)"),
    ("gtja_173", "momentum", "normal", 0, "((3.0 * sma(close, 13, 2)) - (2.0 * sma(sma(close, 13, 2), 13, 2))) + sma(sma(log(close), 13, 2), 13, 2)"),
    ("gtja_174", "volatility", "normal", 0, "sma(IF(is_null(delay(close, 1)) | is_null(std(close, 20)), null, IF(close > delay(close, 1), std(close, 20), 0.0)), 20, 1)"),
    ("gtja_175", "volatility", "normal", 0, "mean(MAX(MAX(high - low, abs(delay(close, 1) - high)), abs(delay(close, 1) - low)), 6)"),
    ("gtja_176", "correlation", "normal", 0, "corr(rank((close - ts_min(low, 12)) / (ts_max(high, 12) - ts_min(low, 12))), rank(volume), 6)"),
    ("gtja_177", "momentum", "normal", 0, "((20.0 - highday(high, 20)) / 20.0) * 100.0"),
    ("gtja_178", "volume", "normal", 0, "((close - delay(close, 1)) / delay(close, 1)) * volume"),
    ("gtja_179", "correlation", "normal", 0, "rank(corr(vwap, volume, 4)) * rank(corr(rank(low), rank(mean(volume, 50)), 12))"),
    ("gtja_180", "momentum", "reverse", 0, "IF(mean(volume, 20) < volume, (-1.0 * ts_rank(abs(delta(close, 7)), 60)) * sign(delta(close, 7)), -1.0 * volume)"),
    ("gtja_181", "benchmark", "normal", 1, "sum((((close / delay(close, 1)) - 1.0) - mean((close / delay(close, 1)) - 1.0, 20)) - ((dailyMean((close / delay(close, 1)) - 1.0) - mean(dailyMean((close / delay(close, 1)) - 1.0), 20)) ^ 2), 20) / sum((dailyMean((close / delay(close, 1)) - 1.0) - mean(dailyMean((close / delay(close, 1)) - 1.0), 20)) ^ 3, 20)"),
    ("gtja_182", "benchmark", "normal", 0, "sum((close > open) == (dailyMean(close) > dailyMean(open)), 20) / 20.0"),
    ("gtja_183", "volatility", "normal", 1, "ts_max(sum(close - mean(close, 24), 24), 24) - (ts_min(sum(close - mean(close, 24), 24), 24) / std(close, 24))"),
    ("gtja_184", "correlation", "normal", 0, "rank(corr(delay(open - close, 1), close, 200)) + rank(open - close)"),
    ("gtja_185", "momentum", "reverse", 0, "rank(-1.0 * ((1.0 - (open / close)) ^ 2))"),
    ("gtja_186", "momentum", "normal", 0, "(mean((abs(minus_di - plus_di) / (minus_di + plus_di)) * 100.0, 6) + delay(mean((abs(minus_di - plus_di) / (minus_di + plus_di)) * 100.0, 6), 6)) / 2.0"),
    ("gtja_187", "momentum", "normal", 0, "sum(up_range, 20)"),
    ("gtja_188", "volatility", "normal", 0, "(((high - low) - sma(high - low, 11, 2)) / sma(high - low, 11, 2)) * 100.0"),
    ("gtja_189", "volatility", "normal", 0, "mean(abs(close - mean(close, 6)), 6)"),
    ("gtja_190", "momentum", "normal", 0, "log(((count(((close / delay(close, 1)) - 1.0) > (((close / delay(close, 19)) ^ (1.0 / 20.0)) - 1.0), 20) - 1.0) * sumif((((close / delay(close, 1)) - 1.0) - (((close / delay(close, 19)) ^ (1.0 / 20.0)) - 1.0)) ^ 2, 20, ((close / delay(close, 1)) - 1.0) < (((close / delay(close, 19)) ^ (1.0 / 20.0)) - 1.0))) / ((count(((close / delay(close, 1)) - 1.0) < (((close / delay(close, 19)) ^ (1.0 / 20.0)) - 1.0), 20) * sumif((((close / delay(close, 1)) - 1.0) - (((close / delay(close, 19)) ^ (1.0 / 20.0)) - 1.0)) ^ 2, 20, ((close / delay(close, 1)) - 1.0) > (((close / delay(close, 19)) ^ (1.0 / 20.0)) - 1.0))) + 1e-12))"),
    ("gtja_191", "volume", "normal", 1, "(corr(mean(volume, 20), low, 5) + ((high + low) / 2.0)) - close"),
]
# fmt: on
