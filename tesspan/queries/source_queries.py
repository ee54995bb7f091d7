"""Queries of sources, sinks, wide joins, records, streams and the user-function surface."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import col, ts_mean
from ..functions.shared import shared, shared_path
from ..operators import factors
from ..plans.columns import computed
from ..sources import export
from ..sources import warehouse as w
from ..sources.embedded import DRIVER, embedded_database
from ..sources.panel import PANEL_SQL, TRAINING_SQL, training_panel
from ..streaming import tail
from ..streaming.lines import appended_metrics
from ..streaming.liveness import current, liveness
from ..streaming.sink import BatchTable
from .base import final, out, panel


def _tables(spark, sf_dir, *names):
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def scan_prune(spark, sf_dir):
    df = w.read_panel(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_shipdate"])
    return df.where("l_shipdate >= '1997-01-01' AND l_shipdate < '1997-02-01'").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"))


def template(spark, sf_dir):
    orders, customer = _tables(spark, sf_dir, "orders", "customer")
    orders.createOrReplaceTempView("tesspan_orders")
    customer.createOrReplaceTempView("tesspan_customer")
    text = """
      WITH base AS (SELECT c_custkey, c_mktsegment, c_name FROM tesspan_customer WHERE c_mktsegment = :segment OR c_name LIKE :pattern)
      SELECT b.c_mktsegment AS segment, count(*) AS n, sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS total
      FROM base b JOIN tesspan_orders o ON o.o_custkey = b.c_custkey
      WHERE o.o_orderdate >= to_timestamp(:start) AND o.o_orderdate <= to_timestamp(:end) AND o.o_orderpriority IS NOT NULL GROUP BY 1"""
    df = w.run_template(spark, text, segment="BUILDING", pattern="%00001%", start="1996-01-01", end="1998-12-31")
    return out(df.withColumn("total", F.col("total").cast("double")))


def universe(name):
    return lambda spark, sf_dir: w.in_universe(training_panel(spark, sf_dir), name).groupBy("ts_code").agg(F.count(F.lit(1)).alias("n"))


def wide(spark, sf_dir):
    t = training_panel(spark, sf_dir)
    fact = t.select("ts_code", "trade_date", "close", "vol").where("trade_date BETWEEN '1996-01-01' AND '1997-12-31'")
    static = t.groupBy("ts_code").agg(F.max("name").alias("name"), F.max("industry_code").alias("industry_code"))
    alpha = t.select("ts_code", "trade_date", "alpha_001").where("alpha_001 < 2")
    flow = t.select("ts_code", "trade_date", "mfp_000").where("vol > 0")
    mood = t.groupBy("trade_date").agg(F.count_if(F.col("pct_chg") > 0.1).alias("senti_up"))
    sector = t.groupBy("industry_code", "trade_date").agg(F.avg("pct_chg").alias("ind_change"))
    df = w.wide_join(fact, static, {"alpha": alpha, "flow": flow}, {"mood": mood}, {"sector": sector})
    return out(df.select("ts_code", "trade_date", "name", F.col("industry_code").cast("int").alias("industry_code"), F.col("senti_up"), "close", "vol", "alpha_001", "mfp_000", "ind_change"))


def membership(spark, sf_dir):
    t = training_panel(spark, sf_dir)
    a, b = t.where("is_hs300 AND vol > 300").select("trade_date", "ts_code"), t.where("is_zz500").select("trade_date", "ts_code")
    return w.with_membership(w.with_membership(t.select("ts_code", "trade_date"), a, "in_a"), b, "in_b")


def prefixes(spark, sf_dir):
    return w.prefix_coverage(training_panel(spark, sf_dir))


def _records(spark, sf_dir, *more):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    pick = F.element_at(F.array(F.lit("PPO"), F.lit("A2C"), F.lit("SAC"), F.lit("OTHER")), (F.col("user_id") % 4 + 1).cast("int"))
    return ev.select(
        *more, F.col("event_id").alias("timestep"), F.col("value").alias("episode_reward_mean"), (F.col("event_id") % 500).alias("fps"),
        pick.alias("algorithm"), F.when(F.col("event_id") % 9 == 0, 0.0).otherwise(0.001).alias("learning_rate"),
    )


def metrics(spark, sf_dir):
    return out(w.metrics_summary(w.valid_metrics(_records(spark, sf_dir)).withColumn("kind", F.col("algorithm")), ["kind"]))


def json_round_trip(spark, sf_dir):
    path = shared_path(spark, "records")
    rows = _records(spark, sf_dir)
    w.append_json(rows.where("timestep % 2 = 0"), path)
    w.append_json(rows.where("timestep % 2 = 1"), path)
    w.append_json(spark.range(3).select(F.lit("not a record").alias("timestep")), path)
    return out(w.metrics_summary(w.read_metrics(spark, path)))


def parquet_round_trip(spark, sf_dir):
    path = shared_path(spark, "panel")
    w.write_panel(training_panel(spark, sf_dir), path, by_month=True)
    back = w.read_panel(spark, path, ["ts_code", "trade_date", "close", "alpha_001"], "1997-03-01", "1997-06-30")
    return out(back)


def database(spark, sf_dir):
    """Suppliers put in an embedded database and read back by a query, in ranges of keys at once."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("int").alias("K"), F.col("s_nationkey").cast("int").alias("N"), F.col("s_acctbal").cast("double").alias("B"))
    url = embedded_database(spark, {"SUPPLIERS": (rows, "K INTEGER, N INTEGER, B DOUBLE")})
    low, high = rows.agg(F.min("K"), F.max("K")).first()
    back = w.read_database(spark, url, "SELECT K, N, B FROM SUPPLIERS WHERE N < 15", DRIVER, split=("K", str(low or 0), str((high or 0) + 1), 4))
    return out(back.groupBy(F.col("N").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.max("B").alias("top")))


def database_export(spark, sf_dir):
    """The training panel put in an embedded database and exported by a query with parameters, in ten ranges of dates at once."""
    rows = training_panel(spark, sf_dir).select("ts_code", "trade_date", "close", "pct_chg", "vol", "is_st", "name", "alpha_001")
    columns = 'TS_CODE VARCHAR(16), TRADE_DATE DATE, "CLOSE" DOUBLE, PCT_CHG DOUBLE, VOL DOUBLE, IS_ST BOOLEAN, NAME VARCHAR(64), ALPHA_001 DOUBLE'
    url = embedded_database(spark, {"QUOTES": (rows, columns)})
    text = """
      SELECT ts_code, trade_date, "CLOSE", pct_chg, vol, is_st, name, alpha_001 FROM QUOTES -- :not_a_parameter
      WHERE trade_date BETWEEN :start_date AND :end_date AND vol > :least AND name <> :odd_name AND ts_code NOT IN :codes;"""
    values = {"least": 100.0, "odd_name": "it's :start_date", "codes": ["600005.SH", "000001.SZ"]}
    got = export.export_panel(spark, url, text, dt.date(1996, 1, 1), dt.date(1998, 6, 30), "main_board_non_st", values, 10, DRIVER)
    return out(got.select("ts_code", "trade_date", "name", "close", "pct_chg", "vol", "alpha_001"))


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _event_stream(spark, sf_dir):
    return spark.readStream.schema(_events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parque[t]")


def _in_slices(spark, sf_dir, at, slices=4):
    """The events in a folder, in files by time of arrival, which is up to half an hour after their own; a stream takes one a batch."""
    rows = _events(spark, sf_dir).withColumn("came", F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(1800)))
    low, high = rows.agg(F.min("came"), F.max("came")).first()
    part = F.floor((F.col("came") - F.lit(low or 0)) * slices / F.lit((high or 0) - (low or 0) + 1))
    for k in range(slices):
        rows.where(part == k).drop("came").coalesce(1).write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema(_events(spark, sf_dir).schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def stream_windows(spark, sf_dir):
    """Hourly counts of the events stream, without state: each batch appends its own sums once, and reading adds them up."""
    at = shared_path(spark, "stream")
    parts = BatchTable(spark, f"{at}/sums", tail.windowed_events(_events(spark, sf_dir)).schema)
    tail.follow(_event_stream(spark, sf_dir), lambda batch, k: parts.put(tail.windowed_events(batch), k), f"{at}/checkpoint").awaitTermination()
    got = parts.read().groupBy("window_start", "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return out(got.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", "total"))


def stream_closed_windows(spark, sf_dir):
    """Hourly counts in append mode: a window leaves the state for the table once the watermark has passed it, whatever was late by under an hour."""
    at = shared_path(spark, "closed")
    windows = tail.windowed_events(_in_slices(spark, sf_dir, at))
    closed = BatchTable(spark, f"{at}/windows", windows.schema)

    def put(batch, k):
        closed.put(batch, k)
        closed.put(batch, k)  # as after a failure between the write and the checkpoint

    tail.follow(windows, put, f"{at}/checkpoint").awaitTermination()
    return out(closed.read().select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", "total"))


def stream_tail(spark, sf_dir):
    """Records appended as JSON lines, followed as a stream into a table from which the summary is read."""
    at = shared_path(spark, "tail")
    rows = _records(spark, sf_dir)
    for k in range(3):
        w.append_json(rows.where(f"timestep % 3 = {k}").coalesce(1), f"{at}/in")
    stream = tail.tail_metrics(spark, f"{at}/in", 1)
    records = BatchTable(spark, f"{at}/records", stream.schema)
    tail.follow(stream, records.put, f"{at}/checkpoint").awaitTermination()
    return out(w.metrics_summary(records.read()))


def _append_logs(pieces, root):
    """Append pieces (run, nth, at, piece) to a log file for each run, one writer a run; at is a piece's place in its file, so done again it writes the same bytes at the same place."""
    root = root.removeprefix("file://")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(root, exist_ok=True)
        last, file = None, None
        for pdf in batches:
            for run, at, piece in zip(pdf["run"], pdf["at"], pdf["piece"]):
                if run != last:
                    if file:
                        file.close()
                    last, file = run, os.fdopen(os.open(f"{root}/run={run}.jsonl", os.O_WRONLY | os.O_CREAT, 0o644), "wb")
                    file.seek(at)
                file.write(piece.encode())
        if file:
            file.close()
        yield pd.DataFrame({"done": [0]})

    dealt = pieces.repartition("run").sortWithinPartitions("run", "nth")
    dealt.mapInPandas(write, "done int").write.format("noop").mode("overwrite").save()


def stream_run_logs(spark, sf_dir, rounds=3):
    """A log file for each run (user), appended to in rounds that end in the middle of a line, followed by byte offsets in small batches
    while it grows; after the second round the stream is stopped and goes on from its checkpoint."""
    at = shared_path(spark, "logs")
    line = F.to_json(F.struct("timestep", "episode_reward_mean", "fps", "algorithm", "learning_rate"))
    rows = _records(spark, sf_dir, F.coalesce(F.col("user_id").cast("string"), F.lit("none")).alias("run"))
    rows = rows.select("run", F.coalesce(F.pmod("timestep", F.lit(rounds)), F.lit(0)).alias("round"), F.col("timestep").alias("nth"), F.concat(line, F.lit("\n")).alias("line"))
    in_file = Window.partitionBy("run").orderBy("round", "nth")
    rows = rows.withColumn("ends", F.coalesce(F.lead("round").over(in_file) != F.col("round"), F.lit(True)))
    half = F.floor(F.length("line") / 2).cast("int")
    cut = F.when(F.col("ends"), F.array(
        F.struct("round", "nth", F.substring("line", F.lit(1), half).alias("piece")),
        F.struct((F.col("round") + 1).alias("round"), F.lit(-1).cast("long").alias("nth"), F.substring("line", half + 1, F.length("line")).alias("piece")),
    )).otherwise(F.array(F.struct("round", "nth", F.col("line").alias("piece"))))
    before = F.sum(F.octet_length("piece")).over(in_file.rowsBetween(Window.unboundedPreceding, -1))
    pieces = rows.select("run", F.inline(cut)).withColumn("at", F.coalesce(before, F.lit(0)))
    pieces.write.partitionBy("round").parquet(f"{at}/pieces")  # a round reads its own
    pieces = spark.read.schema(pieces.schema).parquet(f"{at}/pieces")
    stream = appended_metrics(spark, f"{at}/in", maxBytesPerTrigger=200_000)
    records = BatchTable(spark, f"{at}/records", stream.schema)
    following = None
    for k in range(rounds + 1):
        _append_logs(pieces.where(F.col("round") == k), f"{at}/in")
        following = following or tail.follow(stream, records.put, f"{at}/checkpoint", every="0 seconds")
        following.processAllAvailable()
        if k in (1, rounds):
            following.stop()
            following = None
    run = F.regexp_extract("path", r"run=(-?\d+)\.jsonl$", 1).try_cast("long").alias("run")
    return out(w.metrics_summary(records.read().select(run, *[c for c in stream.columns if c not in ("path", "start")]), ["run"]))


SILENCE_HOURS = 6


def stream_liveness(spark, sf_dir):
    """When each run (user) was live: from a record until none has come for six hours; open intervals are still live."""
    at = shared_path(spark, "live")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        records = _in_slices(spark, sf_dir, at).select(F.col("user_id").alias("run"), "ts")
        states = liveness(records, SILENCE_HOURS * 3600, "1 hour")
        table = BatchTable(spark, f"{at}/intervals", states.schema)
        tail.follow(states, table.put, f"{at}/checkpoint", mode="update").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return current(table.read()).select(F.col("run").cast("long").alias("run"), text("live_from"), text("last_record"), "n", "live")


def user_factor(spark, sf_dir):
    """A factor that a user writes and registers, computed beside one of the catalogue."""
    text = "cs_rank(ts_mean(close / open, 5)) - ts_rank(volume, 6)"
    mine = factors.register(factors.Factor("user_strength", "alpha101", "user", "normal", 0, text))
    return out(computed(panel(spark, sf_dir), {"user_strength": mine.expression, "alpha101": factors.factor("alpha101").expression}))


def _spread(high, low):
    def spread(high: pd.Series, low: pd.Series) -> pd.Series:
        return (high - low) / low

    return F.pandas_udf(spread, "double")(high, low)


def _since_high(close, window):
    """Weeks since the highest close of the last eight rows."""
    at = F.max(F.struct(close.alias("c"), F.col("trade_date").alias("d"))).over(window.rowsBetween(-7, 0))["d"]
    return F.datediff("trade_date", at).cast("double") / 7.0


def _share(volume, window):
    return volume / F.sum(volume).over(window)


def user_functions(spark, sf_dir):
    """Factors that a user writes as functions (of a row in Python, of a stock's days, of a day's stocks, one upon another) beside one of the catalogue, in one plan."""
    close, high, low, volume = map(col, ("close", "high", "low", "volume"))
    spread = factors.register_function("user_spread", _spread, high, low)
    since = factors.register_function("user_since_high", _since_high, close, side="stock")
    share = factors.register_function("user_share", _share, volume, side="day")
    mixed = ts_mean(share.expression * spread.expression, 3)
    wanted = {f.id: f.expression for f in (spread, since, share)} | {"user_mixed": mixed, "alpha101": factors.factor("alpha101").expression}
    return out(computed(panel(spark, sf_dir), wanted))


def score_callback(spark, sf_dir):
    """A score function of the user's as a vectorised Python function."""

    @F.pandas_udf("double")
    def score(change: pd.Series, turnover: pd.Series) -> pd.Series:
        return (change.fillna(0.0) * 2.0 - turnover.fillna(1.0)).clip(-5.0, 5.0)

    df = training_panel(spark, sf_dir)
    return out(df.select("ts_code", "trade_date", score("pct_chg", "mfp_000").alias("score")))


QUERIES = {
    "source_scan_pruned": scan_prune,
    "source_sql_template": template,
    "source_universe_all": universe("all_a"),
    "source_universe_main_board": universe("main_board_non_st"),
    "source_universe_hs300": universe("hs300"),
    "source_universe_zz500": universe("zz500"),
    "source_wide_join": wide,
    "source_membership_flags": membership,
    "source_prefix_summary": prefixes,
    "source_parquet_round_trip": parquet_round_trip,
    "source_json_round_trip": json_round_trip,
    "source_database": database,
    "source_database_export": database_export,
    "metrics_summary": metrics,
    "stream_hourly_events": stream_windows,
    "stream_metrics_tail": stream_tail,
    "stream_closed_windows": stream_closed_windows,
    "stream_run_logs": stream_run_logs,
    "stream_run_liveness": stream_liveness,
    "user_registered_factor": user_factor,
    "user_functions": user_functions,
    "user_score_callback": score_callback,
}

_REC = """rec AS (SELECT event_id AS timestep, value AS episode_reward_mean, event_id % 500 AS fps, ['PPO', 'A2C', 'SAC', 'OTHER'][user_id % 4 + 1] AS algorithm,
  CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE 0.001 END AS learning_rate FROM events), good AS (SELECT * FROM rec WHERE learning_rate > 0 AND algorithm <> 'OTHER')"""
_SUMMARY = """max(timestep) AS total_timesteps, max(episode_reward_mean) AS best_reward, arg_max(episode_reward_mean, timestep) AS final_reward,
  floor(avg(fps))::BIGINT AS mean_fps, count(*) AS n_checkpoints, arg_max(algorithm, timestep) AS algorithm"""
_ALL = final(_REC, f"SELECT {_SUMMARY} FROM good", "total_timesteps mean_fps n_checkpoints algorithm", "best_reward final_reward")
_U = "SELECT ts_code, count(*) AS n FROM training WHERE {} GROUP BY ts_code"
_MAIN = r"regexp_matches(ts_code, '^(60[0135]\d{3}\.SH|00[0123]\d{3}\.SZ)$')"
_W5 = "(PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"

ORACLES = {
    "source_scan_pruned": "SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem WHERE l_shipdate >= '1997-01-01' AND l_shipdate < '1997-02-01' GROUP BY 1",
    "source_sql_template": final(
        "",
        """SELECT c_mktsegment AS segment, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM customer JOIN orders ON o_custkey = c_custkey
           WHERE (c_mktsegment = 'BUILDING' OR c_name LIKE '%00001%') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' GROUP BY 1""",
        "segment n",
        "total",
    ),
    "source_universe_all": f"WITH {TRAINING_SQL} " + _U.format("TRUE"),
    "source_universe_main_board": f"WITH {TRAINING_SQL} " + _U.format(f"{_MAIN} AND NOT is_st"),
    "source_universe_hs300": f"WITH {TRAINING_SQL} " + _U.format("is_hs300"),
    "source_universe_zz500": f"WITH {TRAINING_SQL} " + _U.format("is_zz500"),
    "source_wide_join": final(
        TRAINING_SQL,
        """SELECT q.ts_code, q.trade_date, sb.name, sb.industry_code::INT AS industry_code, senti_up, q.close, q.vol, a.alpha_001, f.mfp_000, i.ind_change
           FROM training q LEFT JOIN (SELECT ts_code, max(name) AS name, max(industry_code) AS industry_code FROM training GROUP BY 1) sb ON sb.ts_code = q.ts_code
           LEFT JOIN (SELECT * FROM training WHERE alpha_001 < 2) a ON a.ts_code = q.ts_code AND a.trade_date = q.trade_date
           LEFT JOIN (SELECT * FROM training WHERE vol > 0) f ON f.ts_code = q.ts_code AND f.trade_date = q.trade_date
           LEFT JOIN (SELECT trade_date, count(*) FILTER (pct_chg > 0.1) AS senti_up FROM training GROUP BY 1) m ON m.trade_date = q.trade_date
           LEFT JOIN (SELECT industry_code, trade_date, avg(pct_chg) AS ind_change FROM training GROUP BY ALL) i ON i.industry_code = sb.industry_code AND i.trade_date = q.trade_date
           WHERE q.trade_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""",
        "ts_code trade_date name industry_code senti_up",
        "close vol alpha_001 mfp_000 ind_change",
    ),
    "source_membership_flags": f"WITH {TRAINING_SQL} SELECT ts_code, trade_date::VARCHAR AS trade_date, is_hs300 AND vol > 300 AS in_a, is_zz500 AS in_b FROM training",
    "source_database": final("", "SELECT s_nationkey::INT AS nation, count(*) AS n, max(s_acctbal)::DOUBLE AS top FROM supplier WHERE s_nationkey < 15 GROUP BY 1", "nation n", "top"),
    "source_prefix_summary": f"""WITH {TRAINING_SQL} SELECT prefix, count(DISTINCT name) AS n, count(*) FILTER (isfinite(value)) AS n_values FROM (
      SELECT unnest(['alpha_', 'alpha_', 'mf_', 'mfp_', 'gtja_']) AS prefix, unnest(['alpha_000', 'alpha_001', 'mf_000', 'mfp_000', 'gtja_000']) AS name, unnest([alpha_000, alpha_001, mf_000, mfp_000, gtja_000]) AS value FROM training) GROUP BY prefix""",
    "source_parquet_round_trip": final(TRAINING_SQL, "SELECT * FROM training WHERE trade_date BETWEEN DATE '1997-03-01' AND DATE '1997-06-30'", "ts_code trade_date", "close alpha_001"),
    "source_json_round_trip": _ALL,
    "metrics_summary": final(_REC, f"SELECT algorithm AS kind, {_SUMMARY} FROM good GROUP BY kind", "kind total_timesteps mean_fps n_checkpoints algorithm", "best_reward final_reward"),
    "stream_hourly_events": final("", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2", "window_start event_type n", "total"),
    "stream_metrics_tail": _ALL,
    "stream_closed_windows": final(
        "",
        """SELECT strftime(h, '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, sum(value) AS total
           FROM (SELECT *, date_trunc('hour', ts) AS h, date_trunc('milliseconds', max(ts) OVER ()) AS seen FROM events) WHERE h + INTERVAL 1 HOUR <= seen - INTERVAL 1 HOUR GROUP BY 1, 2""",
        "window_start event_type n",
        "total",
    ),
    "stream_run_logs": final(
        _REC.replace("SELECT event_id AS timestep", "SELECT user_id AS run, event_id AS timestep", 1),
        f"SELECT run, {_SUMMARY} FROM good GROUP BY run",
        "run total_timesteps mean_fps n_checkpoints algorithm",
        "best_reward final_reward",
    ),
    "stream_run_liveness": f"""WITH gaps AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL {SILENCE_HOURS} HOUR, TRUE) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      islands AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM gaps)
      SELECT user_id AS run, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS live_from, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_record, count(*) AS n,
        max(ts) + INTERVAL {SILENCE_HOURS} HOUR > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS live FROM islands GROUP BY user_id, k""",
    "user_registered_factor": final(
        PANEL_SQL
        + f""", m AS (SELECT *, CASE WHEN count(close) OVER {_W5.format(4)} = 5 THEN avg(close / open) OVER {_W5.format(4)} END AS a, list(volume) OVER {_W5.format(5)} AS l FROM panel)""",
        """SELECT stock_code, trade_date, (close - open) / (high - low + 0.001) AS alpha101,
           CASE WHEN a IS NOT NULL AND len(l) = 6 THEN (rank() OVER (PARTITION BY trade_date ORDER BY a NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, a) - 1) / 2.0) / count(a) OVER (PARTITION BY trade_date)
             - (len(list_filter(l, lambda v: v < volume)) + (len(list_filter(l, lambda v: v = volume)) + 1) / 2.0 - 1) / 5 END AS user_strength FROM m""",
        "stock_code trade_date",
        "user_strength alpha101",
    ),
    "user_score_callback": final(TRAINING_SQL, "SELECT ts_code, trade_date, least(greatest(coalesce(pct_chg, 0) * 2 - coalesce(mfp_000, 1), -5), 5) AS score FROM training", "ts_code trade_date", "score"),
    "user_functions": final(
        PANEL_SQL
        + """, m AS (SELECT *, (high - low) / low AS user_spread, volume / sum(volume) OVER (PARTITION BY trade_date) AS user_share,
             list({'c': close, 'd': trade_date}) OVER (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS l FROM panel)""",
        """SELECT stock_code, trade_date, user_spread, user_share, (trade_date - list_max(l).d) / 7.0 AS user_since_high, (close - open) / (high - low + 0.001) AS alpha101,
           CASE WHEN count(user_share) OVER w = 3 THEN avg(user_share * user_spread) OVER w END AS user_mixed FROM m
           WINDOW w AS (PARTITION BY stock_code ORDER BY trade_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
        "stock_code trade_date",
        "user_spread user_share user_since_high user_mixed alpha101",
    ),
    "source_database_export": final(
        TRAINING_SQL,
        f"""SELECT * FROM training WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30' AND vol > 100 AND ts_code NOT IN ('600005.SH', '000001.SZ') AND {_MAIN} AND NOT is_st""",
        "ts_code trade_date name",
        "close pct_chg vol alpha_001",
    ),
}
