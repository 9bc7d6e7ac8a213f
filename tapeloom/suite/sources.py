"""Sources, table maintenance, joins and streaming runs over the given tables (S*, J*, P1, P2, L22)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tapeloom.functions.scalars import normalize_code, parse_amount
from tapeloom.operators import joins
from tapeloom.session import shared_folder
from tapeloom.sources import bars as src
from tapeloom.sources import ticks as tsrc
from tapeloom.sources import warehouse as wh
from tapeloom.streaming import ticks as st
from tapeloom.suite.common import bars, out
from tapeloom.suite.quality import clean, dirty
from tapeloom.suite.sqlbase import S, i, r, sql

QUERIES, ORACLES = {}, {}


def normalize_bars(spark, d):
    raw = bars(spark, d).selectExpr("code", "CASE WHEN day(date) = 1 THEN 'bad' ELSE CAST(date AS STRING) END AS date", "CASE WHEN day(date) = 2 THEN 'x' ELSE CAST(open AS STRING) END AS open",
                                    "CAST(high AS STRING) AS high", "CAST(low AS STRING) AS low", "CAST(close AS STRING) AS close", "CAST(volume * (day(date) % 5) AS STRING) AS volume")
    return out(src.normalize_bars(raw), "code date open close volume")


QUERIES["normalize_bars"] = normalize_bars
ORACLES["normalize_bars"] = sql(f"SELECT code, date, {r('open close volume')} FROM (SELECT * REPLACE (volume*(day(date) % 5) AS volume) FROM bars) WHERE day(date) NOT IN (1, 2) AND volume > 0", "bars")


def upsert_bars(spark, d):
    cols = ("code", "date", "close", "volume")
    return out(src.upsert_bars(bars(spark, d).select(*cols), dirty(spark, d).select(*cols)), "code date close volume")


QUERIES["upsert_bars"] = upsert_bars
ORACLES["upsert_bars"] = sql(f"SELECT code, date, {r('close volume')} FROM (SELECT b.code, b.date, coalesce(d.close, b.close) AS close, coalesce(d.volume, b.volume) AS volume FROM bars b LEFT JOIN dirty d ON d.code = b.code AND d.date = b.date)", "dirty")


def instruments(spark, d):
    return src.list_instruments(bars(spark, d), ["00000", "00001"])


QUERIES["instruments"] = instruments
ORACLES["instruments"] = sql("SELECT DISTINCT code FROM bars WHERE code LIKE '00000%' OR code LIKE '00001%'", "bars")


def selection_universe(spark, d):
    s = wh.table(spark, d, "supplier").selectExpr(f"{normalize_code('s_suppkey')} AS code", "s_name AS name", "s_acctbal > 0 AS eligible")
    u = src.selection_universe(s.filter("NOT eligible"), s, bars(spark, d))
    return out(src.name_filter(src.with_policy(u.join(s.selectExpr("code", "name"), "code"))), "code asset_type exchange name_filter cap_gate price_limits")


QUERIES["selection_universe"] = selection_universe
ORACLES["selection_universe"] = sql(
    """SELECT lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(6, length(CAST(s_suppkey AS VARCHAR))) AS INT), '0') AS code, CASE WHEN s_acctbal > 0 THEN 'etf' ELSE 'stock' END AS asset_type, 'SZ' AS exchange, CAST(s_acctbal <= 0 AS INT) AS name_filter, CAST(s_acctbal <= 0 AS INT) AS cap_gate, CAST(s_acctbal <= 0 AS INT) AS price_limits FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey)"""
)


def exact_session(spark, d):
    last = bars(spark, d).groupBy("code").agg(F.max("date").alias("date"))
    return out(src.exact_session(dirty(spark, d), last), "code date volume")


QUERIES["exact_session"] = exact_session
ORACLES["exact_session"] = sql(f"SELECT code, date, {r('volume')} FROM dirty d WHERE date = (SELECT max(date) FROM bars b WHERE b.code = d.code)", "dirty")


def concept_bridge(spark, d):
    m = wh.membership(spark, d).groupBy("block").agg(F.expr("to_json(map(block, collect_list(concat('sz', code))))").alias("payload"))
    return src.concept_bridge(m)


QUERIES["concept_bridge"] = concept_bridge
ORACLES["concept_bridge"] = sql("SELECT DISTINCT block, code FROM membership", "membership")


def daily_returns(spark, d):
    b = bars(spark, d)
    old = src.daily_returns(dirty(spark, d), None, 400)
    return out(src.daily_returns(b, old, 60), "*")


QUERIES["daily_returns"] = daily_returns
ORACLES["daily_returns"] = sql(
    f"""SELECT code, date, {r('ret')} FROM (SELECT code, date, coalesce(n.ret, o.ret) AS ret FROM (SELECT * FROM (SELECT code, date, (close/lag(close) OVER {S} - 1)*100 AS ret FROM dirty) WHERE ret IS NOT NULL AND date >= (SELECT min(date) FROM (SELECT DISTINCT date FROM dirty ORDER BY date DESC LIMIT 400))) o
FULL JOIN (SELECT * FROM (SELECT code, date, (close/lag(close) OVER {S} - 1)*100 AS ret FROM bars) WHERE ret IS NOT NULL AND date >= (SELECT min(date) FROM (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 60))) n USING (code, date))""",
    "dirty",
)


def market_listing(spark, d):
    b = src.drop_incomplete_bar(bars(spark, d), datetime(2001, 5, 7, 10, 0))
    return out(src.paged_listing(b, 0, 50), "*")


QUERIES["market_listing"] = market_listing
ORACLES["market_listing"] = sql(f"SELECT code, last_date, {r('last_close')}, sessions FROM (SELECT code, max(date) AS last_date, arg_max(close, date) AS last_close, count(*) AS sessions FROM bars WHERE date <> DATE '2001-05-07' GROUP BY code ORDER BY code LIMIT 50)", "bars")


def trading_calendar(spark, d):
    return src.trading_calendar(bars(spark, d), "1996-01-01", "1999-12-31")


QUERIES["trading_calendar"] = trading_calendar
ORACLES["trading_calendar"] = sql("SELECT DISTINCT date FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", "bars")


def universe_summary(spark, d):
    return src.universe_summary(bars(spark, d), 5)


QUERIES["universe_summary"] = universe_summary
ORACLES["universe_summary"] = sql("SELECT substring(code, 1, 5) AS prefix, count(DISTINCT code) AS codes FROM bars GROUP BY 1", "bars")


def report_table(spark, d):
    t = wh.table(spark, d, "lineitem")
    return out(src.report_table(t, "l_linestatus", "l_returnflag", "l_quantity", ["A", "N", "R"]), "*")


QUERIES["report_table"] = report_table
ORACLES["report_table"] = sql("""SELECT l_linestatus, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS "A", round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS "N", round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS "R" FROM lineitem GROUP BY 1""")


def parsed_amounts(spark, d):
    t = wh.table(spark, d, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN concat(o_totalprice, '亿') WHEN 1 THEN concat(o_totalprice, '万') WHEN 2 THEN CAST(o_totalprice AS STRING) ELSE '--' END AS text", "concat(o_custkey, '.0') AS c")
    return out(t.selectExpr("o_orderkey", f"{parse_amount('text')} AS amount", f"{normalize_code('c')} AS code"), "*")


QUERIES["parsed_amounts"] = parsed_amounts
ORACLES["parsed_amounts"] = sql("SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice/10000 WHEN 2 THEN o_totalprice ELSE 0 END, 6) AS amount, lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(6, length(CAST(o_custkey AS VARCHAR))) AS INT), '0') AS code FROM orders")


def normalized_ticks(spark, d):
    t = wh.table(spark, d, "events").selectExpr("user_id", "event_id AS SequenceNo", "value AS LastPrice", "CASE WHEN event_id % 9 > 0 THEN CAST(event_id % 10 AS INT) END AS Qty", "CAST(event_id % 3 AS INT) AS Side")
    return out(tsrc.normalize_ticks(t, {"SequenceNo": "seq", "LastPrice": "price", "Qty": "volume", "Side": "direction"}), "seq price volume amount direction")


QUERIES["normalized_ticks"] = normalized_ticks
ORACLES["normalized_ticks"] = sql(
    f"SELECT seq, {r('price')}, volume, round(price*q, 6) AS amount, direction FROM (SELECT event_id AS seq, value AS price, CASE WHEN event_id % 9 > 0 THEN CAST(event_id % 10 AS INT) END AS q, coalesce(CASE WHEN event_id % 9 > 0 THEN CAST(event_id % 10 AS INT) END, 0) AS volume, CAST(CASE event_id % 3 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS INT) AS direction FROM events)"
)


def asof_shares(spark, d):
    """Latest order of the customer with the supplier's key, as of each bar."""
    changes = wh.table(spark, d, "orders").selectExpr(f"{normalize_code('o_custkey')} AS code", "CAST(o_orderdate AS DATE) AS cdate", "o_orderkey", "o_totalprice AS shares")
    per_day = changes.groupBy("code", "cdate").agg(F.expr("max_by(shares, o_orderkey)").alias("shares"))
    b = bars(spark, d).select("code", "date", "volume")
    return out(joins.asof_join(b, per_day, "code", "date", "cdate", ["shares"], bucket="year").withColumnRenamed("asof_time", "as_of"), "*")


QUERIES["asof_shares"] = asof_shares
ORACLES["asof_shares"] = sql(
    f"""SELECT code, date, {r('volume shares')}, as_of FROM (SELECT b.code, b.date, b.volume, c.cdate AS as_of, c.shares FROM bars b ASOF LEFT JOIN (SELECT lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(6, length(CAST(o_custkey AS VARCHAR))) AS INT), '0') AS code, CAST(o_orderdate AS DATE) AS cdate, arg_max(o_totalprice, o_orderkey) AS shares FROM orders GROUP BY 1, 2) c ON c.code = b.code AND b.date >= c.cdate)""",
    "bars",
)


def enriched_bars(spark, d):
    """Uniqueness-checked lookups and a bridge join with unmatched members named."""
    b = clean(spark, d).select("code", "date", "close")
    e = joins.lookup(b, dirty(spark, d).selectExpr("code", "date", "amount"), ["code", "date"])
    blocks = wh.industry(spark, d).filter("industry LIKE '%1%'")
    return out(e.join(blocks, "code", "left").selectExpr("code", "date", "amount", "coalesce(industry, 'UNKNOWN') AS industry"), "*")


QUERIES["enriched_bars"] = enriched_bars
ORACLES["enriched_bars"] = sql(
    f"SELECT code, date, {r('amount')}, coalesce(industry, 'UNKNOWN') AS industry FROM (SELECT b.code, b.date, d.amount, n.industry FROM bars b LEFT JOIN dirty d ON d.code = b.code AND d.date = b.date LEFT JOIN (SELECT * FROM industry WHERE industry LIKE '%1%') n ON n.code = b.code)", "dirty", "industry"
)


def concept_resonance(spark, d):
    """Largest share of a block's members that jumped within two sessions of each jump."""
    jumps = bars(spark, d).selectExpr("code", "date", "close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS ret").filter("ret > 0.5")
    return out(joins.concept_resonance(jumps, wh.membership(spark, d), 14), "code date resonance")


QUERIES["concept_resonance"] = concept_resonance
ORACLES["concept_resonance"] = sql(
    f"""SELECT code, date, round(max(n/m), 6) AS resonance FROM (SELECT j.code, j.date, j.block, count(DISTINCT p.code) AS n, any_value(s.m) AS m FROM jm j JOIN jm p ON p.block = j.block AND abs(p.date - j.date) <= 14 JOIN (SELECT block, count(*) AS m FROM membership GROUP BY block) s ON s.block = j.block GROUP BY ALL) GROUP BY code, date""",
    "bars",
    "membership",
).replace("\nSELECT code, date, round", f",\njm AS MATERIALIZED (SELECT code, date, block FROM (SELECT code, date, close/lag(close) OVER {S} - 1 AS ret FROM bars) JOIN membership USING (code) WHERE ret > 0.5)\nSELECT code, date, round", 1).replace("\nSELECT code, date, (CASE", f",\njm AS MATERIALIZED (SELECT code, date, block FROM (SELECT code, date, close/lag(close) OVER {S} - 1 AS ret FROM bars) JOIN membership USING (code) WHERE ret > 0.5)\nSELECT code, date, (CASE", 1)


EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _stream(spark, d):
    raw = st.ticks_stream(spark, d, EVENTS, "events.parquet")
    ticks = raw.selectExpr(
        "CAST(ts AS TIMESTAMP) AS time", "lpad(CAST(user_id AS STRING), greatest(6, length(CAST(user_id AS STRING))), '0') AS code", "event_id AS seq", "CAST(event_id % 10 + 1 AS DOUBLE) AS volume",
        "CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS direction")
    return ticks.withWatermark("time", st.WATERMARK)


def streamed_intensity(spark, d):
    """Final one-hour windows of the event stream, written by a restartable query."""
    folder = shared_folder(spark, "stream")
    st.run_to_table(st.intensity_stream(_stream(spark, d), "1 hour"), f"{folder}/table", f"{folder}/state")
    return spark.read.parquet(f"{folder}/table")


QUERIES["streamed_intensity"] = streamed_intensity
ORACLES["streamed_intensity"] = sql(
    """SELECT lpad(CAST(user_id AS VARCHAR), CAST(greatest(6, length(CAST(user_id AS VARCHAR))) AS INT), '0') AS code, date_trunc('hour', ts) AS slot, count(*) AS ticks, sum(event_id % 10 + 1.0::DOUBLE) AS volume, sum((event_id % 10 + 1.0::DOUBLE)*CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS delta
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 MINUTE FROM events) GROUP BY 1, 2"""
)


def streamed_whale_runs(spark, d):
    """Runs of net buying per code, from a stream over its daily feature rows."""
    folder = shared_folder(spark, "whales")
    events = wh.table(spark, d, "events")
    net = "sum(CASE event_type WHEN 'purchase' THEN 1D WHEN 'error' THEN -1D ELSE 0D END * (event_id % 10 + 1)) AS net_buy_vol"
    daily = events.groupBy(F.expr("CAST(user_id AS STRING)").alias("code"), F.expr("CAST(ts AS DATE)").alias("date")).agg(F.expr(net))
    daily.write.parquet(f"{folder}/daily")
    stream = spark.readStream.schema(daily.schema).parquet(f"{folder}/daily")
    st.run_to_table(st.whale_stream(stream), f"{folder}/table", f"{folder}/state")
    return out(spark.read.parquet(f"{folder}/table"), "*")


QUERIES["streamed_whale_runs"] = streamed_whale_runs
ORACLES["streamed_whale_runs"] = sql(
    f"""SELECT code, date, CAST(ups AS INT) AS net_buy_days, {r('net_volume')} FROM (SELECT *, count(*) FILTER (v > 0) OVER f AS ups, sum(v) OVER f AS net_volume FROM (
SELECT CAST(user_id AS VARCHAR) AS code, CAST(ts AS DATE) AS date, sum(CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'error' THEN -1 ELSE 0 END*(event_id % 10 + 1)) AS v FROM events GROUP BY ALL)
WINDOW f AS (PARTITION BY code ORDER BY date ROWS 4 PRECEDING)) WHERE ups >= 2 AND v > 0"""
)
