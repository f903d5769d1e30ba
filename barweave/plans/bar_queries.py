"""Queries of the bar, join, calendar and account operators, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import accounts, bars, search
from ..sources import files, panels
from ..streaming import ticks
from . import duck
from .factor_queries import published

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_D = "strftime(date, '%Y-%m-%d') AS date"


def query(sql: str | None = None):
    def mark(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: published(function(spark, sf_dir))
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return mark


def _r(*names: str) -> str:
    return ", ".join(f"{duck.rounded(n)} AS {n}" for n in names)


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one-row bars."""
    v = F.col("value")
    return panels.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), v.alias("open"), v.alias("high"), v.alias("low"), v.alias("close"), F.lit(1.0).alias("volume"), v.alias("amount"), F.col("user_id").cast("double").alias("oi"))


@query(f"WITH {duck.PANEL_E} SELECT {_D}, symbol, {_r('open', 'high', 'low', 'close', 'volume', 'amount', 'oi')} FROM panel")
def bars_of_events(spark, sf_dir):
    return panels.event_bars(spark, sf_dir)


@query(f"WITH {duck.PANEL_L_FULL} SELECT {_D}, symbol, {_r('open', 'high', 'low', 'close', 'volume', 'amount', 'oi')} FROM panel")
def bars_of_shipments_complete(spark, sf_dir):
    return panels.complete(panels.shipment_bars(spark, sf_dir))


_TRADING = """trading AS (SELECT event_type AS symbol, ts, event_id, value, user_id, CAST(ts AS DATE) AS day, isodow(ts) - 1 AS wd, hour(ts) >= 12 AS late FROM events),
 dated AS (SELECT *, day + CAST(CASE WHEN late THEN CASE WHEN wd >= 4 THEN 7 - wd ELSE 1 END ELSE CASE WHEN wd >= 5 THEN 7 - wd ELSE 0 END END AS INTEGER) AS date FROM trading)"""


@query(f"WITH {_TRADING} SELECT symbol, strftime(date, '%Y-%m-%d') AS date, {', '.join(f'{duck.rounded(x)} AS {n}' for x, n in (('arg_min(value, ts)', 'open'), ('max(value)', 'high'), ('min(value)', 'low'), ('arg_max(value, ts)', 'close'), ('count(*)::DOUBLE', 'volume'), ('arg_max(user_id, ts)::DOUBLE', 'oi'), ('sum(value)', 'amount')))} FROM dated GROUP BY symbol, date")
def bars_resample_daily(spark, sf_dir):
    return bars.resample_daily(_ticks(spark, sf_dir))


@query(
    """WITH RECURSIVE t AS (SELECT event_type AS symbol, ts, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    f(symbol, i, ts, anchor) AS (SELECT symbol, i, ts, ts FROM t WHERE i = 1 UNION ALL SELECT t.symbol, t.i, t.ts, CASE WHEN date_diff('microsecond', f.anchor, t.ts) >= 14400000000 THEN t.ts ELSE f.anchor END FROM f JOIN t ON t.symbol = f.symbol AND t.i = f.i + 1)
    SELECT symbol, strftime(anchor, '%Y-%m-%d %H:%M:%S') AS start, count(*)::DOUBLE AS volume, """
    + f"{duck.rounded('arg_min(value, i)')} AS open, {duck.rounded('max(value)')} AS high, {duck.rounded('min(value)')} AS low, {duck.rounded('arg_max(value, i)')} AS close FROM f JOIN t USING (symbol, i) GROUP BY symbol, anchor"
)
def bars_resample_anchored(spark, sf_dir):
    return bars.resample_anchored(_ticks(spark, sf_dir), 4 * 3600).select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start"), "open", "high", "low", "close", "volume")


_CONTRACTS = """contracts AS (SELECT CAST(s_nationkey AS VARCHAR) AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS contract,
  arg_max(l_extendedprice / l_quantity, row(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS close, sum(l_quantity) AS oi FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def _contracts(spark, sf_dir):
    rows = panels.table(spark, sf_dir, "lineitem").join(panels.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(F.col("s_nationkey").cast("string").alias("symbol"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"), F.col("l_suppkey").cast("string").alias("contract"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey").alias("seq"))
    return rows.groupBy("symbol", "date", "contract").agg(F.max_by("price", "seq").alias("close"), F.sum("l_quantity").alias("oi"))


@query(
    f"""WITH {_CONTRACTS}, main AS (SELECT *, lag(contract) OVER (PARTITION BY symbol ORDER BY date) AS old FROM (SELECT * FROM contracts QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY oi DESC, contract DESC) = 1)),
    g AS (SELECT m.symbol, m.date, m.contract, m.close, CASE WHEN m.old <> m.contract AND c.close IS NOT NULL THEN m.close - c.close ELSE 0 END AS gap FROM main m LEFT JOIN contracts c ON c.symbol = m.symbol AND c.date = m.date AND c.contract = m.old)
    SELECT {_D}, symbol, contract, {duck.rounded('close')} AS close, {duck.rounded('close + coalesce(sum(gap) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)')} AS adjusted FROM g"""
)
def bars_continuous_contract(spark, sf_dir):
    return bars.continuous(_contracts(spark, sf_dir))


_JUMPS = f"{duck.PANEL_L_OWN}, j AS (SELECT symbol, date, date_diff('day', lag(date) OVER (PARTITION BY symbol ORDER BY date), date) AS gap, abs(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1) AS jump FROM panel)"


@query(
    f"""WITH {_JUMPS}, q AS (SELECT symbol, count(*) AS n, count_if(gap > 21) AS gaps, count_if(jump >= 0.2 AND jump <= 0.5) AS outliers, count_if(jump > 0.5) AS rollovers, (date_diff('day', max(date), DATE '2001-11-30') > 49)::INT AS stale FROM j GROUP BY symbol)
    SELECT *, {duck.rounded('greatest(0.0, 100 - least(35.0, gaps * 100.0 / n * 3) - least(35.0, outliers * 100.0 / n * 5) - least(15.0, rollovers * 3.0) - stale * 20)')} AS score FROM q"""
)
def bars_quality(spark, sf_dir):
    return bars.quality(panels.shipment_bars(spark, sf_dir), 7, "2001-11-30")


@query(f"WITH {duck.PANEL_L_OWN}, x AS (SELECT *, CAST(symbol::INT % 3 AS VARCHAR) AS exchange FROM panel) SELECT exchange, count(*) AS n, count(DISTINCT symbol) AS symbols, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last FROM x GROUP BY ROLLUP (exchange)")
def bars_warehouse_statistics(spark, sf_dir):
    return bars.warehouse_statistics(panels.shipment_bars(spark, sf_dir).withColumn("exchange", (F.col("symbol").cast("int") % 3).cast("string")))


@query(f"WITH {duck.PANEL_L_OWN}, f AS (SELECT symbol, max(date) AS l, date_diff('day', max(date), DATE '2001-11-30') AS days FROM panel GROUP BY symbol) SELECT symbol, strftime(l, '%Y-%m-%d') AS last, days::INT AS days, CASE WHEN days <= 1 THEN 'fresh' WHEN days <= 7 THEN 'recent' WHEN days <= 30 THEN 'stale' ELSE 'old' END AS class FROM f")
def bars_freshness(spark, sf_dir):
    return bars.freshness(panels.shipment_bars(spark, sf_dir), "2001-11-30")


@query("SELECT user_id, event_type, event_id, round(value, 6) + 0.0 AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def bars_keep_last(spark, sf_dir):
    rows = panels.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return bars.keep_last(rows.withColumn("seq", F.col("event_id")), ["user_id", "event_type"], "seq").drop("seq")


@query("WITH o AS (SELECT o_custkey, max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END) AS new, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END) AS old FROM orders GROUP BY o_custkey) SELECT o_custkey, coalesce(new, old) AS o_orderkey FROM o")
def bars_upsert(spark, sf_dir):
    rows = panels.table(spark, sf_dir, "orders")
    side = lambda odd: rows.where(F.col("o_orderkey") % 2 == odd).groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return bars.upserted(side(0), side(1), ["o_custkey"])


@query(
    "WITH c AS (SELECT CAST(d AS DATE) AS day, isodow(d) <= 5 AND CAST(d AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-02-12') AS is_open FROM (SELECT unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS d FROM events)) "
    "SELECT strftime(day, '%Y-%m-%d') AS day, is_open, strftime(min(CASE WHEN is_open THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '%Y-%m-%d') AS next_open, "
    "strftime(max(CASE WHEN is_open THEN day END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '%Y-%m-%d') AS prev_open, sum(is_open::INT) OVER (ORDER BY day)::BIGINT AS n_open FROM c"
)
def calendar_days(spark, sf_dir):
    ends = panels.table(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi"))
    return bars.calendar(ends, ["2024-01-01", "2024-02-12"])


@query("WITH m AS (SELECT hour(ts) * 60 + minute(ts) AS m FROM events) SELECT CASE WHEN m >= 1260 OR m < 150 THEN 'NIGHT' WHEN m >= 540 AND m < 690 THEN 'MORNING' WHEN m >= 810 AND m < 900 THEN 'AFTERNOON' ELSE 'CLOSED' END AS session, count(*) AS n FROM m GROUP BY 1")
def calendar_sessions(spark, sf_dir):
    minute = F.hour("ts") * 60 + F.minute("ts")
    return panels.table(spark, sf_dir, "events").groupBy(bars.session_name(minute).alias("session")).agg(F.count(F.lit(1)).alias("n"))


def _sides(spark, sf_dir):
    """All events: those with even ids ask for what the user's odd ones held last."""
    rows = panels.table(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    return rows.where(even).select("user_id", "ts", "event_id"), rows.where(~even).groupBy("user_id", "ts").agg(F.max("value").alias("value"))


def _as_of_sql(compare: str, pick: str) -> str:
    return f"""WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
    SELECT a.event_id, {duck.rounded(f'{pick}(b.value, b.ts)')} AS value FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts {compare} a.ts GROUP BY a.event_id"""


@query(_as_of_sql("<=", "arg_max"))
def join_as_of(spark, sf_dir):
    return bars.as_of(*_sides(spark, sf_dir), "user_id", "ts", "value").select("event_id", "value")


@query(_as_of_sql("<", "arg_max"))
def join_as_of_strict(spark, sf_dir):
    return bars.as_of(*_sides(spark, sf_dir), "user_id", "ts", "value", strict=True).select("event_id", "value")


@query(_as_of_sql(">=", "arg_min"))
def join_as_of_forward(spark, sf_dir):
    return bars.as_of(*_sides(spark, sf_dir), "user_id", "ts", "value", forward=True).select("event_id", "value")


@query(f"WITH {duck.PANEL_L_OWN} SELECT strftime(a.date, '%Y-%m-%d') AS date, {', '.join(f'{duck.rounded(f'a.{c} - b.{c}')} AS {c}' for c in ('open', 'high', 'low', 'close'))}, {duck.rounded('least(a.volume, b.volume)')} AS volume FROM panel a JOIN panel b ON a.date = b.date WHERE a.symbol = '1' AND b.symbol = '2'")
def join_spread(spark, sf_dir):
    rows = panels.shipment_bars(spark, sf_dir)
    return bars.spread(rows.where("symbol = '1'"), rows.where("symbol = '2'"))


_BOOKS = "l AS (SELECT l_partkey AS part, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), m AS (SELECT l_partkey AS part, sum(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)"


@query(f"WITH {_BOOKS} SELECT part, l.qty AS local, m.qty AS remote, CASE WHEN l.qty IS NULL THEN 'MISSING_LOCAL' WHEN m.qty IS NULL THEN 'MISSING_REMOTE' WHEN abs(l.qty - m.qty) <= greatest(1e-9, 1e-9 * abs(m.qty)) THEN 'OK' ELSE 'MISMATCH' END AS state FROM l FULL JOIN m USING (part)")
def join_reconcile(spark, sf_dir):
    lines = panels.table(spark, sf_dir, "lineitem")
    book = lambda flag: lines.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("qty"))
    return bars.reconciled(book("R"), book("A"), "part", "qty")


@query(f"WITH {duck.PANEL_L_OWN}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM panel) SELECT {_D}, symbol, CASE WHEN close / nullif(prev, 0) - 1 >= 0.1 - 1e-6 THEN 'up' WHEN close / nullif(prev, 0) - 1 <= -0.1 + 1e-6 THEN 'down' ELSE 'none' END AS state, {duck.rounded('prev * 1.1')} AS upper, {duck.rounded('prev * 0.9')} AS lower FROM p")
def bars_limit_days(spark, sf_dir):
    return bars.limit_days(panels.shipment_bars(spark, sf_dir))


# Accounts: trades of a book, made from order lines.
_TRADES = """trades AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS seq,
  CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END AS side, l_quantity AS volume, l_extendedprice / l_quantity AS price FROM lineitem)"""


def _trades(spark, sf_dir):
    lines = panels.table(spark, sf_dir, "lineitem")
    seq = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    return lines.select(F.col("l_suppkey").cast("string").alias("symbol"), seq.alias("seq"), F.when(F.col("l_returnflag") == "N", 1).otherwise(-1).alias("side"), F.col("l_quantity").alias("volume"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


@query(f"WITH {_TRADES} SELECT symbol, {duck.rounded('sum(side * volume)')} AS net, {duck.rounded('sum(volume * price)')} AS traded, count(*) AS n FROM trades GROUP BY symbol")
def account_net_positions(spark, sf_dir):
    return accounts.net_positions(_trades(spark, sf_dir))


@query(
    f"""WITH {_TRADES}, c AS (SELECT *, volume * price AS turnover FROM trades)
    SELECT symbol, seq, {duck.rounded('greatest(turnover * 0.0003, 5.0)')} AS commission, {duck.rounded('CASE WHEN side < 0 THEN turnover * 0.001 ELSE 0 END')} AS stamp, {duck.rounded('volume * 0.01')} AS slippage,
    {duck.rounded('greatest(turnover * 0.0003, 5.0) + CASE WHEN side < 0 THEN turnover * 0.001 ELSE 0 END + volume * 0.01')} AS cost FROM c"""
)
def account_costs(spark, sf_dir):
    return accounts.costs(_trades(spark, sf_dir), rate=0.0003, least=5.0, stamp=0.001, slippage=0.01).select("symbol", "seq", "commission", "stamp", "slippage", "cost")


@query(
    f"""WITH RECURSIVE {_TRADES.replace("trades AS (", "trades AS MATERIALIZED (", 1)}, f(symbol, seq, net, average, realised) AS (SELECT symbol, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM trades WHERE seq = 1
      UNION ALL SELECT t.symbol, t.seq, f.net + t.side * t.volume, CASE WHEN f.net * t.side * t.volume >= 0 THEN CASE WHEN f.net <> 0 OR t.volume <> 0 THEN (f.average * abs(f.net) + t.price * t.volume) / (abs(f.net) + t.volume) ELSE 0 END
        WHEN t.volume > abs(f.net) THEN t.price WHEN t.volume = abs(f.net) THEN 0 ELSE f.average END, f.realised + CASE WHEN f.net * t.side * t.volume < 0 THEN least(abs(f.net), t.volume) * (t.price - f.average) * sign(f.net) ELSE 0 END
      FROM f JOIN trades t ON t.symbol = f.symbol AND t.seq = f.seq + 1)
    SELECT symbol, {_r('net', 'average', 'realised')} FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) = 1"""
)
def account_average_cost(spark, sf_dir):
    return accounts.average_cost(_trades(spark, sf_dir))


@query()
def account_paired_profit(spark, sf_dir):
    return accounts.paired_profit(_trades(spark, sf_dir))


@query(
    f"""WITH {_TRADES}, v AS (SELECT symbol, sum(side * volume * price) AS value FROM trades GROUP BY symbol)
    SELECT {duck.rounded('sum(abs(value))')} AS gross, {duck.rounded('sum(value)')} AS net, {duck.rounded('sum(greatest(value, 0))')} AS long_value, {duck.rounded('sum(least(value, 0))')} AS short_value, {duck.rounded('max(abs(value)) / nullif(sum(abs(value)), 0)')} AS concentration,
    {duck.rounded('sum(pow(value / (SELECT nullif(sum(abs(value)), 0) FROM v), 2))')} AS hhi FROM v"""
)
def account_exposures(spark, sf_dir):
    return accounts.exposures(_trades(spark, sf_dir))


_MA = duck.stages({"target": "where(gated_mean(close,5,5)>gated_mean(close,20,20),1,-1)", "ready": "gated_mean(close,25,25)"}, "panel", "single", fill=False)


@query(
    f"""WITH {duck.PANEL_L_OWN}, {_MA[0]}, t AS (SELECT date, symbol, open, close, CASE WHEN {_MA[2]['ready']} IS NOT NULL THEN {_MA[2]['target']} ELSE 0 END AS target FROM {_MA[1]}),
    p AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY symbol ORDER BY date), 0) AS position, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM t),
    q AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY date), 0) AS held FROM p),
    e AS (SELECT *, coalesce(held * (open - prev), 0) + position * (close - open) - abs(position - held) * open * 0.0005 AS pnl FROM q)
    SELECT {_D}, symbol, position::INT AS position, {duck.rounded('pnl')} AS pnl, {duck.rounded('1000000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY date)')} AS equity FROM e"""
)
def backtest_dual_average(spark, sf_dir):
    rows = accounts.dual_average(panels.shipment_bars(spark, sf_dir), 5, 20)
    return accounts.replay_targets(rows, 1_000_000.0, 0.0005).select("date", "symbol", F.col("position").cast("int").alias("position"), "pnl", "equity")


@query(
    f"""WITH RECURSIVE {duck.PANEL_L_OWN}, {_MA[0]}, k AS MATERIALIZED (SELECT date, symbol, open, close, CASE WHEN {_MA[2]['ready']} IS NOT NULL THEN {_MA[2]['target']} ELSE 0 END AS target, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM {_MA[1]}),
    f(symbol, date, i, position, cash, pending, prev) AS (SELECT symbol, NULL::DATE, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM k WHERE i = 1
      UNION ALL SELECT symbol, date, i, CASE WHEN fills THEN pending ELSE position END, cash - CASE WHEN fills THEN (pending - position) * open + abs(pending - position) * open * 0.0005 ELSE 0 END, target, close FROM (
        SELECT k.symbol, k.date, k.i, k.open, k.close, k.target::DOUBLE AS target, f.position, f.cash, f.pending, coalesce(f.pending <> f.position AND NOT coalesce((f.pending > f.position AND k.open >= f.prev * 1.5 - 1e-9) OR (f.pending < f.position AND k.open <= f.prev * 0.5 + 1e-9), false), false) AS fills
        FROM f JOIN k ON k.symbol = f.symbol AND k.i = f.i + 1))
    SELECT {_D}, symbol, position, {duck.rounded('1000000 + cash + position * prev')} AS equity FROM f WHERE i > 0"""
)
def backtest_fold(spark, sf_dir):
    rows = accounts.dual_average(panels.shipment_bars(spark, sf_dir), 5, 20)
    return accounts.replay_fold(rows, 1_000_000.0, 0.0005, limit=0.5)


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderstatus FROM orders), w AS (SELECT *, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth FROM o)
    SELECT o_orderkey, CASE WHEN o_custkey % 97 = 0 THEN 'SYMBOL_DENIED' WHEN o_totalprice > 400000 THEN 'NOTIONAL_LIMIT' WHEN o_orderstatus = 'P' THEN 'CLOSED' WHEN nth > 12 THEN 'RATE_LIMIT' ELSE 'PASS' END AS verdict FROM w"""
)
def risk_order_checks(spark, sf_dir):
    orders = panels.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("symbol"), F.col("o_totalprice").alias("notional"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") != "P").alias("in_session"))
    denied = orders.where(F.col("symbol") % 97 == 0).select("symbol").distinct()
    return accounts.order_checks(orders, denied, 400_000.0, 12).select(F.col("order_id").alias("o_orderkey"), "verdict")


_TOKENS = "t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM documents)"
_BM25 = f"""{_TOKENS}, tf AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2), len AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY 1), s AS (SELECT count(*) AS docs, avg(n) AS mean FROM len),
 df AS (SELECT token, count(*) AS df FROM tf WHERE token IN ('tion', 'onth', 'ing') GROUP BY 1),
 b AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS score FROM tf JOIN df USING (token) JOIN len USING (doc_id), s GROUP BY doc_id)"""


def _documents(spark, sf_dir):
    return panels.table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"WITH {_BM25} SELECT doc_id, {duck.rounded('score')} AS score FROM b ORDER BY score DESC, doc_id LIMIT 20")
def search_bm25_top(spark, sf_dir):
    return search.top(search.bm25(_documents(spark, sf_dir), "doc_id", "text", ["tion", "onth", "ing"]), "doc_id", 20)


@query("WITH c AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS text, lower(role) AS role FROM conversations) SELECT conv_id, turn, (3 * (contains(text, 'the')::INT) + 3 * (contains(text, 'tion')::INT) + (contains(role, 'user')::INT) + 0.0)::DOUBLE AS score FROM c WHERE contains(text, 'the') OR contains(text, 'tion') OR contains(role, 'user')")
def search_keywords(spark, sf_dir):
    rows = panels.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role")
    scored = search.keyword_score(rows, {"text": (["the", "tion"], 3.0), "role": (["user"], 1.0)})
    return scored.where("score > 0").select("conv_id", "turn", "score")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def search_json_fields(spark, sf_dir):
    rows = panels.table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return rows.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, count(*) AS n, " + duck.rounded("avg(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))") + " AS energy FROM embeddings GROUP BY label")
def search_vector_energy(spark, sf_dir):
    energy = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return panels.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(energy).alias("energy"))


@query(
    f"""SELECT event_type AS symbol, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, {duck.rounded('arg_min(value, row(ts, event_id))')} AS open, {duck.rounded('max(value)')} AS high, {duck.rounded('min(value)')} AS low,
    {duck.rounded('arg_max(value, row(ts, event_id))')} AS close, count(*) AS n FROM events GROUP BY 1, time_bucket(INTERVAL 6 HOUR, ts)"""
)
def stream_window_bars(spark, sf_dir):
    schema = panels.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    name = f"window_bars_{uuid.uuid4().hex[:8]}"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"{(shared or tempfile.mkdtemp()).rstrip('/')}/{name}"
    made = ticks.run_available(ticks.window_bars(rows, "6 hours", "1 hour"), name, "complete", folder)
    return made.select("symbol", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "open", "high", "low", "close", "n")


_SEATS = """s AS (SELECT CAST(ts AS DATE) AS date, CAST(user_id % 7 AS VARCHAR) AS seat, sum(CASE WHEN event_type IN (SELECT event_type FROM k WHERE i <= 2) THEN round(value) ELSE 0 END) AS long_pos, sum(CASE WHEN event_type IN (SELECT event_type FROM k WHERE i > 2) THEN round(value) ELSE 0 END) AS short_pos FROM events GROUP BY 1, 2),
 n AS (SELECT *, (long_pos - short_pos)::DOUBLE AS net FROM s), c AS (SELECT *, net - lag(net) OVER (PARTITION BY seat ORDER BY date) AS change FROM n),
 e AS (SELECT date, net, change, net / nullif(sum(abs(net)) OVER d, 0) AS ratio, abs(net) / nullif(sum(abs(net)) OVER d, 0) AS share, change / nullif(lag(net) OVER w, 0) AS rate, change - lag(change) OVER w AS accel,
  (net - avg(net) OVER r) / nullif(CASE WHEN count(net) OVER r >= 5 THEN stddev_samp(net) OVER r END, 0) AS z, (rank() OVER (PARTITION BY date ORDER BY net) + (count(*) OVER (PARTITION BY date, net) - 1) / 2.0::DOUBLE) / count(net) OVER d AS rank
  FROM c WINDOW d AS (PARTITION BY date), w AS (PARTITION BY seat ORDER BY date), r AS (PARTITION BY seat ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
_SEAT_NAMES = {"F1_net_position": "net", "F2_net_change": "change", "F3_net_ratio": "ratio", "F4_concentration": "share", "F5_net_change_rate": "rate", "F6_net_accel": "accel", "F7_net_zscore": "z", "F8_seat_sentiment": "rank"}


@query(f"WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)), {_SEATS} SELECT {_D}, {', '.join(f'{duck.rounded(f'coalesce(avg({c}), 0)')} AS {n}' for n, c in _SEAT_NAMES.items())} FROM e GROUP BY date")
def seat_factors(spark, sf_dir):
    rows = panels.table(spark, sf_dir, "events")
    kinds = [r.event_type for r in rows.select("event_type").distinct().orderBy("event_type").collect()]
    slim = rows.select(F.to_date("ts").alias("date"), (F.col("user_id") % 7).cast("string").alias("member"), F.round("value").alias("position"), F.col("event_type").isin(kinds[:2]).alias("is_long"))
    seats = files.seat_positions(slim.where("is_long"), slim.where("NOT is_long"))
    none = seats.select("date").distinct().withColumn("total_oi", F.lit(None).cast("double"))
    return files.seat_factors(seats, none)
