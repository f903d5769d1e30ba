"""Queries of the upkeep, session, timeframe and account-backtest operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accounts, backtest, bars, sessions, upkeep, views
from ..sources import panels
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


# Files of a warehouse, made from suppliers.
PLACES = ("SHFE", "CFFEX", "SSE", "HKEX", "NASDAQ", "LSE", "sse")
_FILES = f"""files AS (SELECT 's' || s_suppkey || 'X' AS symbol, list_extract({list(PLACES)}, (s_suppkey % 7 + 1)::INT) AS exchange, CASE WHEN s_suppkey % 2 = 0 THEN '1d' ELSE '5m' END AS interval,
  CASE WHEN s_nationkey < 5 THEN 'fresh' ELSE 'old' END AS class, s_suppkey AS key, s_acctbal AS rows FROM supplier)"""
_MARKET = "CASE WHEN upper(exchange) IN ('CFFEX', 'SHFE', 'DCE', 'CZCE', 'INE', 'GFEX') THEN '期货' WHEN upper(exchange) IN ('SSE', 'SZSE') THEN 'A股' WHEN upper(exchange) = 'HKEX' THEN '港股' WHEN upper(exchange) IN ('NASDAQ', 'NYSE', 'AMEX', 'COMEX', 'CME', 'NYMEX', 'CBOT') THEN '美股' ELSE '其他' END"


def _files(spark, sf_dir):
    key = F.col("s_suppkey")
    return panels.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), key, F.lit("X")).alias("symbol"), F.element_at(F.array(*map(F.lit, PLACES)), (key % 7 + 1).cast("int")).alias("exchange"), F.when(key % 2 == 0, "1d").otherwise("5m").alias("interval"),
        F.when(F.col("s_nationkey") < 5, "fresh").otherwise("old").alias("class"), key.alias("key"), F.col("s_acctbal").alias("rows"),
    )


@query(f"WITH {_FILES} SELECT symbol, exchange, {_MARKET} AS market, symbol || '.' || exchange AS full_symbol FROM files")
def upkeep_markets(spark, sf_dir):
    rows = _files(spark, sf_dir)
    return rows.select("symbol", "exchange", upkeep.market(F.col("exchange")).alias("market"), upkeep.full_symbol(F.col("symbol"), F.col("exchange")).alias("full_symbol"))


@query("WITH f AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '.' || p_brand ELSE replace(p_name || '.v' || p_size || '.' || p_type, ' ', '.') END AS w FROM part) SELECT p_partkey, regexp_extract(w, '^(.*)\\.([^.]+)$', 1) AS symbol, regexp_extract(w, '^(.*)\\.([^.]+)$', 2) AS exchange FROM f")
def upkeep_symbol_parts(spark, sf_dir):
    full = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("."), "p_brand")).otherwise(F.replace(F.concat("p_name", F.lit(".v"), "p_size", F.lit("."), "p_type"), F.lit(" "), F.lit(".")))
    symbol, exchange = upkeep.symbol_parts(full)
    return panels.table(spark, sf_dir, "part").select("p_partkey", symbol.alias("symbol"), exchange.alias("exchange"))


@query(f"WITH {_FILES}, n AS (SELECT * FROM files WHERE {_MARKET} = 'A股' AND interval = '1d' AND contains(lower(symbol), '1')) SELECT symbol, exchange, {_r('rows')}, count(*) OVER () AS total, ceil(count(*) OVER () / 5.0)::BIGINT AS pages FROM n ORDER BY rows DESC, n.key LIMIT 5 OFFSET 0")
def upkeep_drill_down(spark, sf_dir):
    rows = upkeep.narrowed(_files(spark, sf_dir), market_name="A股", interval="1d", text="1")
    return upkeep.paged(rows, [F.desc("rows"), F.col("key")], 1, 5).select("symbol", "exchange", "rows", "total", "pages")


@query(f"SELECT o_orderkey, {_r('o_totalprice')}, total, ceil(total / 50.0)::BIGINT AS pages FROM (SELECT *, count(*) OVER () AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100)")
def upkeep_page(spark, sf_dir):
    rows = panels.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return upkeep.paged(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 50)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def upkeep_recent(spark, sf_dir):
    rows = panels.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return upkeep.first_of(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 50).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


# Trials of formulas, made from parts.
_TRIALS = """trials AS (SELECT p_partkey AS name, 'run' || p_size AS run_id, CASE WHEN p_partkey % 3 > 0 THEN (p_size - 20) / 400.0::DOUBLE END AS test_ic, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 50 - 10) / 400.0::DOUBLE END AS train_ic,
  CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 11 - 2) / 5.0::DOUBLE END AS test_sharpe, (p_partkey % 40)::DOUBLE AS turnover,
  list_transform(generate_series(1, (p_partkey % 45)::INT), lambda i: ((p_partkey * i * 7919) % 1000 - 380) / 1000.0::DOUBLE / sqrt(i::DOUBLE)) AS ics, replace(p_name || '(' || p_type || ',' || p_brand || '(x))', ' ', '-') AS expression FROM part)"""


def _trials(spark, sf_dir):
    key = F.col("p_partkey")
    ics = F.transform(F.when(key % 45 > 0, F.sequence(F.lit(1), (key % 45).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: ((key * i * 7919) % 1000 - 380) / 1000.0 / F.sqrt(i.cast("double")))
    return panels.table(spark, sf_dir, "part").select(
        key.alias("name"), F.concat(F.lit("run"), "p_size").alias("run_id"), F.when(key % 3 > 0, (F.col("p_size") - 20) / 400.0).alias("test_ic"), F.when(key % 5 > 0, (key % 50 - 10) / 400.0).alias("train_ic"),
        F.when(key % 7 > 0, (key % 11 - 2) / 5.0).alias("test_sharpe"), (key % 40).cast("double").alias("turnover"), ics.alias("ics"),
        F.replace(F.concat("p_name", F.lit("("), "p_type", F.lit(","), "p_brand", F.lit("(x))")), F.lit(" "), F.lit("-")).alias("expression"),
    )


@query(f"WITH {_TRIALS} SELECT name, row_number() OVER (ORDER BY coalesce(test_ic, train_ic, -1) DESC, name)::INT AS place FROM trials")
def upkeep_ranked_trials(spark, sf_dir):
    return upkeep.ranked_trials(_trials(spark, sf_dir)).select("name", "place")


@query(f"WITH {_TRIALS}, r AS (SELECT run_id, arg_max(idea, created) AS idea, arg_max(market, created) AS market FROM (SELECT 'run' || o_custkey AS run_id, o_orderstatus AS idea, o_orderpriority AS market, o_orderkey AS created FROM orders) GROUP BY 1) SELECT name, trials.run_id, idea, market FROM trials LEFT JOIN r USING (run_id)")
def upkeep_trials_with_runs(spark, sf_dir):
    runs = panels.table(spark, sf_dir, "orders").select(F.concat(F.lit("run"), "o_custkey").alias("run_id"), F.col("o_orderstatus").alias("idea"), F.col("o_orderpriority").alias("market"), F.col("o_orderkey").alias("created"))
    return upkeep.trials_with_runs(_trials(spark, sf_dir).select("name", "run_id"), runs)


@query(
    f"""WITH {_TRIALS}, v AS (SELECT *, list_filter(ics, lambda v: v IS NOT NULL) AS c, len(ics) // 2 AS h FROM trials),
    j AS (SELECT *, CASE WHEN len(c) >= 20 THEN len(list_filter(c, lambda v: v > 0)) / len(c)::DOUBLE END AS share, list_sum(c[1:h]) / h AS a, list_sum(c[h + 1:len(c)]) / (len(c) - h) AS b FROM v),
    k AS (SELECT *, CASE WHEN len(c) >= 10 AND a > 0 AND b > 0 THEN CASE WHEN b >= a THEN 1e300 ELSE h / log2(a / b) END END AS life FROM j)
    SELECT name, CASE WHEN test_ic IS NULL OR test_ic < 0.02 OR coalesce(test_sharpe, 0) < 0 OR coalesce(share, 1) < 0.52 OR coalesce(life, 9) < 2 OR turnover > 30 THEN 'rejected'
      WHEN test_ic >= 0.03 AND test_sharpe >= 0.5 AND train_ic > 0 THEN 'verified' ELSE 'active' END AS status FROM k"""
)
def upkeep_judged(spark, sf_dir):
    return upkeep.judged(_trials(spark, sf_dir)).select("name", "status")


@query(
    f"""WITH {_TRIALS}, t AS (SELECT name, expression, lower(expression) AS e FROM trials)
    SELECT name, array_to_string(CASE WHEN contains(e, 'delta') OR contains(e, 'std') OR contains(e, 'corr') OR contains(e, 'rank') THEN list_filter([CASE WHEN contains(e, 'delta') THEN 'momentum' END, CASE WHEN contains(e, '-delta') THEN 'mean_reversion' END,
      CASE WHEN contains(e, 'std') THEN 'volatility' END, CASE WHEN contains(e, 'corr') THEN 'price_volume' END, CASE WHEN contains(e, 'rank') THEN 'rank' END], lambda x: x IS NOT NULL) ELSE ['generic'] END, ',') AS tags,
      (length(expression) - length(replace(expression, '(', '')))::INT AS complexity, 'book|f5|' || md5(expression) || '|' || expression AS key FROM t"""
)
def upkeep_formula_texts(spark, sf_dir):
    e = F.col("expression")
    return _trials(spark, sf_dir).select("name", F.array_join(upkeep.rule_tags(e), ",").alias("tags"), upkeep.complexity(e).alias("complexity"), upkeep.cache_key(F.lit("book"), F.lit(5), F.md5(e), e).alias("key"))


@query(f"WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_custkey AS contract, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2) SELECT {_D}, contract, {_r('total')} FROM s QUALIFY row_number() OVER (PARTITION BY date ORDER BY total DESC, contract) = 1")
def upkeep_largest_sum(spark, sf_dir):
    rows = panels.table(spark, sf_dir, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"), F.col("o_custkey").alias("contract"), "o_totalprice")
    return upkeep.largest_sum(rows, ["date"], "contract", "o_totalprice")


@query(
    f"""WITH w AS (SELECT p_brand AS expression, avg(p_size) / 50 AS weight FROM part GROUP BY 1), s AS (SELECT p_brand AS expression, max((p_retailprice - 1400) / 10000) AS ic FROM part WHERE p_size > 10 AND p_brand <> 'Brand#11' GROUP BY 1),
    c AS (SELECT w.expression, weight, ic, weight * coalesce(ic, 0) AS part FROM w LEFT JOIN s USING (expression)) SELECT expression, {_r('weight', 'ic')}, {duck.rounded('part / nullif((SELECT sum(abs(part)) FROM c), 0)')} AS contribution FROM c"""
)
def upkeep_contributions(spark, sf_dir):
    part = panels.table(spark, sf_dir, "part").select(F.col("p_brand").alias("expression"), "p_size", ((F.col("p_retailprice") - 1400) / 10000).alias("ic"))
    weights = part.groupBy("expression").agg((F.avg("p_size") / 50).alias("weight"))
    return upkeep.contributions(weights, part.where("p_size > 10 AND expression <> 'Brand#11'").select("expression", "ic"))


@query(f"WITH {_FILES}, l AS (SELECT user_id % 60 AS key, max(row(ts, event_id, event_type)) AS m FROM events GROUP BY 1) SELECT symbol, strftime(m[1], '%Y-%m-%d %H:%M:%S') AS refreshed, m[2] AS refreshed_rows, m[3] AS status FROM files LEFT JOIN l USING (key)")
def upkeep_last_refresh(spark, sf_dir):
    log = panels.table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("rows"), F.col("event_type").alias("status"))
    out = upkeep.with_last_refresh(_files(spark, sf_dir).select("symbol", "key"), log)
    return out.select("symbol", F.date_format("refreshed", "yyyy-MM-dd HH:mm:ss").alias("refreshed"), "refreshed_rows", "status")


@query("SELECT key, strftime(m, '%Y-%m-%d %H:%M:%S') AS seen FROM (SELECT user_id AS key, max(ts) AS m FROM events GROUP BY 1 UNION ALL SELECT o_custkey, o_orderdate FROM orders) ORDER BY m DESC, key LIMIT 200")
def upkeep_log(spark, sf_dir):
    log = panels.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("at"))
    new = panels.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"))
    return upkeep.logged(log, new).select("key", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("seen"))


@query(f"WITH o AS (SELECT o_custkey AS account, sum(o_totalprice) AS remote FROM orders GROUP BY 1), b AS (SELECT c_custkey AS account, remote, remote + CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 100 ELSE 0.5 END AS local FROM customer LEFT JOIN o ON c_custkey = account) SELECT account, {duck.rounded('remote - local')} AS delta, abs(remote - local) <= greatest(1.0, abs(remote) * 0.001) AS ok FROM b")
def upkeep_account_reconciled(spark, sf_dir):
    remote = panels.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("remote"))
    rows = panels.table(spark, sf_dir, "customer").join(remote, F.col("c_custkey") == F.col("o_custkey"), "left")
    local = F.col("remote") + F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") / 100).otherwise(0.5)
    return upkeep.account_reconciled(rows.select(F.col("c_custkey").alias("account"), "remote", local.alias("local"))).select("account", "delta", "ok")


_RETURNS = f"{duck.PANEL_E}, r AS (SELECT symbol AS strategy, date, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS r FROM panel)"


@query(f"WITH {_RETURNS} SELECT a.strategy AS a, b.strategy AS b, {duck.rounded('coalesce(corr(a.r, b.r), 0)')} AS correlation FROM r a JOIN r b ON a.date = b.date AND a.strategy < b.strategy AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2")
def upkeep_strategy_correlation(spark, sf_dir):
    from ..functions.ops import with_column

    rows = with_column(panels.event_bars(spark, sf_dir), "r", "pct_change(close,1)")
    return upkeep.returns_correlation(rows.select(F.col("symbol").alias("strategy"), "date", "r"))


_RESULTS = "results AS (SELECT 's' || c_nationkey AS strategy, c_custkey AS symbol, c_acctbal > 0 AS passed, c_acctbal / 10000 AS total_return, c_acctbal / 4000 AS sharpe, -abs(c_acctbal) / 20000 AS max_drawdown FROM customer)"


@query(f"WITH {_RESULTS}, g AS (SELECT strategy, count(*) AS n, count(*) FILTER (passed) AS passed, avg(passed::INT) AS pass_rate, avg(total_return) AS mean_return, avg(sharpe) AS mean_sharpe, min(max_drawdown) AS worst_drawdown, arg_max(symbol, row(total_return, symbol)) AS best FROM results GROUP BY 1) SELECT strategy, n, passed, {_r('pass_rate', 'mean_return', 'mean_sharpe', 'worst_drawdown')}, best FROM g")
def upkeep_validation_summary(spark, sf_dir):
    b = F.col("c_acctbal")
    rows = panels.table(spark, sf_dir, "customer").select(F.concat(F.lit("s"), "c_nationkey").alias("strategy"), F.col("c_custkey").alias("symbol"), (b > 0).alias("passed"), (b / 10000).alias("total_return"), (b / 4000).alias("sharpe"), (-F.abs(b) / 20000).alias("max_drawdown"))
    return upkeep.validation_summary(rows)


@query("WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 10 > 0 THEN c_acctbal / 4000 ELSE 0 END AS a, (c_custkey % 17 - 5) / 4.0::DOUBLE AS b, c_acctbal / 10000 AS x, (c_custkey % 13 - 6) / 10.0::DOUBLE AS y FROM customer) SELECT c_custkey, (a > 0 AND b < 0.5 * a) OR (x > 0 AND y <= 0) AS overfit FROM r")
def upkeep_overfit(spark, sf_dir):
    key, b = F.col("c_custkey"), F.col("c_acctbal")
    rows = panels.table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 10 > 0, b / 4000).otherwise(float("nan")).alias("train_sharpe"), ((key % 17 - 5) / 4.0).alias("test_sharpe"), (b / 10000).alias("train_return"), ((key % 13 - 6) / 10.0).alias("test_return"))
    return upkeep.overfit(rows).select("c_custkey", "overfit")


_HEALTH = "h AS (SELECT c_custkey, c_custkey % 600 AS n, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal / 100000 END AS ic, c_acctbal / 8000 AS ir, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 80 END AS turnover, -(c_custkey % 9) / 10.0::DOUBLE AS drawdown, CASE WHEN c_custkey % 6 > 0 THEN (c_custkey % 10) / 10.0::DOUBLE END AS coverage FROM customer)"


@query(f"WITH {_HEALTH}, k AS (SELECT c_custkey, n >= 250 AS enough, abs(ic) >= 0.02 AND abs(ir) >= 0.5 AS significant, turnover <= 60 AS turnover_ok, abs(drawdown) <= 0.5 AS drawdown_ok, coverage >= 0.8 AS covered FROM h) SELECT *, enough AND coalesce(significant, true) AND coalesce(turnover_ok, true) AND coalesce(drawdown_ok, true) AND coalesce(covered, true) AS healthy FROM k")
def upkeep_health(spark, sf_dir):
    key, b = F.col("c_custkey"), F.col("c_acctbal")
    rows = panels.table(spark, sf_dir, "customer").select(
        "c_custkey", (key % 600).alias("n"), F.when(key % 4 > 0, b / 100000).alias("ic"), (b / 8000).alias("ir"), F.when(key % 5 > 0, key % 80).alias("turnover"), (-(key % 9) / 10.0).alias("drawdown"), F.when(key % 6 > 0, (key % 10) / 10.0).alias("coverage"),
    )
    return upkeep.health(rows).select("c_custkey", "enough", "significant", "turnover_ok", "drawdown_ok", "covered", "healthy")


@query("SELECT user_id, event_type, event_id, round(value, 6) + 0.0 AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def upkeep_keep_first(spark, sf_dir):
    rows = panels.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value").withColumn("seq", F.col("event_id"))
    return upkeep.keep_first(rows, ["user_id", "event_type"], "seq").drop("seq")


@query(f"WITH {duck.PANEL_L_OWN} SELECT {_D}, symbol, {_r('close')} FROM panel WHERE symbol = '7' AND date BETWEEN DATE '1996-01-01' AND DATE '1999-06-30' ORDER BY panel.date LIMIT 100")
def upkeep_range_scan(spark, sf_dir):
    return upkeep.range_scan(panels.shipment_bars(spark, sf_dir), "7", "1996-01-01", "1999-06-30", 100).select("date", "symbol", "close")


_STORED = "a AS (SELECT symbol, date, close FROM panel WHERE symbol::INT % 3 > 0 OR date >= DATE '1996-06-01')"


@query(f"WITH {duck.PANEL_L_OWN}, {_STORED}, b AS (SELECT symbol, date, -close AS close FROM panel), h AS (SELECT symbol FROM a GROUP BY 1 HAVING min(date) <= DATE '1996-01-15' AND max(date) >= DATE '2000-12-31'), u AS (SELECT * FROM a WHERE symbol IN (FROM h) UNION ALL SELECT * FROM b WHERE symbol NOT IN (FROM h)) SELECT {_D}, symbol, {_r('close')} FROM u WHERE u.date BETWEEN DATE '1996-01-15' AND DATE '2000-12-31'")
def upkeep_unified(spark, sf_dir):
    rows = panels.shipment_bars(spark, sf_dir).select("symbol", "date", "close")
    stored = rows.where("cast(symbol AS int) % 3 > 0 OR date >= '1996-06-01'")
    return upkeep.unified(stored, rows.withColumn("close", -F.col("close")), "1996-01-15", "2000-12-31")


# Sessions: events as ticks of products.
PRODUCTS = ("rb2410", "CU2409", "ag2412", "IF2409", "T2412", "jd2409", "600000", "0700", "lh2411")
PRODUCT_PLACES = ("SHFE", "SHFE", "shfe", "CFFEX", "CFFEX", "DCE", "SSE", "HKEX", "DCE")
_CAL = """cal AS (SELECT day, is_open, has_night, lag(has_night) OVER (ORDER BY day) AS night_before FROM (SELECT *, is_open AND coalesce(date_diff('day', day, next_open) <= 3, false) AS has_night FROM (
  SELECT *, min(CASE WHEN is_open THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_open, sum(is_open::INT) OVER (ORDER BY day) AS n_open FROM (SELECT day, isodow(day) <= 5 AND day NOT IN (DATE '2024-01-01', DATE '2024-01-12') AS is_open
  FROM (SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM events)))))"""
_TICK = f"""ticks AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, hour(ts) * 60 + minute(ts) AS m, list_extract({list(PRODUCTS)}, (event_id % 9 + 1)::INT) AS symbol, list_extract({list(PRODUCT_PLACES)}, (event_id % 9 + 1)::INT) AS exchange FROM events)"""


def _calendar(spark, sf_dir):
    ends = panels.table(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi"))
    return bars.calendar(ends, ["2024-01-01", "2024-01-12"])


@query(
    f"""WITH {_CAL}, {_TICK}, e AS (SELECT *, CASE event_id % 9 WHEN 0 THEN 1380 WHEN 1 THEN 60 WHEN 2 THEN 150 END AS night,
      CASE WHEN upper(exchange) = 'CFFEX' THEN (m >= 570 AND m < 690) OR (m >= 780 AND m < CASE WHEN symbol = 'T2412' THEN 915 ELSE 900 END) WHEN exchange = 'SSE' THEN (m >= 570 AND m < 690) OR (m >= 780 AND m < 900) WHEN exchange = 'HKEX' THEN (m >= 570 AND m < 720) OR (m >= 780 AND m < 960)
      ELSE (m >= 540 AND m < 615) OR (m >= 630 AND m < 690) OR (m >= 810 AND m < 900) END AS inside FROM ticks JOIN cal USING (day)),
    s AS (SELECT symbol, CASE WHEN coalesce((m >= 1260 AND (night <= 1260 OR m < night) AND has_night) OR (night <= 1260 AND m < night AND coalesce(night_before, false)), false) THEN 'NIGHT' WHEN is_open AND inside THEN CASE WHEN m < 720 THEN 'MORNING' ELSE 'AFTERNOON' END ELSE 'CLOSED' END AS session FROM e)
    SELECT symbol, session, count(*) AS n FROM s GROUP BY 1, 2"""
)
def sessions_by_product(spark, sf_dir):
    at = (F.col("event_id") % 9 + 1).cast("int")
    rows = panels.table(spark, sf_dir, "events").select("ts", F.element_at(F.array(*map(F.lit, PRODUCTS)), at).alias("symbol"), F.element_at(F.array(*map(F.lit, PRODUCT_PLACES)), at).alias("exchange"))
    return sessions.with_session(rows, _calendar(spark, sf_dir)).groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CAL} SELECT strftime(day, '%Y-%m-%d') AS day, has_night FROM cal")
def sessions_night_days(spark, sf_dir):
    return sessions.night_days(_calendar(spark, sf_dir)).select("day", "has_night")


@query(f"WITH {_CAL}, o AS (SELECT day, sum(is_open::INT) OVER (ORDER BY day) AS n FROM cal), l AS (SELECT user_id, CAST(max(ts) AS DATE) AS last FROM events GROUP BY 1) SELECT user_id, strftime(last, '%Y-%m-%d') AS last, greatest((SELECT n FROM o WHERE day = DATE '2024-01-29') - n, 0)::INT AS behind FROM l LEFT JOIN o ON day = last")
def sessions_days_behind(spark, sf_dir):
    latest = panels.table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.max("ts")).alias("last"))
    return sessions.trading_days_behind(latest, _calendar(spark, sf_dir), "2024-01-29")


@query(f"WITH {duck.PANEL_L_OWN}, f AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM panel), g AS (SELECT symbol, count(*) AS n, date_diff('day', min(date), max(date)) AS d FROM f WHERE i <= 2 GROUP BY 1) SELECT symbol, CASE WHEN n < 2 THEN 252 ELSE greatest(1, round_even(365.0 / greatest(1, abs(d)), 0))::INT END AS periods FROM g")
def sessions_periods(spark, sf_dir):
    return sessions.periods_per_year(panels.shipment_bars(spark, sf_dir))


@query(f"WITH {duck.PANEL_L_OWN}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM panel) SELECT {_D}, symbol, {duck.rounded('round_even(prev * 0.9 * 100, 0) / 100')} AS lower, {duck.rounded('round_even(prev * 1.1 * 100, 0) / 100')} AS upper FROM p")
def bars_limit_prices(spark, sf_dir):
    return bars.limit_prices(panels.shipment_bars(spark, sf_dir))


# Views of other timeframes.
_VIEW = """CASE WHEN count(*) OVER r = {n} THEN avg(close) OVER r END AS sma, {hi} AS highest, {lo} AS lowest, CASE WHEN row_number() OVER s > {a} THEN avg(tr) OVER t END AS atr"""
_WINDOWS = "WINDOW s AS (PARTITION BY symbol ORDER BY at_), r AS (PARTITION BY symbol ORDER BY at_ ROWS BETWEEN {n} PRECEDING AND CURRENT ROW), t AS (PARTITION BY symbol ORDER BY at_ ROWS BETWEEN {a} PRECEDING AND CURRENT ROW)"
_RANGE = "SELECT *, greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY at_)), abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY at_))) AS tr FROM b"
_SEEN = ("prev_open", "prev_high", "prev_low", "prev_close", "sma", "highest", "lowest", "atr")
_PREV = "open AS prev_open, high AS prev_high, low AS prev_low, close AS prev_close"


@query(
    f"""WITH {duck.PANEL_E}, b AS (SELECT symbol, date AS at_, open, high, low, close FROM panel), g AS ({_RANGE}), v AS (SELECT symbol, at_, {_PREV}, {_VIEW.format(n=5, a=4, hi='max(high) OVER r', lo='min(low) OVER r')} FROM g {_WINDOWS.format(n=4, a=3)})
    SELECT event_id, {_r(*_SEEN)} FROM (SELECT event_id, event_type, CAST(ts AS DATE) AS day FROM events) e ASOF LEFT JOIN v ON e.event_type = v.symbol AND e.day > v.at_"""
)
def views_daily_context(spark, sf_dir):
    rows = panels.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"))
    return views.daily_context(rows, panels.event_bars(spark, sf_dir), 5, 4).drop("symbol", "date")


@query(
    f"""WITH b AS (SELECT event_type AS symbol, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS at_, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close FROM events GROUP BY 1, 2),
    g AS ({_RANGE}), v AS (SELECT symbol, at_, {_PREV}, {_VIEW.format(n=8, a=6, hi='CASE WHEN count(*) OVER r = 8 THEN max(high) OVER r END', lo='CASE WHEN count(*) OVER r = 8 THEN min(low) OVER r END')} FROM g {_WINDOWS.format(n=7, a=5)})
    SELECT event_id, {_r(*_SEEN)} FROM events e ASOF LEFT JOIN v ON e.event_type = v.symbol AND e.ts >= v.at_"""
)
def views_multi_timeframe(spark, sf_dir):
    events = panels.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")
    made = events.groupBy("symbol", F.window("ts", "6 hours").alias("w")).agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"))
    return views.multi_timeframe(events.select("event_id", "symbol", "ts"), made.select("symbol", F.col("w.end").alias("close_time"), "open", "high", "low", "close"), 8, 6).drop("symbol", "ts")


# Backtests of accounts, which hold several symbols each.
_MA = duck.stages({"target": "where(gated_mean(close,5,5)>gated_mean(close,20,20),1,-1)", "ready": "gated_mean(close,25,25)"}, "panel", "single", fill=False)
_RUN = f"""{duck.PANEL_L_OWN}, {_MA[0]},
    k AS MATERIALIZED (SELECT (symbol::INT % 3)::VARCHAR AS account, symbol, date, open, close, 250.0 * CASE WHEN {_MA[2]['ready']} IS NOT NULL THEN {_MA[2]['target']} ELSE 0 END AS target, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM {_MA[1]}),
    f(account, symbol, date, i, position, average, cash, pending, close) AS (SELECT account, symbol, NULL::DATE, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM k WHERE i = 1
      UNION ALL SELECT account, symbol, date, i, position, average, cash, CASE WHEN target - position > 1e-9 THEN floor((target - position) / 100) * 100 WHEN target - position < -1e-9 THEN target - position ELSE 0 END, close FROM (
        SELECT account, symbol, date, i, target, close, CASE WHEN abs(after) < 1e-9 THEN 0 ELSE after END AS position, CASE WHEN abs(after) < 1e-9 THEN 0 WHEN c = 0 THEN average WHEN before * after <= 0 THEN price WHEN abs(after) > abs(before) THEN (average * abs(before) + price * (abs(after) - abs(before))) / abs(after) ELSE average END AS average,
          cash + CASE WHEN before * c < 0 THEN (price - average) * least(abs(c), abs(before)) * sign(before) ELSE 0 END - CASE WHEN c = 0 THEN 0 ELSE greatest(abs(c) * price * 0.0003, 5) + CASE WHEN c < 0 THEN abs(c) * price * 0.001 ELSE 0 END END AS cash
        FROM (SELECT t.account, t.symbol, t.date, t.i, t.target, t.close, f.average, f.cash, f.position AS before, f.pending AS c, f.position + f.pending AS after, t.open * (1 + 0.001 * sign(f.pending)) AS price FROM f JOIN k t ON t.symbol = f.symbol AND t.i = f.i + 1))),
    lasts AS (SELECT account, max(date) AS final FROM k GROUP BY 1),
    s AS (SELECT account, symbol, date, cash - CASE WHEN date = final AND position <> 0 THEN greatest(abs(position) * close * 0.0003, 5) + CASE WHEN position > 0 THEN abs(position) * close * 0.001 ELSE 0 END ELSE 0 END + CASE WHEN date = final THEN (close - average) * position ELSE 0 END AS cash,
      CASE WHEN date = final THEN 0 ELSE position * (close - average) END AS gain, position, average FROM f JOIN lasts USING (account) WHERE i > 0),
    grid AS (SELECT a.account, a.symbol, d.date FROM (SELECT DISTINCT account, symbol FROM k) a JOIN (SELECT DISTINCT account, date FROM k) d USING (account)),
    e AS (SELECT g.account, g.date, coalesce(s.cash, 0) AS cash, coalesce(s.gain, 0) AS gain FROM grid g ASOF LEFT JOIN s ON g.symbol = s.symbol AND g.date >= s.date)"""


@query(f"WITH RECURSIVE {_RUN} SELECT account, {_D}, {duck.rounded('1000000 + sum(cash)')} AS cash, {duck.rounded('1000000 + sum(cash) + sum(gain)')} AS equity FROM e GROUP BY account, e.date")
def backtest_accounts(spark, sf_dir):
    rows = accounts.dual_average(panels.shipment_bars(spark, sf_dir), 5, 20)
    rows = rows.select((F.col("symbol").cast("int") % 3).cast("string").alias("account"), "date", "symbol", "open", "close", (F.col("target") * 250).alias("target"))
    return backtest.accounts(rows, backtest.Rules(lot=100, rate=0.0003, least=5, stamp=0.001, slip=0.001)).select("account", "date", "cash", "equity")
