"""Queries of the desk and attribution operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ops import with_column, with_factors
from ..operators import accounts, attribution, desk, formula_search
from ..operators import research as r
from ..sources import panels
from . import duck
from .factor_queries import published
from .research_queries import FACTOR, THREE

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


# Cost models: by symbol, by leading letters, by exchange, and the common one.
_MODELS = [("RB", 1e-4, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.1, 2e-4), ("IF", 2.3e-5, 0.5, 0.0, 2.0, 0.0, 0.0, 1e-5, 0.12, 1e-4), ("7", 3e-4, 0.0, 1.0, 1.0, 50.0, 1e-3, 0.0, 1.0, 0.0)]
_PLACES = [("SSE", 2.5e-4, 0.0, 1.0, 1.0, 5.0, 1e-3, 0.0, 1.0, 5e-4), ("SHFE", 1e-4, 1.5, 1.0, 1.0, 0.0, 0.0, 0.0, 0.1, 1e-4)]
_COMMON = dict(zip(desk.MODEL, (1e-4, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.1, 0.0), strict=True))
_FIELDS = ", ".join(desk.MODEL)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in row) + ")" for row in rows)


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_suppkey").cast("string")
    kind = F.col("l_suppkey") % 4
    rows = panels.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(kind == 0, F.concat(F.lit("rb"), key)).when(kind == 1, F.concat(F.lit("IF"), key)).when(kind == 2, F.concat(F.lit("zz"), key)).otherwise(key).alias("symbol"),
        F.when(F.col("l_linenumber") % 3 == 0, "SHFE").when(F.col("l_linenumber") % 3 == 1, "SSE").otherwise("XX").alias("exchange"), F.col("l_quantity").alias("volume"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.lit(10.0).alias("size"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("side"), F.when(F.col("l_linestatus") == "F", "CLOSE_YESTERDAY").otherwise("OPEN").alias("offset"), (F.col("l_partkey") % 20).cast("double").alias("closed_today"),
    )
    kinds = ", ".join(f"{f} double" for f in desk.MODEL)
    return desk.cost_models(rows, spark.createDataFrame(_MODELS, f"key string, {kinds}"), spark.createDataFrame(_PLACES, f"exchange string, {kinds}"), _COMMON)


_PRICED = f"""models(key, {_FIELDS}) AS (VALUES {_values(_MODELS)}), places(exchange, {_FIELDS}) AS (VALUES {_values(_PLACES)}),
rows0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_suppkey % 4 WHEN 0 THEN 'rb' WHEN 1 THEN 'IF' WHEN 2 THEN 'zz' ELSE '' END || l_suppkey AS symbol, CASE l_linenumber % 3 WHEN 0 THEN 'SHFE' WHEN 1 THEN 'SSE' ELSE 'XX' END AS exchange,
  l_quantity AS volume, l_extendedprice / l_quantity AS price, 10.0::DOUBLE AS size, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side, l_linestatus = 'F' AS old, least(l_partkey % 20, l_quantity)::DOUBLE AS closed FROM lineitem),
priced AS (SELECT t.*, {', '.join(f'CASE WHEN a.key IS NOT NULL THEN a.{f} WHEN b.key IS NOT NULL THEN b.{f} WHEN c.exchange IS NOT NULL THEN c.{f} ELSE {_COMMON[f]!r}::DOUBLE END AS {f}' for f in desk.MODEL)}
  FROM rows0 t LEFT JOIN models a ON a.key = t.symbol LEFT JOIN models b ON b.key = upper(regexp_extract(t.symbol, '^([A-Za-z]+)', 1)) LEFT JOIN places c ON c.exchange = t.exchange)"""


@query(
    f"""WITH {_PRICED}, f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest((price * size * rate + per_lot) * (closed * today + (volume - closed) * CASE WHEN old THEN yesterday ELSE 1 END), least) AS commission,
    CASE WHEN side < 0 THEN price * size * volume * stamp ELSE 0 END AS stamp, price * size * volume * impact AS impact, price * size * volume * margin AS margin FROM priced) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_r('commission', 'stamp', 'impact', 'margin')} FROM f"""
)
def desk_trade_costs(spark, sf_dir):
    return desk.trade_costs(_priced(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "commission", "stamp", "impact", "margin")


@query(
    f"""WITH {_PRICED}, b AS (SELECT DISTINCT symbol, exchange, (greatest(rate + per_lot, least) + greatest((rate + per_lot) * yesterday, least) + 2 * slip) * 10000 AS bps FROM priced)
    SELECT symbol, exchange, {_r('bps')}, {duck.rounded('bps * 6')} AS drag_bps, {duck.rounded('bps * 6 / 10000 * 250000')} AS drag FROM b"""
)
def desk_roll_costs(spark, sf_dir):
    return desk.roll_costs(_priced(spark, sf_dir), 250_000.0, 6).select("symbol", "exchange", "bps", "drag_bps", "drag").distinct()


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus = 'O' THEN 'OPEN' WHEN l_suppkey % 3 <> 0 THEN 'CLOSE' WHEN l_partkey % 5 = 0 OR l_partkey % 40 - l_partkey % 7 >= l_quantity THEN 'CLOSE_TODAY' ELSE 'CLOSE_YESTERDAY' END AS "offset" FROM lineitem"""
)
def desk_closing_offsets(spark, sf_dir):
    held = F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey") % 40)
    offset = desk.closing_offset(F.when(F.col("l_linestatus") == "O", "OPEN").otherwise("CLOSE"), F.col("l_quantity"), held, F.col("l_partkey") % 7, F.col("l_suppkey") % 3 == 0)
    return panels.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", offset.alias("offset"))


_W = "OVER (PARTITION BY symbol ORDER BY date)"


@query(
    f"""WITH {duck.PANEL_L_OWN}, e AS (SELECT date, symbol, close / nullif(lag(close) {_W}, 0) - 1 AS day_return, close / nullif(max(close) {_W}, 0) - 1 AS drawdown FROM panel),
    c AS (SELECT *, CASE WHEN day_return <= -0.25 THEN 'DAILY_LOSS_LIMIT' WHEN drawdown <= -0.6 THEN 'DRAWDOWN_LIMIT' END AS code FROM e) SELECT {_D}, symbol, {_r('day_return', 'drawdown')}, code, count(code) {_W} > 0 AS halted FROM c"""
)
def desk_equity_halts(spark, sf_dir):
    rows = panels.shipment_bars(spark, sf_dir).select("date", "symbol", F.col("close").alias("equity"))
    return desk.equity_halts(rows, "symbol", 0.25, 0.6).drop("equity")


_LIMITS = desk.Limits(most_volume=34, least_volume=2, step=1, deviation=1.2, most_position=60, margin_rate=0.1, most_margin=0.8, a_day=3, a_minute=2)


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey AS account, o_orderpriority AS symbol, o_orderdate AS ts, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side, o_orderkey % 5 <> 0 AS opens, (o_orderkey % 37)::DOUBLE AS volume, o_totalprice AS price, 200000.0::DOUBLE AS reference,
      (o_orderkey % 29)::DOUBLE AS held, 2000000.0::DOUBLE AS equity, CASE o_custkey % 101 WHEN 0 THEN 'HARD' WHEN 1 THEN 'SOFT' END AS halt, o_orderkey % 53 <> 0 AS in_session, o_orderstatus FROM orders),
    active AS (SELECT DISTINCT account, symbol, -side AS side FROM o WHERE o_orderstatus = 'O' AND o_orderkey % 11 = 0),
    w AS (SELECT *, sum(side * volume) OVER (PARTITION BY account, symbol ORDER BY ts, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after, row_number() OVER (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts, o_orderkey) AS d,
      count(*) OVER (PARTITION BY account ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS m FROM o)
    SELECT o_orderkey, CASE WHEN halt = 'HARD' OR (halt = 'SOFT' AND opens) THEN 'HALTED' WHEN symbol = '5-LOW' THEN 'SYMBOL_DENIED' WHEN NOT in_session THEN 'CLOSED' WHEN volume <= 0 OR volume > 34 OR volume < 2 THEN 'VOLUME'
      WHEN price < 0 OR (price <> 0 AND abs(price / reference - 1) > 1.2) THEN 'PRICE' WHEN a.side IS NOT NULL THEN 'SELF_TRADE' WHEN NOT opens AND volume > held THEN 'CLOSE_VOLUME' WHEN opens AND abs(after) > 60 THEN 'POSITION'
      WHEN opens AND abs(after) * price * 0.1::DOUBLE > 0.8::DOUBLE * equity THEN 'MARGIN' WHEN d > 3 OR m > 2 THEN 'RATE' ELSE 'PASS' END AS code FROM w LEFT JOIN active a USING (account, symbol, side)"""
)
def desk_order_gate(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = panels.table(spark, sf_dir, "orders").select(
        key.alias("order_id"), F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.when(key % 2 == 0, 1).otherwise(-1).alias("side"), F.when(key % 5 == 0, "CLOSE").otherwise("OPEN").alias("offset"),
        (key % 37).cast("double").alias("volume"), F.col("o_totalprice").alias("price"), F.lit(200_000.0).alias("reference"), (key % 29).cast("double").alias("held"), F.lit(2_000_000.0).alias("equity"),
        F.when(F.col("o_custkey") % 101 == 0, "HARD").when(F.col("o_custkey") % 101 == 1, "SOFT").alias("halt"), (key % 53 != 0).alias("in_session"), "o_orderstatus",
    )
    active = rows.where((F.col("o_orderstatus") == "O") & (F.col("order_id") % 11 == 0))
    denied = rows.where("symbol = '5-LOW'").select("symbol").distinct()
    return desk.order_gate(rows, denied, active, _LIMITS).select(F.col("order_id").alias("o_orderkey"), "code")


@query(
    f"""WITH {duck.PANEL_L_OWN}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM panel WHERE close IS NOT NULL), s AS (SELECT symbol, count(*) AS n, avg(CASE WHEN back <= 20 THEN volume END) AS volume FROM b GROUP BY symbol)
    SELECT symbol, n, {_r('volume')} FROM s WHERE n >= 100 AND volume >= 50"""
)
def desk_liquid_universe(spark, sf_dir):
    return desk.liquid(panels.shipment_bars(spark, sf_dir), 100, 20, 50.0)


_C, _LAST, _OUT = duck.stages({"value": FACTOR}, "panel", fill=False)
_VALUES = f"{duck.PANEL_L_FULL}, {_C}, v AS (SELECT date, symbol, close, {_OUT['value']} AS value FROM {_LAST})"


def _valued(spark, sf_dir):
    return with_column(panels.complete(panels.shipment_bars(spark, sf_dir)), "value", FACTOR)


@query(f"WITH {_VALUES}, p AS (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY value DESC, symbol) AS place FROM v WHERE value IS NOT NULL) SELECT {_D}, symbol, place, {duck.rounded('1.0::DOUBLE / count(*) OVER (PARTITION BY date)')} AS weight FROM p WHERE place <= 5")
def desk_best(spark, sf_dir):
    return desk.best(_valued(spark, sf_dir), 5).select("date", "symbol", "place", "weight")


_CV, _LV, _OV = duck.stages({"sd": "gated_std(ret,20,5)", "trend": "momentum(close,60)"}, "panel", "single", fill=False)


@query(f"WITH {duck.PANEL_L_OWN}, {_CV}, s AS (SELECT date, symbol, {_OV['sd']} AS sd, {_OV['trend']} AS trend FROM {_LV}) SELECT {_D}, symbol, {duck.rounded('coalesce(sign(trend) * CASE WHEN sd > 0 THEN least(1, 0.2::DOUBLE / (sd * sqrt(252.0::DOUBLE))) WHEN sd = 0 THEN 1 END, 0)')} AS position FROM s")
def strategy_volatility_target(spark, sf_dir):
    return desk.volatility_target(panels.shipment_bars(spark, sf_dir))


_AHEAD = f"{_VALUES}, a AS (SELECT date, symbol, {duck.steady('value')} AS x, lead(close) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS fwd, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM v)"


@query(
    f"""WITH {_AHEAD}, q AS (SELECT date, symbol, i, x, {duck.steady('fwd')} AS y FROM a), p AS (SELECT s.symbol, s.i, rank() OVER (PARTITION BY s.symbol, s.i ORDER BY b.x) + (count(*) OVER (PARTITION BY s.symbol, s.i, b.x) - 1) / 2.0::DOUBLE AS rx,
      rank() OVER (PARTITION BY s.symbol, s.i ORDER BY b.y) + (count(*) OVER (PARTITION BY s.symbol, s.i, b.y) - 1) / 2.0::DOUBLE AS ry FROM q s JOIN q b ON b.symbol = s.symbol AND b.i BETWEEN s.i - 60 AND s.i - 1 WHERE b.x IS NOT NULL AND b.y IS NOT NULL),
    c AS (SELECT symbol, i, CASE WHEN count(*) >= 10 AND stddev_samp(rx) > 0 AND stddev_samp(ry) > 0 THEN covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) END AS ic FROM p GROUP BY 1, 2) SELECT {_D}, a.symbol, {_r('ic')} FROM a LEFT JOIN c USING (symbol, i)"""
)
def research_rolling_ic(spark, sf_dir):
    return attribution.rolling_ic(r.forward_return(_valued(spark, sf_dir)))


@query(
    f"""WITH {_AHEAD}, h AS (SELECT s.symbol, s.i, count(*) AS n, count(*) FILTER (b.x <= s.x) AS p FROM a s JOIN a b ON b.symbol = s.symbol AND b.i <= s.i WHERE s.x IS NOT NULL AND s.fwd IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT symbol, i, CASE WHEN n > 5 THEN greatest(0, ceil((p - 1) * 5 / (n - 1)) - 1)::INT END AS bucket FROM h) SELECT {_D}, a.symbol, bucket, {duck.rounded('CASE bucket WHEN 4 THEN fwd WHEN 0 THEN -fwd ELSE 0 END')} AS ret FROM a LEFT JOIN k USING (symbol, i)"""
)
def research_expanding_long_short(spark, sf_dir):
    return attribution.expanding_long_short(r.forward_return(_valued(spark, sf_dir)))


_CR, _LR, _OR = duck.stages({"ret": "pct_change(close,1)", "sd": "gated_std(pct_change(close,1),20,20)"}, "panel", "single", fill=False)


@query(
    f"""WITH {duck.PANEL_L_OWN}, {_CR}, s AS (SELECT symbol, {_OR['ret']} AS ret, {_OR['sd']} AS sd FROM {_LR}), c AS (SELECT *, quantile_cont(sd, 1 / 3.0::DOUBLE) OVER (PARTITION BY symbol) AS q1, quantile_cont(sd, 2 / 3.0::DOUBLE) OVER (PARTITION BY symbol) AS q2 FROM s WHERE sd IS NOT NULL),
    g AS (SELECT *, ({duck.steady('sd')} >= {duck.steady('q1')})::INT + ({duck.steady('sd')} >= {duck.steady('q2')})::INT AS regime FROM c) SELECT symbol, regime, count(*) AS n, {duck.rounded('avg(ret)')} AS mean, {duck.rounded('min(sd)')} AS low, {duck.rounded('max(sd)')} AS high FROM g GROUP BY symbol, regime"""
)
def validation_volatility_regimes(spark, sf_dir):
    rows = attribution.volatility_regimes(panels.shipment_bars(spark, sf_dir))
    return rows.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.min("sd").alias("low"), F.max("sd").alias("high"))


@query(f"WITH {duck.PANEL_L_OWN} SELECT strftime(min(date), '%Y-%m-%d') || '~' || strftime(max(date), '%Y-%m-%d') || '#' || count(DISTINCT date) || 'x' || count(DISTINCT symbol) || '#' || left(md5(string_agg(DISTINCT symbol, ',' ORDER BY symbol)), 8) AS fingerprint FROM panel")
def research_fingerprint(spark, sf_dir):
    return attribution.fingerprint(panels.shipment_bars(spark, sf_dir))


@query()
def research_risk_attribution(spark, sf_dir):
    panel = panels.complete(panels.shipment_bars(spark, sf_dir))
    rows = with_factors(panel, THREE, fill=False).join(r.forward_return(panel).select("date", "symbol", "fwd"), ["date", "symbol"])
    weighted = rows.withColumn("weight", F.coalesce(F.col("reversal"), F.lit(0.0)))
    return attribution.risk_attribution(weighted, "weight", "fwd", list(THREE))


@query()
def research_learned_factor(spark, sf_dir):
    panel = panels.complete(panels.shipment_bars(spark, sf_dir))
    rows = with_factors(panel, THREE, fill=False).join(r.forward_return(panel).select("date", "symbol", "fwd"), ["date", "symbol"])
    return attribution.learned_factor(rows, list(THREE), "fwd")


_BATCH = {"reversal": "-delta(close,5)/close", "activity": "volume/mean(volume,10)", "range": "(high-low)/close", "trend": "mean(close,5)/mean(close,20)-1", "co": "-corr(rank(close),rank(volume),10)"}
_CB, _LB, _OB = duck.stages(_BATCH, "panel", fill=False)
_PLACE = "rank() OVER (PARTITION BY name, date ORDER BY {0}) + (count(*) OVER (PARTITION BY name, date, {0}) - 1) / 2.0::DOUBLE"


@query(
    f"""WITH {duck.PANEL_L_FULL}, {_CB}, v AS (SELECT date, lead(close) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS fwd, {', '.join(f'{x} AS "{k}_"' for k, x in _OB.items())} FROM {_LB}),
    e AS ({' UNION ALL '.join(f"SELECT '{k}' AS name, date, {k}_ AS x, fwd FROM v" for k in _BATCH)}), q AS (SELECT name, date, {duck.steady('x')} AS x, {duck.steady('fwd')} AS y FROM e WHERE x IS NOT NULL AND fwd IS NOT NULL),
    p AS (SELECT name, date, {_PLACE.format('x')} AS rx, {_PLACE.format('y')} AS ry FROM q),
    c AS (SELECT name, date, CASE WHEN stddev_samp(rx) * stddev_samp(ry) > 1e-12 THEN covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) END AS ic FROM p GROUP BY 1, 2 HAVING count(*) >= 3),
    s AS (SELECT name, count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, avg((ic > 1e-12)::INT) AS positive FROM c WHERE ic IS NOT NULL GROUP BY name) SELECT name, n, {_r('mean', 'std', 'positive')}, {duck.rounded('mean / nullif(std, 0)')} AS ir FROM s"""
)
def research_batch_report(spark, sf_dir):
    return formula_search.batch_report(panels.complete(panels.shipment_bars(spark, sf_dir)), _BATCH)


_ALIKE = _BATCH | {"reversal_6": "-delta(close,6)/close", "activity_12": "volume/mean(volume,12)"}
_CA, _LA, _OA = duck.stages(_ALIKE, "panel", fill=False)
_RANK = "rank() OVER (PARTITION BY name, date ORDER BY z) + (count(*) OVER (PARTITION BY name, date, z) - 1) / 2.0::DOUBLE"


@query(
    f"""WITH RECURSIVE {duck.PANEL_L_FULL}, {_CA}, v AS (SELECT date, symbol, lead(close) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS fwd, {', '.join(f'{x} AS "{k}_"' for k, x in _OA.items())} FROM {_LA}),
    e AS MATERIALIZED ({' UNION ALL '.join(f"SELECT '{k}' AS name, date, symbol, {k}_ AS x, fwd FROM v" for k in _ALIKE)}), q AS (SELECT name, date, {duck.steady('x')} AS x, {duck.steady('fwd')} AS y FROM e WHERE x IS NOT NULL AND fwd IS NOT NULL),
    p AS (SELECT name, date, {_PLACE.format('x')} AS rx, {_PLACE.format('y')} AS ry FROM q),
    c AS (SELECT name, date, CASE WHEN stddev_samp(rx) * stddev_samp(ry) > 1e-12 THEN covar_samp(rx, ry) / (stddev_samp(rx) * stddev_samp(ry)) END AS ic FROM p GROUP BY 1, 2 HAVING count(*) >= 3),
    o AS (SELECT name, avg(ic) AS mean, row_number() OVER (ORDER BY abs(avg(ic)) DESC, name) AS k FROM c GROUP BY name),
    z AS (SELECT name, date, symbol, {duck.steady('x')} AS z FROM e WHERE x IS NOT NULL), r AS MATERIALIZED (SELECT name, date, symbol, {_RANK} AS r FROM z),
    near AS (SELECT a.name AS a, b.name AS b, covar_samp(a.r, b.r) / nullif(stddev_samp(a.r) * stddev_samp(b.r), 0) AS q FROM r a JOIN r b ON a.date = b.date AND a.symbol = b.symbol AND a.name <> b.name GROUP BY 1, 2),
    nb AS (SELECT o.name, o.mean, o.k, coalesce(list(near.b) FILTER (near.q >= 0.7), []) AS close FROM o LEFT JOIN near ON near.a = o.name GROUP BY ALL),
    pick(k, heads) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT nb.k, CASE WHEN list_has_any(heads, nb.close) THEN heads ELSE list_append(heads, nb.name) END FROM pick JOIN nb ON nb.k = pick.k + 1),
    h AS (SELECT arg_max(heads, k) AS heads FROM pick)
    SELECT name, {duck.rounded('abs(mean)')} AS mean, CASE WHEN list_contains(heads, name) THEN name ELSE list_filter(heads, lambda x: list_contains(nb.close, x))[1] END AS head FROM nb, h"""
)
def research_deduplicated(spark, sf_dir):
    return formula_search.deduplicated(panels.complete(panels.shipment_bars(spark, sf_dir)), _ALIKE)


@query()
def research_evolved(spark, sf_dir):
    return formula_search.evolved(panels.complete(panels.shipment_bars(spark, sf_dir)), list(_BATCH.values()))


_STATES = "CASE o_orderstatus WHEN 'O' THEN 'NOT_TRADED' WHEN 'P' THEN 'PART_TRADED' ELSE 'ALL_TRADED' END"


def _working(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = panels.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "NOT_TRADED").when(F.col("o_orderstatus") == "P", "PART_TRADED").otherwise("ALL_TRADED")
    return o.select("o_orderkey", F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), status.alias("status"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("side"), F.col("o_totalprice").alias("volume"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") / 4).alias("traded"))


@query(f"SELECT o_orderpriority AS symbol, {duck.rounded('sum(CASE WHEN o_orderstatus IN (' + chr(39) + 'O' + chr(39) + ', ' + chr(39) + 'P' + chr(39) + ') THEN CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * (o_totalprice - CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 4 ELSE 0 END) ELSE 0 END)')} AS frozen FROM orders GROUP BY 1")
def account_frozen_volume(spark, sf_dir):
    return accounts.frozen_volume(_working(spark, sf_dir))


@query("SELECT o_orderkey, (epoch(TIMESTAMP '1998-01-01 00:00:00') - epoch(o_orderdate))::BIGINT AS age FROM orders WHERE o_orderstatus IN ('O', 'P') AND epoch(TIMESTAMP '1998-01-01 00:00:00') - epoch(o_orderdate) >= 86400")
def account_overdue_orders(spark, sf_dir):
    return accounts.overdue(_working(spark, sf_dir), "1998-01-01 00:00:00", 86_400).select("o_orderkey", "age")
