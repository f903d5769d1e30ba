"""Queries of the research operators on panel L, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ops import with_column, with_factors
from ..operators import bars
from ..operators import research as r
from ..operators import validation as v
from ..sources import panels
from . import duck
from .factor_queries import published

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FACTOR, K = "mean(close,5)/close-1", 5
THREE = {"reversal": "-delta(close,5)/close", "activity": "volume/mean(volume,10)", "range": "(high-low)/close"}


def query(sql: str | None = None):
    def mark(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: published(function(spark, sf_dir))
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return mark


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.complete(panels.shipment_bars(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.forward_return(with_column(_panel(spark, sf_dir), "value", FACTOR))


_CTES, _LAST, _OUT = duck.stages({"value": FACTOR}, "panel", fill=False)
_STEADY = duck.steady
_SCORED = f"""{duck.PANEL_L_FULL}, {_CTES},
scored AS (SELECT date, symbol, close, {_OUT['value']} AS value, lead(close) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS fwd FROM {_LAST})"""


def _rank(x: str) -> str:
    s = _STEADY(x)
    return f"rank() OVER (PARTITION BY date ORDER BY {s}) + (count(*) OVER (PARTITION BY date, {s}) - 1) / 2.0::DOUBLE"


def _corr(a: str, b: str) -> str:
    return f"CASE WHEN stddev_samp({a}) * stddev_samp({b}) > 1e-12 THEN covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) END"


_PAIRS = f"ranked AS (SELECT date, value AS x, fwd AS y, {_rank('value')} AS rx, {_rank('fwd')} AS ry FROM scored WHERE value IS NOT NULL AND fwd IS NOT NULL)"
_IC = f"{_SCORED}, {_PAIRS}, ic AS (SELECT date, count(*) AS n, {_corr('rx', 'ry')} AS rank_ic, {_corr('x', 'y')} AS ic FROM ranked GROUP BY date HAVING count(*) >= 3)"
_BUCKETS = f"""{_SCORED},
placed AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {_STEADY('value')}, symbol) AS p, count(*) OVER (PARTITION BY date) AS n_date FROM scored WHERE value IS NOT NULL AND fwd IS NOT NULL),
bucketed AS (SELECT *, greatest(0, ceil((p - 1) * {K} / nullif(n_date - 1, 0)) - 1)::INT AS bucket FROM placed WHERE n_date >= {K})"""
_MEANS = f"{_BUCKETS}, daily AS (SELECT date, bucket, avg(fwd) AS r FROM bucketed GROUP BY 1, 2), means AS (SELECT bucket, count(*) AS n, avg(r) AS mean_return FROM daily GROUP BY 1)"
_BOOK = f"""{_BUCKETS},
sided AS (SELECT *, CASE bucket WHEN {K - 1} THEN 1.0::DOUBLE WHEN 0 THEN -1.0::DOUBLE END AS side FROM bucketed WHERE bucket IN (0, {K - 1})),
held AS (SELECT date, symbol, side / count(*) OVER (PARTITION BY date, side) AS weight, fwd AS r FROM sided),
dates AS (SELECT date, sum(weight * r) AS gross, count(*) AS n, row_number() OVER (ORDER BY date) AS seq FROM held GROUP BY date),
now AS (SELECT seq, symbol, weight FROM held JOIN dates USING (date)),
moved AS (SELECT coalesce(a.seq, b.seq + 1) AS seq, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS moved FROM now a FULL JOIN now b ON a.symbol = b.symbol AND a.seq = b.seq + 1 GROUP BY 1),
book AS (SELECT date, gross, CASE WHEN seq = 1 THEN 0 ELSE moved / 2 END AS turnover, gross - 0.001 * CASE WHEN seq = 1 THEN 0 ELSE moved / 2 END AS net, n FROM dates JOIN moved USING (seq))"""
_D = "strftime(date, '%Y-%m-%d') AS date"


def _r(*names: str) -> str:
    return ", ".join(f"{duck.rounded(n)} AS {n}" for n in names)


@query(f"WITH {_IC} SELECT {_D}, n, {_r('rank_ic', 'ic')} FROM ic")
def research_daily_ic(spark, sf_dir):
    return r.daily_ic(_scored(spark, sf_dir))


@query(f"WITH {_IC}, s AS (SELECT count(rank_ic) AS n, avg(rank_ic) AS mean, stddev_samp(rank_ic) AS std, avg((rank_ic > 1e-12)::INT) AS positive FROM ic) SELECT n, {_r('mean', 'std', 'positive')}, {duck.rounded('mean / nullif(std, 0)')} AS ir FROM s")
def research_ic_statistics(spark, sf_dir):
    return r.ic_statistics(r.daily_ic(_scored(spark, sf_dir)))


def _decay_sql() -> str:
    parts, ctes = [], [_SCORED]
    for h in range(1, 6):
        ctes.append(f"f{h} AS (SELECT date, symbol, value, lead(close, {h}) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS fwd FROM scored)")
        ctes.append(f"g{h} AS (SELECT date, {_rank('value')} AS rx, {_rank('fwd')} AS ry FROM f{h} WHERE value IS NOT NULL AND fwd IS NOT NULL)")
        ctes.append(f"i{h} AS (SELECT {_corr('rx', 'ry')} AS c FROM g{h} GROUP BY date HAVING count(*) >= 3)")
        parts.append(f"SELECT {h} AS lag, avg(c) AS mean_ic FROM i{h}")
    return ", ".join(ctes) + f", decay AS ({' UNION ALL '.join(parts)})"


_DECAY = _decay_sql()


@query(f"WITH {_DECAY} SELECT lag, {_r('mean_ic')} FROM decay")
def research_ic_decay(spark, sf_dir):
    return r.ic_decay(with_column(_panel(spark, sf_dir), "value", FACTOR))


@query(f"WITH {_DECAY}, s AS (SELECT count(*) AS n, covar_samp(lag::DOUBLE, ln(abs(mean_ic))) / nullif(var_samp(lag::DOUBLE), 0) AS b FROM decay WHERE abs(mean_ic) > 0) SELECT {duck.rounded('CASE WHEN n >= 3 AND b < 0 THEN -ln(2.0::DOUBLE) / b END')} AS half_life FROM s")
def research_half_life(spark, sf_dir):
    return r.half_life(r.ic_decay(with_column(_panel(spark, sf_dir), "value", FACTOR)))


@query(f"WITH {_BUCKETS} SELECT {_D}, symbol, bucket FROM bucketed")
def research_buckets(spark, sf_dir):
    return r.bucketed(_scored(spark, sf_dir).where("fwd IS NOT NULL"), "value", K, K).select("date", "symbol", "bucket")


@query(f"WITH {_MEANS} SELECT bucket, n, {_r('mean_return')} FROM means")
def research_bucket_returns(spark, sf_dir):
    return r.bucket_returns(_scored(spark, sf_dir))


@query(f"WITH {_MEANS} SELECT {duck.rounded(_corr('bucket::DOUBLE', 'mean_return'))} AS monotonicity FROM means")
def research_monotonicity(spark, sf_dir):
    return r.monotonicity(r.bucket_returns(_scored(spark, sf_dir)))


@query(f"WITH {_BOOK} SELECT {_D}, {_r('gross', 'turnover', 'net')}, n FROM book")
def research_long_short(spark, sf_dir):
    return r.long_short(_scored(spark, sf_dir), cost=0.001)


_PATH = f"""{_BOOK}, path0 AS (SELECT date, net AS r, exp(sum(ln(1 + greatest(net, -0.999999))) OVER (ORDER BY date)) AS equity FROM book),
path AS (SELECT *, equity / greatest(1.0, max(equity) OVER (ORDER BY date)) - 1 AS drawdown FROM path0)"""


@query(
    f"""WITH {_PATH}, s AS (SELECT count(r) AS n, arg_max(equity, date) - 1 AS total, avg(r) AS mean, stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < 0 THEN r END) AS sd_down, min(drawdown) AS max_drawdown,
    avg((r > 0)::INT) AS win_rate, sum(CASE WHEN r > 0 THEN r END) / nullif(sum(CASE WHEN r < 0 THEN -r END), 0) AS profit_factor FROM path),
    t AS (SELECT *, CASE WHEN total > -1 THEN pow(1 + total, 252.0 / n) - 1 ELSE -1 END AS annual FROM s)
    SELECT n, {_r('total', 'annual', 'max_drawdown', 'win_rate', 'profit_factor')}, {duck.rounded('mean / nullif(sd, 0) * sqrt(252.0::DOUBLE)')} AS sharpe, {duck.rounded('mean / nullif(sd_down, 0) * sqrt(252.0::DOUBLE)')} AS sortino,
    {duck.rounded('annual / nullif(abs(max_drawdown), 0)')} AS calmar FROM t"""
)
def research_performance(spark, sf_dir):
    return r.performance(r.long_short(_scored(spark, sf_dir), cost=0.001))


@query(
    f"""WITH {_PATH}, v AS (SELECT quantile_cont(r, 0.05) AS var95, count(*) AS n, stddev_samp(r) * sqrt(252.0::DOUBLE) AS volatility, skewness(r) AS skew, kurtosis(r) AS kurtosis FROM path),
    u AS (SELECT *, ln(equity) < greatest(0.0, max(ln(equity)) OVER (ORDER BY date)) - 1e-12 AS under FROM path), i AS (SELECT *, sum(CASE WHEN under THEN 0 ELSE 1 END) OVER (ORDER BY date) AS island FROM u),
    l AS (SELECT coalesce(max(c), 0) AS underwater FROM (SELECT count(*) AS c FROM i WHERE under GROUP BY island))
    SELECT n::DOUBLE AS n, {_r('volatility', 'skew', 'kurtosis', 'var95')}, {duck.rounded('(SELECT avg(r) FROM path WHERE r <= var95)')} AS cvar95, underwater FROM v, l"""
)
def research_risk_xray(spark, sf_dir):
    return r.risk_xray(r.long_short(_scored(spark, sf_dir), cost=0.001))


_C3, _L3, _O3 = duck.stages(THREE, "panel", fill=False)
_THREE = f"{duck.PANEL_L_FULL}, {_C3}, three AS (SELECT date, symbol, {', '.join(f'{x} AS {duck_name}' for duck_name, x in ((f'{k}_', v) for k, v in _O3.items()))} FROM {_L3})"


def _three(spark, sf_dir):
    return with_factors(_panel(spark, sf_dir), THREE, fill=False)


def _pooled(a: str, b: str) -> str:
    x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


def _null_rank(x: str) -> str:
    s = _STEADY(x)
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY {s} NULLS LAST) + (count({x}) OVER (PARTITION BY date, {s}) - 1) / 2.0::DOUBLE END"


@query(
    f"WITH {_THREE}, k AS (SELECT "
    + ", ".join(f"{_null_rank(n + '_')} AS {n}" for n in THREE)
    + " FROM three) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {duck.rounded(_pooled(a, b))} AS correlation FROM k" for a, b in (("reversal", "activity"), ("reversal", "range"), ("activity", "range")))
)
def research_factor_correlations(spark, sf_dir):
    return r.factor_correlations(_three(spark, sf_dir), list(THREE))


def _z(n: str) -> str:
    sd = f"stddev_samp({n}_) OVER (PARTITION BY date)"
    return f"CASE WHEN {n}_ IS NOT NULL AND {sd} > 1e-12 THEN least(greatest(({n}_ - avg({n}_) OVER (PARTITION BY date)) / {sd}, -3), 3) END"


@query(f"WITH {_THREE} SELECT {_D}, symbol, {duck.rounded(' + '.join(f'coalesce({_z(n)}, 0) * {w}' for n, w in zip(THREE, (0.5, 0.3, 0.2))))} AS value FROM three")
def research_combined(spark, sf_dir):
    return r.combined(_three(spark, sf_dir), dict(zip(THREE, (0.5, 0.3, 0.2), strict=True)))


@query(f"WITH {_THREE} SELECT {_D}, symbol, {', '.join(f'{duck.rounded(_z(n))} AS {n}' for n in THREE)} FROM three")
def research_standardised(spark, sf_dir):
    return r.standardised(_three(spark, sf_dir), list(THREE))


@query(f"WITH {_SCORED} SELECT {_D}, symbol, {duck.rounded('value - avg(value) OVER (PARTITION BY date, symbol::INT % 3)')} AS value FROM scored")
def research_neutralised(spark, sf_dir):
    return r.neutralised(_scored(spark, sf_dir).withColumn("g", F.col("symbol").cast("int") % 3), "value", "g").select("date", "symbol", "value")


@query()
def research_neutralised_by_styles(spark, sf_dir):
    return r.neutralised_by_styles(_three(spark, sf_dir), "reversal", ["activity", "range"])


@query()
def research_orthogonalised(spark, sf_dir):
    return r.orthogonalised(_three(spark, sf_dir), list(THREE))


@query()
def research_factor_returns(spark, sf_dir):
    scored = r.forward_return(_panel(spark, sf_dir)).select("date", "symbol", "fwd")
    return r.factor_returns(_three(spark, sf_dir).join(scored, ["date", "symbol"]), "fwd", list(THREE))


@query(
    f"""WITH {_BOOK}, m AS (SELECT avg(gross) AS ma, avg(turnover) AS mb, count(*) AS t FROM book), c AS (SELECT date, gross - ma AS x, turnover - mb AS y, t FROM book, m),
    v AS (SELECT t, x * y {' '.join(f'+ {1 - j / 4!r} * (coalesce(x * lag(y, {j}) OVER (ORDER BY date), 0) + coalesce(y * lag(x, {j}) OVER (ORDER BY date), 0))' for j in (1, 2, 3))} AS v FROM c)
    SELECT {duck.rounded('sum(v) / max(t)')} AS covariance FROM v"""
)
def research_newey_west(spark, sf_dir):
    return r.newey_west(r.long_short(_scored(spark, sf_dir), cost=0.001), "gross", "turnover", 3)


_CR, _LR, _OR = duck.stages({"slope": "slope(log(close),20)"}, "panel", "single", fill=False)


@query(
    f"""WITH {duck.PANEL_L_OWN}, {_CR}, a AS (SELECT date, symbol, {_OR['slope']} AS slope FROM {_LR}), b AS (SELECT *, slope - lag(slope, 5) OVER (PARTITION BY symbol ORDER BY date) AS change FROM a)
    SELECT symbol, CASE WHEN slope IS NULL OR abs(coalesce(change, 0)) < 1e-3 THEN 'sideways' WHEN slope > 0 THEN 'bull' ELSE 'bear' END AS regime, count(*) AS n FROM b GROUP BY 1, 2"""
)
def research_regime_counts(spark, sf_dir):
    rows = with_column(panels.shipment_bars(spark, sf_dir), "slope", "slope(log(close),20)", "single")
    return r.regimes(rows, 1e-3).groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {duck.PANEL_L_OWN}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)),
    s AS (SELECT date, CASE WHEN i <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'valid' ELSE 'test' END AS part FROM d)
    SELECT part, count(*) AS n, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last FROM panel JOIN s USING (date) GROUP BY part"""
)
def research_time_split(spark, sf_dir):
    return r.time_split(panels.shipment_bars(spark, sf_dir)).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(
    f"""WITH {duck.PANEL_L_OWN}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM panel), b AS (SELECT *, CASE WHEN i <= 50 THEN close END AS f FROM a),
    c AS (SELECT *, avg(f) OVER (PARTITION BY symbol) AS m, stddev_samp(f) OVER (PARTITION BY symbol) AS sd FROM b) SELECT {_D}, symbol, {duck.rounded('CASE WHEN sd > 1e-12 THEN abs(close - m) / sd END')} AS turbulence FROM c"""
)
def research_turbulence(spark, sf_dir):
    return r.turbulence(panels.shipment_bars(spark, sf_dir), "close", 50).select("date", "symbol", "turbulence")


@query(
    f"""WITH {_IC}, b AS (SELECT rank_ic, row_number() OVER (ORDER BY date DESC) AS i FROM ic WHERE rank_ic IS NOT NULL), s AS (SELECT avg(CASE WHEN i <= 60 THEN rank_ic END) AS recent, avg(CASE WHEN i > 60 THEN rank_ic END) AS history FROM b),
    t AS (SELECT *, recent / nullif(history, 0) AS ratio FROM s) SELECT {_r('recent', 'history', 'ratio')}, CASE WHEN ratio IS NULL THEN 'ACTIVE' WHEN ratio < 0 THEN 'DISABLED' WHEN ratio < 0.5 THEN 'DECAYED' WHEN ratio < 0.6 THEN 'MONITORING' ELSE 'ACTIVE' END AS status FROM t"""
)
def research_decay_status(spark, sf_dir):
    return r.decay_status(r.daily_ic(_scored(spark, sf_dir)))


@query(
    f"""WITH {_BUCKETS}, p2 AS (SELECT date, bucket, row_number() OVER (PARTITION BY date ORDER BY value DESC, symbol) AS p, row_number() OVER (PARTITION BY date ORDER BY bucket DESC, symbol) AS q FROM bucketed)
    SELECT {_D}, {duck.rounded('sum(CASE WHEN p <= 5 THEN (pow(2.0::DOUBLE, bucket) - 1) / log2(p + 1.0::DOUBLE) END) / nullif(sum(CASE WHEN q <= 5 THEN (pow(2.0::DOUBLE, bucket) - 1) / log2(q + 1.0::DOUBLE) END), 0)')} AS ndcg FROM p2 GROUP BY date"""
)
def research_ndcg(spark, sf_dir):
    return r.ndcg(r.bucketed(_scored(spark, sf_dir).where("fwd IS NOT NULL"), "value", K, K), "value", "bucket")


@query()
def research_report(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    ic = r.ic_statistics(r.daily_ic(scored)).select(F.col("mean").alias("mean_ic"), "ir")
    book = r.long_short(scored)
    perf = r.performance(book).select("sharpe", "annual", "max_drawdown")
    turn = book.agg((F.avg("turnover") * 252).alias("turnover"))
    mono = r.monotonicity(r.bucket_returns(scored))
    return r.composite_score(ic.crossJoin(perf).crossJoin(turn).crossJoin(mono))  # each is one row


def _book(spark, sf_dir):
    return r.long_short(_scored(spark, sf_dir), cost=0.001)


@query(f"WITH {_BOOK}, i AS (SELECT net AS r, row_number() OVER (ORDER BY date) AS i FROM book), f AS (SELECT ((i - 101) // 50)::INT AS fold, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS sd FROM i WHERE i > 100 GROUP BY 1) SELECT fold, n, {_r('mean')}, {duck.rounded('mean / nullif(sd, 0) * sqrt(252.0::DOUBLE)')} AS sharpe FROM f")
def validation_walk_forward(spark, sf_dir):
    return v.walk_forward(_book(spark, sf_dir), "net", 100, 50)


@query(f"WITH {_BOOK}, m AS (SELECT gross - multiplier * 0.001 * turnover AS net, multiplier FROM book, (SELECT unnest([0.0::DOUBLE, 0.5, 1, 2, 4]) AS multiplier)) SELECT multiplier, {duck.rounded('avg(net)')} AS mean, {duck.rounded('avg((net > 0)::INT)')} AS positive FROM m GROUP BY multiplier")
def validation_cost_sensitivity(spark, sf_dir):
    return v.cost_sensitivity(_book(spark, sf_dir), 0.001)


def _grid_sql(fast: list[int], slow: list[int]) -> str:
    windows = sorted({*fast, *slow})
    means = ", ".join(f"CASE WHEN count(close) OVER w{n} >= {n} THEN avg(close) OVER w{n} END AS m{n}" for n in windows)
    frames = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in windows)
    side = "CASE WHEN m{a} IS NULL OR m{b} IS NULL THEN 0 WHEN m{a} > m{b} THEN 1 ELSE -1 END AS target"
    every = " UNION ALL ".join(f"SELECT {a} AS fast, {b} AS slow, date, symbol, open, {side.format(a=a, b=b)} FROM means" for a in fast for b in slow if a < b)
    w = "OVER (PARTITION BY fast, slow, symbol ORDER BY date)"
    return f"""WITH {duck.PANEL_L_OWN}, means AS MATERIALIZED (SELECT date, symbol, open, {means} FROM panel WINDOW {frames}), every AS ({every}),
    p AS (SELECT *, coalesce(lag(target) {w}, 0) AS position, lead(open) {w} AS after FROM every), h AS (SELECT *, coalesce(lag(position) {w}, 0) AS held FROM p)
    SELECT fast, slow, {duck.rounded('sum(coalesce(position * (after / nullif(open, 0) - 1), 0))')} AS pnl, sum(abs(position - held))::BIGINT AS trades FROM h GROUP BY fast, slow"""


@query(_grid_sql([3, 5, 10], [10, 20, 40]))
def validation_parameter_grid(spark, sf_dir):
    return v.parameter_grid(panels.shipment_bars(spark, sf_dir), [3, 5, 10], [10, 20, 40])


@query()
def validation_monte_carlo(spark, sf_dir):
    return v.monte_carlo(_book(spark, sf_dir), "net", 200)


@query()
def validation_bootstrap_interval(spark, sf_dir):
    return v.bootstrap_interval(r.daily_ic(_scored(spark, sf_dir)))


_SPREAD = f"{duck.PANEL_L_OWN}, sp AS (SELECT a.date, a.close - b.close AS close FROM panel a JOIN panel b ON a.date = b.date WHERE a.symbol = '1' AND b.symbol = '2')"
_W20 = "OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query(
    f"""WITH {_SPREAD}, z AS (SELECT date, CASE WHEN count(close) {_W20} >= 20 THEN (close - avg(close) {_W20}) / nullif(stddev_samp(close) {_W20}, 0) END AS z FROM sp),
    m AS (SELECT *, CASE WHEN z > 1.5 THEN -1 WHEN z < -1.5 THEN 1 WHEN abs(z) < 0.5 THEN 0 END AS mark FROM z) SELECT {_D}, {_r('z')}, coalesce(last_value(mark IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS position FROM m"""
)
def strategy_pair(spark, sf_dir):
    rows = panels.shipment_bars(spark, sf_dir)
    return v.pair_signal(bars.spread(rows.where("symbol = '1'"), rows.where("symbol = '2'")), 20, 1.5, 0.5)


@query(f"WITH {duck.PANEL_L_OWN}, m AS (SELECT date, symbol, close / nullif(lag(close, 20) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS r FROM panel) SELECT {_D}, symbol, CASE WHEN r > 0.02 THEN 1 WHEN r < -0.02 THEN -1 ELSE 0 END AS position FROM m")
def strategy_momentum(spark, sf_dir):
    return v.momentum_signal(panels.shipment_bars(spark, sf_dir))


@query(
    f"""WITH {duck.PANEL_L_OWN}, m AS (SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS top, CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END AS trend FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    n AS (SELECT *, lag(top) OVER (PARTITION BY symbol ORDER BY date) AS before FROM m) SELECT {_D}, symbol, coalesce(close - trend > 0 AND close - before >= 0, false) AS buy FROM n"""
)
def strategy_third_buy(spark, sf_dir):
    return v.third_buy_signal(panels.shipment_bars(spark, sf_dir))


@query()
def strategy_bollinger_recover(spark, sf_dir):
    return v.bollinger_recover(panels.shipment_bars(spark, sf_dir))


@query()
def strategy_first_buy(spark, sf_dir):
    return v.first_buy(panels.shipment_bars(spark, sf_dir))


@query(
    """WITH s AS (SELECT o_custkey, avg(o_totalprice) / 150000 AS sharpe, -count(*) / 100.0::DOUBLE AS max_drawdown, count(*) * 3 AS days, max(o_totalprice) / 300000 AS calmar, avg((o_orderstatus = 'F')::INT) AS win_rate FROM orders GROUP BY 1)
    SELECT o_custkey, array_to_string(list_filter([CASE WHEN sharpe < 1 THEN 'sharpe' END, CASE WHEN max_drawdown < -0.15 THEN 'drawdown' END, CASE WHEN days < 30 THEN 'days' END, CASE WHEN calmar < 1 THEN 'calmar' END, CASE WHEN win_rate < 0.45 THEN 'win_rate' END], lambda x: x IS NOT NULL), ',') AS reasons,
    NOT (sharpe < 1 OR max_drawdown < -0.15 OR days < 30 OR calmar < 1 OR win_rate < 0.45) AS promoted FROM s""")
def validation_promotion(spark, sf_dir):
    o = panels.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        (F.avg("o_totalprice") / 150000).alias("sharpe"), (-F.count(F.lit(1)) / 100.0).alias("max_drawdown"), (F.count(F.lit(1)) * 3).alias("days"), (F.max("o_totalprice") / 300000).alias("calmar"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("win_rate")
    )
    return v.promotion(o).select("o_custkey", "reasons", "promoted")
