"""Queries of composites, mining, models and searches on panel L, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.factors import FAMILIES
from ..operators import composite as c
from ..operators import formula_search, gate, lattice, mining, ranker, research, validation
from ..operators import multifactor as mf
from ..sources import panels
from . import duck
from .factor_queries import published

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
POOL = {
    "activity": "volume/mean(volume,10)", "gap": "open/delay(close,1)-1", "level": "mean(close,5)/close-1", "mix": "rank(close)-rank(volume)",
    "range": "(high-low)/close", "reversal": "-delta(close,5)/close", "reversal_3": "-delta(close,3)/close", "spread": "mean(high-low,5)/close",
}
THREE = ("activity", "range", "reversal")
LEAST, NEAR, K, COST = 0.02, 0.5, 5, 0.001
SETTINGS = mining.Settings(least_ic=LEAST, near=NEAR, k=K, cost=COST)
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


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.complete(panels.shipment_bars(spark, sf_dir))


def _pool_sql(formulas: dict[str, str]) -> str:
    """``rows`` (wide), ``long``, ``ic`` and ``stats`` of the formulas, with parts whose returns end in them."""
    ctes, last, out = duck.stages(formulas, "panel", fill=False, prefix="q")
    made = ", ".join(f"{x} AS f_{n}" for n, x in out.items())
    long = " UNION ALL ".join(f"SELECT '{n}' AS name, date, symbol, part, f_{n} AS x, fwd FROM rows WHERE f_{n} IS NOT NULL" for n in formulas)
    return f"""{duck.PANEL_L_FULL}, {ctes}, f AS MATERIALIZED (SELECT date, symbol, close, {made} FROM {last}),
d AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM f)),
p AS (SELECT date, CASE WHEN i <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'valid' ELSE 'test' END AS part FROM d),
rows AS MATERIALIZED (SELECT f.*, part, lead(close) OVER (PARTITION BY symbol, part ORDER BY date) / nullif(close, 0) - 1 AS fwd FROM f JOIN p USING (date)),
every AS MATERIALIZED ({long}), long AS (SELECT * FROM every WHERE fwd IS NOT NULL), {_ic_sql('long', 'ic')},
stats AS MATERIALIZED (SELECT name, part, count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std FROM ic WHERE ic IS NOT NULL GROUP BY 1, 2)"""


def _ic_sql(long: str, out: str) -> str:
    place = "rank() OVER (PARTITION BY name, date ORDER BY {c}) + (count(*) OVER (PARTITION BY name, date, {c}) - 1) / 2.0::DOUBLE"
    spread = "stddev_samp(rx) * stddev_samp(ry)"
    return f"""{out}_s AS (SELECT name, part, date, {duck.steady('x')} AS sx, {duck.steady('fwd')} AS sy FROM {long}),
{out}_r AS (SELECT name, part, date, {place.format(c='sx')} AS rx, {place.format(c='sy')} AS ry FROM {out}_s),
{out} AS (SELECT name, part, date, count(*) AS n, CASE WHEN {spread} > 1e-12 THEN covar_samp(rx, ry) / ({spread}) END AS ic FROM {out}_r GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""


def _book_sql(long: str, out: str) -> str:
    """The book of every name of ``long`` (``name, date, symbol, x, fwd``)."""
    return f"""{out}_p AS (SELECT *, row_number() OVER (PARTITION BY name, date ORDER BY {duck.steady('x')}, symbol) AS p, count(*) OVER (PARTITION BY name, date) AS n_date FROM {long}),
{out}_b AS (SELECT *, greatest(0, ceil((p - 1) * {K} / nullif(n_date - 1, 0)) - 1) AS bucket FROM {out}_p WHERE n_date >= {K}),
{out}_h AS (SELECT name, date, symbol, fwd AS r, CASE WHEN bucket = 0 THEN -1.0::DOUBLE ELSE 1.0 END AS side FROM {out}_b WHERE bucket IN (0, {K - 1})),
{out}_w AS (SELECT name, date, symbol, r, side / count(*) OVER (PARTITION BY name, date, side) AS weight FROM {out}_h),
{out}_d AS (SELECT name, date, sum(weight * r) AS gross, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY date) AS seq FROM {out}_w GROUP BY name, date),
{out}_n AS (SELECT name, seq, symbol, weight FROM {out}_w JOIN {out}_d USING (name, date)),
{out}_m AS (SELECT coalesce(a.name, b.name) AS name, coalesce(a.seq, b.seq + 1) AS seq, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) AS moved
  FROM {out}_n a FULL JOIN {out}_n b ON a.name = b.name AND a.symbol = b.symbol AND a.seq = b.seq + 1 GROUP BY 1, 2),
{out} AS (SELECT name, date, gross, CASE WHEN seq = 1 THEN 0 ELSE moved / 2 END AS turnover, gross - {COST} * CASE WHEN seq = 1 THEN 0 ELSE moved / 2 END AS net, n FROM {out}_d JOIN {out}_m USING (name, seq))"""


_REPORT = ("total", "sharpe", "max_drawdown", "net_total", "net_sharpe", "net_max_drawdown", "turnover", "calmar", "net_calmar", "cost_ratio", "cost_bps")


#: Weekly returns of this panel multiply up to what no step of publishing holds, so these are shown as signed logarithms.
_WIDE = ("total", "net_total", "calmar", "net_calmar")


def _shown(report: DataFrame) -> DataFrame:
    return report.withColumns({x: F.signum(x) * F.log1p(F.abs(x)) for x in _WIDE})


def _rr(*names: str) -> str:
    return ", ".join(f"{duck.rounded(f'sign({n}) * ln(1 + abs({n}))' if n in _WIDE else n)} AS {n}" for n in names)


def _report_sql(book: str, out: str) -> str:
    w = "OVER (PARTITION BY name ORDER BY date)"
    paths = ", ".join(f"exp(sum(ln(1 + greatest({x}, -0.999999))) {w}) AS e_{x}" for x in ("gross", "net"))
    falls = ", ".join(f"e_{x} / greatest(1.0, max(e_{x}) {w}) - 1 AS d_{x}" for x in ("gross", "net"))
    of = ", ".join(
        f"arg_max(e_{x}, date) - 1 AS {p}total, avg({x}) / nullif(stddev_samp({x}), 0) * sqrt(252.0::DOUBLE) AS {p}sharpe, min(d_{x}) AS {p}max_drawdown" for x, p in (("gross", ""), ("net", "net_"))
    )
    year = ", ".join(f"CASE WHEN {p}total > -1 THEN pow(1 + {p}total, 252.0 / n) - 1 ELSE -1 END / nullif(abs({p}max_drawdown), 0) AS {p}calmar" for p in ("", "net_"))
    return f"""{out}_p AS (SELECT *, {paths} FROM {book}), {out}_q AS (SELECT *, {falls} FROM {out}_p),
{out}_t AS (SELECT name, count(*) AS n, {of}, avg(turnover) AS turnover FROM {out}_q GROUP BY name),
{out} AS (SELECT *, {year}, coalesce(greatest(0, total - net_total) / nullif(abs(total), 0), 0) AS cost_ratio, 1e4 * coalesce(greatest(0, total - net_total) / nullif(abs(total), 0), 0) AS cost_bps FROM {out}_t)"""


def _value_sql(weights: str, part: str = "test") -> str:
    """``comp``: the composite of ``weights`` on a part, in long form."""
    return f"""z AS (SELECT name, date, symbol, CASE WHEN stddev_samp(x) OVER w > 1e-12 THEN least(greatest((x - avg(x) OVER w) / stddev_samp(x) OVER w, -3), 3) END AS z
  FROM every WHERE part = '{part}' WINDOW w AS (PARTITION BY name, date)),
zw AS (SELECT date, symbol, sum(coalesce(z, 0) * weight) AS v FROM z JOIN {weights} USING (name) GROUP BY 1, 2),
comp AS (SELECT 'composite' AS name, r.date, r.symbol, r.part, coalesce(v, 0) AS x, r.fwd FROM rows r LEFT JOIN zw ON r.date = zw.date AND r.symbol = zw.symbol WHERE r.part = '{part}' AND r.fwd IS NOT NULL)"""


_ICIR = "SELECT name, CASE WHEN sum(raw) OVER () > 0 THEN raw / sum(raw) OVER () ELSE 1.0::DOUBLE / count(*) OVER () END AS weight FROM"
_RAW = "(SELECT name, greatest(0, coalesce(mean / nullif(std, 0), 0)) AS raw FROM stats WHERE part = 'train' {where})"

# The choice: formulas that pass, in the order of their coefficients; one is dropped if a better one that stays is near.
_CHOSEN = f"""{_pool_sql(POOL)},
o AS (SELECT name, mean, row_number() OVER (ORDER BY abs(mean) DESC, name) AS k FROM stats WHERE part = 'train' AND abs(mean) >= {LEAST}),
rs AS (SELECT name, date, symbol, {duck.steady('x')} AS s FROM every WHERE part = 'train' AND name IN (SELECT name FROM o)),
rk AS MATERIALIZED (SELECT name, date, symbol, rank() OVER (PARTITION BY name, date ORDER BY s) + (count(*) OVER (PARTITION BY name, date, s) - 1) / 2.0::DOUBLE AS r FROM rs),
near AS (SELECT a.name AS a, b.name AS b, covar_samp(a.r, b.r) / nullif(stddev_samp(a.r) * stddev_samp(b.r), 0) AS q FROM rk a JOIN rk b ON a.date = b.date AND a.symbol = b.symbol AND a.name <> b.name GROUP BY 1, 2),
nb AS (SELECT o.name, o.mean, o.k, coalesce(list(near.b) FILTER (near.q >= {NEAR}), []) AS close FROM o LEFT JOIN near ON near.a = o.name GROUP BY ALL),
pick(k, heads) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT nb.k, CASE WHEN list_has_any(heads, nb.close) THEN heads ELSE list_append(heads, nb.name) END FROM pick JOIN nb ON nb.k = pick.k + 1),
heads AS (SELECT arg_max(heads, k) AS heads FROM pick),
chosen AS (SELECT name, mean, CASE WHEN list_contains(heads, name) THEN name ELSE list_filter(heads, lambda h: list_contains(nb.close, h))[1] END AS head FROM nb, heads)"""
_HEADS = "IN (SELECT name FROM chosen WHERE name = head)"
_WEIGHTS = f"weights AS ({_ICIR} {_RAW.format(where='AND name ' + _HEADS)})"


def _mined(spark: SparkSession, sf_dir: str) -> mining.Mined:
    return mining.mine(_panel(spark, sf_dir), POOL, SETTINGS)


@query(f"WITH RECURSIVE {_CHOSEN} SELECT name, {_r('mean')}, head FROM chosen")
def mining_chosen(spark, sf_dir):
    return mining.chosen(c.parted(_panel(spark, sf_dir), POOL), POOL, SETTINGS)


@query(
    f"""WITH RECURSIVE {_CHOSEN}, tests AS (SELECT * FROM long WHERE part = 'test' AND name {_HEADS}), {_book_sql('tests', 'bk')}, {_report_sql('bk', 'rep')},
    ics AS (SELECT name, max(mean) FILTER (part = 'train') AS train_ic, max(mean) FILTER (part = 'valid') AS valid_ic, max(mean) FILTER (part = 'test') AS test_ic FROM stats WHERE name {_HEADS} GROUP BY name)
    SELECT name, {_rr('train_ic', 'valid_ic', 'test_ic', *_REPORT)}, n FROM ics LEFT JOIN rep USING (name)"""
)
def mining_steps(spark, sf_dir):
    return _shown(_mined(spark, sf_dir).steps)


@query(f"WITH RECURSIVE {_CHOSEN}, {_WEIGHTS} SELECT name, {_r('weight')} FROM weights")
def mining_weights(spark, sf_dir):
    return _mined(spark, sf_dir).weights


@query(f"WITH RECURSIVE {_CHOSEN}, {_WEIGHTS}, {_value_sql('weights')}, {_book_sql('comp', 'bk')} SELECT name, {_D}, {_r('gross', 'turnover', 'net')}, n FROM bk")
def mining_composite(spark, sf_dir):
    return _mined(spark, sf_dir).book


_FORMULAS = {n: POOL[n] for n in THREE}
_THREE = _pool_sql(_FORMULAS)
_THREE_WEIGHTS = f"weights AS ({_ICIR} {_RAW.format(where='')})"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.parted(_panel(spark, sf_dir), _FORMULAS)


@query(
    f"""WITH {_THREE}, zt AS (SELECT name, date, symbol, CASE WHEN stddev_samp(x) OVER w > 1e-12 THEN least(greatest((x - avg(x) OVER w) / stddev_samp(x) OVER w, -3), 3) END AS z FROM every WHERE part = 'train' WINDOW w AS (PARTITION BY name, date)),
    grid AS (SELECT n.name, r.date, r.symbol FROM rows r, (SELECT unnest({list(THREE)}) AS name) n WHERE part = 'train'), v AS (SELECT name, 1 / var_samp(coalesce(z, 0)) AS raw FROM grid LEFT JOIN zt USING (name, date, symbol) GROUP BY 1),
    w AS (SELECT 'icir' AS scheme, * FROM ({_ICIR} {_RAW.format(where='')}) UNION ALL SELECT 'inverse_variance', * FROM ({_ICIR} v) UNION ALL SELECT 'equal', name, 1 / 3.0::DOUBLE FROM v) SELECT scheme, name, {_r('weight')} FROM w"""
)
def composite_weights(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    found = [c.fitted_weights(rows, THREE, s).select(F.lit(s).alias("scheme"), "name", "weight") for s in ("equal", "icir", "inverse_variance")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"WITH {_THREE}, {_THREE_WEIGHTS}, {_value_sql('weights')}, {_ic_sql('comp', 'cic')}, everyone AS (SELECT * FROM ic WHERE part = 'test' UNION ALL SELECT * FROM cic) SELECT name, part, {_D}, n, {_r('ic')} FROM everyone")
def composite_coefficients(spark, sf_dir):
    return c.composite_backtest(_rows(spark, sf_dir), THREE, "icir", K, COST)[1]


@query(f"WITH {_THREE}, {_THREE_WEIGHTS}, {_value_sql('weights')}, {_book_sql('comp', 'bk')}, {_report_sql('bk', 'rep')} SELECT name, n, {_rr(*_REPORT)} FROM rep")
def composite_report(spark, sf_dir):
    return _shown(c.book_report(c.composite_backtest(_rows(spark, sf_dir), THREE, "icir", K, COST)[2]))


_NAMED = duck.stages({"score": FAMILIES["alpha101_panel"][0]["alpha006"]}, "panel", fill=False)


@query(f"WITH {duck.PANEL_L_FULL}, {_NAMED[0]} SELECT {_D}, symbol, {duck.rounded(_NAMED[2]['score'])} AS score FROM {_NAMED[1]}")
def factor_scores(spark, sf_dir):
    return c.factor_scores(_panel(spark, sf_dir), "alpha006")


# Models along time.
SPECS = (mf.spec_of("momentum", 10, 1.0), mf.spec_of("mean_reversion", 20, -0.5), mf.spec_of("volatility", 20, -0.3))
BOUND, ENTER, LEAVE = 0.3, 0.4, 0.15
_Z = duck.stages({s.name: f"expanding_zscore({s.formula})" for s in SPECS}, "panel", "single", fill=True)


def _pair(a: int, b: int) -> str:
    spread = f"stddev_samp(z{a}) * stddev_samp(z{b})"
    return f"coalesce(abs(CASE WHEN {spread} > 1e-12 THEN covar_samp(z{a}, z{b}) / ({spread}) END), 0) < {BOUND} AS far{a}{b}"


_SCORES = f"""{duck.PANEL_L_OWN}, {_Z[0]}, z AS MATERIALIZED (SELECT date, symbol, {', '.join(f'{x} AS z{i}' for i, x in enumerate(_Z[2].values()))} FROM {_Z[1]}),
far AS (SELECT symbol, {_pair(0, 1)}, {_pair(0, 2)}, {_pair(1, 2)} FROM z GROUP BY symbol),
keeps AS (SELECT symbol, far01 AS k1, far02 AND (NOT far01 OR far12) AS k2 FROM far),
scored AS (SELECT date, symbol, (z0 * {SPECS[0].weight} + CASE WHEN k1 THEN z1 * {SPECS[1].weight} ELSE 0 END + CASE WHEN k2 THEN z2 * {SPECS[2].weight} ELSE 0 END)
  / ({abs(SPECS[0].weight)}::DOUBLE + CASE WHEN k1 THEN {abs(SPECS[1].weight)}::DOUBLE ELSE 0 END + CASE WHEN k2 THEN {abs(SPECS[2].weight)}::DOUBLE ELSE 0 END) AS score FROM z JOIN keeps USING (symbol))"""


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = mf.signals(panels.shipment_bars(spark, sf_dir), SPECS)
    return mf.scores(z, SPECS, mf.kept(z, SPECS, BOUND))


@query(f"WITH {_SCORES} SELECT symbol, concat('0', CASE WHEN k1 THEN ',1' ELSE '' END, CASE WHEN k2 THEN ',2' ELSE '' END) AS kept FROM keeps")
def model_kept(spark, sf_dir):
    z = mf.signals(panels.shipment_bars(spark, sf_dir), SPECS)
    return mf.kept(z, SPECS, BOUND).select("symbol", F.concat_ws(",", F.col("kept").cast("array<string>")).alias("kept"))


@query(f"WITH {_SCORES} SELECT {_D}, symbol, {_r('score')} FROM scored")
def model_scores(spark, sf_dir):
    return _model(spark, sf_dir)


_IN_TIME = "OVER (PARTITION BY symbol ORDER BY date)"


@query(
    f"""WITH {_SCORES}, decided AS (SELECT *, CASE WHEN score > {ENTER} THEN 1 WHEN score < -{ENTER} THEN -1 WHEN abs(score) < {LEAVE} OR sign(score) * sign(lag(score) {_IN_TIME}) < 0 THEN 0 END AS d FROM scored)
    SELECT {_D}, symbol, {_r('score')}, 10.0::DOUBLE * coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS target FROM decided"""
)
def model_targets(spark, sf_dir):
    return mf.targets(_model(spark, sf_dir), ENTER, LEAVE, size=10.0)


REPLICATES = 50


@query(
    f"""WITH {duck.PANEL_L_OWN}, n AS (SELECT *, row_number() {_IN_TIME} AS place FROM panel), r AS (SELECT unnest(generate_series(0, {REPLICATES})) AS replicate),
    dealt AS (SELECT symbol, open, close, replicate, row_number() OVER (PARTITION BY symbol, replicate ORDER BY CASE WHEN replicate = 0 THEN '' ELSE md5(concat_ws('-', 42, replicate, symbol, place)) END, place) AS place FROM n, r),
    b AS (SELECT d.symbol, d.replicate, n.date, d.open, d.close FROM dealt d JOIN n ON n.symbol = d.symbol AND n.place = d.place),
    m AS (SELECT *, close / nullif(lag(close, 20) OVER w, 0) - 1 AS r, lag(close) OVER w AS prev FROM b WINDOW w AS (PARTITION BY symbol, replicate ORDER BY date)),
    t AS (SELECT *, CASE WHEN r > 0.02 THEN 1 WHEN r < -0.02 THEN -1 ELSE 0 END AS target FROM m),
    p AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY symbol, replicate ORDER BY date), 0) AS position FROM t), q AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY symbol, replicate ORDER BY date), 0) AS held FROM p),
    s AS (SELECT symbol, replicate, sum(coalesce(held * (open - prev), 0) + position * (close - open) - abs(position - held) * open * 0.0005) / 10000 AS total FROM q GROUP BY 1, 2),
    o AS (SELECT symbol, count(total) FILTER (replicate > 0) AS n_shuffles, avg(total) FILTER (replicate > 0) AS mean, stddev_pop(total) FILTER (replicate > 0) AS std, quantile_cont(total, 0.95) FILTER (replicate > 0) AS p95, max(total) FILTER (replicate = 0) AS real FROM s GROUP BY 1)
    SELECT symbol, n_shuffles, {_r('mean', 'std', 'p95', 'real')}, {duck.rounded('mean + 2 * std')} AS upper, real <= mean + 2 * std AS no_lookahead FROM o"""
)
def validation_shuffle_noise(spark, sf_dir):
    return validation.shuffle_noise(panels.shipment_bars(spark, sf_dir), validation.momentum_signal, REPLICATES, capital=10_000.0, cost=0.0005)


GRID = {"fast": [3, 5, 10, 15], "slow": [10, 20, 40]}


def _lattice_sql() -> str:
    windows = sorted({n for v in GRID.values() for n in v})
    means = ", ".join(f"CASE WHEN count(close) OVER w{n} >= {n} THEN avg(close) OVER w{n} END AS m{n}" for n in windows)
    frames = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in windows)
    every = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, {a}.0::DOUBLE AS fast, {b}.0::DOUBLE AS slow, date, symbol, open, CASE WHEN m{a} IS NULL OR m{b} IS NULL THEN 0 WHEN m{a} > m{b} THEN 1 ELSE -1 END AS target FROM means"
        for i, a in enumerate(GRID["fast"]) for j, b in enumerate(GRID["slow"]) if a < b
    )
    w = "OVER (PARTITION BY i, j, symbol ORDER BY date)"
    return f"""{duck.PANEL_L_OWN}, means AS MATERIALIZED (SELECT date, symbol, open, {means} FROM panel WINDOW {frames}), every AS ({every}),
    g AS (SELECT *, coalesce(lag(target) {w} * (lead(open) {w} / nullif(open, 0) - 1), 0) AS gain FROM every), d AS (SELECT i, j, fast, slow, date, avg(gain) AS r FROM g GROUP BY ALL),
    res AS MATERIALIZED (SELECT i, j, fast, slow, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0::DOUBLE) AS sharpe FROM d GROUP BY ALL),
    nb AS (SELECT a.i, a.j, count(*) AS neighbours, quantile_cont(b.sharpe, 0.5) AS median FROM res a JOIN res b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY 1, 2),
    plat AS (SELECT res.*, coalesce(neighbours, 0) AS neighbours, median, CASE WHEN sharpe > 0 THEN median / sharpe END AS ratio, row_number() OVER (ORDER BY sharpe DESC, i, j) = 1 AS best FROM res LEFT JOIN nb USING (i, j))"""


@query(f"WITH {_lattice_sql()} SELECT fast, slow, {_r('sharpe')}, neighbours, {_r('median', 'ratio')}, sharpe > 0 AND (neighbours = 0 OR coalesce(ratio >= 0.6, false)) AS ok, best FROM plat")
def lattice_plateau(spark, sf_dir):
    run = lattice.averages_run(panels.shipment_bars(spark, sf_dir), GRID)
    return lattice.plateau(run, 2).drop("at")


@query()
def search_tree(spark, sf_dir):
    return formula_search.tree_searched(_panel(spark, sf_dir), "mean(close,5)", 2, 4, 2)


@query()
def search_chain(spark, sf_dir):
    return formula_search.chain_searched(_panel(spark, sf_dir), "mean(close,5)", 2, 4)


# The order gate on orders that passed.
_DAY, _WHILE = 86_400_000_000, 120 * 86_400
GATE = gate.Limits(most_volume=6, deviation=0.9, most_position=12, a_day=1, a_while=3, within=_WHILE)


@query(
    f"""WITH RECURSIVE o AS MATERIALIZED (SELECT o_custkey::VARCHAR AS account, o_orderkey AS order_id, epoch_us(o_orderdate::TIMESTAMP) AS t, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS side, o_orderkey % 5 = 0 AS closes,
      (1 + o_orderkey % 7)::DOUBLE AS volume, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
    g(account, i, order_id, code, held, times) AS (SELECT account, 0::BIGINT, NULL::BIGINT, '', 0.0::DOUBLE, []::BIGINT[] FROM o WHERE i = 1
      UNION ALL SELECT account, i, order_id, code, CASE WHEN code = 'PASS' THEN held + side * volume ELSE held END, CASE WHEN code = 'PASS' THEN list_append(times, t) ELSE times END FROM (
        SELECT o.*, g.held, g.times, CASE WHEN o.volume > 6 THEN 'VOLUME' WHEN abs(o.price - 150000) / 150000 > 0.9 THEN 'PRICE' WHEN o.closes AND o.volume > abs(g.held) + 1e-9 THEN 'CLOSE_VOLUME'
          WHEN abs(g.held + o.side * o.volume) > abs(g.held) + 1e-9 AND abs(g.held + o.side * o.volume) > 12 + 1e-9 THEN 'POSITION' WHEN len(list_filter(g.times, lambda x: x // {_DAY} = o.t // {_DAY})) >= 1 THEN 'DAY_ORDERS'
          WHEN len(list_filter(g.times, lambda x: x > o.t - {_WHILE}::BIGINT * 1000000)) >= 3 THEN 'RATE' ELSE 'PASS' END AS code FROM g JOIN o ON o.account = g.account AND o.i = g.i + 1))
    SELECT account, order_id, code, held FROM g WHERE i > 0"""
)
def desk_gate_passed(spark, sf_dir):
    o = panels.table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("order_id"), F.lit("x").alias("symbol"), F.col("o_orderdate").alias("ts"), F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1).alias("side"),
        F.when(F.col("o_orderkey") % 5 == 0, "CLOSE").otherwise("OPEN").alias("offset"), (1 + F.col("o_orderkey") % 7).alias("volume"), F.col("o_totalprice").alias("price"), F.lit(150000.0).alias("reference"),
    )
    return gate.gated(rows, GATE)


@query()
def research_ranker(spark, sf_dir):
    """NDCG of the first five on test dates: of the ranker, and of a regression on the same factors."""
    names = ["activity", "range", "reversal"]
    rows = c.parted(_panel(spark, sf_dir), {n: POOL[n] for n in names})
    made = research.bucketed(rows.where(F.col("fwd").isNotNull()), "fwd", K, K).select("date", "symbol", "part", "fwd", "bucket", *names)
    made = made.cache()  # a row for a nation and week, whatever the number of shipments; fits and scores are jobs of their own
    train, test = made.where("part = 'train'"), made.where("part = 'test'")
    out = None
    for name, weights in (("ranker", ranker.fitted(train, names, "bucket", K)), ("regression", ranker.least_squares(train, names, "fwd"))):
        part = research.ndcg(ranker.scored(test, names, weights), "score", "bucket", K).select(F.lit(name).alias("model"), "date", "ndcg")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""WITH {duck.PANEL_L_OWN}, a AS (SELECT *, row_number() {_IN_TIME} AS i FROM panel), b AS (SELECT *, CASE WHEN i <= 50 THEN close END AS f FROM a),
    c AS (SELECT *, avg(f) OVER (PARTITION BY symbol) AS m, stddev_samp(f) OVER (PARTITION BY symbol) AS sd FROM b), t AS (SELECT date, symbol, i, CASE WHEN sd > 1e-12 THEN abs(close - m) / sd END AS turbulence FROM c),
    q AS (SELECT symbol, quantile_cont(turbulence, 0.95) AS q95, quantile_cont(turbulence, 0.99) AS q99 FROM t WHERE i > 50 GROUP BY 1),
    r AS (SELECT t.*, CASE WHEN i > 50 AND turbulence > greatest(q99, q95 + 1e-9) THEN 'EXTREME' WHEN i > 50 AND turbulence > greatest(q95, 1) THEN 'HIGH' ELSE 'LOW' END AS regime FROM t JOIN q USING (symbol))
    SELECT {_D}, symbol, {_r('turbulence')}, regime, CASE regime WHEN 'LOW' THEN 1.0::DOUBLE WHEN 'HIGH' THEN 0.5 ELSE 0 END AS scale FROM r"""
)
def research_turbulence_regimes(spark, sf_dir):
    return research.turbulence_regimes(panels.shipment_bars(spark, sf_dir), "close", 50).select("date", "symbol", "turbulence", "regime", "scale")
