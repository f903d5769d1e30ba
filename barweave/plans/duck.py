"""The same formulas as DuckDB SQL, for the oracle that checks every registered query."""

from __future__ import annotations

from ..functions.formula import Node, build, parse, plan
from ..functions.ops import TIES


def _over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_TIME = "OVER (PARTITION BY symbol ORDER BY date)"
_FAR = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DAY = "OVER (PARTITION BY date)"


def clean(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def steady(x: str) -> str:
    """As in :mod:`barweave.functions.ops`: what ranks compare."""
    def near(power: int) -> str:
        scale = f"1e{abs(power)}::DOUBLE"
        return f"round_even(t / {scale}, 0) * {scale}" if power >= 0 else f"round_even(t * {scale}, 0) / {scale}"

    cases = " ".join(f"WHEN abs(t) < {bound!r}::DOUBLE THEN {near(power)}" for bound, power in TIES)
    return f"list_transform([({x})::DOUBLE], lambda t: CASE WHEN t = 0 THEN 0 {cases} ELSE t END)[1]"


def gated(value: str, counted: str, w: str, mp: int) -> str:
    return f"CASE WHEN count({counted}) {w} >= {mp} THEN {value} END"


def co(a: str, b: str, w: str, mp: int, what: str) -> str:
    x, y = f"CASE WHEN ({b}) IS NOT NULL THEN {a} END", f"CASE WHEN ({a}) IS NOT NULL THEN {b} END"
    value = f"covar_samp({x}, {y}) {w}"
    if what == "corr":
        value = ratio(value, f"(stddev_samp({x}) {w}) * (stddev_samp({y}) {w})")
    return gated(value, x, w, mp)


def ewm(x: str, alpha: float) -> str:
    seen = f"list_filter(list({x}) {_FAR}, lambda e: e IS NOT NULL)"
    return f"CASE WHEN len({seen}) > 0 THEN list_reduce({seen}, lambda a, v: a + {alpha!r}::DOUBLE * (v - a)) END"


class DuckBackend:
    def num(self, value: float) -> str:
        return f"({value!r}::DOUBLE)"

    def var(self, name: str) -> str:
        return f'"{name}"'

    def neg(self, a: str) -> str:
        return f"(-({a}))"

    def op(self, name: str, a: str, b: str) -> str:
        match name:
            case "/":
                return ratio(a, b)
            case "%":
                return f"((({a}) % nullif({b}, 0)) + ({b})) % ({b})"
            case "//":
                return f"floor({ratio(a, b)})"
            case "**":
                return clean(f"pow({a}, {b})")
        return f"(({a}) {name} ({b}))"

    def cmp(self, name: str, a: str, b: str) -> str:
        return f"coalesce(({a}) {name.replace('==', '=')} ({b}), false)"

    def bool(self, name: str, args: list[str]) -> str:
        return "(" + f" {name} ".join(args) + ")"

    def call(self, name: str, args: list[str], numbers: list[float | None]) -> str:
        x = args[0]
        n = int(numbers[1]) if len(numbers) > 1 and numbers[1] is not None else 0
        k = int(numbers[2]) if len(numbers) > 2 and numbers[2] is not None else 0
        w = _over(n) if n > 0 else ""
        full = f"count({x}) {w} = count(*) {w}"
        simple = {"mean": "avg", "std": "stddev_samp", "sum": "sum", "ts_min": "min", "ts_max": "max", "ts_product": "product", "ts_median": "median"}
        if name in simple:
            return f"({simple[name]}({x}) {w})"
        if name in ("gated_mean", "gated_std", "gated_var", "gated_max", "gated_min"):
            f = {"mean": "avg", "std": "stddev_samp", "var": "var_samp", "max": "max", "min": "min"}[name[6:]]
            return gated(f"{f}({x}) {w}", x, w, k)
        match name:
            case "ts_arg_max" | "ts_arg_min":
                x = steady(x)
                values = f"(list({x}) {w})"
                best = "list_max" if name == "ts_arg_max" else "list_min"
                return f"CASE WHEN {full} THEN {n}::DOUBLE - list_position({values}, {best}({values})) ELSE {n}::DOUBLE - list_position(list_transform({values}, lambda e: e IS NULL), true) END"
            case "ts_zscore":
                return ratio(f"({x}) - avg({x}) {w}", f"stddev_samp({x}) {w}")
            case "zscore":
                return gated(ratio(f"({x}) - avg({x}) {w}", f"stddev_samp({x}) {w}"), x, w, min(n, 2))
            case "ts_percentile":
                return f"CASE WHEN {full} THEN quantile_cont({x}, {numbers[2] if len(numbers) > 2 else 0.5}) {w} END"
            case "ts_skew" | "ts_kurt" | "unbiased_skew":
                m, spread = f"(count({x}) {w})::DOUBLE", f"var_samp({x}) {w} > 1e-24"
                mp = {"ts_skew": max(3, n // 2), "ts_kurt": max(4, n // 2)}.get(name, k or 3)
                value = {"ts_kurt": f"kurtosis_pop({x}) {w}", "unbiased_skew": f"skewness({x}) {w}", "ts_skew": f"skewness({x}) {w} * {m} * {m} / (sqrt({m} * ({m} - 1)) * ({m} - 1))"}[name]
                return f"CASE WHEN {m} >= {mp} AND {spread} THEN {value} END"
            case "delay":
                return f"(lag({x}, {n}) {_TIME})"
            case "delta":
                return f"(({x}) - lag({x}, {n}) {_TIME})"
            case "momentum" | "pct_change":
                return f"({ratio(x, f'lag({x}, {n}) {_TIME}')} - 1)"
            case "slope":
                value = ratio(f"covar_samp(row_no::DOUBLE, {x}) {w}", f"var_samp(row_no::DOUBLE) {w}")
                return f"CASE WHEN {full} AND count(*) {w} >= {max(2, n // 2)} THEN {value} END"
            case "decay_linear":
                values = f"(list({x}) {w})"
                return f"CASE WHEN {full} THEN list_sum(list_transform({values}, lambda e, i: e * (i + {n} - len({values})))) / {n * (n + 1) / 2} END"
            case "ts_rank" | "own_rank":
                x = steady(x)
                n = n or 250
                values = f"(list({x}) {_over(n)})"
                value = f"coalesce(len(list_filter({values}, lambda e: e > ({x}))), 0)::DOUBLE / len({values})"
                return value if name == "ts_rank" else gated(value, x, _over(n), 5)
            case "corr" | "cov":
                return co(x, args[1], _over(k), max(2, k // 2), name)
            case "roll_corr":
                return co(x, args[1], _over(k), k, "corr")
            case "gated_corr" | "gated_cov":
                return co(x, args[1], _over(k), int(numbers[3]), name.removeprefix("gated_"))
            case "scale":
                w = _over(k or 250)
                return ratio(f"({x}) * {numbers[1] if len(numbers) > 1 else 1.0}", gated(f"sum(abs({x})) {w}", x, w, 5))
            case "reg_beta" | "reg_resi":
                w = _over(k)
                y, z = f"CASE WHEN ({args[1]}) IS NOT NULL THEN {x} END", f"CASE WHEN ({x}) IS NOT NULL THEN {args[1]} END"
                beta = gated(ratio(f"covar_samp({y}, {z}) {w}", f"var_samp({z}) {w}"), y, w, max(2, k // 2))
                return f"({beta})" if name == "reg_beta" else f"(({x}) - (avg({y}) {w} - ({beta}) * (avg({z}) {w}) + ({beta}) * ({args[1]})))"
            case "ema":
                return ewm(x, 2 / (n + 1))
            case "wilder":
                return ewm(x, 1 / n)
            case "ewm":
                return ewm(x, numbers[1])
            case "cumsum":
                return f"(sum({x}) {_FAR})"
            case "expanding_zscore":
                return ratio(f"({x}) - avg({x}) {_FAR}", f"stddev_samp({x}) {_FAR}")
            case "mad":
                return f"list_avg(list_transform(list({x}) {w}, lambda e: abs(e - (avg({x}) {w}))))"
            case "cs_rank":
                x = steady(x)
                return f"CASE WHEN ({x}) IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0::DOUBLE) / count({x}) {_DAY} END"
            case "cs_zscore":
                return ratio(f"({x}) - avg({x}) {_DAY}", f"stddev_samp({x}) {_DAY}")
            case "winsorize_q":
                low, high = (numbers[1] if len(numbers) > 1 else 0.01), (numbers[2] if len(numbers) > 2 else 0.99)
                return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, quantile_cont({x}, {low}) {_DAY}), quantile_cont({x}, {high}) {_DAY}) END"
            case "sign":
                return f"sign({x})::DOUBLE"
            case "abs":
                return f"abs({x})"
            case "log":
                return f"CASE WHEN ({x}) IS NOT NULL THEN ln(greatest({x}, 1e-9)) END"
            case "ln":
                return f"ln(CASE WHEN ({x}) > 0 THEN {x} END)"
            case "sqrt":
                return f"sqrt(CASE WHEN ({x}) >= 0 THEN {x} END)"
            case "power":
                return clean(f"pow({x}, {args[1]})")
            case "signed_power":
                return f"(sign({x}) * pow(abs({x}), {args[1]}))" if len(args) > 1 else x
            case "winsorize":
                low, high = (f"-({args[1]})", args[1]) if len(args) == 2 else (args[1], args[2])
                return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {low}), {high}) END"
            case "larger" | "smaller":
                f = "greatest" if name == "larger" else "least"
                return f"CASE WHEN ({x}) IS NOT NULL AND ({args[1]}) IS NOT NULL THEN {f}({x}, {args[1]}) END"
            case "where":
                return f"CASE WHEN {x} THEN {args[1]} ELSE {args[2]} END"
            case "fill":
                return f"coalesce({x}, {args[1]})"
            case "nz":
                return f"nullif({x}, 0)"
        raise ValueError(name)


def stages(formulas: dict[str, str], panel: str, dialect: str = "panel", fill: bool = True, prefix: str = "") -> tuple[str, str, dict[str, str]]:
    """CTEs that hold the windowed columns over ``panel``, the name of the last one, and the final expressions."""
    laid = plan({k: parse(v, dialect) for k, v in formulas.items()})
    backend = DuckBackend()
    ctes = [f"{prefix}s0 AS (SELECT *, row_number() {_TIME} AS row_no FROM {panel})"]
    for i, stage in enumerate(laid.stages):
        made = ", ".join(f'{build(n, backend)} AS "{name}"' for name, n in stage)
        ctes.append(f"{prefix}s{i + 1} AS (SELECT *, {made} FROM {prefix}s{i})")

    def finished(n: Node) -> str:
        x = clean(f"({build(n, backend)})::DOUBLE")
        return f"coalesce({x}, 0)" if fill else x

    return ", ".join(ctes), f"{prefix}s{len(laid.stages)}", {k: finished(n) for k, n in laid.outputs.items()}


#: Publishing steps: below each bound a double is rounded to the step; nine to twelve digits stay.
STEPS = ((1e3, 1e-6), (1e6, 1e-3), (1e9, 1e-2), (1e12, 30.0), (1e24, 3e9))
#: Added before the floor. It is not a half, as means of a few sums of cents lie exactly on halves, where
#: the last bit of a sum would decide.
UP = 0.4871


def rounded(x: str) -> str:
    """How both engines publish doubles: the same arithmetic, and no negative zero."""
    cases = " ".join(f"WHEN abs(v) < {bound!r} THEN floor(v / {step!r}::DOUBLE + {UP}) * {step!r}::DOUBLE" if step >= 1 else f"WHEN abs(v) < {bound!r} THEN floor(v * {1 / step!r}::DOUBLE + {UP}) / {1 / step!r}::DOUBLE" for bound, step in STEPS)
    return f"list_transform([({x})::DOUBLE], lambda v: CASE {cases} ELSE v END + 0.0)[1]"


def factor_query(formulas: dict[str, str], panel_cte: str, dialect: str = "panel", fill: bool = True) -> str:
    """``date, symbol`` and every formula; ``panel_cte`` defines ``panel``."""
    ctes, last, outputs = stages(formulas, "panel", dialect, fill)
    made = ", ".join(f'{rounded(x)} AS "{k}"' for k, x in outputs.items())
    return f"WITH {panel_cte}, {ctes} SELECT strftime(date, '%Y-%m-%d') AS date, symbol, {made} FROM {last}"


#: Panel E: events by type and day.
PANEL_E = """panel AS (
  SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close,
         count(*)::DOUBLE AS volume, sum(value) AS amount, count(DISTINCT user_id)::DOUBLE AS oi
  FROM events GROUP BY 1, 2)"""

#: Panel L: shipments by the supplier's nation and week.
PANEL_L = """trade AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity, l_extendedprice, l_suppkey,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
weekly AS (
  SELECT symbol, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS amount, count(DISTINCT l_suppkey)::DOUBLE AS oi
  FROM trade GROUP BY 1, 2)"""
#: With a row for every symbol on every date, as panels across symbols need.
PANEL_L_FULL = PANEL_L + """,
panel AS (
  SELECT s.symbol, d.date, open, high, low, close, volume, amount, oi
  FROM (SELECT DISTINCT symbol FROM weekly) s CROSS JOIN (SELECT DISTINCT date FROM weekly) d LEFT JOIN weekly w ON w.symbol = s.symbol AND w.date = d.date)"""
PANEL_L_OWN = PANEL_L + ",\npanel AS (SELECT * FROM weekly)"
