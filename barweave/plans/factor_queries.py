"""Queries of the formula operators and the named factors, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.factors import FAMILIES
from ..functions.ops import with_factors
from ..sources import panels
from . import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: One formula for each operator of the two dialects.
OPERATORS = {
    "mean": "mean(close,5)", "std": "Std(close,5)", "sum": "sum(volume,5)", "ts_min": "ts_min(low,7)", "ts_max": "ts_max(high,7)", "ts_arg_max": "TsArgMax(close,7)", "ts_arg_min": "TsArgMin(close,7)",
    "ts_product": "ts_product(close/delay(close,1),4)", "ts_zscore": "ts_zscore(close,10)", "ts_median": "Median(volume,5)", "ts_percentile": "ts_percentile(close,8,0.3)", "ts_skew": "Skew(close,9)", "ts_kurt": "Kurt(close,9)",
    "delay": "delay(close,3)", "delta": "Delta($close,2)", "slope": "slope(close,6)", "decay_linear": "DecayLinear(close,6)", "ts_rank": "TsRank(close,9)", "rank_window": "rank(close,9)", "corr": "corr(close,volume,8)", "cov": "Cov(open,close,8)",
    "cs_rank": "rank(close)", "cs_zscore": "CsZscore(volume)", "winsorize_q": "winsorize_q(close,0.1,0.9)", "winsorize": "winsorize(close/delay(close,1)-1,0.2)", "winsorize_bounds": "winsorize(volume,10,60)",
    "sign": "sign(close-open)", "abs": "abs(close-open)", "log": "log(close)", "power": "power(close,0.5)", "signed_power": "signed_power(close-open)", "signed_power_2": "signed_power(close-open,2)", "scale": "scale(close-open,2,20)",
    "reg_beta": "reg_beta(close,volume,8)", "reg_resi": "reg_resi(close,volume,8)", "own_rank": "own_rank(close,20)", "nested": "rank(mean(close,5)-delay(close,2))*ts_rank(rank(volume),4)", "condition": "where((close>open) and (volume>mean(volume,3)),1,-1)",
    "arithmetic": "(high-low)/close*2-(-open)%3+volume//7", "powers": "(close/open)**2", "vwap": "vwap", "adv": "mean(amount,20)", "expanding_zscore": "expanding_zscore(close)", "rolling_zscore": "gated_mean(close,120,20)",
}
EXPRESSIONS = {
    "ref": "ref(close,2)", "momentum": "momentum(close,5)", "pct_change": "pct_change(close,5)", "mean": "mean(close,5)", "std": "std(close,5)", "sma": "sma(close,4)", "max": "max(high,5)", "min": "min(low,5)",
    "ema": "ema(close,12)", "zscore": "zscore(close,10)", "roll_corr": "roll_corr(close,volume,6)", "abs": "abs(close-open)", "log": "log(close)", "mixed": "(close-mean(close,5))/std(close,5)+oi*0.001-turnover/volume",
}


def rounded(v: Column) -> Column:
    """As :func:`duck.rounded`."""
    out = v
    for bound, step in reversed(duck.STEPS):
        near = F.floor(v / step + duck.UP).cast("double") * step if step >= 1 else F.floor(v * (1 / step) + duck.UP).cast("double") / (1 / step)
        out = F.when(F.abs(v) < bound, near).otherwise(out)
    return out + 0.0


def published(df: DataFrame) -> DataFrame:
    """Doubles rounded, dates as text."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((rounded(c) if kind == "double" else F.date_format(c, "yyyy-MM-dd") if kind == "date" else c).alias(f.name))
    return df.select(out)


def _panel(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    match kind:
        case "E":
            return panels.event_bars(spark, sf_dir)
        case "L":
            return panels.complete(panels.shipment_bars(spark, sf_dir))
    return panels.shipment_bars(spark, sf_dir)


_SQL = {"E": duck.PANEL_E, "L": duck.PANEL_L_FULL, "own": duck.PANEL_L_OWN}


def add(name: str, formulas: dict[str, str], kind: str, dialect: str, fill: bool = True) -> None:
    QUERIES[name] = lambda spark, sf_dir: published(with_factors(_panel(kind, spark, sf_dir), formulas, dialect, fill))
    ORACLE_SQL[name] = duck.factor_query(formulas, _SQL[kind], dialect, fill)


for _name, _formula in OPERATORS.items():
    add(f"op_{_name}", {"value": _formula}, "L", "panel", fill=False)
for _name, _formula in EXPRESSIONS.items():
    add(f"expr_{_name}", {"value": _formula}, "own", "expr", fill=False)
#: Factors of a family in one query: one compiled batch that shares its windows.
BATCH = 10
for _family, (_formulas, _dialect) in FAMILIES.items():
    _names = list(_formulas)
    for _i in range(0, len(_names), BATCH):
        add(f"factors_{_family}_{_i // BATCH + 1}", {k: _formulas[k] for k in _names[_i : _i + BATCH]}, "L" if _dialect == "panel" else "own", _dialect)
add("filled_mean_events", {"value": "mean(close,5)"}, "E", "panel")
