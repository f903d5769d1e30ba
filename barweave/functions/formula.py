"""Factor formulas: a small expression language over bars, compiled into staged window columns.

A formula is a Python expression over the columns of a panel (``close``, ``volume`` ...) and the
operators of :mod:`barweave.functions.ops`. ``$close`` and capitalised operator names are accepted too.
Compilation finds the distinct windowed sub-expressions of a whole batch of formulas and lays them out
in stages: everything in one stage needs only what earlier stages made, so Spark evaluates a stage with
one sort and exchange for each partitioning, and a sub-expression that several formulas share once.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass
from typing import Protocol

# The names of the language.
VARIABLES = ("open", "high", "low", "close", "volume", "amount", "oi")
ALIASES = {"vol": "volume", "open_interest": "oi", "turnover": "amount", "opens": "open", "lows": "low", "highs": "high"}

#: Operators by kind, with the least and most number of arguments.
TS = {
    "mean": (2, 2), "std": (2, 2), "sum": (2, 2), "ts_min": (2, 2), "ts_max": (2, 2), "ts_arg_max": (2, 2), "ts_arg_min": (2, 2), "ts_product": (2, 2), "ts_zscore": (2, 2), "ts_median": (2, 2),
    "ts_percentile": (2, 3), "ts_skew": (2, 2), "ts_kurt": (2, 2), "delay": (2, 2), "delta": (2, 2), "slope": (2, 2), "decay_linear": (2, 2), "ts_rank": (2, 2), "corr": (3, 3), "cov": (3, 3),
    "scale": (1, 3), "own_rank": (1, 2), "reg_beta": (3, 3), "reg_resi": (3, 3), "ema": (2, 2), "wilder": (2, 2), "cumsum": (1, 1), "mad": (2, 2), "unbiased_skew": (2, 3), "ewm": (2, 2),
    "gated_mean": (3, 3), "gated_std": (3, 3), "gated_corr": (4, 4), "gated_cov": (4, 4), "gated_var": (3, 3), "gated_max": (3, 3), "gated_min": (3, 3), "momentum": (2, 2), "pct_change": (2, 2), "zscore": (2, 2), "roll_corr": (3, 3), "expanding_zscore": (1, 1),
}
CS = {"cs_rank": (1, 1), "cs_zscore": (1, 1), "winsorize_q": (1, 3)}
SCALAR = {"sign": (1, 1), "abs": (1, 1), "log": (1, 1), "ln": (1, 1), "sqrt": (1, 1), "power": (2, 2), "signed_power": (1, 2), "winsorize": (2, 3), "larger": (2, 2), "smaller": (2, 2), "where": (3, 3), "fill": (2, 2), "nz": (1, 1)}
#: Capitalised and short names of the panel dialect.
NAMES = {
    "sma": "mean", "tsmean": "mean", "ref": "delay", "tsrank": "ts_rank", "min": "ts_min", "max": "ts_max", "tsargmax": "ts_arg_max", "tsargmin": "ts_arg_min", "sumprod": "ts_product", "tszscore": "ts_zscore", "median": "ts_median", "tsmedian": "ts_median",
    "percentile": "ts_percentile", "tspercentile": "ts_percentile", "skew": "ts_skew", "tsskew": "ts_skew", "kurt": "ts_kurt", "tskurt": "ts_kurt", "ts_delta": "delta", "tsdelta": "delta", "decaylinear": "decay_linear",
    "csrank": "cs_rank", "cszscore": "cs_zscore", "winsorizeq": "winsorize_q", "signedpower": "signed_power",
}
#: Operators whose window is an argument that must be a positive whole number, and its place.
WINDOW_AT = {name: (2 if name in ("corr", "cov", "reg_beta", "reg_resi", "gated_corr", "gated_cov", "roll_corr", "scale") else 1) for name in TS if name not in ("cumsum", "expanding_zscore", "ewm")}


#: In the single-symbol expression dialect these need two values; elsewhere one.
_AT_LEAST_TWO = {"mean": "gated_mean", "std": "gated_std", "ts_max": "gated_max", "ts_min": "gated_min"}


class FormulaError(ValueError):
    """The formula is not in the language, or looks ahead."""


@dataclass(frozen=True)
class Node:
    """``kind`` is num, var, op (binary), neg, cmp, bool, or call; ``name`` says which."""

    kind: str
    name: str
    args: tuple["Node", ...] = ()
    value: float | None = None

    @property
    def key(self) -> str:
        if self.kind == "num":
            return repr(self.value)
        return self.name if self.kind == "var" else f"{self.name}({','.join(a.key for a in self.args)})"

    @property
    def windowed(self) -> bool:
        return self.kind == "call" and (self.name in TS or self.name in CS)


_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "**", ast.Mod: "%", ast.FloorDiv: "//"}
_COMPARE = {ast.Gt: ">", ast.GtE: ">=", ast.Lt: "<", ast.LtE: "<=", ast.Eq: "==", ast.NotEq: "!="}


def parse(text: str, dialect: str = "panel") -> Node:
    """The tree of a formula.

    ``dialect``: ``panel`` (``rank`` across symbols), ``single`` (``rank`` along time), or ``expr`` (as
    single, but rolling statistics need two values).
    """
    text = re.sub(r"\$([A-Za-z_]+)", r"\1", text.strip())
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise FormulaError(f"not an expression: {text}") from e
    return _node(tree, dialect)


def _node(t: ast.AST, dialect: str) -> Node:
    match t:
        case ast.Constant(value=bool()):
            raise FormulaError("only numbers are constants")
        case ast.Constant(value=int() | float() as v):
            return Node("num", "num", value=float(v))
        case ast.Name(id=name):
            name = ALIASES.get(name.lower(), name.lower())
            if name not in VARIABLES and name not in ("vwap", "ret", "typical"):
                raise FormulaError(f"unknown variable: {name}")
            return _derived(name) if name in _DERIVED else Node("var", name)
        case ast.UnaryOp(op=ast.USub(), operand=x):
            inner = _node(x, dialect)
            return Node("num", "num", value=-inner.value) if inner.kind == "num" else Node("neg", "neg", (inner,))
        case ast.UnaryOp(op=ast.UAdd(), operand=x):
            return _node(x, dialect)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
            return Node("op", _BINARY[type(op)], (_node(a, dialect), _node(b, dialect)))
        case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
            return Node("cmp", _COMPARE[type(op)], (_node(a, dialect), _node(b, dialect)))
        case ast.BoolOp(op=op, values=values):
            return Node("bool", "and" if isinstance(op, ast.And) else "or", tuple(_node(v, dialect) for v in values))
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
            return _call(name, tuple(_node(a, dialect) for a in args), dialect)
    raise FormulaError(f"not allowed: {ast.dump(t)[:60]}")


def _call(name: str, args: tuple[Node, ...], dialect: str) -> Node:
    plain = name.lower()
    plain = NAMES.get(plain, plain)
    if plain in ("rank", "r"):
        plain = "ts_rank" if len(args) == 2 else "cs_rank" if dialect == "panel" else "own_rank"
    if dialect != "panel" and plain in CS:
        raise FormulaError(f"{name} needs a panel")
    limits = TS.get(plain) or CS.get(plain) or SCALAR.get(plain)
    if limits is None:
        raise FormulaError(f"unknown operator: {name}")
    if not limits[0] <= len(args) <= limits[1]:
        raise FormulaError(f"{name} takes {limits[0]} to {limits[1]} arguments")
    if plain in WINDOW_AT and (at := WINDOW_AT[plain]) < len(args):
        window = args[at]
        if window.kind != "num" or window.value != int(window.value) or window.value <= 0:
            raise FormulaError(f"{name} needs a positive whole window; anything else looks ahead")
    if plain == "ewm" and not (args[1].kind == "num" and 0 < args[1].value <= 1):
        raise FormulaError("ewm needs a weight above 0 and up to 1")
    if dialect == "expr" and plain in _AT_LEAST_TWO:
        return Node("call", _AT_LEAST_TWO[plain], (*args, Node("num", "num", value=2.0)))
    return Node("call", plain, args)


def _derived(name: str) -> Node:
    if name == "typical":
        return _node(ast.parse("(high+low+close)/3", mode="eval").body, "panel")
    if name == "ret":
        return _node(ast.parse("pct_change(close,1)", mode="eval").body, "panel")
    return _node(ast.parse("fill(nz(amount)/nz(volume),(high+low+close)/3)", mode="eval").body, "panel")


_DERIVED = ("typical", "ret", "vwap")


class Backend(Protocol):
    """Builds expressions of one engine; used for Spark columns, and by the registry for SQL text."""

    def num(self, value: float): ...
    def var(self, name: str): ...
    def neg(self, a): ...
    def op(self, name: str, a, b): ...
    def cmp(self, name: str, a, b): ...
    def bool(self, name: str, args: list): ...
    def call(self, name: str, args: list, numbers: list[float | None]): ...


@dataclass(frozen=True)
class Plan:
    """Stages of named windowed sub-expressions, and the final expressions over their columns."""

    stages: list[list[tuple[str, Node]]]
    outputs: dict[str, Node]


def plan(formulas: dict[str, Node]) -> Plan:
    """Lay out the windowed sub-expressions of all formulas in stages."""
    names: dict[str, str] = {}
    stages: list[list[tuple[str, Node]]] = []

    def level(n: Node) -> int:
        return max((level(a) + 1 if a.windowed else level(a) for a in n.args), default=0)

    def place(n: Node) -> Node:
        """``n`` with every windowed sub-expression replaced by the column that holds it."""
        if n.key in names:
            return Node("var", names[n.key])
        at = level(n) if n.windowed else 0
        inner = Node(n.kind, n.name, tuple(place(a) for a in n.args), n.value)
        if not n.windowed:
            return inner
        names[n.key] = name = f"w{len(names)}"
        while len(stages) <= at:
            stages.append([])
        stages[at].append((name, inner))
        return Node("var", name)

    return Plan(stages, {k: place(n) for k, n in formulas.items()})


def build(n: Node, backend: Backend):
    """The expression of ``n`` in one engine."""
    match n.kind:
        case "num":
            return backend.num(n.value)
        case "var":
            return backend.var(n.name)
    args = [build(a, backend) for a in n.args]
    match n.kind:
        case "neg":
            return backend.neg(args[0])
        case "op":
            return backend.op(n.name, *args)
        case "cmp":
            return backend.cmp(n.name, *args)
        case "bool":
            return backend.bool(n.name, args)
    return backend.call(n.name, args, [a.value for a in n.args])
