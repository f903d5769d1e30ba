"""Reports on many formulas in one job, their de-duplication, and searches over them: by generations, as a tree, as a chain.

The driver holds formulas and one row of statistics for each; every generation is evaluated as one batch.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.formula import FormulaError, parse
from ..functions.ops import ratio, steady, with_columns
from .research import _corr, factor_correlations, forward_return, greedy_clusters

#: Windows that a mutation may choose, what it may wrap a formula in, and how deep a formula may get.
WINDOWS, WRAPS, DEPTH = (3, 5, 10, 20, 40), ("rank({})", "-({})", "delta({},5)", "mean({},5)", "ts_zscore({},20)"), 6


def batch_report(panel: DataFrame, formulas: dict[str, str], h: int = 1, least: int = 3) -> DataFrame:
    """``name, n, mean, std, ir, positive``: statistics of the daily rank coefficient of every formula."""
    rows = forward_return(with_columns(panel, formulas), h).where("fwd IS NOT NULL")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(f"`{k}`").alias("x")) for k in formulas)))
    rows = rows.select("date", "fwd", each.alias("e")).select("date", "e.name", "e.x", "fwd").where("x IS NOT NULL")

    def place(c: str) -> Column:
        s = steady(F.col(c))
        return F.rank().over(W.partitionBy("name", "date").orderBy(s)) + (F.count(F.lit(1)).over(W.partitionBy("name", "date", s)) - 1) / 2

    daily = rows.select("name", "date", place("x").alias("rx"), place("fwd").alias("ry")).groupBy("name", "date").agg(F.count(F.lit(1)).alias("n"), _corr("rx", "ry").alias("ic"))
    x = F.col("ic")
    out = daily.where((F.col("n") >= least) & x.isNotNull()).groupBy("name").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg((x > 1e-12).cast("double")).alias("positive"))
    return out.withColumn("ir", ratio(F.col("mean"), F.col("std")))


def deduplicated(panel: DataFrame, formulas: dict[str, str], threshold: float = 0.7) -> DataFrame:
    """``name, mean, head``: each formula and the better one (by |coefficient|) that stands for it."""
    metric = {r["name"]: abs(r["mean"]) for r in batch_report(panel, formulas).select("name", "mean").collect()}  # a row for each formula
    near = {(r.a, r.b): r.correlation or 0.0 for r in factor_correlations(with_columns(panel, formulas), list(formulas)).collect()}
    heads = {n: head for head, others in greedy_clusters(list(formulas), metric, near, threshold).items() for n in (head, *others)}
    return panel.sparkSession.createDataFrame([(n, metric.get(n), heads[n]) for n in formulas], "name string, mean double, head string")


def mutated(formula: str, rng: random.Random) -> str:
    """The formula with another window somewhere, or wrapped in another operator."""
    places = list(re.finditer(r",(\d+)\)", formula))
    if places and (rng.random() < 0.6 or formula.count("(") >= DEPTH):
        m = rng.choice(places)
        return f"{formula[: m.start()]},{rng.choice(WINDOWS)}){formula[m.end() :]}"
    return rng.choice(WRAPS).format(formula)


def evolved(panel: DataFrame, seeds: list[str], generations: int = 2, survivors: int = 4, children: int = 4, seed: int = 0) -> DataFrame:
    """``generation, formula, mean``: what each generation tried; the ``survivors`` with the highest signed coefficient have children."""
    rng, known, tried = random.Random(seed), {}, list(dict.fromkeys(seeds))
    out = []
    for generation in range(generations + 1):
        names = {f"f{i}": f for i, f in enumerate(tried)}
        found = {names[r["name"]]: r["mean"] for r in batch_report(panel, names).select("name", "mean").collect()} if names else {}
        known |= {f: found.get(f) for f in tried}
        out += [(generation, f, known[f]) for f in tried]
        best = sorted((f for f in known if known[f] is not None), key=lambda f: (-known[f], f))[:survivors]
        tried = []
        for _ in range(children * 5):
            child = mutated(rng.choice(best), rng) if best else ""
            try:
                parse(child)
            except FormulaError:
                continue
            if child not in known and child not in tried and len(tried) < children:
                tried.append(child)
    return panel.sparkSession.createDataFrame(out, "generation int, formula string, mean double")


def proposals(formula: str) -> list[str]:
    """What a formula may become in one step, in a fixed order: each of its windows changed, then the whole of it wrapped."""
    out = []
    for m in re.finditer(r",(\d+)\)", formula):
        out += [f"{formula[: m.start()]},{n}){formula[m.end() :]}" for n in WINDOWS if n != int(m[1])]
    if formula.count("(") < DEPTH:
        out += [w.format(formula) for w in WRAPS]
    return [f for f in dict.fromkeys(out) if f != formula and _sound(f)]


def _sound(formula: str) -> bool:
    try:
        parse(formula)
    except FormulaError:
        return False
    return True


def _means(panel: DataFrame, formulas: list[str]) -> dict[str, float | None]:
    """The mean daily coefficient of every formula, from one job."""
    names = {f"f{i}": f for i, f in enumerate(formulas)}
    return {names[r["name"]]: r["mean"] for r in batch_report(panel, names).select("name", "mean").collect()} if names else {}


def _best_first(found: dict[str, float | None]) -> list[str]:
    return sorted((f for f, m in found.items() if m is not None), key=lambda f: (-found[f], f))


def tree_searched(panel: DataFrame, seed: str, depth: int = 2, branch: int = 4, survivors: int = 2) -> DataFrame:
    """``level, formula, parent, mean, kept``: every level proposes ``branch`` steps from each survivor and is judged as one batch.

    The ``survivors`` best of a level, by signed coefficient, are what the next one starts from; a formula is tried once only. With
    branches and survivors enough this is the exhaustive search.
    """
    known = {seed: _means(panel, [seed]).get(seed)}
    out, frontier = [(0, seed, None, known[seed], True)], [seed]
    for level in range(1, depth + 1):
        parent: dict[str, str] = {}
        for node in frontier:
            for child in proposals(node)[:branch]:
                if child not in known:
                    parent.setdefault(child, node)
        if not parent:
            break
        found = {f: None for f in parent} | _means(panel, list(parent))
        known |= found
        frontier = _best_first(found)[:survivors]
        out += [(level, f, parent[f], found[f], f in frontier) for f in parent]
    return panel.sparkSession.createDataFrame(out, "level int, formula string, parent string, mean double, kept boolean")


def chain_searched(panel: DataFrame, seed: str, rounds: int = 3, branch: int = 4) -> DataFrame:
    """As :func:`tree_searched`, along one chain: each round tries steps from the best formula so far, and moves on only to a better one."""
    known = {seed: _means(panel, [seed]).get(seed)}
    best, out = seed, [(0, seed, None, known[seed], True)]
    for level in range(1, rounds + 1):
        tried = [f for f in proposals(best) if f not in known][:branch]
        if not tried:
            break
        found = {f: None for f in tried} | _means(panel, tried)
        known |= found
        first = _best_first(found)[:1]
        better = [f for f in first if known[best] is None or known[f] > known[best]]
        out += [(level, f, best, found[f], f in better) for f in tried]
        best = better[0] if better else best
    return panel.sparkSession.createDataFrame(out, "level int, formula string, parent string, mean double, kept boolean")
