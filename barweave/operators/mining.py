"""Mining a pool of formulas: search and selection on train dates, judgement on test dates, a composite at the end.

The steps are one graph of tables, each stored by what it depends on: the panel's content, the formulas and the settings that matter to
it. A run that broke, or one with other settings further down, reads what is there.

Only two steps see dates after the train part: the report of the chosen formulas and the composite's book. Nothing flows back from them,
but for the gate on turnover and costs, which is off unless asked for and takes from the composite only.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import composite as c
from .research import factor_correlations, greedy_clusters
from .stored import Stored, content_key


@dataclass(frozen=True)
class Settings:
    """``h``: rows ahead; ``train``, ``valid``: shares of dates; ``least_ic``: |mean coefficient| on train dates; ``near``: correlation at which
    a formula is the same as a better one; ``most``: formulas that are judged, the best first; ``k``, ``cost``, ``long_short``: the books;
    ``scheme``: weights; ``most_turnover``, ``least_net_sharpe``: gates of the composite (0: none).
    """

    h: int = 1
    train: float = 0.6
    valid: float = 0.2
    least_ic: float = 0.03
    near: float = 0.7
    most: int = 12
    k: int = 5
    cost: float = 0.0
    long_short: bool = True
    scheme: str = "icir"
    most_turnover: float = 0.0
    least_net_sharpe: float = 0.0


@dataclass
class Mined:
    """``chosen``: ``name, head, mean``; ``steps``: one row for each judged formula; ``weights``, ``coefficients`` and ``book`` of the composite."""

    chosen: DataFrame
    steps: DataFrame
    weights: DataFrame | None
    coefficients: DataFrame | None
    book: DataFrame | None


def chosen(rows: DataFrame, formulas: dict[str, str], settings: Settings) -> DataFrame:
    """``name, mean, head``: formulas with a large enough coefficient on train dates, and the better one that stands for each.

    Sees the rows of the train part only. The driver holds a row for each formula and each pair of formulas that passed.
    """
    spark, names = rows.sparkSession, list(formulas)
    train = rows.where("part = 'train'")
    stats = c.coefficient_statistics(c.daily_coefficients(c.each(train, names)))
    mean = {r["name"]: r["mean"] for r in stats.collect() if abs(r["mean"]) >= settings.least_ic}
    passed = [n for n in names if n in mean]
    near = {(r.a, r.b): r.correlation or 0.0 for r in factor_correlations(train, passed).collect()} if len(passed) > 1 else {}
    groups = greedy_clusters(passed, {n: abs(m) for n, m in mean.items()}, near, settings.near)
    found = [(n, mean[n], head) for head, others in groups.items() for n in (head, *others)]
    return spark.createDataFrame(found, "name string, mean double, head string")


def judged(rows: DataFrame, heads: list[str], settings: Settings) -> DataFrame:
    """``name, train_ic, valid_ic, test_ic`` and the report of its book on test dates, for every head, all of them in one job."""
    long = c.each(rows, heads)
    stats = c.coefficient_statistics(c.daily_coefficients(long)).groupBy("name")
    parts = stats.agg(*(F.max(F.when(F.col("part") == p, F.col("mean"))).alias(f"{p}_ic") for p in ("train", "valid", "test")))
    report = c.book_report(c.books(long.where("part = 'test'"), settings.k, settings.cost, settings.long_short))
    return parts.join(report, "name", "left")


def mine(panel: DataFrame, formulas: dict[str, str], settings: Settings = Settings(), folder: str | None = None) -> Mined:
    """Choose formulas on train dates, judge them on later ones and compose them; ``folder`` keeps the steps.

    A pool of which nothing passes gives empty tables and no composite. Formulas are judged from the best coefficient on train dates down.
    """
    store = Stored(panel.sparkSession, folder) if folder else None
    s = asdict(settings)

    def step(name: str, keys: list[str], more: object, make) -> DataFrame:
        return store.table(name, [base, {k: s[k] for k in keys}, more], make) if store else make()

    base = [content_key(panel), sorted(formulas.items())] if store else None
    split, picks = ["h", "train", "valid"], ["least_ic", "near"]
    rows = step("parted", split, None, lambda: c.parted(panel, formulas, settings.h, settings.train, settings.valid))
    found = step("chosen", split + picks, None, lambda: chosen(rows, formulas, settings))
    best = found.where("name = head").orderBy(F.desc(F.abs("mean")), "name").limit(settings.most)
    heads = [r["name"] for r in best.select("name").collect()]  # at most `most`
    books = ["k", "cost", "long_short"]
    steps = step("judged", split + books, heads, lambda: judged(rows, heads, settings)) if heads else _no_steps(panel)
    kept = _gated(steps, heads, settings)
    if not kept:
        return Mined(found, steps, None, None, None)
    weights = step("weights", split + ["scheme"], kept, lambda: c.fitted_weights(rows, kept, settings.scheme))
    test = rows.where("part = 'test'")
    value = c.composed(test.select("date", "symbol", "part", "fwd", *kept), weights, kept).withColumnRenamed("value", "composite")
    long = c.each(value, ["composite"])
    coefficients = step("coefficients", split + ["scheme"], kept, lambda: c.daily_coefficients(c.each(test, kept).unionByName(long)))
    book = step("book", split + ["scheme", *books], kept, lambda: c.books(long, settings.k, settings.cost, settings.long_short))
    return Mined(found, steps, weights, coefficients, book)


def _no_steps(panel: DataFrame) -> DataFrame:
    numbers = ("train_ic", "valid_ic", "test_ic", "total", "sharpe", "max_drawdown", "net_total", "net_sharpe", "net_max_drawdown", "turnover", "calmar", "net_calmar", "cost_ratio", "cost_bps")
    return panel.sparkSession.createDataFrame([], "name string, n long, " + ", ".join(f"{x} double" for x in numbers))


def _gated(steps: DataFrame, heads: list[str], settings: Settings) -> list[str]:
    """Heads whose turnover and net Sharpe ratio pass the gates that are on; one without a book passes."""
    if not heads or not (settings.most_turnover or settings.least_net_sharpe):
        return heads
    out = F.lit(False)
    if settings.most_turnover:
        out = out | (F.col("turnover") > settings.most_turnover)
    if settings.least_net_sharpe:
        out = out | (F.col("net_sharpe") < settings.least_net_sharpe)
    gone = {r["name"] for r in steps.where(F.coalesce(out, F.lit(False))).select("name").collect()}  # at most `most`
    return [h for h in heads if h not in gone]
