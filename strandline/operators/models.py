"""Logistic models and gates. Sums over rows are Spark aggregates; what the driver solves has the size of the features."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.statistics import sigmoid, solve


@dataclass(frozen=True)
class Logistic:
    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    weights: tuple[float, ...]  # the intercept first
    iterations: int
    converged: bool

    def score(self) -> Column:
        """Linear score of a row, standardised as in training."""
        out = F.lit(self.weights[0])
        for f, m, s, w in zip(self.features, self.means, self.deviations, self.weights[1:], strict=True):
            out = out + (F.col(f) - m) / s * w
        return out

    def probability(self) -> Column:
        return sigmoid(self.score())


def newton_sums(rows: DataFrame, xs: Sequence[Column], label: Column, weights: Sequence[float]) -> tuple[list[float], list[list[float]]]:
    """Gradient and Hessian of the log-likelihood in one aggregation: k + k (k + 1) / 2 sums."""
    score = F.lit(0.0)
    for w, x in zip(weights, xs, strict=True):
        score = score + w * x
    k = len(xs)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    p = F.col("_p")
    work = rows.select(label.cast("double").alias("_y"), *[x.alias(f"_x{i}") for i, x in enumerate(xs)], sigmoid(score).alias("_p"))
    got = work.agg(*[F.sum((F.col("_y") - p) * F.col(f"_x{i}")) for i in range(k)], *[F.sum(p * (1 - p) * F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in cells]).first()
    gradient, hessian = [got[i] or 0.0 for i in range(k)], [[0.0] * k for _ in range(k)]
    for n, (i, j) in enumerate(cells):
        hessian[i][j] = hessian[j][i] = got[k + n] or 0.0
    return gradient, hessian


def fit_logistic(rows: DataFrame, features: Sequence[str], label: str, ridge: float = 1.0, rounds: int = 80, tolerance: float = 1e-12) -> Logistic:
    """Ridge logistic regression by Newton's method; the intercept is not penalised. Rows with a null feature are left out.

    A constant feature has deviation 1. The linear system is solved exactly in decimals of 60 digits.
    """
    kept = rows.dropna(subset=[*features, label]).cache()
    try:
        stats = kept.agg(*[F.avg(f) for f in features], *[F.stddev_pop(f) for f in features]).first()
        k = len(features)
        means = tuple(float(stats[i] or 0.0) for i in range(k))
        deviations = tuple(float(stats[k + i] or 0.0) or 1.0 for i in range(k))
        xs = [F.lit(1.0), *[(F.col(f) - m) / s for f, m, s in zip(features, means, deviations, strict=True)]]
        weights, step = [0.0] * (k + 1), math.inf
        for n in range(1, rounds + 1):
            gradient, hessian = newton_sums(kept, xs, F.col(label), weights)
            for i in range(1, k + 1):
                gradient[i] -= ridge * weights[i]
                hessian[i][i] += ridge
            with localcontext() as c:
                c.prec = 60
                delta = [float(x) for x in solve([[Decimal(v) for v in r] for r in hessian], [Decimal(g) for g in gradient])]
            weights = [w + d for w, d in zip(weights, delta, strict=True)]
            step = max(map(abs, delta))
            if step < tolerance:
                return Logistic(tuple(features), means, deviations, tuple(weights), n, True)
        return Logistic(tuple(features), means, deviations, tuple(weights), rounds, False)
    finally:
        kept.unpersist()


def support(rows: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, rows, complete, positive, non_positive)."""
    complete = F.lit(True)
    for f in features:
        complete = complete & F.col(f).isNotNull()
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), n(complete, "complete"), n(complete & (F.col(label) > 0), "positive"), n(complete & (F.col(label) <= 0), "non_positive"))


@dataclass(frozen=True)
class Verdict:
    status: str  # PASS, FAIL or INCONCLUSIVE
    codes: tuple[str, ...]


def movement_gate(movement_q95: float | None, friction_q50: float | None, windows: int, needed: int) -> Verdict:
    """PASS only if the movement is strictly greater, over enough windows."""
    if windows < needed or movement_q95 is None or friction_q50 is None:
        return Verdict("INCONCLUSIVE", ("TOO_FEW_WINDOWS",))
    return Verdict("PASS", ()) if movement_q95 > friction_q50 else Verdict("FAIL", ("MOVEMENT_NOT_ABOVE_FRICTION",))


def selection_gate(trials: dict[str, dict], controls: Sequence[float], needed: int, alpha: float) -> dict[str, Verdict]:
    """Each trial (evaluable, lower_bound, p_value, mean_net) fails by up to four independent codes.

    One trial with too few evaluable rows makes the whole selection inconclusive.
    """
    if any(x["evaluable"] < needed for x in trials.values()):
        return {name: Verdict("INCONCLUSIVE", ("TOO_FEW_ROWS",)) for name in trials}
    out = {}
    for name, x in trials.items():
        codes = [
            code
            for bad, code in (
                (x["lower_bound"] <= 0.5, "LOWER_BOUND_NOT_ABOVE_HALF"),
                (x["p_value"] >= alpha, "NOT_SIGNIFICANT"),
                (x["mean_net"] <= 0, "NET_NOT_POSITIVE"),
                (any(x["mean_net"] <= c for c in controls), "NOT_ABOVE_CONTROLS"),
            )
            if bad
        ]
        out[name] = Verdict("FAIL" if codes else "PASS", tuple(codes))
    return out
