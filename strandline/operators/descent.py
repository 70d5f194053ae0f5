"""Logistic regression by batch gradient descent: thousands of steps in one job.

Equal rows become one with a weight. These are dealt over the tasks of one barrier stage; every task keeps its share, and
in each step the tasks add up their gradients (one number for each feature) and all take the same step. A task that is lost
restarts the stage from the written rows, and the same weights come out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.quantiles import type7
from strandline.sources.checkpoints import cut

#: Distinct rows that one task is given before another one is added, up to one for each core. Several tasks meet once a step,
#: which takes Spark a second; so a task gets what it can pass over in about that time.
TASK_ROWS = 5_000_000
#: Scores are clipped here before the exponential.
CLIP = 50.0


@dataclass(frozen=True)
class Descent:
    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    weights: tuple[float, ...]  # the intercept first

    def probability(self, values: Sequence[Column] | None = None) -> Column:
        """Of a row's features, or of other values in their place."""
        score = F.lit(self.weights[0])
        for x, m, s, w in zip(values or [F.col(f) for f in self.features], self.means, self.deviations, self.weights[1:], strict=True):
            score = score + (x - m) / s * w
        return 1 / (1 + F.exp(-F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), score))))


def gradient(z: np.ndarray, y: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of (p - y) and (p - y) z over rows that count n times."""
    p = 1 / (1 + np.exp(-np.clip(weights[0] + z @ weights[1:], -CLIP, CLIP)))
    off = n * (p - y)
    return np.concatenate([[off.sum()], off @ z])


def fit_descent(rows: DataFrame, features: Sequence[str], label: str, steps: int = 4_000, rate: float = 0.05, ridge: float = 1.0, task_rows: int = TASK_ROWS) -> Descent:
    """Mean log-loss plus ridge / (2 n) of the squared weights, the intercept apart. Rows with a null are left out.

    Features are standardised by mean and population deviation; a constant one has deviation 1. Without rows all weights are 0.
    """
    features = list(features)
    k = len(features)
    kept = rows.dropna(subset=[*features, label]).select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"))
    packed = cut(kept.groupBy(*kept.columns).agg(F.count("*").cast("double").alias("n")))
    total = packed.agg(F.sum("n").alias("n"), F.count("*").alias("rows"), *[(F.sum(F.col("n") * F.col(f"x{i}")) / F.sum("n")).alias(f"m{i}") for i in range(k)]).first()
    if not total["rows"]:
        return Descent(tuple(features), (0.0,) * k, (1.0,) * k, (0.0,) * (k + 1))
    n, means = total["n"], np.array([total[f"m{i}"] for i in range(k)])
    spread = packed.agg(*[F.sqrt(F.sum(F.col("n") * (F.col(f"x{i}") - float(means[i])) ** 2) / n) for i in range(k)]).first()
    deviations = np.array([s or 1.0 for s in spread])
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, -(-total["rows"] // task_rows))

    def run(batches: Iterator[pd.DataFrame]):
        context = BarrierTaskContext.get()
        mine = pd.concat([*batches, pd.DataFrame(columns=[*[f"x{i}" for i in range(k)], "y", "n"], dtype=float)])
        z = (mine[[f"x{i}" for i in range(k)]].to_numpy(dtype=float) - means) / deviations
        y, times = mine["y"].to_numpy(dtype=float), mine["n"].to_numpy(dtype=float)
        weights = np.zeros(k + 1)
        for _ in range(steps):
            part = gradient(z, y, times, weights)
            # Every task adds in the order of the tasks' numbers, so that all have the same weights to the last bit.
            whole = part if tasks == 1 else np.sum([json.loads(x) for x in context.allGather(json.dumps(part.tolist()))], axis=0)
            whole[1:] += ridge * weights[1:]
            weights = weights - rate * whole / n
        yield pd.DataFrame({"task": [context.partitionId()], "weights": [weights.tolist()]})

    dealt = packed.repartition(tasks, *[f"x{i}" for i in range(k)])
    found = dealt.mapInPandas(run, "task int, weights array<double>", barrier=True).where("task = 0").collect()[0]  # one row for each task
    return Descent(tuple(features), tuple(means.tolist()), tuple(deviations.tolist()), tuple(found["weights"]))


def directed(signed: Sequence[str], action: int) -> list[Column]:
    """Features of a trade in a direction: each signal along the direction, and its size."""
    return [x for s in signed for x in (action * F.col(s), F.abs(F.col(s)))]


def fit_directions(rows: DataFrame, signed: Sequence[str], long_net: str, short_net: str, **options) -> Descent:
    """A model of whether a trade gains, from both directions of every row that has signals and outcomes."""
    names = [f"d{k}" for k in range(2 * len(signed))]
    full = rows.dropna(subset=[*signed, long_net, short_net])
    one = lambda action, net: F.struct(*[c.alias(n) for n, c in zip(names, directed(signed, action), strict=True)], (F.col(net) > 0).cast("int").alias("gain"))
    both = full.select(F.explode(F.array(one(1, long_net), one(-1, short_net))).alias("t")).select("t.*")
    return fit_descent(both, names, "gain", **options)


def best_direction(rows: DataFrame, model: Descent, signed: Sequence[str], long_net: str, short_net: str) -> DataFrame:
    """rows that can be scored, with probability (the better direction's), action (1 or -1; a tie is long) and its net."""
    full = rows.dropna(subset=[*signed, long_net, short_net])
    full = full.withColumn("_long", model.probability(directed(signed, 1))).withColumn("_short", model.probability(directed(signed, -1)))
    long = F.col("_long") >= F.col("_short")
    return full.withColumn("probability", F.greatest("_long", "_short")).withColumn("action", F.when(long, 1).otherwise(-1)).withColumn("net", F.when(long, F.col(long_net)).otherwise(F.col(short_net))).drop("_long", "_short")


def top_gates(scored: DataFrame, part: str, train: str, shares: dict[str, str]) -> DataFrame:
    """(gate, part, threshold, trades, winners, net): of each part the rows at or above a quantile of the training part's scores.

    shares: gate -> probability of the interpolated quantile, as a decimal string. One row of thresholds is broadcast.
    """
    bounds = type7(scored.where(F.col(part) == train), [], "probability", list(shares.values()), list(shares))
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("threshold")) for g in shares]))
    rows = scored.crossJoin(F.broadcast(bounds.select(each.alias("g")).select("g.*")))  # as many rows as gates
    hit = F.col("probability") >= F.col("threshold")
    return rows.groupBy("gate", part).agg(F.max("threshold").alias("threshold"), F.count(F.when(hit, 1)).alias("trades"), F.count(F.when(hit & (F.col("net") > 0), 1)).alias("winners"), F.coalesce(F.sum(F.when(hit, F.col("net"))), F.lit(0)).alias("net"))
