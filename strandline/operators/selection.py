"""Registered selection: each trial's directional accuracy, dependence and net result, and the decision over the trials.

All numbers come from one pass over the ledger and one over the correctness series; what is left for the decision has one
row for each trial.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strandline.functions import statistics
from strandline.operators.features import autocorrelation
from strandline.operators.scan import DAY

#: Failure codes of a trial, and the two-sided 95 % normal quantile.
SUPPORT, P_VALUE = "INSUFFICIENT_DIRECTIONAL_EVALUABLE_SUPPORT", "IID_REFERENCE_P_VALUE_ABOVE_ALPHA"
LOWER_BOUND, MEAN_NET = "DEPENDENCE_ADJUSTED_LOWER_BOUND_NOT_ABOVE_HALF", "NONPOSITIVE_MEAN_PARTIAL_KNOWN_COST_PNL"
Z_975 = 1.959963984540054


def correctness(ledger: DataFrame, direction: str) -> Column:
    """1 or 0 where a trade's direction was right or wrong; null without a trade, a valid outcome or a move."""
    action, moved = F.col("action"), F.col(direction)
    said = F.when(action == "LONG", 1).when(action == "SHORT", -1)
    return F.when(said.isNotNull() & F.col("invalid").isNull() & moved.isin(-1, 1), (said == moved).cast("long"))


@F.pandas_udf(DoubleType())
def _upper_tail(correct: pd.Series, total: pd.Series) -> pd.Series:
    """Of a few rows: exact tails of fair coins."""
    return pd.Series([float(statistics.upper_tail(int(k), int(n))) if n else None for k, n in zip(correct, total, strict=True)], dtype="float64")


def evaluate(ledger: DataFrame, order: Sequence[str], direction: str, lags: int, least: int, alpha: float, width: int = DAY) -> DataFrame:
    """One row for each policy of the ledger (of simulate.run, with `direction` the sign of the outcome).

    rows, abstained, valid, evaluable, correct, traded, mean_net_micro, p_value, design_effect, effective_n, lower_bound,
    failures (sorted, joined by commas), passed. Means and shares are null without rows.
    """
    rows = ledger.withColumn("_right", correctness(ledger, direction))
    count = lambda c: F.count(F.when(c, 1))
    traded = F.col("status") == "TRADED"
    sums = rows.groupBy("policy").agg(
        F.count("*").alias("rows"), count(F.col("action") == "ABSTAIN").alias("abstained"), count(F.col("invalid").isNull()).alias("valid"), F.count("_right").alias("evaluable"), F.coalesce(F.sum("_right"), F.lit(0)).alias("correct"),
        count(traded).alias("traded"), (F.sum(F.when(traded, F.col("known_net_micro"))).cast("double") / F.when(count(traded) > 0, count(traded)).cast("double")).alias("mean_net_micro"),
    )
    series = autocorrelation(rows.where(F.col("_right").isNotNull()).select("policy", *order, "_right"), ["policy"], order, "_right", lags, width)
    effects = series.groupBy("policy").agg(statistics.design_effect(F.collect_list("rho")).alias("design_effect"))
    n, k = F.col("evaluable"), F.col("correct")
    out = sums.join(effects, "policy", "left").withColumn("p_value", _upper_tail("correct", "evaluable"))
    out = out.withColumn("effective_n", F.when(n > 0, statistics.effective_n(n, F.col("design_effect"))).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("lower_bound", statistics.wilson_lower(k, n, F.col("effective_n"), Z_975))
    no = lambda c: F.coalesce(c, F.lit(True))
    failed = [(n < least, SUPPORT), (no(F.col("p_value") > alpha), P_VALUE), (no(F.col("lower_bound") <= 0.5), LOWER_BOUND), (no(F.col("mean_net_micro") <= 0), MEAN_NET)]
    codes = F.array_sort(F.array_compact(F.array(*[F.when(c, name) for c, name in failed])))
    return out.withColumn("failures", F.array_join(codes, ",")).withColumn("passed", F.size(codes) == 0)


def decided(trials: DataFrame, least: int) -> DataFrame:
    """trials (one row each) with decision and champion: INCONCLUSIVE if one trial lacks support, STOP if none passes.

    The champion has the highest lower bound; equal ones go by name.
    """
    every = Window.partitionBy(F.lit(0))  # one row for each trial
    thin = F.max(F.col("evaluable") < least).over(every)
    best = F.min(F.when(F.col("passed"), F.struct((-F.col("lower_bound")).alias("b"), "policy"))).over(every)
    champion = F.when(~thin, best["policy"])
    return trials.withColumn("champion", champion).withColumn("decision", F.when(thin, "INCONCLUSIVE").when(champion.isNull(), "STOP").otherwise("CHAMPION"))
