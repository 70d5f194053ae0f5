"""Trade simulation as columns: one row for each opportunity and policy, no loop over rows.

Costs that are unknown stay null, and so does every total that contains one; they are never zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import prices, text


@dataclass(frozen=True)
class Costs:
    """Rates in hundredths of a basis point; None is unknown. fee and slippage are for each side, impact and funding for the round trip."""

    fee: int | None = 450
    slippage: int | None = None
    impact: int | None = None
    funding: int | None = None

    def names(self) -> list[str]:
        return ["fee", "slippage", "impact", "funding"]


def no_trade(row: DataFrame | None = None) -> Column:
    return F.lit("ABSTAIN")


def random_direction(seed: str, key: str = "opportunity_id") -> Column:
    """Control policy: a coin that depends on the seed and the opportunity alone."""
    return text.coin(F.lit(seed), F.col(key))


def sign_policy(signal: Column, least: float = 0.0) -> Column:
    """Follow the sign of a signal that is larger than `least`, else abstain."""
    return F.when(signal > least, "LONG").when(signal < -least, "SHORT").otherwise("ABSTAIN")


def with_policies(opportunities: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """Each opportunity once for each policy, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), c.alias("action")) for n, c in policies.items()]))
    return opportunities.withColumn("_p", each).select(*opportunities.columns, "_p.policy", "_p.action")


def run(opportunities: DataFrame, costs: Costs = Costs(), quantity: int = 1) -> DataFrame:
    """The ledger: opportunities (entry_bid, entry_ask, exit_bid, exit_ask, invalid_reasons, action) with status and accounts.

    An invalid opportunity is INVALID whatever the policy says, with null accounts; ABSTAIN is NO_TRADE with zeros. Long
    buys at the ask and sells at the bid, short the other way round, so that the spread is paid once.
    """
    invalid = F.size("invalid_reasons") > 0
    traded = ~invalid & F.col("action").isin("LONG", "SHORT")
    long = F.col("action") == "LONG"
    entry = F.when(long, F.col("entry_ask")).otherwise(F.col("entry_bid"))
    exit_ = F.when(long, F.col("exit_bid")).otherwise(F.col("exit_ask"))
    q = F.lit(quantity)
    gross = F.when(long, exit_ - entry).otherwise(entry - exit_) * q
    both, once = (entry + exit_) * q, entry * q
    account = lambda value: F.when(invalid, F.lit(None)).when(traded, value).otherwise(F.lit(0))
    # Costs in millionths of the price unit: notional x rate in hundredths of a basis point.
    cost = {n: account((both if n in ("fee", "slippage") else once) * F.lit(getattr(costs, n)).cast("long")) for n in costs.names()}
    out = opportunities.withColumn("status", F.when(invalid, "INVALID").when(traded, "TRADED").otherwise("NO_TRADE")).withColumn("gross", account(gross)).withColumn("notional", account(once))
    for n, c in cost.items():
        out = out.withColumn(f"{n}_micro", c.cast("long"))
    known = sum((F.coalesce(F.col(f"{n}_micro"), F.lit(0)) for n in cost), F.lit(0))
    everything = sum((F.col(f"{n}_micro") for n in cost), F.lit(0))
    unknown = F.when(traded, F.array_sort(prices.reasons(*[(F.col(f"{n}_micro").isNull(), n.upper()) for n in cost]))).otherwise(F.array().cast("array<string>"))
    return (
        out.withColumn("known_cost_micro", F.when(~invalid, known))
        .withColumn("known_net_micro", F.when(~invalid, F.col("gross") * 1_000_000 - known))
        .withColumn("business_net_micro", F.when(~invalid, F.col("gross") * 1_000_000 - everything))
        .withColumn("unknown_costs", unknown)
    )


def violations(ledger: DataFrame) -> DataFrame:
    """Rows that break an invariant of the ledger; there must be none."""
    status = F.col("status")
    bad = (
        ((status == "NO_TRADE") & ((F.col("gross") != 0) | (F.col("known_net_micro") != 0)))
        | ((status == "INVALID") & (F.col("gross").isNotNull() | F.col("known_net_micro").isNotNull()))
        | ((status == "TRADED") & F.col("gross").isNull())
        | ((F.size("unknown_costs") > 0) & F.col("business_net_micro").isNotNull())
    )
    return ledger.where(bad)


def summary(ledger: DataFrame, *by: str) -> DataFrame:
    """Counts and sums; business net is null as soon as one trade's is."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s.lower())
    traded = F.col("status") == "TRADED"
    return ledger.groupBy(*by).agg(
        F.count("*").alias("opportunities"), count("INVALID"), count("NO_TRADE"), count("TRADED"),
        F.sum("gross").alias("gross"), F.sum("known_net_micro").alias("known_net_micro"),
        F.when(F.count(F.when(traded & F.col("business_net_micro").isNull(), 1)) == 0, F.sum("business_net_micro")).alias("business_net_micro"),
        F.count(F.when(traded & (F.col("known_net_micro") > 0), 1)).alias("winners"),
    )


def repeated(opportunities: DataFrame, key: str = "opportunity_id") -> DataFrame:
    """Ids that occur more than once; there must be none."""
    return opportunities.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
