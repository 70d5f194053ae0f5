"""Column expressions over quotes and trades. Prices and sizes are exact; a ratio is one last division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def usable(bid: Column, ask: Column) -> Column:
    """Both sides there, positive and not crossed or locked."""
    return bid.isNotNull() & ask.isNotNull() & (bid > 0) & (ask > bid)


def twice_mid(bid: Column, ask: Column) -> Column:
    return F.when(usable(bid, ask), bid + ask)


def spread_bps(bid: Column, ask: Column) -> Column:
    """(ask - bid) / mid in basis points."""
    return F.when(usable(bid, ask), _d(20000 * (ask - bid)) / _d(ask + bid))


def return_bps(start: Column, end: Column) -> Column:
    """Signed return; null at a start that is not positive."""
    return F.when(start > 0, _d(10000 * (end - start)) / _d(start))


def friction_bps(bid: Column, ask: Column, fee_bps_x10: int) -> Column:
    """The dearer of a long and a short round trip in the same book, fee per side in tenths of a basis point.

    Long: 1 - bid (1 - f) / (ask (1 + f)); short: ask (1 + f) / (bid (1 - f)) - 1.
    """
    up, down = 100_000 + fee_bps_x10, 100_000 - fee_bps_x10
    long_side = _d(10000 * (ask * up - bid * down)) / _d(ask * up)
    short_side = _d(10000 * (ask * up - bid * down)) / _d(bid * down)
    return F.when(usable(bid, ask), F.greatest(long_side, short_side))


def round_trip_fee(fee_bps: Column) -> Column:
    return 2 * fee_bps


def capture_fraction(friction: Column, movement: Column) -> Column:
    return F.when(movement > 0, friction / movement)


def imbalance(bid_size: Column, ask_size: Column) -> Column:
    """(b - a) / (b + a); null when nothing is there."""
    return F.when(bid_size + ask_size > 0, _d(bid_size - ask_size) / _d(bid_size + ask_size))


def bps_cost(notional: Column, bps: Column) -> Column:
    """Cost of a notional; null when the rate is unknown."""
    return notional * bps / F.lit(10000.0)


def direction(value: Column) -> Column:
    """-1, 0 or 1; null counts as 0."""
    return F.coalesce(F.signum(value), F.lit(0.0)).cast("int")


def flagged(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(mask) != 0


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]))


def quote_reasons(bid: Column, ask: Column, flags: Column, mask: int, prefix: str = "") -> Column:
    """Why a quote cannot be traded: a missing side, a crossed or locked book, quality flags (by number)."""
    missing = bid.isNull() | ask.isNull()
    return F.concat(
        reasons((missing, f"{prefix}MISSING_BBO_SIDE"), (~missing & (bid >= ask), f"{prefix}CROSSED_OR_LOCKED_BBO")),
        F.when(flagged(flags, mask), F.array(F.concat(F.lit(f"{prefix}QUALITY_FLAGS_"), flags.bitwiseAND(mask).cast("string")))).otherwise(F.array().cast("array<string>")),
    )


def merged_reasons(*arrays: Column) -> Column:
    """Sorted distinct union."""
    out = arrays[0]
    for a in arrays[1:]:
        out = F.array_union(out, a)
    return F.array_sort(F.array_distinct(out))
