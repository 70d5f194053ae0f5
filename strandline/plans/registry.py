"""All named queries of the library with their SQL oracles."""

from __future__ import annotations

from strandline.plans import core, feeds, lake, lifecycle, market, relational, research, streams

FLAGSHIP = "trade_flow_window"
MODULES = (feeds, lake, lifecycle, market, relational, research, streams)


def queries() -> dict[str, core.Query]:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.ORACLES)
