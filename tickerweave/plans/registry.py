"""All registered queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from tickerweave.plans import evaluation, learning, market, news, portfolio, streams, technical

_MODULES = [technical, market, portfolio, news, evaluation, streams, learning]

QUERIES = {}
ORACLES = {}
for _m in _MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLES.update(_m.ORACLES)
