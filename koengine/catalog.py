"""All registered queries of the core, by name, with their SQL."""

from koengine.plans import feed, governance, knowledge, lookups, streams

_MODULES = (lookups, governance, knowledge, streams, feed)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
