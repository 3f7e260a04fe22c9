"""All queries that are bound to the driver's tables, with their SQL."""

from lattica.plans import q_metrics, q_models, q_select, q_signal

_PARTS = (q_metrics, q_signal, q_select, q_models)
QUERIES: dict = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLES: dict = {k: s for p in _PARTS for k, s in p.ORACLES.items()}
