"""All queries of the library by name, and the SQL each is compared with."""

from __future__ import annotations

from . import alignment, calibration, facets, gated, matching, profiles, rules, states, storage, workflow

MODULES = (profiles, rules, matching, calibration, workflow, alignment, storage, states, facets, gated)
QUERIES = {k: v for m in MODULES for k, v in m.registry.queries.items()}
ORACLES = {k: v for m in MODULES for k, v in m.registry.oracles.items()}
