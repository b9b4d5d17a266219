"""Every query of the engine, by name, and the same in plain SQL."""

from joulewright.plans import advise, judge, prepare

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for part in (prepare, judge, advise):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
