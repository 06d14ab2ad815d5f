"""All queries of the reference's operators, with their SQL, by name."""

from __future__ import annotations

from strandframe.plans import files, models, ranges, reads, sequences, simulation, variants

QUERIES: dict = {}
ORACLE: dict = {}
for _part in (sequences, ranges, variants, models, reads, simulation, files):
    QUERIES |= _part.Q
    ORACLE |= _part.O
