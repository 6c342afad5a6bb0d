"""All queries of the library by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from .catalog import ORACLES, QUERIES
from .plans import aggregates, graphs, joins, sampling, scalars, scans, screens, streams, validity, windows  # noqa: F401

FLAGSHIP = "win_rate"
