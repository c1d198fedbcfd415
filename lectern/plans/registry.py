"""The library's own queries by name, gathered from the modules that define them."""

from lectern.plans import audio, catalog, files, jobs, layout, reading, streams, text

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (text, audio, layout, jobs, reading, catalog, files, streams):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
