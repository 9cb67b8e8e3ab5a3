"""Sources and sinks: raw files (S1-S7, K1-K3) and adapters over the shared test tables."""

from murmur.sources import files, tables  # noqa: F401
