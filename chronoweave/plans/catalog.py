"""Every query of the series engine by name."""

from __future__ import annotations

from chronoweave.plans import entities, recordings, series, streams, studio

ALL = series.QUERIES | entities.QUERIES | studio.QUERIES | recordings.QUERIES | streams.QUERIES


def queries() -> dict:
    return {name: fn for name, (fn, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
