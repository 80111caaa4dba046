"""Every registered query and the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

AREAS = ("sources", "corpus", "augmentation", "evaluation", "detection", "cost", "telemetry", "streams")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for area in AREAS:
        try:
            found = getattr(import_module(f"tallyloom.plans.{area}"), attribute)
        except ModuleNotFoundError as missing:
            if missing.name != f"tallyloom.plans.{area}":
                raise
            continue
        clash = merged.keys() & found.keys()
        if clash:
            raise ValueError(f"query names registered twice: {sorted(clash)}")
        merged.update(found)
    return merged


def _utc(query):
    def run(spark, folder):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, folder)

    return run


def queries() -> dict:
    return {name: _utc(query) for name, query in _collect("QUERIES").items()}


def oracle_sql() -> dict[str, str]:
    return _collect("SQL")
