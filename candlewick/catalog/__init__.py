"""Registered queries and their DuckDB checks, by topic."""

from __future__ import annotations

from importlib import import_module

TOPICS = ("volume", "ingest", "adaptive", "price", "changes", "host", "sources", "streaming", "layouts")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for topic in TOPICS:
        part = getattr(import_module(f"candlewick.catalog.{topic}"), attribute)
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        found.update(part)
    return found


def registry() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLE")
