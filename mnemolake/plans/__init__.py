"""Registered queries over the given tables, by area."""

from importlib import import_module

AREAS = (
    "documents", "retrieval", "sources", "aggregates", "enrichment", "privacy", "consent", "memory", "reasoning",
    "upkeep", "quality", "streams",
)


def _registries():
    for area in AREAS:
        yield import_module(f"mnemolake.plans.{area}").registry


def all_queries() -> dict:
    return {name: fn for r in _registries() for name, fn in r.queries.items()}


def all_oracles() -> dict[str, str]:
    return {name: text for r in _registries() for name, text in r.oracle.items()}
