"""The registered queries and the SQL each is checked against."""

from marginflow.registry import oracles as _oracles
from marginflow.registry.published import published_oracles
from marginflow.registry.queries import QUERIES, Tables, registered


def oracles() -> dict[str, str]:
    """SQL text per registered query."""
    return {**_oracles.oracles(), **published_oracles()}


__all__ = ["QUERIES", "Tables", "oracles", "registered"]
