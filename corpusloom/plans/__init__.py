"""Registered queries. Importing the modules fills the registry."""

from corpusloom.plans.registry import ORACLE, QUERIES


def _load() -> None:
    from corpusloom.plans import corpus, duplicates, editing, evaluation, feeds, training  # noqa: F401


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLE)
