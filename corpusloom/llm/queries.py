"""All queries of this package. Importing the operators fills the registry."""

from __future__ import annotations

from corpusloom.llm import decontam, hyperminhash, langid, linededup, lm, packing, pii, quality, simhash, suffix, vectorcodes, warc, whitening  # noqa: F401
from corpusloom.llm.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
