"""Operators for building training corpora, with their queries; nothing else in the library imports this."""

from mediaflow.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
