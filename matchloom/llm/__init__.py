"""Operators for training data that need language or learnt models; nothing else in the library imports this."""

from matchloom.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
