"""Corpus preparation for training language models: ten operators and their queries."""

from lectern.llm.plans import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
