"""Registered queries over the driver tables (import side effect: registration)."""

from lectern.plans import chat, chunks, evaluation, html, index, io, lists, markup, nested, retrieval, streaming, synthesis, text  # noqa: F401
from lectern.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
