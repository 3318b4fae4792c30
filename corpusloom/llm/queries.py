"""Queries of the training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

from corpusloom.plans.registry import Registry

llm = Registry()

from corpusloom.llm import annotation_queries  # noqa: E402, F401
from corpusloom.llm import token_queries  # noqa: E402, F401
from corpusloom.llm import text_queries  # noqa: E402, F401
from corpusloom.llm import name_queries  # noqa: E402, F401
