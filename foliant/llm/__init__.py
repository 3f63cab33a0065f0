"""Operators for language-model training data; nothing outside this package imports it."""

PLAN_MODULES = ["foliant.llm.queries"]
