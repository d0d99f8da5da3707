"""Errors of query parsing, index options and scoring, with SQLSTATE-like codes."""

from __future__ import annotations


class SearchError(ValueError):
    def __init__(self, message: str, sqlstate: str = "22023", hint: str | None = None):
        super().__init__(message if hint is None else f"{message} ({hint})")
        self.sqlstate, self.hint = sqlstate, hint
