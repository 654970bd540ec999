"""Errors of the query language. All carry the place in the query where it is known."""

from __future__ import annotations

from difflib import get_close_matches


class QueryError(Exception):
    """Any error about a query."""

    def __init__(self, message: str, query: str = "", at: int | None = None):
        self.at = at
        if query and at is not None:
            line = query.count("\n", 0, at)
            start = query.rfind("\n", 0, at) + 1
            end = query.find("\n", at)
            message += f"\n  line {line + 1}: {query[start : end if end >= 0 else None]}\n  {' ' * (len(f'line {line + 1}: ') + at - start)}^"
        super().__init__(message)


class CypherSyntaxError(QueryError):
    """The text is not a query."""


class BindingError(QueryError):
    """A label, type, variable or property that does not exist."""


class UnsupportedError(QueryError):
    """Part of the language that this engine does not run."""


def did_you_mean(name: str, known: list[str]) -> str:
    close = get_close_matches(name, known, 3, 0.6)
    return f"; did you mean {', '.join(close)}?" if close else f"; known: {', '.join(sorted(known)) or 'none'}"
