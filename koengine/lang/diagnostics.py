"""Errors of the query language, with a code, a place and a hint."""

from __future__ import annotations


class QueryError(ValueError):
    """A query that cannot be compiled."""

    code = 1000

    def __init__(self, message: str, line: int = 0, column: int = 0, hint: str = ""):
        self.message, self.line, self.column, self.hint = message, line, column, hint
        at = f" at {line}:{column}" if line else ""
        super().__init__(f"[{self.code}] {message}{at}" + (f" ({hint})" if hint else ""))


class UnexpectedCharacter(QueryError):
    code = 1001


class UnterminatedString(QueryError):
    code = 1002


class UnexpectedEnd(QueryError):
    code = 1003


class UnexpectedToken(QueryError):
    code = 1010


class MissingReturn(QueryError):
    code = 1011


class BadLiteral(QueryError):
    code = 1012


class UnsupportedStatement(QueryError):
    code = 1014


class UnknownType(QueryError):
    code = 1030


class UnknownProperty(QueryError):
    code = 1031


class TypeMismatch(QueryError):
    code = 1032


class UnknownRelationship(QueryError):
    code = 1033


class InvalidPlan(QueryError):
    code = 1040
