"""Errors of the query language: kind, phase and code, with an optional hint."""

from __future__ import annotations


class QueryError(Exception):
    def __init__(self, kind: str, code: str, message: str, phase: str = "SemanticAnalysis", hint: str | None = None, span: tuple[int, int] | None = None):
        super().__init__(f"{kind}({code}) in {phase}: {message}" + (f" ({hint})" if hint else ""))
        self.kind, self.code, self.phase, self.hint, self.span = kind, code, phase, hint, span


def syntax(message: str, at: int, code: str = "UnexpectedSyntax") -> QueryError:
    return QueryError("SyntaxError", code, f"{message} at offset {at}", "Parse", span=(at, at + 1))


def semantic(code: str, message: str, hint: str | None = None) -> QueryError:
    return QueryError("SyntaxError", code, message, hint=hint)


def mistyped(message: str, code: str = "InvalidArgumentType") -> QueryError:
    return QueryError("TypeError", code, message)


def nearest(name: str, known) -> str | None:
    """A known name within two edits, as a hint."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    found = min(((distance(name.lower(), k.lower()), k) for k in known), default=(9, ""))
    return f"did you mean {found[1]}?" if found[0] <= 2 else None
