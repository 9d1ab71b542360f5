"""Diagnostics of the compiler and errors of execution."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Span:
    """A half-open range of a file: byte offsets, lines and columns from 1."""

    file: str
    start: tuple[int, int, int]
    end: tuple[int, int, int]

    def to_json(self) -> dict:
        point = lambda p: {"offset": p[0], "line": p[1], "column": p[2]}
        return {"file": self.file, "start": point(self.start), "end": point(self.end)}


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    span: Span
    path: str | None = None
    severity: str = "error"


def ordered(found: list[Diagnostic]) -> list[Diagnostic]:
    return sorted(found, key=lambda d: (d.span.file, d.span.start[0], d.code))


class CompileError(ValueError):
    def __init__(self, diagnostics: list[Diagnostic]):
        self.diagnostics = ordered(diagnostics)
        super().__init__("; ".join(f"{d.code} at {d.span.file}:{d.span.start[1]}:{d.span.start[2]}: {d.message}" for d in self.diagnostics))


class ExecutionError(Exception):
    """An error with a code and, where known, the path of the output member."""

    def __init__(self, code: str, message: str, path: str = ""):
        self.code, self.message, self.path = code, message, path
        super().__init__(f"{code} at {path}: {message}" if path else f"{code}: {message}")
