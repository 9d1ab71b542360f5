"""One record: a program run over one tree."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from webloom.functions.builtins import BuiltinError, apply_builtin
from webloom.html.node import Node
from webloom.html.tree import parse
from webloom.plans.diagnostics import ExecutionError
from webloom.plans.program import Call, Collection, Field, Program
from webloom.plans.types import FLOATS, INTEGERS, Type, conforms, to_spark

_MISSING = object()
Externals = Mapping[str, Callable]


class Run:
    """Warnings and ``partial`` of one record. Warnings of rows that are dropped later stay."""

    def __init__(self, program: Program, externals: Externals):
        self.program, self.externals = program, externals
        self.warnings: list[tuple[str, str, str | None, int | None]] = []
        self.partial = False
        self.calling: list[str] = []
        #: Matches by scope and selector: members that share a selector query once.
        self.matches: dict[tuple[int, str, int], list[Node]] = {}

    def query(self, scope: Node, selector, limit: int) -> list[Node]:
        k = (id(scope), selector.text, limit)
        if k not in self.matches:
            self.matches[k] = selector.query(scope, limit)
        return self.matches[k]

    def object(self, members, scope: Node, path: str) -> dict:
        return {m.name: self.collection(m, scope, f"{path}.{m.name}") if isinstance(m, Collection) else self.field(m, scope, f"{path}.{m.name}") for m in members}

    def field(self, f: Field, scope: Node, path: str):
        try:
            value = self.read(f, scope, path)
            if value is not _MISSING:
                value = self.chain(f.calls, value, path)
                if not conforms(value, f.type):
                    raise ExecutionError("E_OUTPUT_TYPE", f"value does not match {f.type}", path)
        except ExecutionError as e:
            return self.recovered(f, e, path)
        if value is not _MISSING:
            return value
        if f.required:
            raise ExecutionError("E_REQUIRED_VALUE_MISSING", "required value is missing", path)
        return f.default

    def recovered(self, f: Field, e: ExecutionError, path: str):
        if f.on_error == "fail":
            raise e
        self.partial = True
        if f.on_error == "warn":
            self.warnings.append(("W_ERROR_RECOVERED", str(e), path, None))
        return f.default if f.on_error == "default" else None

    def read(self, f: Field, scope: Node, path: str):
        if f.source == "javascript":
            raise ExecutionError("E_SNAPSHOT_UNSUPPORTED", "JavaScript values need a browser", path)
        found = self.query(scope, f.selector, 1 if f.match == "first" else 2)
        if not found:
            return _MISSING
        if len(found) > 1:
            raise ExecutionError("E_SELECTOR_CARDINALITY", f"selector matched {len(found)} elements, expected one", path)
        n = found[0]
        if f.source == "text":
            return n.text_content()
        if f.source == "html":
            return n.inner_html()
        return n.attrs.get(f.attribute, _MISSING)

    def chain(self, calls: tuple[Call, ...], value, path: str):
        for c in calls:
            value = self.call(c, value, path)
        return value

    def call(self, c: Call, value, path: str):
        if c.builtin:
            try:
                return apply_builtin(c.target, value, dict(c.named), c.positional, c.given.name)
            except BuiltinError as e:
                raise ExecutionError("E_TRANSFORM", str(e), path) from None
        t = self.program.transforms[c.target]
        if t.symbol in self.calling:
            raise ExecutionError("E_TRANSFORM_RECURSION", f"transform {t.name} calls itself", path)
        if t.kind == "match":
            same = lambda a: a == value and isinstance(a, bool) == isinstance(value, bool)
            return _as(next((then for when, then in t.cases if same(when)), t.default), t.gives)
        if t.kind == "pipeline":
            self.calling.append(t.symbol)
            try:
                return self.chain(t.calls, value, path)
            finally:
                self.calling.pop()
        try:
            value = self.externals[t.external](value)
        except Exception as e:
            raise ExecutionError("E_EXTERNAL_TRANSFORM", str(e), path) from None
        if not conforms(value, t.gives):
            raise ExecutionError("E_EXTERNAL_TRANSFORM_RESULT_TYPE", f"result does not match {t.gives}", path)
        return value

    def collection(self, c: Collection, scope: Node, path: str) -> list[dict]:
        rows = []
        for i, n in enumerate(self.query(scope, c.selector, 0)):
            try:
                row = self.object(c.members, n, f"{path}[{i}]")
            except ExecutionError as e:
                if not c.skip_rows:
                    raise
                self.partial = True
                self.warnings.append(("W_ROW_SKIPPED", str(e), path, i))
                continue
            rows.append(row)
            if c.max_items is not None and len(rows) > c.max_items:
                raise ExecutionError("E_COLLECTION_CARDINALITY", f"collection has more than {c.max_items} items", path)
        if len(rows) < c.min_items:
            raise ExecutionError("E_COLLECTION_CARDINALITY", f"collection has {len(rows)} items, expected at least {c.min_items}", path)
        return rows


def _as(value, t: Type):
    """A literal as a value of the declared type."""
    if isinstance(value, bool) or value is None:
        return value
    name = t.bare.name
    if name in FLOATS and isinstance(value, int):
        return float(value)
    return int(value) if name in INTEGERS and isinstance(value, float) else value


def bind(program: Program, externals: Externals) -> None:
    for symbol in program.externals():
        if symbol not in externals:
            raise ExecutionError("E_EXTERNAL_TRANSFORM_MISSING", f'external transform "{symbol}" is not bound')


def extract_node(program: Program, root: Node, externals: Externals = {}) -> dict:
    """{value, warnings, partial}; raises ``ExecutionError``."""
    run = Run(program, externals)
    value = run.object(program.members, root, "output")
    if run.partial:
        run.warnings.append(("W_PARTIAL_EXTRACTION", "extraction completed with one or more recovered errors", None, None))
    return {"value": value, "warnings": [dict(zip(("code", "message", "path", "row"), w, strict=True)) for w in run.warnings], "partial": run.partial}


def extract_html(program: Program, html: str, externals: Externals = {}) -> dict:
    """One saved page."""
    unfit = program.snapshot_error()
    if unfit:
        raise ExecutionError("E_SNAPSHOT_UNSUPPORTED", unfit[1], unfit[0])
    bind(program, externals)
    return extract_node(program, parse(html), externals)


def spark_value(members, value: dict) -> dict:
    return {m.name: [spark_value(m.members, r) for r in value[m.name]] if isinstance(m, Collection) else to_spark(value[m.name], m.effective) for m in members}
