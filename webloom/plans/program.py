"""The validated, immutable plan of a program."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

from webloom.plans.diagnostics import Diagnostic, Span
from webloom.plans.selector import Selector
from webloom.plans.types import Type

VERSION = "2026-07-15"
_WARNING = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType()), T.StructField("path", T.StringType()), T.StructField("row", T.IntegerType())])
_ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("path", T.StringType()), T.StructField("message", T.StringType())])


@dataclass(frozen=True)
class Call:
    """``target``: a built-in's name, or a declared transform's symbol id."""

    target: str
    builtin: bool
    positional: tuple
    named: tuple[tuple[str, object], ...]
    given: Type
    gives: Type


@dataclass(frozen=True)
class Transform:
    symbol: str
    name: str
    kind: str  # pipeline, match, external
    given: Type
    gives: Type
    origin: str
    calls: tuple[Call, ...] = ()
    cases: tuple[tuple[object, object], ...] = ()
    default: object = None
    external: str = ""
    span: Span | None = None


@dataclass(frozen=True)
class Field:
    name: str
    path: str
    type: Type
    effective: Type
    required: bool
    default: object
    has_default: bool
    selector: Selector | None
    match: str
    source: str  # text, html, attribute, javascript
    attribute: str
    calls: tuple[Call, ...]
    on_error: str
    script: str = ""
    scope: str = ""
    timeout_ms: int | None = None
    raw: Type | None = None
    span: Span | None = None


@dataclass(frozen=True)
class Collection:
    name: str
    path: str
    selector: Selector
    required: bool
    min_items: int
    max_items: int | None
    skip_rows: bool
    members: tuple
    span: Span | None = None


@dataclass(frozen=True)
class Input:
    name: str
    type: Type
    required: bool
    default: object = None
    has_default: bool = False


@dataclass(frozen=True)
class Step:
    kind: str
    args: tuple
    options: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Program:
    name: str
    version: str
    files: tuple[tuple[str, str], ...]
    mode: str
    url: tuple[tuple[str, str], ...]  # (literal or input, text)
    raw_url: str
    session: str
    workflow: tuple[Step, ...]
    inputs: tuple[Input, ...]
    transforms: dict[str, Transform]
    members: tuple
    capabilities: tuple[str, ...]
    warnings: tuple[Diagnostic, ...] = field(default=())

    @property
    def schema(self) -> T.StructType:
        """The schema of ``value``, known before any job runs."""
        return _object_schema(self.members)

    @property
    def result_schema(self) -> T.StructType:
        """value, ordered warnings, partial, and the error of a record that failed."""
        return T.StructType([T.StructField("value", self.schema), T.StructField("warnings", T.ArrayType(_WARNING)), T.StructField("partial", T.BooleanType()), T.StructField("error", _ERROR)])

    def descriptor(self) -> dict:
        """What a host must know to acquire the page."""
        return {"source": {"fetchMode": self.mode, "urlTemplate": self.raw_url, "sessionPolicy": self.session}}

    def externals(self) -> list[str]:
        return sorted({t.external for t in self.transforms.values() if t.kind == "external"})

    def snapshot_error(self) -> tuple[str, str] | None:
        """(path, why) of the first thing that saved HTML can't reproduce."""
        if self.workflow:
            return "source.workflow", "workflow steps need a browser"

        def walk(members):
            for m in members:
                if isinstance(m, Collection):
                    got = walk(m.members)
                    if got:
                        return got
                elif m.source == "javascript":
                    return m.path, "JavaScript values need a browser"
            return None

        return walk(self.members)

    def ir(self) -> dict:
        kind = lambda t: {"kind": "primitive", "name": t.name} if t.kind == "primitive" else {"kind": t.kind, "element" if t.kind == "array" else "of": kind(t.of)}

        def call(c: Call) -> dict:
            target = {"kind": "builtin", "name": c.target} if c.builtin else {"kind": "declared", "symbolId": c.target}
            return {"target": target, "positionalArguments": list(c.positional), "namedArguments": [{"name": k, "value": v} for k, v in c.named], "input": kind(c.given), "output": kind(c.gives)}

        def transform(t: Transform) -> dict:
            out = {"kind": t.kind, "symbolId": t.symbol, "name": t.name, "origin": t.origin, "input": kind(t.given), "output": kind(t.gives)}
            if t.kind == "pipeline":
                return out | {"calls": [call(c) for c in t.calls]}
            if t.kind == "match":
                return out | {"cases": [{"when": a, "then": b} for a, b in t.cases], "default": t.default}
            return out | {"symbol": t.external}

        def member(m) -> dict:
            if isinstance(m, Collection):
                out = {"kind": "collection", "id": m.path, "name": m.name, "selector": m.selector.text, "required": m.required, "minItems": m.min_items}
                if m.max_items is not None:
                    out["maxItems"] = m.max_items
                return out | {"onRowError": "skip" if m.skip_rows else "fail", "item": {"kind": "object", "members": [member(x) for x in m.members]}}
            out = {"kind": "field", "id": m.path, "name": m.name, "successfulType": kind(m.type), "effectiveType": kind(m.effective), "required": m.required}
            if m.has_default:
                out["default"] = m.default
            if m.selector is not None:
                out["selection"] = {"selector": m.selector.text, "match": m.match}
            source = {"kind": m.source, "rawType": kind(m.raw)}
            if m.source == "attribute":
                source["name"] = m.attribute
            if m.source == "javascript":
                source |= {"script": m.script, "scope": m.scope} | ({"timeoutMs": m.timeout_ms} if m.timeout_ms else {})
            return out | {"valueSource": source, "transforms": [call(c) for c in m.calls], "onError": m.on_error}

        def declared(i: Input) -> dict:
            out = {"name": i.name, "type": kind(i.type), "required": i.required}
            return out | {"default": i.default} if i.has_default else out

        return {
            "kind": "extractor", "irVersion": VERSION, "languageVersion": VERSION, "name": self.name, "version": self.version,
            "files": [{"path": p, "sha256": s} for p, s in self.files],
            "source": {"kind": "html", "fetch": {"mode": self.mode, "urlTemplate": {"raw": self.raw_url, "segments": [{"kind": k, "value" if k == "literal" else "name": v} for k, v in self.url]}}, "sessionPolicy": self.session, "workflow": [{"kind": s.kind, "arguments": list(s.args), **dict(s.options)} for s in self.workflow]},
            "inputs": [declared(i) for i in self.inputs], "transforms": [transform(t) for t in self.transforms.values()],
            "output": {"kind": "object", "members": [member(m) for m in self.members]}, "capabilities": list(self.capabilities),
        }

    def ir_json(self) -> str:
        """Canonical JSON: names in code-point order, no white space."""
        return json.dumps(self.ir(), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _object_schema(members) -> T.StructType:
    out = []
    for m in members:
        if isinstance(m, Collection):
            out.append(T.StructField(m.name, T.ArrayType(_object_schema(m.members), False)))
        else:
            out.append(T.StructField(m.name, m.effective.spark(), True))
    return T.StructType(out)
