"""Live pages through an adapter that the host supplies: the same members, read from a browser.

One adapter serves one page at a time. It isn't part of any default plan: JavaScript must be allowed, and a
partition function opens its own adapter (``extract_live``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webloom.operators import runtime
from webloom.plans.diagnostics import ExecutionError
from webloom.plans.program import Field, Program, Step
from webloom.plans.types import Type, conforms
from webloom.sources.urls import expand_url, public_internet


class Adapter(Protocol):
    def navigate(self, url: str) -> None: ...
    def wait_for(self, selector: str, state: str, timeout_ms: int | None) -> None: ...
    def click(self, selector: str, timeout_ms: int | None) -> None: ...
    def fill(self, selector: str, value: str, timeout_ms: int | None) -> None: ...
    def press(self, selector: str, key: str, timeout_ms: int | None) -> None: ...
    def scroll(self, x: float, y: float) -> None: ...
    def wait_for_network_idle(self, idle_ms: int, timeout_ms: int | None) -> None: ...
    def evaluate(self, script: str, element: object | None, timeout_ms: int | None) -> object: ...
    def query_all(self, scope: object | None, selector: str, limit: int) -> list: ...
    def text(self, element: object) -> str: ...
    def html(self, element: object) -> str: ...
    def attribute(self, element: object, name: str) -> str | None: ...
    def close(self) -> None: ...


def normalized(value: object, t: Type, path: str) -> object:
    """A JavaScript result as a value of its declared type."""
    if t.nullable:
        return None if value is None else normalized(value, t.of, path)
    if t.kind == "array" and isinstance(value, list):
        return [normalized(v, t.of, path) for v in value]
    if isinstance(value, float) and value.is_integer() and t.name not in ("float", "f32", "f64", "unknown"):
        value = int(value)
    if isinstance(value, int) and not isinstance(value, bool) and t.name in ("float", "f32", "f64"):
        value = float(value)
    if not conforms(value, t) or not _is_json(value):
        raise ExecutionError("E_JAVASCRIPT_RESULT_TYPE", f"result does not match {t}", path)
    return value


def _is_json(v: object) -> bool:
    if isinstance(v, dict):
        return all(isinstance(k, str) and _is_json(x) for k, x in v.items())
    if isinstance(v, list):
        return all(map(_is_json, v))
    return v is None or isinstance(v, (str, bool, int)) or isinstance(v, float) and math.isfinite(v)


class LiveRun(runtime.Run):
    def __init__(self, program: Program, externals, adapter: Adapter):
        super().__init__(program, externals)
        self.adapter = adapter

    def query(self, scope, selector, limit):
        return self._do("E_BROWSER_QUERY", self.adapter.query_all, scope, selector.text, limit)

    @staticmethod
    def _do(code: str, f: Callable, *args, path: str = ""):
        try:
            return f(*args)
        except ExecutionError:
            raise
        except TimeoutError as e:
            raise ExecutionError("E_TIMEOUT", str(e), path) from None
        except Exception as e:
            raise ExecutionError(code, str(e), path) from None

    def read(self, f: Field, scope, path: str):
        a = self.adapter
        element = scope
        if f.selector is not None:
            found = self.query(scope, f.selector, 1 if f.match == "first" else 2)
            if not found:
                return runtime._MISSING
            if len(found) > 1:
                raise ExecutionError("E_SELECTOR_CARDINALITY", f"selector matched {len(found)} elements, expected one", path)
            element = found[0]
        if f.source == "javascript":
            got = self._do("E_JAVASCRIPT_EVALUATION", a.evaluate, f.script, element if f.scope == "current" else None, f.timeout_ms, path=path)
            return normalized(got, f.raw, path)
        if f.source == "attribute":
            got = self._do("E_BROWSER_READ", a.attribute, element, f.attribute, path=path)
            return runtime._MISSING if got is None else got
        return self._do("E_BROWSER_READ", a.text if f.source == "text" else a.html, element, path=path)

    def step(self, s: Step, path: str) -> None:
        a, o = self.adapter, dict(s.options)
        wait = o.get("timeout-ms")
        do = {
            "wait-for": lambda: a.wait_for(s.args[0], o["state"], wait),
            "click": lambda: a.click(s.args[0], wait),
            "fill": lambda: a.fill(*s.args, wait),
            "press": lambda: a.press(*s.args, wait),
            "scroll": lambda: a.scroll(*s.args),
            "wait-for-network-idle": lambda: a.wait_for_network_idle(o["idle-ms"], wait),
            "evaluate-js": lambda: a.evaluate(s.args[0], None, wait),
        }[s.kind]
        self._do("E_BROWSER_WORKFLOW", do, path=path)


def extract_page(program: Program, adapter: Adapter | None, inputs: Mapping[str, object], *, externals=None, allow_javascript: bool = False, policy: Callable[[str], str | None] | None = public_internet) -> dict:
    """One live page: {value, warnings, partial}; all checks come before navigation."""
    if program.mode != "browser":
        raise ExecutionError("E_BROWSER_MODE_REQUIRED", "the program isn't in browser mode")
    if adapter is None:
        raise ExecutionError("E_BROWSER_RUNTIME_MISSING", "no browser adapter")
    if "browser.evaluate-js" in program.capabilities and not allow_javascript:
        raise ExecutionError("E_JAVASCRIPT_DISABLED", "JavaScript isn't allowed")
    runtime.bind(program, externals or {})
    url = expand_url(program, inputs)
    why = policy(url) if policy else None
    if why:
        raise ExecutionError("E_URL_POLICY", why, "source.fetch.url")
    run = LiveRun(program, externals or {}, adapter)
    run._do("E_BROWSER_NAVIGATE", adapter.navigate, url)
    for i, s in enumerate(program.workflow):
        run.step(s, f"source.workflow[{i}]")
    value = run.object(program.members, None, "output")
    if run.partial:
        run.warnings.append(("W_PARTIAL_EXTRACTION", "extraction completed with one or more recovered errors", None, None))
    return {"value": value, "warnings": [dict(zip(("code", "message", "path", "row"), w, strict=True)) for w in run.warnings], "partial": run.partial}


def extract_live(program: Program, requests: DataFrame, adapter: Callable[[], Adapter], **options) -> DataFrame:
    """Rows of inputs to results, one adapter for each partition."""
    names = requests.columns
    schema = T.StructType([*requests.schema.fields, *program.result_schema.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        a = adapter()
        try:
            for b in batches:
                for row in b.to_pylist():
                    out = dict(row)
                    try:
                        got = extract_page(program, a, {k: v for k, v in row.items() if v is not None}, **options)
                        out |= got | {"value": runtime.spark_value(program.members, got["value"]), "error": None}
                    except ExecutionError as e:
                        out |= {"value": None, "warnings": [], "partial": False, "error": {"code": e.code, "path": e.path or None, "message": e.message}}
                    yield pa.RecordBatch.from_pylist([out], schema=arrow)
        finally:
            a.close()

    return requests.select(*names).mapInArrow(run, schema)
