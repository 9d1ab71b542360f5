"""Writing programs: a draft of a program as data, its text, and the catalog of built-ins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from webloom.functions.builtins import BUILTINS
from webloom.plans.compiler import Loader, compile_text
from webloom.plans.program import VERSION, Program


def literal(v: object) -> str:
    """A value as KDL."""
    if v is None:
        return "#null"
    if isinstance(v, bool):
        return "#true" if v else "#false"
    if isinstance(v, (int, float)):
        return repr(v)
    out = v.replace("\\", "\\\\").replace('"', '\\"')
    for c, e in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = out.replace(c, e)
    return f'"{out}"'


@dataclass
class Node:
    name: str
    args: list = field(default_factory=list)
    props: dict = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)

    def write(self, depth: int = 0) -> str:
        head = "  " * depth + " ".join([self.name, *map(literal, self.args), *(f"{k}={literal(v)}" for k, v in self.props.items() if v is not None)])
        if not self.children:
            return head + "\n"
        return head + " {\n" + "".join(c.write(depth + 1) for c in self.children) + "  " * depth + "}\n"


class Members:
    """Fields and collections, in the order they are added."""

    def __init__(self):
        self.nodes: list[Node] = []

    def field(self, name: str, type: str, select: str | None = None, *, match: str | None = None, value: str = "text", attr: str | None = None, apply: list | None = None, required: bool = False, default: object = None, on_error: str | None = None, evaluate_js: tuple[str, str, str] | None = None) -> Members:
        """``apply``: names, or (name, positional arguments, properties). ``evaluate_js``: script, scope, type."""
        children = [Node("select", [select], {"match": match})] if select else []
        if evaluate_js:
            children.append(Node("evaluate-js", [evaluate_js[0]], {"scope": evaluate_js[1], "returns": evaluate_js[2]}))
        else:
            children.append(Node("value", ["attr"], {"name": attr}) if attr else Node("value", [value]))
        for call in apply or ():
            name_, args, props = (call, (), {}) if isinstance(call, str) else call
            if name_ in BUILTINS:
                unknown = set(props) - {a.name for a in BUILTINS[name_].args}
                if unknown:
                    raise ValueError(f"{name_} has no property {sorted(unknown)[0]}")
            children.append(Node("apply", [name_, *args], dict(props)))
        if on_error:
            children.append(Node("on-error", [on_error]))
        self.nodes.append(Node("field", [name], {"type": type, "required": True if required else None, "default": default}, children))
        return self

    def collection(self, name: str, select: str, members: Members, *, min_items: int | None = None, max_items: int | None = None, required: bool = False, on_row_error: str | None = None) -> Members:
        props = {"required": True if required else None, "min-items": min_items, "max-items": max_items, "on-row-error": on_row_error}
        self.nodes.append(Node("collection", [name], props, [Node("select", [select]), *members.nodes]))
        return self


class ExtractorBuilder(Members):
    def __init__(self, name: str, url: str, *, version: str = "2026-01-01", mode: str = "http", session: str | None = None):
        super().__init__()
        self.name, self.version = name, version
        self.source = Node("source", ["html"], {}, [Node("fetch", [], {"mode": mode, "url": url})])
        if session:
            self.source.children.append(Node("session", [], {"policy": session}))
        self.imports: list[Node] = []
        self.declared: list[Node] = []

    def input(self, name: str, type: str, *, required: bool = True, default: object = None) -> ExtractorBuilder:
        self.declared.append(Node("input", [name], {"type": type, "required": None if required else False, "default": default}))
        return self

    def import_(self, path: str, alias: str) -> ExtractorBuilder:
        self.imports.append(Node("import", [path], {"as": alias}))
        return self

    def pipeline(self, name: str, given: str, gives: str, calls: list) -> ExtractorBuilder:
        apply = [Node("apply", [c] if isinstance(c, str) else [c[0], *c[1]], {} if isinstance(c, str) else dict(c[2])) for c in calls]
        self.declared.append(Node("transform", [name], {"input": given, "output": gives}, [Node("pipeline", [], {}, apply)]))
        return self

    def match(self, name: str, given: str, gives: str, cases: dict, default: object) -> ExtractorBuilder:
        body = [Node("case", [k, v]) for k, v in cases.items()] + [Node("default", [default])]
        self.declared.append(Node("transform", [name], {"input": given, "output": gives}, [Node("match", [], {}, body)]))
        return self

    def external(self, name: str, given: str, gives: str, symbol: str) -> ExtractorBuilder:
        self.declared.append(Node("transform", [name], {"input": given, "output": gives}, [Node("external", [], {"symbol": symbol})]))
        return self

    def step(self, name: str, *args, **options) -> ExtractorBuilder:
        """A browser workflow step; options with underscores."""
        flow = next((c for c in self.source.children if c.name == "workflow"), None)
        if flow is None:
            flow = Node("workflow")
            self.source.children.append(flow)
        flow.children.append(Node(name, list(args), {k.replace("_", "-"): v for k, v in options.items()}))
        return self

    def text(self) -> str:
        root = Node("extractor", [self.name], {"version": self.version, "language-version": VERSION}, [self.source, *self.declared, *self.nodes])
        head = "".join(n.write() for n in self.imports)
        return head + ("\n" if head else "") + root.write()

    def build(self, loader: Loader | dict | None = None) -> Program:
        return compile_text(self.text(), loader=loader)


def catalog(spark: SparkSession) -> DataFrame:
    """Every built-in: its group, what it takes and gives, and its arguments."""
    rows = [(b.name, b.group, b.takes, b.gives, b.positional, [(a.name, a.kind, a.required, None if a.default is None else literal(a.default)) for a in b.args]) for b in BUILTINS.values()]
    return spark.createDataFrame(rows, "name string, category string, takes string, gives string, positional boolean, arguments array<struct<name:string,kind:string,required:boolean,default_value:string>>")
