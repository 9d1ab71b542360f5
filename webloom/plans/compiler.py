"""Program text to ``Program``: loading and imports, names, types, capabilities. Nothing here touches Spark jobs."""

from __future__ import annotations

import datetime
import hashlib
import posixpath
import re
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlsplit

from webloom.functions.builtins import BUILTINS, check_arguments, result_type
from webloom.plans.diagnostics import CompileError, Diagnostic, Span, ordered
from webloom.plans.kdl import KdlNode, Value, parse_kdl
from webloom.plans.program import VERSION, Call, Collection, Field, Input, Program, Step, Transform
from webloom.plans.selector import Selector, SelectorError, parse_selector
from webloom.plans.types import STRING, Type, assignable, literal_fits, parse_type

_NAME, _ROOT_NAME = re.compile(r"[a-z][a-z0-9_]*\Z"), re.compile(r"[a-z][a-z0-9-]*\Z")
MOST_MS = 9_223_372_036_854
#: Browser workflow steps: arguments, options, capability.
STEPS = {
    "wait-for": (1, ("state", "timeout-ms"), "browser.wait"),
    "click": (1, ("timeout-ms",), "browser.input"),
    "fill": (2, ("timeout-ms",), "browser.input"),
    "press": (2, ("timeout-ms",), "browser.input"),
    "scroll": (2, (), "browser.scroll"),
    "wait-for-network-idle": (0, ("idle-ms", "timeout-ms"), "browser.network-idle"),
    "evaluate-js": (1, ("timeout-ms",), "browser.evaluate-js"),
}
Loader = Callable[[str], bytes]


class _Compiler:
    def __init__(self, loader: Loader | None):
        self.loader, self.found = loader, []
        self.files: dict[str, str] = {}
        self.modules: dict[str, tuple[dict[str, KdlNode], dict[str, str]]] = {}
        self.transforms: dict[str, Transform] = {}
        self.open: list[str] = []
        self.compiling: set[str] = set()
        self.capabilities: set[str] = set()
        self.script = False

    def error(self, code: str, message: str, span: Span, path: str | None = None, severity: str = "error") -> None:
        self.found.append(Diagnostic(code, message, span, path, severity))

    # -- documents ------------------------------------------------------------------------------------

    def load(self, file: str, data: bytes, kind: str) -> tuple[KdlNode | None, dict[str, str]]:
        """The root of a document and its imports, by alias."""
        self.files[file] = hashlib.sha256(data).hexdigest()
        nodes, found = parse_kdl(file, data)
        self.found += found
        if any(d.severity == "error" for d in found):
            return None, {}
        start = Span(file, (0, 1, 1), (0, 1, 1))
        imports: dict[str, str] = {}
        roots = []
        for n in nodes:
            if n.name == "import":
                if roots:
                    self.error("E_DOCUMENT_ROOT", "imports must precede the root", n.span)
                self.import_(file, n, imports)
            elif n.name in ("extractor", "module"):
                roots.append(n)
            else:
                self.error("E_UNKNOWN_NODE", f'unknown top-level node "{n.name}"', n.span)
        if len(roots) != 1:
            self.error("E_DOCUMENT_ROOT", "a document has exactly one extractor or module", roots[1].span if len(roots) > 1 else start)
            return None, imports
        root = roots[0]
        if root.name != kind:
            self.error("E_IMPORT_KIND" if kind == "module" else "E_DOCUMENT_ROOT", f"expected {kind}, found {root.name}", root.span)
            return None, imports
        self.header(root)
        return root, imports

    def header(self, root: KdlNode) -> None:
        self.node(root, 1, ("version", "language-version"), root.name)
        if root.args and not (isinstance(root.args[0].value, str) and _ROOT_NAME.match(root.args[0].value)):
            self.error("E_IDENTIFIER_INVALID", f"invalid {root.name} name", root.args[0].span, root.name)
        for prop, prefix in (("version", "E_DOCUMENT_VERSION"), ("language-version", "E_LANGUAGE_VERSION")):
            v, path = root.prop(prop), f"{root.name}.{prop}"
            if v is None:
                self.error(f"{prefix}_REQUIRED", f"document requires {prop}", root.span, path)
            elif not _is_date(v.value):
                self.error(f"{prefix}_INVALID", f"{prop} must be a real calendar date in YYYY-MM-DD form", v.span, path)
            elif prop == "language-version" and v.value != VERSION:
                self.error("E_LANGUAGE_VERSION_UNSUPPORTED", f'unsupported language-version "{v.value}"', v.span, path)

    def import_(self, file: str, n: KdlNode, imports: dict[str, str]) -> None:
        self.node(n, 1, ("as",), "import")
        target, alias = (n.args[0].value if n.args else None), n.prop("as")
        if alias is None:
            return self.error("E_IMPORT_ALIAS_REQUIRED", "import requires as", n.span)
        if not (isinstance(alias.value, str) and _NAME.match(alias.value)):
            return self.error("E_IDENTIFIER_INVALID", "invalid import alias", alias.span)
        if alias.value in imports:
            return self.error("E_DUPLICATE_SYMBOL", f'duplicate import alias "{alias.value}"', alias.span)
        if not isinstance(target, str) or not target:
            return self.error("E_ARGUMENT_COUNT", "import needs a path", n.span)
        if "://" in target or target.startswith("/"):
            return self.error("E_REMOTE_IMPORT_UNSUPPORTED", "import path must be relative", n.args[0].span)
        path = posixpath.normpath(posixpath.join(posixpath.dirname(file), target))
        imports[alias.value] = path
        if path in self.open:
            start = Span(path, (0, 1, 1), (0, 1, 1))
            return self.error("E_IMPORT_CYCLE", f'import cycle includes "{path}"', start)
        if path in self.modules:
            return None
        if self.loader is None:
            raise FileNotFoundError(path)
        self.open.append(path)
        root, inner = self.load(path, self.loader(path), "module")
        self.open.pop()
        decls: dict[str, KdlNode] = {}
        self.modules[path] = (decls, inner)
        for c in root.children if root else ():
            if c.name == "transform":
                self.declare(c, decls)
            else:
                self.error("E_UNKNOWN_NODE", f'unknown node "{c.name}" in module', c.span)
        return None

    def declare(self, n: KdlNode, decls: dict[str, KdlNode]) -> None:
        self.node(n, 1, ("input", "output"), "transform")
        name = n.args[0].value if n.args else None
        if not isinstance(name, str):
            return
        if name in BUILTINS:
            self.error("E_TRANSFORM_SHADOWS_BUILTIN", f'transform "{name}" shadows a built-in', n.span)
        elif not _NAME.match(name):
            self.error("E_IDENTIFIER_INVALID", f'invalid transform name "{name}"', n.span)
        elif name in decls:
            self.error("E_DUPLICATE_SYMBOL", f'duplicate transform "{name}"', n.span)
        else:
            decls[name] = n

    # -- helpers --------------------------------------------------------------------------------------

    def node(self, n: KdlNode, args: int | None, props: tuple[str, ...], path: str, children: bool = True) -> None:
        if args is not None and len(n.args) != args:
            self.error("E_ARGUMENT_COUNT", f"{n.name} takes {args} argument{'s' * (args != 1)}", n.span, path)
        seen = set()
        for k, _, span in n.props:
            if k in seen:
                self.error("E_DUPLICATE_PROPERTY", f'duplicate property "{k}"', span, path)
            elif props is not None and k not in props:
                self.error("E_UNKNOWN_PROPERTY", f'unknown property "{k}"', span, path)
            seen.add(k)
        if not children and n.children:
            self.error("E_UNKNOWN_NODE", f"{n.name} takes no children", n.children[0].span, path)

    def typed(self, v: Value | None, n: KdlNode, path: str, code: str = "E_TYPE_UNKNOWN") -> Type | None:
        if v is None:
            self.error("E_FIELD_TYPE_REQUIRED" if n.name == "field" else code, f"{n.name} requires a type", n.span, path)
            return None
        try:
            return parse_type(v.value if isinstance(v.value, str) else "")
        except ValueError as e:
            self.error("E_TYPE_UNKNOWN", str(e), v.span, path)
            return None

    def flag(self, n: KdlNode, name: str, default: bool, path: str) -> bool:
        v = n.prop(name)
        if v is None:
            return default
        if not isinstance(v.value, bool):
            self.error("E_TYPE_MISMATCH", f"{name} must be a boolean", v.span, path)
            return default
        return v.value

    def word(self, n: KdlNode, name: str, among: tuple[str, ...], default: str | None, path: str, code: str = "E_TYPE_MISMATCH") -> str | None:
        v = n.prop(name)
        if v is None:
            if default is None:
                self.error(code, f"{n.name} requires {name}", n.span, path)
            return default
        if v.value not in among:
            self.error(code, f"{name} must be one of {', '.join(among)}", v.span, path)
            return default
        return v.value

    def selector(self, v: Value, path: str) -> Selector | None:
        try:
            if not isinstance(v.value, str):
                raise SelectorError("selector must be a string")
            return parse_selector(v.value)
        except SelectorError as e:
            self.error("E_SELECTOR_UNSUPPORTED" if e.unsupported else "E_SELECTOR_INVALID", str(e), v.span, path)
            return None

    def duration(self, n: KdlNode, name: str, path: str) -> int | None:
        v = n.prop(name)
        if v is None:
            return None
        if not isinstance(v.value, int) or isinstance(v.value, bool) or v.value < 1:
            self.error("E_TYPE_MISMATCH", f"{name} must be a positive integer", n.span, path)
        elif v.value > MOST_MS:
            self.error("E_TYPE_MISMATCH", f"{name} must not exceed {MOST_MS}", n.span, path)
        return v.value if isinstance(v.value, int) else None

    # -- the extractor --------------------------------------------------------------------------------

    def extractor(self, file: str, data: bytes) -> Program | None:
        self.open.append(file)
        root, imports = self.load(file, data, "extractor")
        if root is None:
            return None
        decls: dict[str, KdlNode] = {}
        for c in root.children:
            if c.name == "transform":
                self.declare(c, decls)
            elif c.name not in ("source", "input", "field", "collection"):
                self.error("E_UNKNOWN_NODE", f'unknown node "{c.name}" in extractor', c.span, "extractor")
        self.modules[file] = (decls, imports)
        inputs = self.inputs(root)
        mode, url, raw, session, workflow = self.source(root, inputs)
        done: set[str] = set()

        def imported(path: str) -> None:
            for inner in self.modules[path][1].values():
                if inner in self.modules and inner not in done:
                    done.add(inner)
                    imported(inner)
                    for name in sorted(self.modules[inner][0]):
                        self.transform(inner, name)

        imported(file)
        for name in decls:
            self.transform(file, name)
        members = self.members(root, file, "output", mode, top=True)
        if self.script:
            self.error("W_JAVASCRIPT_PRESENT", "specification contains trusted JavaScript execution", root.span, "source", "warning")
        self.capabilities.add("http.fetch" if mode == "http" else "browser.navigate")
        return Program(
            root.args[0].value if root.args else "", str(root.prop("version").value) if root.prop("version") else "", tuple(sorted(self.files.items())), mode, url, raw, session, workflow,
            tuple(inputs.values()), self.transforms, members, tuple(sorted(self.capabilities)), tuple(d for d in ordered(self.found) if d.severity == "warning"),
        )

    def inputs(self, root: KdlNode) -> dict[str, Input]:
        out: dict[str, Input] = {}
        for n in (c for c in root.children if c.name == "input"):
            self.node(n, 1, ("type", "required", "default"), "input", False)
            name = n.args[0].value if n.args else None
            path = f"input.{name}"
            if not (isinstance(name, str) and _NAME.match(name)):
                self.error("E_IDENTIFIER_INVALID", "invalid input name", n.span, path)
                continue
            if name in out:
                self.error("E_DUPLICATE_SYMBOL", f'duplicate input "{name}"', n.span, path)
            t = self.typed(n.prop("type"), n, path)
            if t is not None and str(t) not in ("string", "bool", "int", "float"):
                self.error("E_TYPE_MISMATCH", "input types are string, bool, int and float", n.span, path)
            required, default = self.flag(n, "required", True, path), n.prop("default")
            if required and default is not None:
                self.error("E_INPUT_REQUIRED_DEFAULT", "a required input has no default", default.span, path)
            elif default is not None and t is not None and not literal_fits(default.value, t):
                self.error("E_DEFAULT_INVALID", "default is not assignable to the input's type", default.span, path)
            out[name] = Input(name, t or STRING, required, default.value if default else None, default is not None)
        return out

    def source(self, root: KdlNode, inputs: dict[str, Input]):
        nodes = [c for c in root.children if c.name == "source"]
        empty = ("http", (), "", "none", ())
        if len(nodes) != 1:
            self.error("E_ARGUMENT_COUNT", "extractor requires exactly one source", nodes[1].span if len(nodes) > 1 else root.span, "source")
            return empty
        n = nodes[0]
        self.node(n, 1, (), "source")
        if n.args and n.args[0].value != "html":
            self.error("E_TYPE_MISMATCH", 'source must be "html"', n.args[0].span, "source")
        by = {k: [c for c in n.children if c.name == k] for k in ("fetch", "session", "workflow")}
        for c in n.children:
            if c.name not in by:
                self.error("E_UNKNOWN_NODE", f'unknown node "{c.name}" in source', c.span, "source")
        if len(by["fetch"]) != 1:
            self.error("E_ARGUMENT_COUNT", "source requires exactly one fetch", n.span, "source")
            return empty
        for k in ("session", "workflow"):
            if len(by[k]) > 1:
                self.error("E_ARGUMENT_COUNT", f"source takes at most one {k}", by[k][1].span, f"source.{k}")
        fetch = by["fetch"][0]
        self.node(fetch, 0, ("mode", "url"), "source.fetch", False)
        mode = self.word(fetch, "mode", ("http", "browser"), None, "source.fetch") or "http"
        u = fetch.prop("url")
        url, raw = (), ""
        if u is None or not isinstance(u.value, str) or not u.value:
            self.error("E_TEMPLATE_INVALID", "fetch requires a url", fetch.span, "source.fetch")
        else:
            raw = u.value
            url = self.template(u, inputs)
        session = "none"
        for s in by["session"][:1]:
            self.node(s, 0, ("policy",), "source.session", False)
            session = self.word(s, "policy", ("none", "optional", "required"), "none", "source.session")
        steps = []
        for w in by["workflow"][:1]:
            if mode != "browser":
                self.error("E_BROWSER_CAPABILITY_REQUIRED", "workflow requires browser fetch mode", w.span, "source.workflow")
            for i, c in enumerate(w.children):
                steps.append(self.step(c, f"source.workflow[{i}]"))
        return mode, url, raw, session, tuple(s for s in steps if s)

    def template(self, u: Value, inputs: dict[str, Input]) -> tuple[tuple[str, str], ...]:
        out: list[tuple[str, str]] = []
        at, literal, text = 0, "", u.value
        while at < len(text):
            two, c = text[at : at + 2], text[at]
            if two in ("{{", "}}"):
                literal += c
                at += 2
                continue
            if c == "}":
                self.error("E_TEMPLATE_INVALID", "unmatched }", u.span, "source.fetch.url")
                return ()
            if c != "{":
                literal += c
                at += 1
                continue
            end = text.find("}", at)
            name = text[at + 1 : end] if end >= 0 else ""
            if not _NAME.match(name):
                self.error("E_TEMPLATE_INVALID", "malformed placeholder", u.span, "source.fetch.url")
                return ()
            if name not in inputs:
                self.error("E_INPUT_UNDECLARED", f'undeclared input "{name}"', u.span, "source.fetch.url")
            elif not inputs[name].required and not inputs[name].has_default:
                self.error("E_TEMPLATE_OPTIONAL_INPUT", f'optional input "{name}" has no default', u.span, "source.fetch.url")
            if literal:
                out.append(("literal", literal))
            out.append(("input", name))
            literal, at = "", end + 1
        if literal:
            out.append(("literal", literal))
        probe = urlsplit("".join(v if k == "literal" else "x" for k, v in out))
        if probe.scheme.lower() not in ("http", "https") or not probe.netloc:
            self.error("E_TEMPLATE_INVALID", "url must be absolute with http or https", u.span, "source.fetch.url")
        return tuple(out)

    def step(self, n: KdlNode, path: str) -> Step | None:
        if n.name not in STEPS:
            self.error("E_UNKNOWN_NODE", f'unknown workflow step "{n.name}"', n.span, path)
            return None
        args, options, capability = STEPS[n.name]
        self.node(n, args, options, path, False)
        self.capabilities.add(capability)
        if n.name == "evaluate-js":
            self.script = True
        if n.name in ("wait-for", "click", "fill", "press") and n.args:
            self.selector(n.args[0], path)
        if n.name == "scroll" and not all(isinstance(a.value, (int, float)) and not isinstance(a.value, bool) for a in n.args):
            self.error("E_TYPE_MISMATCH", "scroll takes numbers", n.span, path)
        found = {}
        if n.name == "wait-for":
            found["state"] = self.word(n, "state", ("attached", "visible", "hidden", "detached"), "visible", path)
        for k in ("idle-ms", "timeout-ms"):
            v = self.duration(n, k, path) if k in options else None
            if v is not None:
                found[k] = v
        if n.name == "wait-for-network-idle":
            found.setdefault("idle-ms", 500)
        return Step(n.name, tuple(a.value for a in n.args), tuple(found.items()))

    # -- transforms -----------------------------------------------------------------------------------

    def transform(self, file: str, name: str) -> Transform | None:
        symbol = f"{file}#transform:{name}"
        if symbol in self.transforms:
            return self.transforms[symbol]
        n = self.modules[file][0][name]
        path = f"transforms.{name}"
        given, gives = self.typed(n.prop("input"), n, path), self.typed(n.prop("output"), n, path)
        if given is None or gives is None:
            return None
        origin = "local" if file == self.open[0] else "imported"
        if symbol in self.compiling:
            return Transform(symbol, name, "pipeline", given, gives, origin)
        self.compiling.add(symbol)
        bodies = [c for c in n.children if c.name in ("pipeline", "match", "external")]
        for c in n.children:
            if c not in bodies:
                self.error("E_UNKNOWN_NODE", f'unknown node "{c.name}" in transform', c.span, path)
        if len(bodies) != 1:
            self.error("E_ARGUMENT_COUNT", "transform requires exactly one body", n.span, path)
            return None
        body = bodies[0]
        out = Transform(symbol, name, body.name, given, gives, origin, span=n.span)
        if body.name == "pipeline":
            self.node(body, 0, (), path)
            calls = self.calls(body.children, file, given, gives, path, "pipeline")
            if not body.children:
                self.error("E_ARGUMENT_COUNT", "pipeline requires an apply", body.span, path)
            out = Transform(symbol, name, "pipeline", given, gives, origin, calls, span=n.span)
        elif body.name == "match":
            out = self.match(body, out, path)
        else:
            self.node(body, 0, ("symbol",), path, False)
            s = body.prop("symbol")
            if s is None or not isinstance(s.value, str) or not s.value:
                self.error("E_TRANSFORM_ARGUMENT", "external requires a symbol", body.span, path)
            else:
                self.capabilities.add(f"transform.external:{s.value}")
                out = Transform(symbol, name, "external", given, gives, origin, external=s.value, span=n.span)
        self.transforms[symbol] = out
        return out

    def match(self, body: KdlNode, t: Transform, path: str) -> Transform:
        self.node(body, 0, (), path)
        if not (t.given.is_scalar and t.gives.is_scalar):
            self.error("E_TYPE_MISMATCH", "match takes and gives scalars", body.span, path)
        cases, defaults, seen = [], [], set()
        for c in body.children:
            if c.name == "case":
                self.node(c, 2, (), path, False)
                if len(c.args) != 2:
                    continue
                when, then = (a.value for a in c.args)
                if not literal_fits(when, t.given):
                    self.error("E_TYPE_MISMATCH", "case value is not assignable to the input", c.args[0].span, path)
                if not literal_fits(then, t.gives):
                    self.error("E_TYPE_MISMATCH", "case result is not assignable to the output", c.args[1].span, path)
                k = (isinstance(when, bool), when)
                if k in seen:
                    self.error("E_MATCH_DUPLICATE_CASE", "duplicate case", c.args[0].span, path)
                seen.add(k)
                cases.append((when, then))
            elif c.name == "default":
                self.node(c, 1, (), path, False)
                defaults.append(c)
                if c.args and not literal_fits(c.args[0].value, t.gives):
                    self.error("E_TYPE_MISMATCH", "default is not assignable to the output", c.args[0].span, path)
            else:
                self.error("E_UNKNOWN_NODE", f'unknown node "{c.name}" in match', c.span, path)
        if len(defaults) != 1:
            self.error("E_MATCH_DEFAULT", "match requires exactly one default", body.span, path)
        return Transform(t.symbol, t.name, "match", t.given, t.gives, t.origin, (), tuple(cases), defaults[0].args[0].value if defaults and defaults[0].args else None, span=t.span)

    def calls(self, nodes: list[KdlNode], file: str, given: Type, target: Type, path: str, where: str) -> tuple[Call, ...]:
        out, now = [], given
        for i, n in enumerate(nodes):
            at = f"{path}.{'transforms' if where == 'field' else 'pipeline.calls'}[{i}]"
            if n.name != "apply":
                self.error("E_UNKNOWN_NODE", f'unknown node "{n.name}" in {where}', n.span, path)
                continue
            call = self.call(n, file, now, at)
            if call is None:
                return tuple(out)
            out.append(call)
            now = call.gives
        if not assignable(now, target):
            self.error("E_TRANSFORM_TYPE_MISMATCH" if where == "pipeline" or out else "E_TYPE_MISMATCH", f"{now} is not assignable to {target}", (nodes[-1].span if nodes else None) or self.here, path)
        return tuple(out)

    def call(self, n: KdlNode, file: str, given: Type, path: str) -> Call | None:
        if n.children:
            self.error("E_UNKNOWN_NODE", "apply takes no children", n.children[0].span, path)
        self.node(n, None, None, path)
        name = n.args[0].value if n.args else None
        if not isinstance(name, str):
            self.error("E_ARGUMENT_COUNT", "apply requires a transform name", n.span, path)
            return None
        named, positional = {k: v.value for k, v, _ in n.props}, [a.value for a in n.args[1:]]
        if name in BUILTINS:
            wrong = check_arguments(name, given, named, positional)
            for code, message in wrong:
                self.error(code, message, n.span, path)
            if wrong:
                return None
            gives = result_type(name, given, named)
            if gives is None:
                self.error("E_TRANSFORM_TYPE_MISMATCH", f"{name} does not take {given}", n.span, path)
                return None
            return Call(name, True, tuple(positional), tuple(sorted(named.items())), given, gives)
        decls, imports = self.modules[file]
        alias, dot, inner = name.partition(".")
        owner, wanted = (imports.get(alias), inner) if dot else (file, name)
        if owner is None or owner not in self.modules or wanted not in self.modules[owner][0]:
            self.error("E_TRANSFORM_UNKNOWN", f'unknown transform "{name}"', n.span, path)
            return None
        if named or positional:
            self.error("E_TRANSFORM_ARGUMENT", "declared transforms take no arguments", n.span, path)
        t = self.transform(owner, wanted)
        if t is None:
            return None
        if not assignable(given, t.given):
            self.error("E_TRANSFORM_TYPE_MISMATCH", f"{name} takes {t.given}, not {given}", n.span, path)
            return None
        return Call(t.symbol, False, (), (), given, t.gives)

    # -- output ---------------------------------------------------------------------------------------

    def members(self, n: KdlNode, file: str, path: str, mode: str, top: bool = False) -> tuple:
        out, names = [], set()
        for c in n.children:
            if c.name not in ("field", "collection"):
                continue
            name = c.args[0].value if c.args else None
            if not (isinstance(name, str) and _NAME.match(name)):
                self.error("E_IDENTIFIER_INVALID", f"invalid {c.name} name", c.span, path)
                continue
            if name in names:
                self.error("E_DUPLICATE_SYMBOL", f'duplicate output "{name}"', c.span, f"{path}.{name}")
            names.add(name)
            m = self.field(c, file, f"{path}.{name}", mode, top) if c.name == "field" else self.collection(c, file, f"{path}.{name}", mode)
            if m is not None:
                out.append(m)
        return tuple(out)

    def field(self, n: KdlNode, file: str, path: str, mode: str, top: bool) -> Field | None:
        self.node(n, 1, ("type", "required", "default"), path)
        self.here = n.span
        t = self.typed(n.prop("type"), n, path)
        required, default = self.flag(n, "required", False, path), n.prop("default")
        selects, sources, applies, policies = ([c for c in n.children if c.name in k] for k in (("select",), ("value", "evaluate-js"), ("apply",), ("on-error",)))
        for c in n.children:
            if c.name not in ("select", "value", "evaluate-js", "apply", "on-error"):
                self.error("E_UNKNOWN_NODE", f'unknown node "{c.name}" in field', c.span, path)
        if not sources:
            self.error("E_VALUE_SOURCE_MISSING", "field requires a value source", n.span, path)
            return None
        if len(sources) > 1:
            self.error("E_VALUE_SOURCE_MULTIPLE", "field takes one value source", sources[1].span, path)
        for group in (selects, policies):
            if len(group) > 1:
                self.error("E_ARGUMENT_COUNT", f"field takes at most one {group[0].name}", group[1].span, path)
        selector, match = None, "one"
        for s in selects[:1]:
            self.node(s, 1, ("match",), f"{path}.selection", False)
            match = self.word(s, "match", ("one", "first"), "one", f"{path}.selection") or "one"
            if s.args:
                selector = self.selector(s.args[0], f"{path}.selection")
        source, at = sources[0], f"{path}.valueSource"
        raw, kind, attribute, script, scope, timeout = STRING, "text", "", "", "", None
        if source.name == "value":
            self.node(source, 1, ("name",), at, False)
            kind = source.args[0].value if source.args else None
            a = source.prop("name")
            if kind not in ("text", "html", "attr"):
                self.error("E_TYPE_MISMATCH", "value must be text, html or attr", source.span, at)
                kind = "text"
            if kind == "attr":
                kind = "attribute"
                if a is None or not isinstance(a.value, str) or not a.value:
                    self.error("E_ATTRIBUTE_NAME_REQUIRED", "attr requires a name", source.span, at)
                else:
                    attribute = a.value.lower()
            elif a is not None:
                self.error("E_UNKNOWN_PROPERTY", "only attr takes a name", a.span, at)
            if not selects:
                self.error("E_SELECTOR_REQUIRED", "value requires select", n.span, path)
            if mode == "browser":
                self.capabilities |= {"browser.query", {"text": "browser.read-text", "html": "browser.read-html", "attribute": "browser.read-attr"}[kind]}
        else:
            kind = "javascript"
            self.script = True
            self.node(source, 1, ("scope", "returns", "timeout-ms"), at, False)
            self.capabilities.add("browser.evaluate-js")
            if mode != "browser":
                self.error("E_BROWSER_CAPABILITY_REQUIRED", "evaluate-js requires browser fetch mode", source.span, at)
            script = source.args[0].value if source.args and isinstance(source.args[0].value, str) else ""
            scope = self.word(source, "scope", ("document", "current"), None, at) or "document"
            raw = self.typed(source.prop("returns"), source, at) or STRING
            timeout = self.duration(source, "timeout-ms", at)
            if scope == "document" and selects:
                self.error("E_SELECTOR_FORBIDDEN", "document scope takes no select", selects[0].span, path)
            if scope == "current" and not selects and top:
                self.error("E_CURRENT_SCOPE_UNAVAILABLE", "current scope needs a row or a select", source.span, path)
        if t is None:
            return None
        calls = self.calls(applies, file, raw, t, path, "field")
        effective = t if required or default is not None else t.lifted()
        if default is not None and (required or not literal_fits(default.value, t)):
            self.error("E_DEFAULT_INVALID", "default conflicts with the field", default.span, path)
        policy = "fail" if required else "null"
        for p in policies[:1]:
            self.node(p, 1, (), f"{path}.onError", False)
            policy = p.args[0].value if p.args else policy
            if policy not in ("fail", "null", "warn", "default"):
                self.error("E_ERROR_POLICY_INVALID", "unknown error policy", p.span, path)
            elif policy in ("null", "warn") and not (effective.nullable or str(effective) == "unknown"):
                self.error("E_ERROR_POLICY_INVALID", f"{policy} requires a nullable output", p.span, path)
            elif policy == "default" and default is None:
                self.error("E_ERROR_POLICY_INVALID", "default policy requires a default", p.span, path)
        if not policies and policy == "null" and not effective.nullable:
            policy = "default" if default is not None and not (effective.nullable) else "fail"
        return Field(n.args[0].value, path, t, effective, required, default.value if default else None, default is not None, selector, match, kind, attribute, calls, policy, script, scope, timeout, raw, n.span)

    def collection(self, n: KdlNode, file: str, path: str, mode: str) -> Collection | None:
        self.node(n, 1, ("required", "min-items", "max-items", "on-row-error"), path)
        bounds = {}
        for k in ("min-items", "max-items"):
            v = n.prop(k)
            if v is not None:
                if not isinstance(v.value, int) or isinstance(v.value, bool) or v.value < 0:
                    self.error("E_COLLECTION_BOUNDS", f"{k} must be a non-negative integer", v.span, path)
                else:
                    bounds[k] = v.value
        required = self.flag(n, "required", False, path)
        least = max(bounds.get("min-items", 0), int(required))
        most = bounds.get("max-items")
        if most is not None and most < least:
            self.error("E_COLLECTION_BOUNDS", "max-items is below the minimum", n.span, path)
        skip = self.word(n, "on-row-error", ("fail", "skip"), "fail", path) == "skip"
        selects = [c for c in n.children if c.name == "select"]
        selector = None
        if len(selects) != 1:
            self.error("E_SELECTOR_REQUIRED" if not selects else "E_ARGUMENT_COUNT", "collection requires exactly one select", n.span, path)
        elif self.node(selects[0], 1, (), path, False) or selects[0].args:
            selector = self.selector(selects[0].args[0], path)
        for c in n.children:
            if c.name not in ("select", "field", "collection"):
                self.error("E_UNKNOWN_NODE", f'unknown node "{c.name}" in collection', c.span, path)
        members = self.members(n, file, f"{path}[]", mode)
        if not any(c.name in ("field", "collection") for c in n.children):
            self.error("E_COLLECTION_EMPTY_SCHEMA", "collection has no members", n.span, path)
        if mode == "browser":
            self.capabilities.add("browser.query")
        return Collection(n.args[0].value, path, selector, required, least, most, skip, members, n.span) if selector else None


def _is_date(v: object) -> bool:
    try:
        return isinstance(v, str) and bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", v, re.A)) and bool(datetime.date.fromisoformat(v))
    except ValueError:
        return False


def diagnose(text: str | bytes, file: str = "program.kdl", loader: Loader | None = None) -> tuple[Program | None, list[Diagnostic]]:
    """The program, if it has no error, and all diagnostics in order."""
    c = _Compiler(loader)
    program = c.extractor(file, text.encode() if isinstance(text, str) else text)
    found = ordered(c.found)
    return (None if any(d.severity == "error" for d in found) else program), found


def compile_text(text: str | bytes, file: str = "program.kdl", loader: Loader | dict[str, str | bytes] | None = None) -> Program:
    """Raises ``CompileError``. ``loader`` gives an imported file's bytes; a dict of files does too."""
    if isinstance(loader, dict):
        files = loader

        def loader(path: str) -> bytes:
            v = files[path]
            return v.encode() if isinstance(v, str) else v

    program, found = diagnose(text, file, loader)
    if program is None:
        raise CompileError([d for d in found if d.severity == "error"])
    return program


def compile_file(path: str) -> Program:
    """Imports are read relative to the file."""
    base = Path(path).parent
    return compile_text(Path(path).read_bytes(), Path(path).name, lambda p: (base / p).read_bytes())
