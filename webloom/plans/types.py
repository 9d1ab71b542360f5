"""The type system of programs and its Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

PRIMITIVES = ("string", "bool", "int", "u8", "u16", "u32", "u64", "i8", "i16", "i32", "i64", "float", "f32", "f64", "object", "unknown")
INTEGERS = {
    "int": (-(2**63), 2**63 - 1), "i64": (-(2**63), 2**63 - 1), "i32": (-(2**31), 2**31 - 1), "i16": (-(2**15), 2**15 - 1), "i8": (-(2**7), 2**7 - 1),
    "u8": (0, 2**8 - 1), "u16": (0, 2**16 - 1), "u32": (0, 2**32 - 1), "u64": (0, 2**64 - 1),
}
FLOATS = ("float", "f32", "f64")
_SPARK = {
    "string": T.StringType(), "bool": T.BooleanType(), "int": T.LongType(), "i64": T.LongType(), "i32": T.IntegerType(), "i16": T.ShortType(), "i8": T.ByteType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "float": T.DoubleType(), "f64": T.DoubleType(), "f32": T.FloatType(),
    # JSON text: a scalar Arrow function can't return a variant; parse_json gives one.
    "object": T.StringType(), "unknown": T.StringType(),
}


@dataclass(frozen=True)
class Type:
    """``kind`` is "primitive", "array" or "nullable"."""

    kind: str
    name: str = ""
    of: Type | None = None

    def __str__(self) -> str:
        if self.kind == "primitive":
            return self.name
        return f"{self.of}[]" if self.kind == "array" else f"{self.of}?"

    @property
    def nullable(self) -> bool:
        return self.kind == "nullable"

    @property
    def bare(self) -> Type:
        return self.of if self.nullable else self

    @property
    def is_scalar(self) -> bool:
        return self.bare.kind == "primitive" and self.bare.name not in ("object", "unknown")

    @property
    def is_numeric(self) -> bool:
        return self.kind == "primitive" and (self.name in INTEGERS or self.name in FLOATS)

    def lifted(self) -> Type:
        return self if self.nullable or self.kind == "primitive" and self.name == "unknown" else Type("nullable", of=self)

    def spark(self) -> T.DataType:
        if self.kind == "array":
            return T.ArrayType(self.of.spark(), self.of.nullable)
        return self.of.spark() if self.nullable else _SPARK[self.name]


def primitive(name: str) -> Type:
    return Type("primitive", name)


STRING, BOOL, INT, FLOAT, UNKNOWN = (primitive(n) for n in ("string", "bool", "int", "float", "unknown"))
_TOKENS = re.compile(r"\s*([a-z][a-z0-9]*|\[\]|\?|\(|\))")


def parse_type(text: str) -> Type:
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"invalid type {text!r}")
        tokens.append(m[1])
        at = m.end()

    def one(i: int) -> tuple[Type, int]:
        if i < len(tokens) and tokens[i] == "(":
            t, i = one(i + 1)
            if i >= len(tokens) or tokens[i] != ")":
                raise ValueError(f"unbalanced parentheses in type {text!r}")
            i += 1
        elif i < len(tokens) and tokens[i] in PRIMITIVES:
            t, i = primitive(tokens[i]), i + 1
        else:
            raise ValueError(f"unknown type {text!r}")
        while i < len(tokens) and tokens[i] in ("[]", "?"):
            if tokens[i] == "?" and t.nullable:
                raise ValueError(f"nested nullable in type {text!r}")
            t = Type("array" if tokens[i] == "[]" else "nullable", of=t)
            i += 1
        return t, i

    found, end = one(0)
    if end != len(tokens):
        raise ValueError(f"invalid type {text!r}")
    return found


def assignable(source: Type, target: Type) -> bool:
    if source == target or target == UNKNOWN:
        return True
    if target.nullable:
        return assignable(source.bare, target.of)
    return source.kind == target.kind == "array" and assignable(source.of, target.of)


def literal_type(value: object) -> Type:
    if value is None:
        return Type("nullable", of=UNKNOWN)
    return BOOL if isinstance(value, bool) else INT if isinstance(value, int) else FLOAT if isinstance(value, float) else STRING


def literal_fits(value: object, target: Type) -> bool:
    if value is None:
        return target.nullable or target == UNKNOWN
    return assignable(literal_type(value), target)


def conforms(value: object, t: Type) -> bool:
    """Whether a runtime value is one of the type."""
    import math

    if t.nullable:
        return value is None or conforms(value, t.of)
    if t.kind == "array":
        return isinstance(value, list) and all(conforms(v, t.of) for v in value)
    if t.name == "unknown":
        return True
    if t.name == "object":
        return isinstance(value, dict) and all(isinstance(k, str) for k in value)
    if t.name == "string":
        return isinstance(value, str)
    if t.name == "bool":
        return isinstance(value, bool)
    if t.name in INTEGERS:
        low, high = INTEGERS[t.name]
        return isinstance(value, int) and not isinstance(value, bool) and low <= value <= high
    return isinstance(value, float) and math.isfinite(value)


def to_spark(value: object, t: Type) -> object:
    """A value as the Spark type of ``t`` takes it: objects as canonical JSON, u64 as decimal."""
    import decimal
    import json

    if value is None:
        return None
    if t.nullable:
        return to_spark(value, t.of)
    if t.kind == "array":
        return [to_spark(v, t.of) for v in value]
    if t.name in ("object", "unknown"):
        return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return decimal.Decimal(value) if t.name == "u64" else value
