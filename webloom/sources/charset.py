"""Bytes of a page to text: byte-order mark, then Content-Type, then <meta> in the first 4096 bytes, then UTF-8."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from webloom.plans.diagnostics import ExecutionError

_META = re.compile(rb"<meta[^>]*?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)", re.I)
#: Labels of the web that Python names otherwise (fixed values).
_LABELS = {"iso-8859-1": "iso-8859-1", "latin1": "cp1252", "x-sjis": "cp932", "shift_jis": "cp932", "gb2312": "gb18030", "gbk": "gb18030", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "unicode-1-1-utf-8": "utf-8", "x-user-defined": ""}


def charset_of(data: bytes, content_type: str | None = None) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if data.startswith(mark):
            return name
    m = re.search(r"charset\s*=\s*\"?([^\s;\"]+)", content_type or "", re.I)
    if m:
        return m[1].lower()
    m = _META.search(data[:4096])
    if not m:
        return "utf-8"
    name = m[1].decode("ascii").lower()
    return "utf-8" if name.startswith("utf-16") else name


def decode_page(data: bytes, content_type: str | None = None, decoders: dict[str, Callable[[bytes], str]] | None = None) -> str:
    """Strict: bytes that the character set doesn't have are an error."""
    name = charset_of(data, content_type)
    own = {"utf-8", "utf8", "us-ascii", "iso-8859-1", "windows-1252", "utf-16le", "utf-16be"}
    if name not in own and decoders and name in decoders:
        return decoders[name](data)
    python = _LABELS.get(name, name)
    try:
        codec = codecs.lookup(python) if python else None
    except LookupError:
        codec = None
    if codec is None:
        raise ExecutionError("E_HTML_CHARSET_UNSUPPORTED", f'charset "{name}" has no decoder')
    try:
        text = data.decode(codec.name)
    except UnicodeDecodeError as e:
        if codec.name == "cp1252":
            return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data)
        raise ExecutionError("E_HTML_DECODE", f"invalid {name}: {e.reason}") from None
    return text.removeprefix("﻿")


def decode_column(content: Column, content_type: Column | None = None, decoders: dict[str, Callable[[bytes], str]] | None = None, max_bytes: int = 32 << 20) -> Column:
    """struct<html, code, message>: ``code`` is null unless the page can't be decoded or is too large."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("html", "code", "message")])
    kind = to_arrow_type(schema)

    def run(data: pa.Array, types: pa.Array) -> pa.Array:
        out = []
        for d, t in zip(data.to_pylist(), types.to_pylist(), strict=True):
            row = {"html": None, "code": None, "message": None}
            if d is not None and len(d) > max_bytes:
                row |= {"code": "E_HTTP_BODY_TOO_LARGE", "message": f"body exceeds {max_bytes} bytes"}
            elif d is not None:
                try:
                    row["html"] = decode_page(d, t, decoders)
                except ExecutionError as e:
                    row |= {"code": e.code, "message": e.message}
            out.append(row)
        return pa.array(out, kind)

    return F.arrow_udf(run, schema)(content, F.lit(None).cast("string") if content_type is None else content_type)
