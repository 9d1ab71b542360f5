"""Programs over DataFrames of pages.

A page is parsed and evaluated in one scalar Arrow function, so the scan reads only the columns that are
used and each page is parsed once. The function is marked as not deterministic: a filter on its result then
can't make Spark evaluate it twice. Filters on other columns are best given as ``where``, which is applied
before. Nothing is shuffled, but for a small table in a few files, which is dealt to all cores first (``spread``);
filtering, joining and counting what comes out are ordinary Spark operations.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from webloom.operators import runtime
from webloom.operators.spread import spread
from webloom.plans.diagnostics import ExecutionError
from webloom.plans.program import Program


def extractor(program: Program, externals: Mapping[str, Callable] | None = None) -> Callable[[Column], Column]:
    """A function from a column of HTML to a column of ``program.result_schema``. Null HTML gives null."""
    externals = dict(externals or {})
    unfit = program.snapshot_error()
    if unfit:
        raise ExecutionError("E_SNAPSHOT_UNSUPPORTED", unfit[1], unfit[0])
    runtime.bind(program, externals)
    schema = program.result_schema
    arrow = to_arrow_type(schema)

    def rows(html: pa.Array) -> pa.Array:
        out = []
        for page in html.to_pylist():
            if page is None:
                out.append(None)
                continue
            try:
                got = runtime.extract_html(program, page, externals)
                out.append(got | {"value": runtime.spark_value(program.members, got["value"]), "error": None})
            except ExecutionError as e:
                out.append({"value": None, "warnings": [], "partial": False, "error": {"code": e.code, "path": e.path or None, "message": e.message}})
        return pa.array(out, arrow)

    return F.arrow_udf(rows, schema).asNondeterministic()


def _distinct(kept: list[str], others: list[str]) -> None:
    """Results of one name would be ambiguous for whoever reads them."""
    seen = {c.lower() for c in others}
    twice = [c for c in kept if c.lower() in seen]
    if twice:
        raise ValueError(f"kept columns have names of results, rename them first: {', '.join(twice)}")


def _extracted(program: Program, df: DataFrame, html: str, where: Column | str | None, keep: tuple[str, ...] | None, externals: Mapping[str, Callable] | None, errors: str) -> tuple[DataFrame, list[str]]:
    """(``kept`` and ``got``, a struct each, so that their members can't clash; the names of what is kept)."""
    if where is not None:
        df = df.where(where)
    kept = [c for c in df.columns if c != html] if keep is None else list(keep)
    df = spread(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, html])]))
    inside = F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(None).alias("none")])
    out = df.select(inside.alias("kept"), extractor(program, externals)(F.col(f"`{html}`")).alias("got"))
    if errors == "raise":
        message = F.concat(F.col("got.error.code"), F.lit(" at "), F.coalesce(F.col("got.error.path"), F.lit("")), F.lit(": "), F.col("got.error.message"))
        checked = F.when(F.col("got.error").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.col("got.partial"))
        out = out.withColumn("got", F.col("got").withField("partial", checked))
    return out, kept


def _members(struct: str, names: list[str]) -> list[Column]:
    return [F.col(f"{struct}.`{n}`").alias(n) for n in names]


def extract(
    program: Program, df: DataFrame, html: str = "html", *, where: Column | str | None = None, keep: tuple[str, ...] | None = None, externals: Mapping[str, Callable] | None = None, errors: str = "column"
) -> DataFrame:
    """``keep``'s columns (all but the HTML by default) and value, warnings, partial, error. With ``errors``
    "raise" a record's error fails the job. A kept column with a result's name is refused."""
    out, kept = _extracted(program, df, html, where, keep, externals, errors)
    _distinct(kept, program.result_schema.names)
    return out.select(*_members("kept", kept), *_members("got", program.result_schema.names))


def fields(program: Program, df: DataFrame, html: str = "html", *, where: Column | str | None = None, keep: tuple[str, ...] | None = None, externals: Mapping[str, Callable] | None = None, errors: str = "column") -> DataFrame:
    """The kept columns and one column for each output member; failed records are left out. A kept column with a member's
    name is refused."""
    out, kept = _extracted(program, df, html, where, keep, externals, errors)
    members = program.schema.names
    _distinct(kept, members)
    return out.where("got.error is null and got is not null").select(*_members("kept", kept), *_members("got.value", members))


def rows(program: Program, df: DataFrame, collection: str, html: str = "html", *, where: Column | str | None = None, keep: tuple[str, ...] | None = None, externals: Mapping[str, Callable] | None = None, errors: str = "column") -> DataFrame:
    """One row for each of a top-level collection's items: the kept columns, ``pos`` from 0, and its members. A kept column
    with the name of one of these is refused."""
    out, kept = _extracted(program, df, html, where, keep, externals, errors)
    members = program.schema[collection].dataType.elementType.names
    _distinct(kept, ["pos", *members])
    out = out.where("got.error is null").select("kept", F.posexplode(F.col(f"got.value.`{collection}`")).alias("pos", "item"))
    return out.select(*_members("kept", kept), "pos", *_members("item", members))


def decode(df: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """``value`` as a declared schema, strictly: a lossy or a missing member is an analysis error."""
    return df.select(f"{value}.*").to(schema)


def sink_json(df: DataFrame, value: str = "value") -> DataFrame:
    """Each record as JSON text, nulls kept."""
    return df.select(F.to_json(F.col(value), {"ignoreNullFields": "false"}).alias("json"))
