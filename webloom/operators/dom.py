"""The tree of a page as rows, and selectors over those rows as filters and semi-joins.

``dom_nodes`` shreds pages into one row for each element, numbered in pre- and post-order, so that b is below
a exactly if a.pre < b.pre and b.post < a.post. Combinators become semi-joins that always have the page's key
as an equality, so Spark plans hash or sort-merge joins whatever the number of pages.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webloom.html.node import ELEMENT
from webloom.html.tree import parse
from webloom.operators.spread import spread
from webloom.plans.selector import Compound, parse_selector

_COLUMNS = [
    ("pre", T.IntegerType()), ("post", T.IntegerType()), ("parent", T.IntegerType()), ("depth", T.IntegerType()), ("tag", T.StringType()), ("attrs", T.MapType(T.StringType(), T.StringType())),
    ("page", T.LongType()), ("elem_idx", T.IntegerType()), ("elem_count", T.IntegerType()), ("type_idx", T.IntegerType()), ("type_count", T.IntegerType()), ("is_empty", T.BooleanType()), ("text", T.StringType()),
]


def dom_nodes(df: DataFrame, key: str = "page_id", html: str = "html", *, text: bool = True) -> DataFrame:
    """(key, pre, post, parent, depth, tag, attrs, page, places, is_empty, text) of every element; ``parent`` is 0
    below the document, ``page`` is the number of the page's row, so pages without key or with one key stay apart. Without
    ``text`` that column is null: every element's text holds its descendants'. Null HTML has no elements."""
    if key in dict(_COLUMNS):
        raise ValueError(f"the key has the name of a result, rename it first: {key}")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *[T.StructField(n, t) for n, t in _COLUMNS]])
    arrow = to_arrow_schema(schema)

    def shred(batches):
        for batch in batches:
            for k, number, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if page is None:
                    continue
                rows = []
                pre = post = 0
                stack = [(c, 0, 1, False) for c in reversed(parse(page).children) if c.kind == ELEMENT]
                at: dict[int, list] = {}
                while stack:
                    n, parent, depth, done = stack.pop()
                    if done:
                        post += 1
                        at[id(n)][2] = post
                        continue
                    pre += 1
                    row = [k, pre, 0, parent, depth, n.tag, list(n.attrs.items()), number, n.index, n.count, n.type_index, n.type_count, n.is_empty(), n.text_content() if text else None]
                    at[id(n)] = row
                    rows.append(row)
                    stack.append((n, parent, depth, True))
                    stack += [(c, pre, depth + 1, False) for c in reversed(n.children) if c.kind == ELEMENT]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    # Numbered where they are read: after a shuffle the order of rows, and so their numbers, may change from run to run.
    numbered = df.select(F.col(f"`{key}`").alias("k"), F.monotonically_increasing_id().alias("page"), F.col(f"`{html}`").alias("h"))
    return spread(numbered).mapInArrow(shred, schema)


def page_matches(df: DataFrame, selectors: dict[str, str], key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, selector, n): for each page and name in ``selectors`` how many elements match. Every selector is answered where
    the page lies, in one parse and without a shuffle; ``select_nodes`` is for tables of nodes. Null HTML has none."""
    if key in ("selector", "n"):
        raise ValueError(f"the key has the name of a result, rename it first: {key}")
    parsed = {name: parse_selector(s) for name, s in selectors.items()}
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("selector", T.StringType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def match(batches):
        for batch in batches:
            keys, names, counts = [], [], []
            for k, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = parse(page) if page is not None else None
                for name, s in parsed.items():
                    keys.append(k)
                    names.append(name)
                    counts.append(len(s.query(tree)) if tree is not None else 0)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((keys, names, counts), arrow, strict=True)], schema=arrow)

    return spread(df.select(F.col(f"`{key}`"), F.col(f"`{html}`"))).mapInArrow(match, schema)


def _words(c: Column) -> Column:
    return F.split(c, "[ \\t\\n\\r\\f]+")


def predicate(c: Compound) -> Column:
    """One compound selector over the columns of ``dom_nodes``."""
    out = F.lit(True)
    if c.tag is not None:
        out &= F.lower("tag") == c.tag
    if c.id is not None:
        out &= F.coalesce(F.col("attrs")["id"] == c.id, F.lit(False))
    for k in c.classes:
        out &= F.coalesce(F.array_contains(_words(F.col("attrs")["class"]), k), F.lit(False))
    for name, op, value in c.attrs:
        a = F.col("attrs")[name]
        test = {
            "": lambda a, v: a.isNotNull(), "=": lambda a, v: a == v, "~=": lambda a, v: F.array_contains(_words(a), v) & F.lit(v != ""), "|=": lambda a, v: (a == v) | a.startswith(v + "-"),
            "^=": lambda a, v: a.startswith(v), "$=": lambda a, v: a.endswith(v), "*=": lambda a, v: a.contains(v),
        }[op](a, value)
        out &= F.coalesce(test, F.lit(False))
    places = {"nth-child": F.col("elem_idx"), "nth-last-child": F.col("elem_count") - F.col("elem_idx") + 1, "nth-of-type": F.col("type_idx"), "nth-last-of-type": F.col("type_count") - F.col("type_idx") + 1}
    fixed = {
        "first-child": F.col("elem_idx") == 1, "last-child": F.col("elem_idx") == F.col("elem_count"), "only-child": F.col("elem_count") == 1, "empty": F.col("is_empty"),
        "first-of-type": F.col("type_idx") == 1, "last-of-type": F.col("type_idx") == F.col("type_count"), "only-of-type": F.col("type_count") == 1,
    }
    for name, arg in c.pseudos:
        if name == "not":
            out &= ~predicate(arg)
        elif name in fixed:
            out &= fixed[name]
        else:
            (a, b), p = arg, places[name]
            out &= (p == b) if a == 0 else ((p - b) % a == 0) & ((p - b) / a >= 0)
    return out


_PLACE = ("page", "pre", "post", "parent", "elem_idx")


def _chained(nodes: DataFrame, chain, is_) -> DataFrame:
    """The rows that the last compound of a chain selects; ``is_`` gives a compound's condition."""
    left = nodes.where(is_(chain[0][1]))
    for combinator, compound in chain[1:]:
        b = nodes.where(is_(compound)).alias("b")
        a = left.select(*_PLACE).distinct().alias("a")
        same = F.col("a.page") == F.col("b.page")
        siblings = same & (F.col("a.parent") == F.col("b.parent"))
        if combinator == "~":
            # Of siblings the first one decides.
            a = left.groupBy("page", "parent").agg(F.min("elem_idx").alias("elem_idx")).alias("a")
        on = {
            ">": lambda: same & (F.col("a.pre") == F.col("b.parent")),
            "+": lambda: siblings & (F.col("a.elem_idx") == F.col("b.elem_idx") - 1),
            "~": lambda: siblings & (F.col("a.elem_idx") < F.col("b.elem_idx")),
            " ": lambda: same & (F.col("a.pre") < F.col("b.pre")) & (F.col("b.post") < F.col("a.post")),
        }[combinator]()
        left = b.join(a, on, "left_semi")
    return left


def select_nodes(nodes: DataFrame, selector: str) -> DataFrame:
    """The rows of ``nodes`` that match, each once."""
    found = None
    for chain in parse_selector(selector).chains:
        part = _chained(nodes, chain, predicate)
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates(["page", "pre"])


def select_many(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """(key, selector, page, pre) of the rows that match each of several selectors, each once. All compounds are tried on a node
    once, before the one exchange by page, which moves numbers and conditions only."""
    key = nodes.columns[0]
    if key in ("selector", *_PLACE):
        raise ValueError(f"the key has the name of a result, rename it first: {key}")
    parsed = {name: parse_selector(s) for name, s in selectors.items()}
    compounds: list[Compound] = []
    for s in parsed.values():
        for chain in s.chains:
            compounds += [c for _, c in chain if c not in compounds]
    tried = nodes.select(F.col(f"`{key}`"), *_PLACE, *[predicate(c).alias(f"is{i}") for i, c in enumerate(compounds)])
    # Nodes that no compound selects take no part. Filters and pruning would make an exchange, and parse pages, for every use:
    # they don't pass a function over batches, so all uses share one exchange.
    tried = tried.where(" or ".join(f"is{i}" for i in range(len(compounds)))).repartition("page")
    tried = tried.mapInArrow(lambda batches: batches, tried.schema)
    out = None
    for name, s in parsed.items():
        for chain in s.chains:
            part = _chained(tried, chain, lambda c: F.col(f"is{compounds.index(c)}"))
            part = part.select(F.col(f"`{key}`"), F.lit(name).alias("selector"), "page", "pre")
            out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["selector", "page", "pre"])
