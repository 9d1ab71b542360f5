"""The engine's own figures: extraction, parsing, built-ins as Columns and in Python, selectors both ways, compiling.

Prints a table in Markdown. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` as for ``bench.py``.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from webloom.functions.builtins import BuiltinError, apply_builtin
from webloom.functions.columns import builtin
from webloom.html.tree import parse
from webloom.operators import dom
from webloom.plans import portfolio
from webloom.plans.cases import DEFECTS
from webloom.plans.compiler import compile_text

CALLS = {
    "trim": {}, "normalize-whitespace": {}, "lowercase": {}, "uppercase": {}, "replace": {"old": "th", "new": "TH"}, "regex-replace": {"pattern": "([a-z]+)\\s(the|und)\\b", "replacement": "$2-$1"},
    "regex-capture": {"pattern": "licensed under ([^.]+)", "group": 1, "flags": "i"}, "substring": {"start": -10, "end": -3}, "split": {"separator": ". ", "limit": 3}, "prepend": {"value": "<"}, "append": {"value": ">"},
    "parse-int": {"as": "i64"}, "parse-float": {"as": "f64"}, "parse-bool": {"true": "yes", "false": "no"}, "empty-to-null": {}, "coalesce": {"value": "none"}, "url-query": {"name": "page"}, "url-path": {}, "path-segment": {"index": -1},
    "url-resolve": {"base": "https://e.example/a/b"}, "assert-matches": {"pattern": "[0-4]$"}, "to-string": {},
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "1m", "spark.sql.files.openCostInBytes": "64k", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out = lambda df: df.write.format("noop").mode("overwrite").save()

    def timed(f) -> float:
        start = time.perf_counter()
        f()
        return time.perf_counter() - start

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = [r["html"] for r in pages.select("html").collect()]
    size = sum(len(h.encode()) for h in html) / 1e6
    print("| metric | value | config |\n| --- | --- | --- |")
    for name in ("page_title", "nav_links"):
        cold, warm = (timed(lambda: out(portfolio.QUERIES[name](spark, sf_dir))) for _ in range(2))
        print(f"| extraction, {name}, pages/s | {len(html) / cold:.0f} cold, {len(html) / warm:.0f} warm | {len(html)} pages, {cpus} cores |")
    few = html[:500]
    print(f"| HTML parse, MB/s | {sum(len(h.encode()) for h in few) / 1e6 / timed(lambda: [parse(h) for h in few]):.2f} | one thread, {size:.1f} MB in all |")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    texts = [r["text"] for r in docs.limit(1000).collect()]
    # Enough rows for the job's own time not to count.
    docs = docs.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(8)))).select("text").repartition(int(cpus)).cache()
    rows = docs.count()
    for name, named in CALLS.items():
        value, failed = builtin(name, F.col("text"), **{("as_" if k == "as" else k): v for k, v in named.items()})
        out(docs.limit(10).select(value, failed))
        column = rows / timed(lambda: out(docs.select(value.alias("v"), failed.alias("f"))))

        def python() -> None:
            for t in texts:
                try:
                    apply_builtin(name, t, named)
                except BuiltinError:
                    pass

        print(f"| {name}, rows/s | {column:,.0f} as a Column, {len(texts) / timed(python):,.0f} in Python | {rows} texts on {cpus} cores; one thread |")
    selectors = {s: s for s in portfolio._COUNTED}
    out(dom.page_matches(pages.limit(10), selectors))
    here = timed(lambda: out(dom.page_matches(pages, selectors)))
    there = timed(lambda: out(portfolio.QUERIES["dom_relational_selectors"](spark, sf_dir)))
    print(f"| five selectors, s | {here:.1f} where the page lies, {there:.1f} over a table of nodes | {len(html)} pages, {cpus} shuffle partitions |")
    text = DEFECTS[0][1]
    print(f"| compile, ms | {timed(lambda: [compile_text(text) for _ in range(200)]) * 5:.2f} | a program of one field, driver |")


if __name__ == "__main__":
    main()
