"""SQL text for Spark and for DuckDB from one template: a query is a function of a dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Spark:
    """Spark SQL over the Parquet tables of a folder."""

    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir

    def t(self, table: str) -> str:
        return f"parquet.`{self.sf_dir}/{table}.parquet`"

    rx = staticmethod(lambda x, pattern, to: f"regexp_replace({x}, '{_escaped(pattern)}', '{to}')")
    matches = staticmethod(lambda x, pattern: f"({x} RLIKE '{_escaped(pattern)}')")
    extract = staticmethod(lambda x, pattern, group: f"regexp_extract({x}, '{_escaped(pattern)}', {group})")
    all_of = staticmethod(lambda x, pattern: f"regexp_extract_all({x}, '{_escaped(pattern)}', 0)")
    split = staticmethod(lambda x, pattern: f"split({x}, '{_escaped(pattern)}')")
    explode = staticmethod(lambda x: f"explode({x})")
    us = staticmethod(lambda x: f"unix_micros(CAST({x} AS TIMESTAMP))")
    percentile = staticmethod(lambda x, p: f"percentile({x}, {p})")
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    size = staticmethod(lambda x: f"CAST(size({x}) AS BIGINT)")
    joined = staticmethod(lambda x, sep=" ": f"array_join(array_sort(collect_list({x})), '{sep}')")
    listed = staticmethod(lambda x, sep=" ": f"array_join({x}, '{sep}')")
    keep_if = staticmethod(lambda x, v, cond: f"filter({x}, {v} -> {cond})")
    each = staticmethod(lambda x, v, value: f"transform({x}, {v} -> {value})")
    distinct = staticmethod(lambda x: f"array_sort(array_distinct({x}))")
    both = staticmethod(lambda a, b: f"array_intersect({a}, {b})")
    has = staticmethod(lambda x, v: f"array_contains({x}, {v})")
    json = staticmethod(lambda x, key: f"get_json_object({x}, '$.{key}')")
    at = staticmethod(lambda x, i: f"get({x}, CAST({i} - 1 AS INT))")
    range = staticmethod(lambda a, b: f"sequence(CAST({a} AS BIGINT), {b})")
    dot = staticmethod(lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)")
    days = staticmethod(lambda a, b: f"datediff(CAST({a} AS DATE), CAST({b} AS DATE))")
    array = staticmethod(lambda *x: f"array({', '.join(x)})")
    # Half away from zero of the binary product, as DuckDB has it; Spark's round() takes the decimal digits that are printed.
    round = staticmethod(lambda x, n: f"(CASE WHEN abs(({x}) * 1e{n}) < 4503599627370496e0 THEN signum(({x}) * 1e{n}) * (floor(abs(({x}) * 1e{n})) + CASE WHEN abs(({x}) * 1e{n}) - floor(abs(({x}) * 1e{n})) >= 0.5e0 THEN 1 ELSE 0 END) / 1e{n} ELSE {x} END)")


class Duck:
    """DuckDB over views with the tables' names."""

    t = staticmethod(lambda table: table)
    rx = staticmethod(lambda x, pattern, to: f"regexp_replace({x}, '{pattern}', '{to.replace('$', chr(92))}', 'g')")
    matches = staticmethod(lambda x, pattern: f"regexp_matches({x}, '{pattern}')")
    extract = staticmethod(lambda x, pattern, group: f"regexp_extract({x}, '{pattern}', {group})")
    all_of = staticmethod(lambda x, pattern: f"regexp_extract_all({x}, '{pattern}')")
    split = staticmethod(lambda x, pattern: f"regexp_split_to_array({x}, '{pattern}')")
    explode = staticmethod(lambda x: f"unnest({x})")
    us = staticmethod(lambda x: f"epoch_us({x})")
    percentile = staticmethod(lambda x, p: f"quantile_cont({x}, {p})")
    sha = staticmethod(lambda x: f"sha256({x})")
    size = staticmethod(lambda x: f"CAST(len({x}) AS BIGINT)")
    joined = staticmethod(lambda x, sep=" ": f"array_to_string(list_sort(list({x})), '{sep}')")
    listed = staticmethod(lambda x, sep=" ": f"array_to_string({x}, '{sep}')")
    keep_if = staticmethod(lambda x, v, cond: f"list_filter({x}, lambda {v}: {cond})")
    each = staticmethod(lambda x, v, value: f"list_transform({x}, lambda {v}: {value})")
    distinct = staticmethod(lambda x: f"list_sort(list_distinct({x}))")
    both = staticmethod(lambda a, b: f"list_intersect({a}, {b})")
    has = staticmethod(lambda x, v: f"list_contains({x}, {v})")
    json = staticmethod(lambda x, key: f"json_extract_string({x}, '$.{key}')")
    at = staticmethod(lambda x, i: f"list_extract({x}, {i})")
    range = staticmethod(lambda a, b: f"range({a}, {b} + 1)")
    dot = staticmethod(lambda a, b: f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))")
    days = staticmethod(lambda a, b: f"date_diff('day', CAST({b} AS DATE), CAST({a} AS DATE))")
    array = staticmethod(lambda *x: f"[{', '.join(x)}]")
    round = staticmethod(lambda x, n: f"round({x}, {n})")


def _escaped(pattern: str) -> str:
    """Spark's string literals read a backslash as an escape."""
    return pattern.replace("\\", "\\\\")


Template = Callable[[object], str]


def queries(templates: dict[str, Template]) -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Spark queries and DuckDB SQL of templates by name."""

    def of(template: Template) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: spark.sql(template(Spark(sf_dir)))

    return {n: of(f) for n, f in templates.items()}, {n: f(Duck) for n, f in templates.items()}
