"""Whole-table validators: each gives the rows or gates that fail."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failing_rows(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """``keys, rule``: one row per broken rule; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def gates(df: DataFrame, metrics: Sequence[Column], rules: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """``by, gate, passed``: predicates over one aggregate per group."""
    g = df.groupBy(*by).agg(*metrics)
    each = F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed")) for n, ok in rules.items()])
    return g.select(*by, F.explode(each).alias("_g")).select(*by, "_g.*")


def varying_fields(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, field, n``: fields with more than one value within a key, null being a value."""
    counts = [F.count_distinct(F.struct(F.col(f))).alias(f) for f in fields]
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])
    return df.groupBy(key).agg(*counts).select(key, F.explode(each).alias("_f")).select(key, "_f.*").filter("n > 1")


def missing_members(df: DataFrame, key: str, member: str, required: Sequence[str]) -> DataFrame:
    """``key, missing``: required members that a key lacks."""
    have = df.groupBy(key).agg(F.collect_set(F.when(F.col(member).isin(*required), F.col(member))).alias("_h"))
    return have.select(key, F.explode(F.array_except(F.array(*[F.lit(r) for r in required]), "_h")).alias("missing"))


def unreferenced(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a partner in ``right``."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def json_schema_errors(df: DataFrame, payload: str, keys: Sequence[str], required: Mapping[str, str]) -> DataFrame:
    """``keys, field, error``: required top-level fields of JSON objects that are missing or of another type.

    ``required`` maps a field to ``string``, ``number``, ``boolean``, ``array`` or
    ``object``.  Lines that are no JSON object have the error ``no object``.
    """
    v = F.try_parse_json(payload)
    kind = F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)
    d = df.select(*keys, v.alias("_v"), kind.alias("_k"))
    prefix = {"string": "STRING", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}
    errors = []
    for f, t in required.items():
        got = F.try_variant_get("_v", f"$.{f}", "variant")
        ok = F.schema_of_variant(got).rlike(f"^({prefix[t]})")
        errors.append(F.when(got.isNull(), F.struct(F.lit(f).alias("field"), F.lit("missing").alias("error"))).when(~ok, F.struct(F.lit(f).alias("field"), F.lit("type").alias("error"))))
    none = F.array(F.struct(F.lit("").alias("field"), F.lit("no object").alias("error")))
    each = F.when(F.coalesce(F.col("_k") == "OBJECT", F.lit(False)), F.array_compact(F.array(*errors))).otherwise(none)
    return d.select(*keys, F.explode(each).alias("_e")).select(*keys, "_e.*")


def path_problem(path: Column, roots: Sequence[str]) -> Column:
    """What is wrong with a source path: missing, absolute, home, generated or of an unknown root; null if nothing."""
    known = path.rlike("^(" + "|".join(roots) + ")/")
    return F.when(path.isNull(), "missing").when(path.startswith("/"), "absolute").when(path.startswith("~"), "home").when(path.startswith("results/"), "generated").when(~known, "unknown root")
