"""Filters, gates, groups and writing labels back to cells."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules as stored: a name, AND or OR, and conditions on columns.
GATES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("logic", T.StringType()), T.StructField("conditions", T.ArrayType(T.StructType([T.StructField("column", T.StringType()), T.StructField("op", T.StringType()), T.StructField("threshold", T.DoubleType())])))]))
OPERATORS = {">": "gt", ">=": "ge", "<": "lt", "<=": "le", "==": "eq", "!=": "ne"}


def filter_sources(df: DataFrame, files: Sequence[str], column: str = "source_file") -> DataFrame:
    return df.filter(F.col(column).isin(list(files)))


def filter_roi(df: DataFrame, value: str, columns: Sequence[str]) -> DataFrame:
    """Rows of which any of ``columns`` (id or name) is ``value``."""
    return df.filter(F.lit(value).isin(*[F.col(c).cast("string") for c in columns]))


def exclude_channels(pixels: DataFrame, channels: Sequence[str]) -> DataFrame:
    return pixels.filter(~F.col("channel").isin(list(channels)))


def _condition(df: DataFrame, condition: dict) -> Column | None:
    name, op = condition["column"], condition["op"]
    if name not in df.columns or op not in OPERATORS:
        return None
    value, limit = F.col(f"`{name}`").cast("double"), F.lit(float(condition["threshold"]))
    test = {"gt": value > limit, "ge": value >= limit, "lt": value < limit, "le": value <= limit, "eq": value == limit, "ne": value != limit}[OPERATORS[op]]
    return F.coalesce(test, F.lit(False))


def apply_gates(df: DataFrame, rules: Sequence[dict], column: str = "manual_phenotype") -> DataFrame:
    """Names each row by the first rule that holds.

    A value that is already there and not empty stays; conditions on unknown
    columns or operators are left out; null tests are false; a rule without
    usable conditions never holds; rows without a rule get an empty string.
    """
    chain = F.when(F.coalesce(F.col(column), F.lit("")) != "", F.col(column)) if column in df.columns else F.when(F.lit(False), F.lit(""))
    for rule in rules:
        tests = [t for t in (_condition(df, c) for c in rule["conditions"]) if t is not None]
        if tests:
            both = (lambda a, b: a | b) if rule.get("logic", "AND").upper() == "OR" else (lambda a, b: a & b)
            chain = chain.when(reduce(both, tests), F.lit(rule["name"]))
    return df.withColumn(column, chain.otherwise(F.lit("")))


def gate_groups(df: DataFrame, column: str = "manual_phenotype", to: str = "gate_group") -> DataFrame:
    """One named gate: its name or ``Other``; several: the name or ``Unassigned``."""
    named = F.nullif(F.col(column), F.lit(""))
    n = df.agg(F.count_distinct(named).alias("_gates"))
    rest = F.when(F.col("_gates") == 1, "Other").otherwise("Unassigned")
    return df.crossJoin(F.broadcast(n)).withColumn(to, F.coalesce(named, rest)).drop("_gates")


def assign_groups(df: DataFrame, groups: DataFrame, key: Sequence[str] = ("source_well", "acquisition_id"), to: str = "batch_group") -> DataFrame:
    """Adds each row's batch group; ``groups``: ``key, batch_group``, one row for each key.

    The row's key is the first of ``key`` that is a column. Rows without a group
    get ``__unassigned__``. Fewer than two groups in use are an error.
    """
    own = next((k for k in key if k in df.columns), None)
    if own is None:
        raise ValueError(f"none of {list(key)} is a column")
    table = groups.select(F.col("key").alias("_key"), F.col("batch_group").alias("_group"))
    out = df.join(table, F.col(own) == F.col("_key"), "left").withColumn(to, F.coalesce("_group", F.lit("__unassigned__"))).drop("_key", "_group")
    if out.select(to).distinct().limit(2).count() < 2:
        raise ValueError("at least two groups are needed")
    return out


def dangling_groups(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Keys of ``groups`` that no row has."""
    return groups.join(df.select(F.col(key).alias("key")), "key", "left_anti")


def write_back(cells: DataFrame, labels: DataFrame, key: Sequence[str] = ("roi_id", "cell_id"), column: str = "cluster", default=0) -> DataFrame:
    """``cells`` with ``labels``' column by key; rows without a label get ``default``."""
    own = labels.select(*key, F.col(column).alias("_label"))
    return cells.drop(column).join(own, list(key), "left").withColumn(column, F.coalesce("_label", F.lit(default))).drop("_label")
