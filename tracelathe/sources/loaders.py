"""User functions that load records into columns of their own, as table functions in SQL.

`register_loader(spark, "load", fn)` makes `SELECT ... FROM lines, LATERAL load(value, '{"size": "int64[pyarrow]"}')` possible: fn takes a record
(a dict) and gives a dict, or a list of dicts for records that yield several rows, or nothing for none. The columns follow from the map of types given in the query, so
one function serves queries that load different columns. Values that don't fit their type are null.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Names of column types in the maps of types that users write.
KINDS = {"int64": LongType(), "int32": LongType(), "uint64": LongType(), "float64": DoubleType(), "double": DoubleType(), "string": StringType(), "bool": BooleanType()}
CASTS = {LongType(): int, DoubleType(): float, StringType(): str, BooleanType(): bool}


def columns_of(types: str) -> StructType:
    found = StructType()
    for name, kind in json.loads(types).items():
        base = kind.split("[")[0].strip().lower()
        if base not in KINDS:
            raise ValueError(f"unknown type {kind} of column {name}")
        found = found.add(name, KINDS[base])
    return found


def _fitted(value, cast):
    try:
        return None if value is None else cast(value)
    except (TypeError, ValueError):
        return None


def loader(fn: Callable[[dict], dict | list[dict] | None]):
    """The table function (value, types) of a user's function."""

    class Load:
        @staticmethod
        def analyze(value: AnalyzeArgument, types: AnalyzeArgument) -> AnalyzeResult:
            if not types.isConstantExpression or types.value is None:
                raise ValueError("the map of types must be a constant")
            return AnalyzeResult(schema=columns_of(types.value))

        def eval(self, value: str, types: str):
            try:
                record = json.loads((value or "").strip().rstrip(","))
            except ValueError:
                return
            if not isinstance(record, dict):
                return
            found = fn(record)
            wanted = [(f.name, CASTS[f.dataType]) for f in columns_of(types).fields]
            for row in found if isinstance(found, list) else [found] if found else []:
                yield tuple(_fitted(row.get(name), cast) for name, cast in wanted)

    return udtf(Load)


def register_loader(spark: SparkSession, name: str, fn: Callable[[dict], dict | list[dict] | None]) -> None:
    spark.udtf.register(name, loader(fn))
