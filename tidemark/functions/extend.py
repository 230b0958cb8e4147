"""User functions and transform hooks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


class FunctionRegistry:
    """Named functions with declared argument types, usable from SQL and DataFrames.

    A column function works on pandas Series in Arrow batches. A table function
    is a class with ``eval``, as for ``udtf``. A later definition of a name
    replaces the earlier one.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.arguments: dict[str, StructType] = {}
        self._columns: dict[str, Callable] = {}

    def _declare(self, name: str, arguments: StructType | str) -> None:
        if not name.isidentifier():
            raise ValueError(f"{name!r} cannot be used as a function name")
        self.arguments[name] = StructType.fromDDL(arguments) if isinstance(arguments, str) else arguments

    def register(self, name: str, arguments: StructType | str, returns: DataType | str, fn: Callable[..., pd.Series]) -> None:
        self._declare(name, arguments)
        self._columns[name] = self.spark.udf.register(name, F.pandas_udf(fn, returns))

    def register_table(self, name: str, arguments: StructType | str, returns: StructType | str, handler: type) -> None:
        self._declare(name, arguments)
        self.spark.udtf.register(name, F.udtf(handler, returnType=returns))

    def call(self, df: DataFrame, name: str, output: str) -> DataFrame:
        """Apply a column function to the columns named like its arguments, cast to their types."""
        declared = self.arguments[name].fields
        missing = [f.name for f in declared if f.name not in df.columns and not f.nullable]
        if missing:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        columns = [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType) for f in declared
        ]
        return df.withColumn(output, self._columns[name](*columns))


class Hooks:
    """Ordered DataFrame transforms by hook name; each sees the result of the one before."""

    def __init__(self):
        self._hooks: dict[str, list[Callable[[DataFrame], DataFrame]]] = {}

    def on(self, name: str, transform: Callable[[DataFrame], DataFrame]) -> None:
        self._hooks.setdefault(name, []).append(transform)

    def apply(self, name: str, df: DataFrame) -> DataFrame:
        for transform in self._hooks.get(name, []):
            df = df.transform(transform)
        return df
