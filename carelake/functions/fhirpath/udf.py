"""Expressions over a column of documents: a compiled column where there is one, else the interpreter over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...errors import EngineError
from .compile import Unsupported, compiled
from ...registry import default
from .interp import Context, evaluate, plain, text
from .values import Node, named


def interpreted(expression: str, content: Column) -> Column:
    """array<string> of the values' texts; null where the expression fails on a document."""

    @F.pandas_udf("array<string>")
    def run(docs: pd.Series) -> pd.Series:
        registry = default()

        def one(doc):
            if doc is None:
                return None
            try:
                return [str(v.data) if isinstance(v, Node) else text(v) for v in map(plain, evaluate(expression, doc, Context(registry, resolve=lambda ref: named(ref, registry))))]
            except (EngineError, ValueError, ArithmeticError):
                return None

        return docs.map(one)

    return run(content)


def path(df: DataFrame, expression: str, type_: str, name: str, content: str = "content") -> DataFrame:
    """df with the expression's values as array<string>."""
    try:
        column = F.transform(compiled(expression, type_, F.col(content)), lambda x: x.cast("string"))
    except Unsupported:
        column = interpreted(expression, F.col(content))
    return df.withColumn(name, column)
