"""Interfaces for feature extraction and model inference: a function per row whose failures become nulls, and a model loaded once per task."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def extract(df: DataFrame, fn: Callable[[dict[str, Any]], dict[str, Any] | None], schema: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, the fields of ``schema`` and ``error``: what ``fn`` gives for each row, a dict by column name.

    A row for which ``fn`` fails or gives None has null fields, and the failure's text in ``error``; the others go on. Rows keep
    their ordinals, so order is restored by sorting, whichever task ends first.
    """
    fields = T._parse_datatype_string(schema)
    out = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(f.name, f.dataType) for f in fields), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            results = []
            for row in b.to_dict("records"):
                try:
                    got, error = fn(row), None
                except Exception as e:  # a bad row must not stop the others
                    got, error = None, f"{type(e).__name__}: {e}"
                results.append([*(row[c] for c in keep), *((got or {}).get(f.name) for f in fields), error])
            yield pd.DataFrame(results, columns=out.names)

    return df.mapInPandas(run, out)


def model_udf(load: Callable[[], Any], apply: Callable[[Any, pd.Series], pd.Series], returns: str):
    """A vectorized column function whose model is loaded once per task, not once per batch."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield apply(model, b)

    return run


class Dependency:
    """An optional module: looked for once; ``require`` warns once when it is missing and gives None, so that callers fall back to neutral output."""

    def __init__(self, name: str, warn: Callable[[str], None] = print):
        self.name, self._warn, self._told = name, warn, False
        try:
            self.module = importlib.import_module(name)
        except ImportError:
            self.module = None

    def __bool__(self) -> bool:
        return self.module is not None

    def require(self) -> Any | None:
        if self.module is None and not self._told:
            self._told = True
            self._warn(f"{self.name} is not installed; its columns stay null")
        return self.module


def gated(df: DataFrame, dependency: Dependency, column: str, value: Callable[[Any], Any], returns: str) -> DataFrame:
    """``df`` with ``column`` computed by ``value(module)``, null throughout when the module is missing, and ``{column}_available``."""
    module = dependency.require()
    x = value(module) if module is not None else F.lit(None).cast(returns)
    return df.withColumns({column: x, f"{column}_available": F.lit(module is not None)})
