"""Arrow UDFs that are made on first use, as type strings can be read only with a running session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    def make(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return make
