"""Arrow-backed column functions that can be declared before a session exists."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def arrow(returns: str):
    """Declare a function over pandas series as a column function that returns a DDL type."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return F.pandas_udf(f, returns)(*columns)

        return call

    return wrap
