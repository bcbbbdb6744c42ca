"""The scalar functions as SQL functions of a session, so that queries in SQL can call them.

Functions over arrays use lambdas, which have no SQL text; they are for DataFrames only.

Each is registered with the expression that the column function builds, not as a
Python function: the optimizer sees through it as through any built-in one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text as T

#: Name -> (parameters with their types, type of the result, column function).
FUNCTIONS: dict[str, tuple[dict[str, str], str, Callable[..., Column]]] = {
    "token_estimate": ({"t": "STRING"}, "BIGINT", T.token_estimate),
    "token_calibrated": ({"raw": "BIGINT"}, "BIGINT", T.token_calibrated),
    "normalized_path": ({"p": "STRING"}, "STRING", T.normalized_path),
    "language_of": ({"p": "STRING"}, "STRING", T.language_of),
    "recency_weight": ({"age": "BIGINT"}, "DOUBLE", T.recency_weight),
    "is_test_symbol": ({"name": "STRING", "path": "STRING", "signature": "STRING", "docstring": "STRING"}, "BOOLEAN", T.is_test),
    "valid_revision": ({"t": "STRING"}, "BOOLEAN", T.valid_revision),
}


def register(spark: SparkSession) -> list[str]:
    """Registers all functions as temporary ones of the session; their names."""
    for name, (parameters, result, make) in FUNCTIONS.items():
        frame = spark.range(0).select(*[F.lit(None).cast(kind).alias(p) for p, kind in parameters.items()])
        plan = frame.select(make(*[F.col(p) for p in parameters]).alias("x"))._jdf.queryExecution().analyzed()
        body = plan.projectList().apply(0).child().sql()
        declared = ", ".join(f"{p} {kind}" for p, kind in parameters.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({declared}) RETURNS {result} RETURN CAST({body} AS {result})")
    return list(FUNCTIONS)
