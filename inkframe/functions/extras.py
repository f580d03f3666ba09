"""Table and aggregate functions to register in a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class TrueRuns:
    """Half-open runs of true values of an array."""

    def eval(self, flags: list[bool]):
        start = None
        for i, ok in enumerate([*(flags or []), False]):
            if ok and start is None:
                start = i
            elif not ok and start is not None:
                yield start, i
                start = None


def variation(v: pd.Series) -> float:
    """Population standard deviation by the mean; 0 for a mean of 0."""
    m = float(v.mean()) if len(v) else 0.0
    return float(v.std(ddof=0)) / m if m else 0.0


def register(spark: SparkSession) -> None:
    spark.udtf.register("true_runs", udtf(TrueRuns, returnType="start: int, end: int"))
    spark.udf.register("variation", F.pandas_udf(variation, "double"))
