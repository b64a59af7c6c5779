"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaqual.llm.common import ship

ship(__name__)


def is_finite(vector: Column) -> Column:
    """Not null and without null, NaN or infinite components."""
    ok = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is above infinity
    return vector.isNotNull() & F.coalesce(ok, F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def parts_needed(rows: DataFrame, *key: str, most: int, name: str) -> DataFrame:
    """Per key the number of parts that hold ``most`` rows on average."""
    return rows.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))
