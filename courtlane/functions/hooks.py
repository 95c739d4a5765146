"""Extension points: a model handed in as a function of NumPy batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def predicted(features: DataFrame, column: str, model: Callable[[np.ndarray], np.ndarray], key: str, out: str) -> DataFrame:
    """``key`` and the model's integer result per row; the model gets Arrow batches of the array column as a matrix. Null rows give null."""
    kind = features.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            known = part[column].notna()
            result = pd.array([None] * len(part), dtype="Int64")
            if known.any():
                result[known.to_numpy()] = np.asarray(model(np.stack(part.loc[known, column].to_numpy()))).astype("int64")
            yield pd.DataFrame({key: part[key], out: result})

    return features.select(key, column).mapInPandas(run, f"`{key}` {kind}, `{out}` long")
