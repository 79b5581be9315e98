"""Where models plug in: codecs, speech recognition, diarization, separation and embeddings stay outside this library.

A model is loaded once for each worker and fed Arrow batches, behind a filter that has run before: a Python call under a
CASE WHEN would see every row, so rows to skip are taken out first."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame


def with_model(df: DataFrame, load: Callable[[], Any], apply: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str, needed: Column | None = None) -> DataFrame:
    """``apply(model, batch)`` over the rows where ``needed`` holds; one row may become many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield apply(model, batch)

    return (df if needed is None else df.where(needed)).mapInPandas(run, schema)
