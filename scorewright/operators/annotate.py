"""A hook for user-supplied per-text annotators (the reference's batched NLP pipe).

``annotate_batches`` runs a Python function over Arrow batches of texts with
``mapInPandas``: rows stay in their task, batches are vectorised pandas
Series, nothing passes through the driver.  Each Arrow batch is cut into chunks of
``batch_size`` texts (100, as the reference's pipeline used).  Built-in expressions
(``scorewright.functions.text``) remain the fast path; this hook is for
annotators that only exist in Python.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def count_letters(texts: pd.Series) -> pd.Series:
    """Demonstration annotator: how many letters each text has, which no single built-in tells."""
    return texts.map(lambda t: None if t is None else [str(sum(map(str.isalpha, t)))])


def annotate_batches(df: DataFrame, fn: Callable[[pd.Series], pd.Series],
                     key: str = "id", text: str = "text", out: str = "tokens",
                     out_type: str = "array<string>", batch_size: int = 100) -> DataFrame:
    """Apply ``fn`` to texts in batches of ``batch_size`` inside each task (Arrow batches are re-chunked)."""
    schema = f"{key} bigint, {out} {out_type}"

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size]
                yield pd.DataFrame({key: chunk[key].to_numpy(), out: fn(chunk[text]).to_numpy()})

    return df.select(key, text).mapInPandas(run, schema)
