"""Plug-in models as batched vector columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def batched_embed(df: DataFrame, text_col: str, load_model: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]], batch_size: int = 8, vector_col: str = "chunk_vector") -> DataFrame:
    """df with vector_col from a model that load_model makes once a task and that maps a list of texts to vectors.

    A batch that fails, or gives another number of vectors, is tried text by text; a text that fails gets null,
    as null text does.
    """
    fields = [f for f in df.schema.fields if f.name != vector_col]
    columns = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{vector_col}` array<float>"

    def vectors(model, texts: list[str]) -> list:
        try:
            got = list(model(texts))
            if len(got) == len(texts):
                return got
        except Exception:  # noqa: BLE001  whatever a model raises
            if len(texts) == 1:
                return [None]
        return [v for t in texts for v in (vectors(model, [t]) if len(texts) > 1 else [None])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for pdf in batches:
            out: list = [None] * len(pdf)
            where = [i for i, t in enumerate(pdf[text_col]) if t is not None]
            for k in range(0, len(where), batch_size):
                part = where[k : k + batch_size]
                for i, v in zip(part, vectors(model, [pdf[text_col].iloc[i] for i in part]), strict=True):
                    out[i] = None if v is None else [float(x) for x in v]
            yield pdf[columns].assign(**{vector_col: out})

    return df.select(*columns).mapInPandas(run, schema)
