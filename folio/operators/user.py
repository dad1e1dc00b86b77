"""Functions of the user's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RECOGNIZED = "id long, text string, scores array<double>, error string"


def with_transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """fn over the whole table; None: df."""
    return df if fn is None else df.transform(fn)


#: Engines of this worker process, by the key they were made for; they live as long as Spark keeps the worker.
_engines: dict[tuple, object] = {}


def engine_of(factory: Callable[[], object], key: tuple) -> object:
    """The worker's engine for a key, made once: tasks that the worker takes later find it there."""
    if key not in _engines:
        _engines[key] = factory()
    return _engines[key]


def recognize(df: DataFrame, factory: Callable[[], object], column: str = "data", language: str = "en", gpu: bool = False, together: int = 16) -> DataFrame:
    """(id, text, scores, error) by an engine's recognize(value) -> {text, scores}. A failure is a row with null text and its message; null values are such failures.

    Each worker process makes one engine for a factory's name, language and gpu. An engine that has recognize_batch(values) gets up to `together`
    values at a time; a batch that fails is tried again one by one, so that only the values at fault are lost.
    """
    key = (f"{factory.__module__}.{factory.__qualname__}", language, gpu)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, ids, values = [], b["id"].tolist(), b[column].tolist()
            for at in range(0, len(ids), together):
                engine, part = engine_of(factory, key), values[at : at + together]
                rows += [(i, *r) for i, r in zip(ids[at : at + together], _recognized(engine, part), strict=True)]
            yield pd.DataFrame(rows, columns=["id", "text", "scores", "error"])

    return df.select("id", column).mapInPandas(run, RECOGNIZED)


def _recognized(engine, values: list) -> list[tuple]:
    if hasattr(engine, "recognize_batch") and all(v is not None for v in values):
        try:
            return [(r["text"], list(r["scores"]), None) for r in engine.recognize_batch(values)]
        except Exception:  # noqa: BLE001  one by one below
            pass
    out = []
    for v in values:
        try:
            if v is None:
                raise ValueError("no data")
            r = engine.recognize(v)
            out.append((r["text"], list(r["scores"]), None))
        except Exception as e:  # noqa: BLE001  any failure of the user's engine is a result
            out.append((None, None, f"{type(e).__name__}: {e}"))
    return out
