"""Boundaries to models and image codecs, which are not part of this engine.

A plug-in is a DataFrame transform that adds the named columns.  Without one
the stage fails with a message that says what is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADDS = {
    "ocr": ("words",), "text_encoder": ("embedding",), "image_encoder": ("image_embedding",), "generate": ("response",),
    "choice_scores": ("choice_scores",), "safety": ("raw_verdict",), "decode": ("pixels",), "render": ("image_bytes",),
}
_FOUND: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(stage: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    if stage not in ADDS:
        raise ValueError(f"unknown stage: {stage}")
    _FOUND[stage] = transform


def apply(stage: str, df: DataFrame) -> DataFrame:
    if stage not in _FOUND:
        raise RuntimeError(f"no plug-in for stage {stage}; it has to add {', '.join(ADDS.get(stage, ()))}")
    out = _FOUND[stage](df)
    lacking = [c for c in ADDS[stage] if c not in out.columns]
    if lacking:
        raise RuntimeError(f"the plug-in for stage {stage} did not add {lacking}")
    return out


def batched(stage: str, make: Callable[[], Callable], inputs: list[str], output: str, kind: str, batch: int = 32):
    """A plug-in for models that work on batches: encoders, generators, classifiers, readers of text in images.

    ``make`` loads the model once in each worker process and returns a function of lists, one for each input
    column, to a list of results; it gets at most ``batch`` rows at a time, and rows of several Arrow batches
    never mix.  Register the result for its stage.
    """
    if stage not in ADDS:
        raise ValueError(f"unknown stage: {stage}")

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = make()
        for columns in batches:
            lists, out = [c.tolist() for c in columns], []
            for k in range(0, len(lists[0]), batch):
                found = list(model(*(x[k : k + batch] for x in lists)))
                if len(found) != len(lists[0][k : k + batch]):
                    raise ValueError(f"the model of stage {stage} returned {len(found)} results for a batch")
                out += found
            yield pd.Series(out, dtype=object)

    if len(inputs) == 1:  # pandas hands a single column over without a tuple
        def single(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from run((c,) for c in batches)

        udf = F.pandas_udf(single, kind)
    else:
        udf = F.pandas_udf(run, kind)
    return lambda df: df.withColumn(output, udf(*[F.col(c) for c in inputs]))


_BACKENDS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_backend(kind: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """A model backend by the name that configurations use."""
    _BACKENDS[kind] = transform


def backend(kind: str) -> Callable[[DataFrame], DataFrame]:
    """The backend of a configuration; an unknown one raises."""
    if kind not in _BACKENDS:
        raise ValueError(f"unknown backend: {kind}; registered: {sorted(_BACKENDS)}")
    return _BACKENDS[kind]
