"""Column functions on envelopes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from .. import value as V
from ..codecs import json_text


def _mapped(f, kind: str = "string"):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else f(V.from_envelope(x)))

    return F.pandas_udf(run, kind)


def display(column):
    """Plain text of an envelope: () for null, hexadecimal bytes, [a, b] and {k: v}."""
    return _mapped(V.display)(column)


def to_json(column, style: str = "compact"):
    """JSON text of an envelope in one of the three styles."""
    return _mapped(json_text.STYLE[style])(column)


def kind(column):
    """The tag of an envelope, by Spark's own functions."""
    return F.regexp_extract(column, r'^\["([a-z0-9]+)"', 1)
