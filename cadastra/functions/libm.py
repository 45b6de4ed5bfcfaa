"""Sines, cosines and squares as the C library gives them, which is what SQL engines in C take.

The JVM's differ from them in the last place for one angle in a few hundred, so that a value that lies exactly on a
limit falls on its other side. Nulls stay null; infinite angles have no sine (NaN).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _mapped(f, values: pa.Array, reach: float, beyond: np.ufunc) -> pa.Array:
    """f of each value up to reach, beyond which the C function's wrapper raises."""
    x = values.to_numpy(zero_copy_only=False).astype(float)
    inside = np.abs(x) <= reach
    with np.errstate(invalid="ignore", over="ignore"):
        out = beyond(x)
    out[inside] = np.fromiter(map(f, x[inside].tolist()), float)
    return pa.array(out, mask=values.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(DoubleType())
def sine(a: pa.Array) -> pa.Array:
    return _mapped(math.sin, a, np.finfo(float).max, np.sin)


@F.arrow_udf(DoubleType())
def cosine(a: pa.Array) -> pa.Array:
    return _mapped(math.cos, a, np.finfo(float).max, np.cos)


@F.arrow_udf(DoubleType())
def square(x: pa.Array) -> pa.Array:
    """The C power to 2, which isn't always x times x rounded."""
    return _mapped(lambda v: math.pow(v, 2.0), x, 1e150, np.square)
