"""Vectors as binary rows of little-endian 32-bit floats, and back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def pack(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack(blobs: pd.Series) -> pd.Series:
    """Null for a null blob or one whose length is no multiple of four."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4"))
