"""Vector columns: the base64 codec of stored embeddings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def valid_vector(encoded: Column, dims: Column | int) -> Column:
    """Whether a base64 string holds so many 32-bit floats."""
    dims = F.lit(dims) if isinstance(dims, int) else dims
    return F.coalesce(F.octet_length(F.unbase64(encoded)) == 4 * dims, F.lit(False))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _decode(data: pd.Series) -> pd.Series:
    import numpy as np

    return data.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def _encode(vectors: pd.Series) -> pd.Series:
    import numpy as np

    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def decode_vector(encoded: Column) -> Column:
    """Little-endian 32-bit floats from base64; null for a length that is no multiple of four."""
    return _decode(F.unbase64(encoded))


def encode_vector(vector: Column) -> Column:
    return F.base64(_encode(vector))


def pending_embeddings(docs: DataFrame, stored: DataFrame, model: str, version: str) -> DataFrame:
    """Rows of (id, content_hash, ...) whose hash of content, model and version isn't stored."""
    key = F.sha2(F.concat_ws("|", "content_hash", F.lit(model), F.lit(version)), 256)
    return docs.withColumn("embedding_key", key).join(stored.select("id", "embedding_key"), ["id", "embedding_key"], "left_anti")
