"""Embedding with a model the user supplies."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.vectors import l2_normalise
from lexloom.session import spread_small_input

Encoder = Callable[[np.ndarray], np.ndarray]


def embed_texts(
    df: DataFrame,
    text: str,
    load_model: Callable[[], Encoder],
    batch_size: int = 64,
    vector: str = "embedding",
) -> DataFrame:
    """Add a unit ``array<float>`` per text.

    ``load_model`` runs once per Python worker and returns a function from a
    batch of texts to a matrix with one row per text. Texts stay on the
    executors; a vector of zeros becomes NULL.
    """

    def make_predict() -> Encoder:
        encode = load_model()
        return lambda texts: np.asarray(encode(texts), dtype=np.float32)

    encode = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    encoded = spread_small_input(df).withColumn(vector, encode(F.coalesce(F.col(text), F.lit(""))))
    return encoded.withColumn(vector, l2_normalise(F.col(vector)))
