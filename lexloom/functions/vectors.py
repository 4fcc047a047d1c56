"""Expressions over ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(left: Column, right: Column) -> Column:
    """Sum of products in double precision; the cosine when both sides are unit vectors."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, product: total + product,
    )


def l2_normalise(vector: Column) -> Column:
    """The unit vector as ``array<float>``; NULL for a zero vector and for one with
    elements that are NaN or infinite.

    The norm sits in a one-element array so that it is evaluated once per row
    and not once per element.
    """
    norm = F.sqrt(inner_product(vector, vector))
    scaled = F.transform(
        F.array(norm),
        lambda length: F.when(
            (length > 0) & (length < float("inf")), F.transform(vector, lambda x: (x.cast("double") / length).cast("float"))
        ),
    )
    return F.get(scaled, F.lit(0))
