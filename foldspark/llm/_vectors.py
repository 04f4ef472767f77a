"""Integer vectors from columns of floating-point ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Squared lengths stay below this, so a hundred times any inner product fits 64 bits, and so does a squared distance.
LONGEST = 2.0**55


def integer_vectors(vectors: DataFrame, scale: int, *extra: str) -> DataFrame:
    """(id, extra columns, v array<long>) of rows that take part: floor(scale * x) of each component x as double.

    Vectors null, with a null inside or with a component that is not finite take no part. A finite vector whose squared
    length would be ``LONGEST`` or more is an error: products of such don't fit 64 bits.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), *extra, F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    reach = F.aggregate("e", F.lit(0.0), lambda a, x: a + (F.abs(x * scale) + 1) * (F.abs(x * scale) + 1))
    v = F.when(reach < LONGEST, F.transform("e", lambda x: F.floor(x * scale).cast("long"))).otherwise(F.raise_error(F.lit("a vector is too long for 64-bit products")).cast("array<long>"))
    return rows.filter(F.col("e").isNotNull() & finite).select("id", *extra, v.alias("v"))
