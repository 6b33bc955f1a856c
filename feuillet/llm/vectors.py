"""What the two operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: an id, and a vector without null or non-finite components that isn't zero, of the most common length."""
    e = F.col("embedding")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    )
    size = good.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return good.where(F.size("embedding") == (size["size"] if size else 0))


def rows(column: pa.Array) -> np.ndarray:
    """A list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def packed(x: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(x, "<f8")]


def unpacked(column) -> np.ndarray:
    values = list(column)
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1)
