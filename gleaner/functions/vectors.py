"""Vector arithmetic as Columns (for single rows) and as numpy helpers (for Arrow batches).

All arithmetic is in double, whatever the element type of the array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Similarities and distances that are compared are compared at this many decimals. Sums of
# products differ in the last bits with the order of summation; rounding makes results
# independent of how rows were batched.
COMPARE_DECIMALS = 9
COMPARE_STEP = 0.5 * 10.0**-COMPARE_DECIMALS


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _double(c: Column | str) -> Column:
    return _column(c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product."""
    return F.aggregate(
        F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column | str) -> Column:
    """``v`` over its norm; null when the norm is zero."""
    length = norm(v)
    return F.when(length > 0, F.transform(_double(v), lambda x: x / length))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null when either side is a zero vector."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance."""
    return F.sqrt(
        F.aggregate(
            F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)),
            F.lit(0.0),
            lambda s, x: s + x,
        )
    )


def is_zero_vector(v: Column | str) -> Column:
    """True for a vector without direction: null, empty or all zeros. Stops at the first
    non-zero entry."""
    return ~F.coalesce(F.exists(_column(v), lambda x: x != 0), F.lit(False))


def content_hash(v: Column | str) -> Column:
    """A cryptographic digest of the vector's entries: equal digests mean equal vectors."""
    return F.sha2(_column(v).cast("string"), 256)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as a matrix that shares its memory where possible."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    rows = len(column)
    values = column.flatten()
    if rows == 0:
        return np.empty((0, 0))
    if column.null_count or values.null_count or len(values) % rows:
        raise ValueError("vectors must be complete and of one length")
    return values.to_numpy(zero_copy_only=False).reshape(rows, -1)


def unit_rows(block: np.ndarray) -> np.ndarray:
    """Rows scaled to norm 1, in double. Zero rows stay zero."""
    wide = block.astype(np.float64)
    lengths = np.sqrt(np.einsum("ij,ij->i", wide, wide))
    lengths[lengths == 0] = 1.0
    wide /= lengths[:, None]
    return wide
