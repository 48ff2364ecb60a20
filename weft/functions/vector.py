"""Vector expressions on ``array<float>`` columns (expression kernel).

Higher-order functions are evaluated per row by the JVM; they are the exact,
pure-SQL form used for re-ranking and for the oracle. Bulk kNN uses the
Arrow-batched matrix kernel in ``operators.vectors``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda s, v: s + v,
    )


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity; NULL when either vector has zero length."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def sq_euclidean(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0).cast("double"),
        lambda s, v: s + v,
    )
