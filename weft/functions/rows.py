"""Row helpers that keep expensive expressions evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_where(df: DataFrame, cols: list[Column], keep: Callable[[Column], Column]) -> DataFrame:
    """``df.select(*cols).where(keep(row))`` with every column computed once per row.

    A plain filter on computed columns is pushed below the projection by the
    optimizer with the column expressions substituted into it, so costly text
    expressions (regular expressions over whole documents) run twice. Here the
    row is built once as a struct and a zero-or-one generator keeps or drops
    it; a filter cannot move below a generator.
    """
    row = F.struct(*cols)
    return df.select(F.explode(F.filter(F.array(row), keep)).alias("_row")).select("_row.*")
