"""How sides of joins are dealt."""

from __future__ import annotations

from pyspark.sql import DataFrame


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is dealt by key, as it grows with the cells.

    Spark would judge it by the size of the compressed files behind it, and put
    millions of small rows on the driver to broadcast them.
    """
    return df.hint("merge")
