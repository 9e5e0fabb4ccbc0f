"""Column helpers shared by the plans."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def revenue() -> Column:
    """Discounted price of a lineitem row."""
    return F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))
