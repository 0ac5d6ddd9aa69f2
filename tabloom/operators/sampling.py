"""Samples of an exact size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.plans.names import col
from tabloom.plans.ordered import order_of


def sample(df: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 0, shuffle: bool = False, order: str | Sequence[str] | None = None) -> DataFrame:
    """Exactly n rows, or the fraction of them rounded to the nearest (half to even), without replacement.

    The rows with the least hashes of seed and order are taken, so the same seed gives the
    same rows however the table is dealt out.  In the table's order, or shuffled.

    One job counts the rows of each of 65,536 ranges of hashes.  Rows of ranges below the
    edge are all in the sample; only those of the range at the edge are sorted for it.
    """
    if (n is None) == (fraction is None):
        raise ValueError("give n or a fraction")
    if n is not None and n < 0 or fraction is not None and not 0 <= fraction <= 1:
        raise ValueError("n is not negative; a fraction is from 0 to 1")
    order = order_of(df, order)
    places = [col(c) for c in order]
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in places]))
    drawn = df.withColumn("__draw", draw).withColumn("__range", F.left("__draw", F.lit(4)))
    counts = sorted((r["__range"], r["count"]) for r in drawn.select("__range").groupBy("__range").count().collect())
    left = round(fraction * sum(c for _, c in counts)) if n is None else n
    edge = None
    for edge, count in counts:
        if count > left:
            break
        left -= count
    else:
        edge = None  # the sample ends with a range, or is the whole table
    out = drawn
    if edge is not None:
        out = drawn.where(F.col("__range") < edge).unionByName(drawn.where(F.col("__range") == edge).orderBy("__draw", *places).limit(left))
    return out.orderBy(*(["__draw"] if shuffle else []), *places).drop("__draw", "__range")
