"""Row order on an unordered engine: ordinals, running values and row numbers without one task for all rows.

Rows are dealt into buckets that follow the order; each bucket is sorted once and worked
on by itself, and what it needs from those before it (a count, the last filled values)
is a row per bucket.  The number of buckets follows the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.plans.names import col

ORDINAL = "_ord"
BUCKET, WITHIN = "__bucket", "__within"
#: Rows that a bucket aims at, buckets at most (beyond 80 million rows they grow, and their sorts spill), rows sampled for each to find where it begins.
ROWS, BUCKETS, SAMPLED = 20_000, 4_096, 64


def ordinal(df: DataFrame, name: str = ORDINAL) -> DataFrame:
    """df with a number that follows the order of the scan below; to be called right on a scan."""
    return df.withColumn(name, F.monotonically_increasing_id())


def order_of(df: DataFrame, order: str | Sequence[str] | None) -> list[str]:
    """The columns that state the rows' order: those named, else the ordinal."""
    names = [order] if isinstance(order, str) else list(order or [])
    if not names and ORDINAL in df.columns:
        names = [ORDINAL]
    if not names:
        raise ValueError(f"this needs an order: name its columns, or add {ORDINAL}")
    return names


def bucketed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with the number of the bucket that each row's place in the order falls in.

    A job counts the rows and, if they fill more than one bucket, another samples at most
    about a quarter of a million places for the bounds.  A place is found by two short
    looks, among groups of bounds and in one of them.  Rows of equal order share a
    bucket, so the order should be total.  A table that has buckets keeps them, through
    the functions below too.
    """
    if BUCKET in df.columns:
        return df
    rows = df.count()
    buckets = min(BUCKETS, math.ceil(rows / ROWS))
    if buckets <= 1:
        return df.withColumn(BUCKET, F.lit(0))
    key = F.struct(*[col(c) for c in order])
    places = df.select(key.alias("k"))
    sample = places.sample(min(1.0, buckets * SAMPLED / rows), seed=42).orderBy("k").collect()
    step = max(1, len(sample) // buckets)
    bounds = list(dict.fromkeys(r["k"] for r in sample[step::step]))
    if not bounds:
        return df.withColumn(BUCKET, F.lit(0))
    wide = math.isqrt(len(bounds) - 1) + 1
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in places.schema["k"].dataType])
    schema = T.StructType([T.StructField("b", T.ArrayType(T.ArrayType(kind)))])
    held = df.sparkSession.createDataFrame([([bounds[i : i + wide] for i in range(0, len(bounds), wide)],)], schema).scalar()
    out = df.withColumn("__bounds", held)
    out = out.withColumn(BUCKET, F.size(F.filter("__bounds", lambda b: F.get(b, F.lit(0)) <= key)))
    inside = F.size(F.filter(F.get("__bounds", F.col(BUCKET) - 1), lambda b: b <= key))
    return out.withColumn(BUCKET, F.when(F.col(BUCKET) == 0, 0).otherwise((F.col(BUCKET) - 1) * wide + inside)).drop("__bounds")


def _without_buckets(out: DataFrame, df: DataFrame) -> DataFrame:
    return out if BUCKET in df.columns else out.drop(BUCKET)


def _ways(order: Sequence[str], backwards: bool) -> tuple:
    """The window of a bucket's rows, that of the buckets, and the aggregate of the value at a bucket's end and at its beginning; with ``backwards`` the other way round."""
    inner = Window.partitionBy(BUCKET).orderBy(*[col(c).desc() if backwards else col(c).asc() for c in order])
    outer = Window.orderBy(F.desc(BUCKET) if backwards else F.asc(BUCKET))  # a row for each bucket
    return inner, outer, *((F.min_by, F.max_by) if backwards else (F.max_by, F.min_by))


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with the row's number in the order, from 0."""
    dealt = bucketed(df, order)
    inner, outer, _, _ = _ways(order, False)
    counts = dealt.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(BUCKET, F.coalesce(F.sum("__n").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rows = dealt.withColumn(name, F.row_number().over(inner)).join(F.broadcast(before), BUCKET)
    return _without_buckets(rows.withColumn(name, col(name) + F.col("__before") - 1).drop("__before"), df)


def carried(df: DataFrame, order: Sequence[str], values: Mapping[str, Column], backwards: bool = False) -> DataFrame:
    """df with, for each name, the last value that is not null at or before each row; at or after it with ``backwards``.

    One pass for the buckets' ends and one sort, whatever the number of names.
    """
    inner, outer, at_end, _ = _ways(order, backwards)
    place = F.struct(*[col(c) for c in order])
    rows = bucketed(df, order).withColumns(dict(values))
    ends = rows.groupBy(BUCKET).agg(*[at_end(col(n), F.when(col(n).isNotNull(), place)).alias(n) for n in values])
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(BUCKET, *[F.last(col(n), True).over(earlier).alias(f"{n}__before") for n in values])
    rows = rows.withColumns({n: F.last(col(n), True).over(inner.rowsBetween(Window.unboundedPreceding, 0)) for n in values})
    out = rows.join(F.broadcast(before), BUCKET).withColumns({n: F.coalesce(col(n), col(f"{n}__before")) for n in values})
    return _without_buckets(out.drop(*[f"{n}__before" for n in values]), df)


def carried_within(df: DataFrame, order: Sequence[str], within: Column, same: Callable[[Column], Column], values: Mapping[str, Column], backwards: bool = False) -> DataFrame:
    """As :func:`carried`, but a value goes no further than the rows in a row that are alike; and WITHIN, ``within`` carried itself.

    ``same`` gives, from WITHIN, what rows that are alike agree in (null where WITHIN is).
    A bucket's runs are numbered from 1; its rows before the first filled ``within`` are
    run 0, which goes on from the bucket before, as run 1 does if it is alike.  Two
    sorts: one for the buckets' ends, one for the rows.
    """
    inner, outer, at_end, at_start = _ways(order, backwards)
    so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*[col(c) for c in order])
    rows = bucketed(df, order).withColumns({WITHIN: within, **values})
    rows = rows.withColumn(WITHIN, F.last(WITHIN, True).over(so_far)).withColumn("__same", same(F.col(WITHIN)))
    changed = F.col("__same").isNotNull() & ~F.col("__same").eqNullSafe(F.lag("__same").over(inner))
    rows = rows.withColumn("__new", changed.cast("long")).withColumn("__run", F.sum("__new").over(so_far))
    rows = rows.withColumns({n: F.last(F.when(col(n).isNotNull(), F.struct(col(n).alias("v"), F.col("__run").alias("r"))), True).over(so_far) for n in values})

    state = F.struct(WITHIN, "__same", "__run", *[col(n) for n in values])
    ends = rows.groupBy(BUCKET).agg(at_end(state, place).alias("e"), at_start("__same", F.when(F.col("__same").isNotNull(), place)).alias("__first"))
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"__w": F.last(f"e.{WITHIN}", True).over(earlier), "__s": F.last("e.__same", True).over(earlier)})
    ends = ends.withColumn("__joins", F.coalesce(F.col("__first") == F.col("__s"), F.lit(False)))  # run 1 goes on
    open_ = (F.col("e.__run") == 0) | (F.col("e.__run") == 1) & F.col("__joins")  # the bucket's last run began before it
    ends = ends.withColumn("__open", open_)
    ends = ends.withColumns({n: F.when(F.col("__open") | (F.col("e")[n]["r"] == F.col("e.__run")), F.col("e")[n]["v"]) for n in values})
    ends = ends.withColumn("__part", F.sum((~F.col("__open")).cast("long")).over(outer.rowsBetween(Window.unboundedPreceding, 0)))
    part = Window.partitionBy("__part").orderBy(F.desc(BUCKET) if backwards else F.asc(BUCKET)).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumns({n: F.last(col(n), True).over(part) for n in values})
    before = ends.select(BUCKET, "__w", "__joins", *[F.lag(col(n)).over(outer).alias(f"{n}__before") for n in values])

    out = rows.join(F.broadcast(before), BUCKET)
    goes_on = (F.col("__run") == 0) | (F.col("__run") == 1) & F.col("__joins")
    found = {n: F.when(goes_on, F.coalesce(col(n)["v"], col(f"{n}__before"))).when(col(n)["r"] == F.col("__run"), col(n)["v"]) for n in values}
    out = out.withColumns({**found, WITHIN: F.coalesce(F.col(WITHIN), F.col("__w"))})
    return _without_buckets(out.drop("__same", "__new", "__run", "__w", "__joins", *[f"{n}__before" for n in values]), df)
