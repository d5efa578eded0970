"""Places in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are looked at for each range.
LOOKED_AT = 20


def range_bounds(keys: DataFrame, order: list[str], parts: int) -> list[tuple]:
    """At most ``parts`` - 1 rising key tuples that cut the rows into ranges of about one size: quantiles of a bounded sample, drawn by a hash of the keys."""
    looked = keys.select(*order).withColumn("_h", F.xxhash64(*order)).orderBy("_h").limit(parts * LOOKED_AT)
    sample = [tuple(r)[:-1] for r in looked.orderBy(*order).collect()]
    cuts = [sample[i] for i in range(LOOKED_AT, len(sample), LOOKED_AT)]
    return [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]


def range_of(bounds: list[tuple], order: list[str], df: DataFrame) -> Column:
    """The number of the range that a row's keys lie in: how many bounds are not above them."""
    kinds = {f.name: f.dataType for f in df.schema}
    if not bounds:
        return F.lit(0)
    keys = F.struct(*[F.col(c) for c in order])
    steps = F.array(*[F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, b, strict=True)]) for b in bounds])
    return F.size(F.filter(steps, lambda b: b <= keys))


def with_place(df: DataFrame, order: list[str], new: str = "place", parts: int | None = None) -> DataFrame:
    """Adds the place (from 1) of each row in the ascending order of ``order``, nulls first.

    Rows are dealt to ranges of the order and counted; a row's place is
    its rank in its range after the rows of all earlier ranges. Ranges are cut
    by whole key tuples, so many rows that share the first key are still
    dealt out; rows that are equal in all of ``order`` stay together and get
    their places in any order. Two shuffles of the rows' ranges; what reaches
    the driver is the bounds.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.withColumn("_range", range_of(range_bounds(df, order, parts), order, df))
    counts = held.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return held.withColumn("_rank", rank).join(F.broadcast(before), "_range").withColumn(new, (F.col("_before") + F.col("_rank")).cast("long")).drop("_range", "_rank", "_before")
