"""Positions in a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import staged

#: Up to so many rows one task ranks faster than two passes over a staged table.
SMALL = 200_000


def global_rank(df: DataFrame, order: Sequence[Column], name: str, n_rows: int | None = None) -> DataFrame:
    """Adds the 1-based position of each row in ``order``, which must be total.

    Above ``SMALL`` rows it is range-partitioned: each partition is ranked by
    itself and shifted by the sizes of those before, so no task sees all rows.
    """
    n_rows = df.count() if n_rows is None else n_rows
    if n_rows <= SMALL:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    part = staged(df.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()), "rank")
    sizes = part.groupBy("__pid").agg(F.count("*").alias("__n"))  # one row a partition
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__pid").orderBy(*order))
    return part.join(F.broadcast(shift), "__pid").withColumn(name, local + F.col("__before")).drop("__pid", "__before")
