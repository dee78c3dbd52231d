"""Running sums over a global order, with no task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.lineage import cut_lineage


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds, by name, the sum of each column over all rows before this one (0 without any), within equal ``by`` columns.

    Rows are dealt to ranges of the order, whose bounds Spark samples from the data, so no distribution of values makes a
    hot range; each range is summed by itself, after the totals of the ranges before it. Rows that are equal in the order
    come in any order.
    """
    dealt = df.repartitionByRange(*map(F.col, by), *order).withColumns({"__part": F.spark_partition_id(), **{f"__{n}": c for n, c in sums.items()}})
    dealt = cut_lineage(dealt)
    totals = dealt.groupBy(*by, "__part").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ahead = totals.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__range"), *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__ahead_{n}") for n in sums])
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({f"__in_{n}": F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)) for n in sums})
    same = [F.col("__part") == F.col("__range"), *[F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]]
    return own.join(ahead, same).select(*df.columns, *[(F.col(f"__ahead_{n}") + F.col(f"__in_{n}")).alias(n) for n in sums])
