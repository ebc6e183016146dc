"""Running values over groups that may be very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512


def carry_forward(df: DataFrame, group: str, order: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Adds each value's last non-null reading in earlier rows of the group.

    ``order`` is an integer. Groups are cut into blocks of consecutive order
    values: a window inside each block, plus the reading carried in from earlier
    blocks, which a second window finds among one row per block. No task holds a
    whole group's rows."""
    names = list(values)
    d = df.withColumns({**{f"_v_{n}": c for n, c in values.items()}, "_blk": F.floor(F.col(order) / block)})
    before = Window.partitionBy(group, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = d.withColumns({f"_in_{n}": F.last(f"_v_{n}", ignorenulls=True).over(before) for n in names})
    ends = d.groupBy(group, "_blk").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_e_{n}") for n in names])
    earlier = Window.partitionBy(group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(group, "_blk", *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in names])
    out = inside.join(carried, [group, "_blk"], "left")
    return out.select(*df.columns, *[F.coalesce(f"_in_{n}", f"_c_{n}").alias(n) for n in names])
