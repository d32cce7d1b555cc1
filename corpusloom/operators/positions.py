"""Dense positions and running counts without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut

BLOCK = 1 << 16


def running_totals(df: DataFrame, major: str, minor: str, amounts: dict[str, Column], *, block: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """Add running totals of ``amounts`` under their names, in the order (major, minor).

    Rows are totalled per block of ``minor``; totals of blocks are accumulated
    within each ``major`` and those of majors among themselves, and the window
    over rows stays within one block.  No task sees more than a block of rows,
    however many rows one ``major`` has.  ``minor`` must not be negative.
    ``df`` is evaluated twice, so what is dear to make is cut before.
    """
    names = list(amounts)
    rows = df.withColumn("__block", F.floor(F.col(minor) / block)).withColumns({f"__a_{n}": a.cast("bigint") for n, a in amounts.items()})
    # one row a block of 65,536 rows
    totals = cut(rows.groupBy(major, "__block").agg(*(F.sum(f"__a_{n}").alias(f"__t_{n}") for n in names)))
    before = lambda w, n: F.coalesce(F.sum(f"__t_{n}").over(w), F.lit(0))
    earlier = Window.partitionBy(major).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.select(major, "__block", *(before(earlier, n).alias(f"__b_{n}") for n in names))
    majors = totals.groupBy(major).agg(*(F.sum(f"__t_{n}").alias(f"__t_{n}") for n in names))
    ordered = Window.orderBy(major).rowsBetween(Window.unboundedPreceding, -1)
    majors = majors.select(major, *(before(ordered, n).alias(f"__m_{n}") for n in names))
    within = Window.partitionBy(major, "__block").orderBy(minor).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = rows.withColumns({f"__o_{n}": F.coalesce(F.sum(f"__a_{n}").over(within), F.lit(0)) for n in names})
    out = own.join(blocks, [major, "__block"]).join(majors, major)
    out = out.withColumns({n: F.col(f"__o_{n}") + F.col(f"__b_{n}") + F.col(f"__m_{n}") for n in names})
    return out.drop("__block", *(f"__{x}_{n}" for n in names for x in "aobm"))


def dense_index(df: DataFrame, major: str, minor: str, name: str, *, block: int = BLOCK) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... in the order (major, minor)."""
    return running_totals(df, major, minor, {name: F.lit(1)}, block=block, inclusive=False)
