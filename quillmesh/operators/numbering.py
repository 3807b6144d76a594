"""Row numbers within groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order column that are numbered apart; their bounds, from approximate quantiles, travel in the plan.
RANGES = 64


def number_within(rows: DataFrame, by: str, order: str, name: str, ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within each ``by`` in ascending ``order`` (a number).

    Rows are dealt by group and range of ``order``; a range's numbers begin after the
    counts of the ranges before it, which are as many rows as groups times ranges. Nulls come first; of equal
    ones any order may come out, as with a row number.
    """
    place = F.col(order).cast("double")
    found = rows.select(place.alias("o")).where("o is not null and not isnan(o)").approxQuantile("o", [k / ranges for k in range(1, ranges)], 0.005)
    bounds = sorted(set(found))
    # The number of bounds below the value: ranges are half open, so equal values share one.
    part = F.lit(0)
    if bounds:
        part = F.coalesce(F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b < place)), F.lit(0))
    parted = rows.withColumn("_part", F.when(place.isNull(), F.lit(-1)).otherwise(part))
    counts = parted.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = parted.withColumn("_row", F.row_number().over(Window.partitionBy(by, "_part").orderBy(order)))
    joined = numbered.join(starts, numbered[by].eqNullSafe(starts["_by"]) & (numbered["_part"] == starts["_p"]))
    return joined.withColumn(name, (F.col("_start") + F.col("_row")).cast("int")).drop("_part", "_row", "_by", "_p", "_start")


def before(rows: DataFrame, order: list[str], values: dict[str, tuple[str, str]], ranges: int = RANGES) -> DataFrame:
    """``rows`` with, for each name of ``values``, the ``sum`` or ``max`` of a column over all rows before, by ``order`` (the first of them a number; nulls first); null before the first row.

    Rows are dealt by ranges of the first order column, and a range begins with what the ranges before it add up to, so no task sees all rows.
    """
    place = F.col(order[0]).cast("double")
    found = rows.select(place.alias("o")).where("o is not null and not isnan(o)").approxQuantile("o", [k / ranges for k in range(1, ranges)], 0.005)
    bounds = sorted(set(found))
    part = F.coalesce(F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b < place)), F.lit(0)) if bounds else F.lit(0)
    parted = rows.withColumn("_part", F.when(place.isNull(), F.lit(-1)).otherwise(part))
    of = {"sum": F.sum, "max": F.max}
    totals = parted.groupBy("_part").agg(*(of[how](c).alias(f"_{n}") for n, (how, c) in values.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = totals.select(F.col("_part").alias("_p"), *(of[how](f"_{n}").over(earlier).alias(f"_{n}") for n, (how, c) in values.items()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = parted.withColumns({f"_in_{n}": of[how](c).over(inside) for n, (how, c) in values.items()})
    joined = here.join(F.broadcast(starts), F.col("_part") == F.col("_p"))  # at most ranges + 1 rows
    both = lambda n, how: F.greatest(f"_in_{n}", f"_{n}") if how == "max" else F.when(F.col(f"_in_{n}").isNull() & F.col(f"_{n}").isNull(), None).otherwise(F.coalesce(f"_in_{n}", F.lit(0)) + F.coalesce(f"_{n}", F.lit(0)))
    return joined.withColumns({n: both(n, how) for n, (how, c) in values.items()}).drop("_part", "_p", *(f"_{n}" for n in values), *(f"_in_{n}" for n in values))
