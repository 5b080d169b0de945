"""Contiguous global positions without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many keys one small window orders them; beyond, ranges of the key are ordered apart.
SMALL = 200_000


def _smaller(cuts: list, key: str) -> Column:
    """How many of cuts, ascending, are smaller than key: a search by halves, as every row asks."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    given = F.array(*[F.lit(c) for c in cuts])
    return F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(given, n + step - 1) < F.col(key), step).otherwise(F.lit(0)))


def offsets(counts: DataFrame, key: str, n: str, by: tuple[str, ...] = (), tie: str | None = None, ranges: int = 1000, small: int = SMALL, rows: int | None = None) -> DataFrame:
    """counts with offset, the sum of n over smaller (key, tie) of the same by. key is a number, unique with tie.

    Few rows are ordered in one window. Many are cut into ranges at approximate quantiles of key: sums of ranges make one row
    each, and inside a range a window does the rest. The result doesn't depend on where the cuts are.
    rows: a bound of counts' rows if one is known, which spares counting them.
    """
    order = [key, tie] if tie else [key]
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    if (counts.count() if rows is None else rows) <= small:
        return counts.withColumn("offset", before(Window.partitionBy(*by).orderBy(*order), n))
    cuts = sorted(set(counts.select(F.percentile_approx(key, [k / ranges for k in range(1, ranges)])).first()[0]))
    placed = counts.withColumn("_range", _smaller(cuts, key) if cuts else F.lit(0))
    sums = placed.groupBy(*by, "_range").agg(F.sum(n).alias("_sum"))
    sums = sums.select(*by, "_range", before(Window.partitionBy(*by).orderBy("_range"), "_sum").alias("_before"))
    inside = placed.withColumn("_inside", before(Window.partitionBy(*by, "_range").orderBy(*order), n))
    return inside.join(sums, [*by, "_range"]).withColumn("offset", (F.col("_inside") + F.col("_before")).cast("long")).select(*counts.columns, "offset")


def indexed(rows: DataFrame, key: str, out: str, tie: str | None = None, most: int | None = None) -> DataFrame:
    """rows, of which there are at most most if that is known, with a contiguous number from 0 in order of (key, tie)."""
    return offsets(rows.withColumn("_one", F.lit(1).cast("long")), key, "_one", tie=tie, rows=most).withColumnRenamed("offset", out).drop("_one")


def stream_positions(rows: DataFrame, key: str, items: str, out: str = "item", by: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """rows (by.., key, items array) as ordered streams: (by.., gpos, out), gpos contiguous from 0 in order of (key, tie).

    Only keys and sizes are ordered; items are exploded next to their offset, which is joined by key.
    """
    keys = [*by, key, *([tie] if tie else [])]
    bound = rows.select(*keys).count()  # reads no items
    placed = offsets(rows.select(*keys, F.size(items).cast("long").alias("_n")).where("_n > 0"), key, "_n", by, tie, rows=bound).select(*keys, "offset")
    return rows.join(placed, keys).select(*by, "offset", F.posexplode(items).alias("_p", out)).select(*by, (F.col("offset") + F.col("_p")).alias("gpos"), out)
