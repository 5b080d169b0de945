"""Points to the intervals that hold them, as an equi-join on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many intervals go to all tasks, and points stay where they are.
BROADCAST_INTERVALS = 50_000
#: Points of one bin beyond which they are dealt out, each share with the bin's intervals.
SHARE = 1_000_000


def bin_width(intervals: DataFrame, begin: str, end: str) -> int:
    """The mean length of intervals, rounded up: with bins of that width n intervals stand in at most 3 n bins, however unequal they are."""
    found = intervals.select((F.col(end) - F.col(begin)).alias("n")).where("n > 0").agg(F.avg("n")).first()[0]
    return max(1, int(-(-(found or 1) // 1)))


def band_join(points: DataFrame, intervals: DataFrame, at: str, begin: str, end: str, by: tuple[str, ...] = (), how: str = "inner", width: int | None = None, share: int | None = SHARE, few: int = BROADCAST_INTERVALS) -> DataFrame:
    """points with the columns of every interval of the same by with begin <= at < end; at, begin and end are whole numbers.

    No row is made for each place of an interval: one stands in the bins that it touches, a point in one, and bins meet by
    equality, so each pair is found once. Intervals may overlap, nest and repeat; empty, reversed or null ones hold nothing, and a
    point whose at or by is null lies in none. how "left" keeps points without an interval, with nulls. points and intervals share no columns but by.

    At most few intervals are broadcast in their bins, at most 3 few rows. Beyond that both sides are shuffled by bin, and bins of more
    than share points are dealt out by a hash of the point (share None leaves that to Spark's own splitting, and spares counting the points).
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no such join: {how}")
    clash = (set(points.columns) & set(intervals.columns)) - set(by)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    able = intervals.where(F.col(begin) < F.col(end))
    bounded = 3 * few if width else few  # the mean length bounds the bins; those of a given width are counted themselves
    width = width or bin_width(able, begin, end)
    number = lambda c: F.floor(c / F.lit(width)).cast("long")
    own = {c: f"_interval_{c}" for c in by}
    bins = able.select(*[F.col(c).alias(own.get(c, c)) for c in able.columns], F.explode(F.sequence(number(F.col(begin)), number(F.col(end) - 1))).alias("_bin"))
    few_enough = (bins if bounded > few else able).limit(bounded + 1).count() <= bounded
    placed = points.withColumn("_point_bin", number(F.col(at)))
    meet: Column = F.col("_point_bin") == F.col("_bin")
    for c in by:
        meet = meet & (F.col(c) == F.col(own[c]))
    if few_enough:
        bins = F.broadcast(bins)
    elif share is not None:
        # bins that hold many points: at most one for each share of the points
        hot = placed.groupBy(*by, "_point_bin").count().where(F.col("count") > share)
        hot = hot.select(*[F.col(c).alias(f"_hot_{c}") for c in by], F.col("_point_bin").alias("_hot_bin"), F.ceil(F.col("count") / share).cast("int").alias("_shares"))
        kept = hot.limit(few + 1).collect()
        side = F.broadcast(hot.sparkSession.createDataFrame(kept, hot.schema)) if len(kept) <= few else hot
        if kept:
            spread = lambda df, bin_, names: df.join(side, _all([F.col(bin_) == F.col("_hot_bin"), *[F.col(names.get(c, c)) == F.col(f"_hot_{c}") for c in by]]), "left").drop("_hot_bin", *[f"_hot_{c}" for c in by]).withColumn("_shares", F.coalesce("_shares", F.lit(1)))
            placed = spread(placed, "_point_bin", {}).withColumn("_point_share", F.pmod(F.xxhash64(*points.columns), F.col("_shares")).cast("int")).drop("_shares")
            bins = spread(bins, "_bin", own).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
            meet = meet & (F.col("_point_share") == F.col("_share"))
    meet = meet & (F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))
    return placed.join(bins, meet, how).select(*points.columns, *[c for c in intervals.columns if c not in by])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
