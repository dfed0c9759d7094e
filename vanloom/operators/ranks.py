"""Global and group ranks without a window over a whole table or group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanloom.session import cut

#: Rows of a range that one task sorts.
RANGE = 1_000_000
#: Values that the driver sorts at the end of ``nth``.
LAST = 10_000


def global_rank(rows: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds the 1-based rank of each row in the total order of ``order``.

    Rows are range-partitioned by the order, sorted and written once; a row's rank is its place in its range, which needs no second shuffle, and
    the sizes of the ranges before it. The number of ranges follows the number of rows.
    """
    parts = parts or max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE))
    ranged = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("_p", F.shiftright("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    before, sizes = 0, []
    for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():
        sizes.append((r["_p"], before))
        before += r.n
    starts = rows.sparkSession.createDataFrame(sizes, "_p int, _before bigint")
    return ranged.join(F.broadcast(starts), "_p").withColumn(name, F.col("_at") + F.col("_before") + 1).drop("_p", "_at", "_before")


def group_rank(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Adds the 1-based rank of each row within its group; a group may be most of the table."""
    ranked = global_rank(rows, [group, *order], name)
    first = ranked.groupBy(F.col(group).alias("_group")).agg(F.min(name).alias("_first"))
    return ranked.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_group", "_first")


def nth(rows: DataFrame, draw: Column, k: int) -> tuple[str, int] | None:
    """The k-th smallest (from 0) hexadecimal hash of the rows and how many are smaller; None if there are fewer rows.

    Counts per prefix, 4096 at a time, narrow the place down until the driver sorts LAST values at most; nothing is sorted as a whole.
    """
    values, prefix, smaller = rows.select(draw.alias("d")), "", 0
    while True:
        here = values.where(F.col("d").startswith(prefix)) if prefix else values
        depth = len(prefix) + 3
        upto = smaller
        for r in sorted(here.groupBy(F.substring("d", 1, depth).alias("p")).agg(F.count("*").alias("n")).collect(), key=lambda r: r.p):
            if upto + r.n > k:
                break
            upto += r.n
        else:
            return None
        prefix, smaller = r.p, upto
        if r.n <= LAST or depth >= 30:
            last = here.where(F.col("d").startswith(prefix)).groupBy("d").agg(F.count("*").alias("n"))
            for v in sorted(last.collect(), key=lambda v: v.d):
                if smaller + v.n > k:
                    return v.d, smaller
                smaller += v.n


def lowest(rows: DataFrame, draw: Column, n: int) -> DataFrame:
    """The n rows of the lowest hashes; of rows with the hash at the edge, as many as are missing."""
    if n <= 0:
        return rows.where("false")
    edge = nth(rows, draw, n - 1)
    if edge is None:
        return rows
    return rows.where(draw < edge[0]).unionByName(rows.where(draw == edge[0]).limit(n - edge[1]))
