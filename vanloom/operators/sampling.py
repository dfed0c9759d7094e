"""Partition-independent sampling: the order of draws is a hash of seed and id, so any cluster draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanloom.operators.ranks import lowest, nth


def draw(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def at_most(rows: DataFrame, group: str, k: int, key: str, seed: int = 42) -> DataFrame:
    """At most k rows per group, and their rank in ``rk``; Spark prunes each group to k before the shuffle."""
    w = Window.partitionBy(group).orderBy(draw(key, seed), key)
    return rows.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def stratified(rows: DataFrame, stratum: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows: n // strata of each stratum as far as it has them, then at random from the rest. The number of strata is small."""
    strata = rows.select(stratum).distinct().count() or 1
    got = at_most(rows, stratum, n // strata, key, seed).drop("rk")
    short = n - got.count()
    rest = rows.join(got.select(key), key, "left_anti")
    return got.unionByName(lowest(rest, draw(key, seed + 1), short))


def enriched(rows: DataFrame, hit: Column, doc: str, stratum: str, n: int, key: str, share: float = 0.5, seed: int = 42) -> DataFrame:
    """A share of keyword rows, the remainder from documents not chosen; a shortfall of keyword rows is made up there."""
    kw = stratified(rows.where(hit), stratum, int(n * share), key, seed)
    rest = rows.join(kw.select(doc).distinct(), doc, "left_anti")
    return kw.unionByName(stratified(rest, stratum, n - kw.count(), key, seed))


def split_sizes(n: int, val: float, test: float) -> tuple[int, int, int]:
    """(train, val, test) sizes; val and test get at least one row and shrink until train has one. n must be 3 or more."""
    if n < 3:
        raise ValueError("a split into three needs at least 3 rows")
    v, t = max(1, round(n * val)), max(1, round(n * test))
    while v + t >= n:
        if v >= t and v > 1:
            v -= 1
        else:
            t -= 1
    return n - v - t, v, t


def ratio_split(rows: DataFrame, key: str, val: float = 0.1, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` by ranges of the hashed order. The two cut points are found by counts of hash prefixes, not by a sort."""
    train, v, _ = split_sizes(rows.count(), val, test)
    ends = [nth(rows, draw(key, seed), k - 1)[0] for k in (train, train + v)]
    d = draw(key, seed)
    return rows.withColumn("split", F.when(d <= ends[0], "train").when(d <= ends[1], "val").otherwise("test"))


def held_out(rows: DataFrame, stratum: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """min(rows, n // strata) rows of each stratum, without topping up."""
    strata = rows.select(stratum).distinct().count() or 1
    return at_most(rows, stratum, n // strata, key, seed).drop("rk")
