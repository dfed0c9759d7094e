"""Joins and reductions that keep a hot key out of any single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it owns at least this share of the rows, so at most HOT_KEYS keys are hot.
HOT_KEYS = 4096


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, weight: str, total: int | None = None) -> DataFrame:
    """Inner join of many ``rows`` with a ``lookup`` that holds each key once.

    ``weight`` is the lookup's column with the number of rows per key. Keys owning 1/HOT_KEYS of all
    rows or more are joined by broadcast (there can be no more than HOT_KEYS of them, whatever
    the input), the others by a shuffle in which no key is large. ``weight`` is not in the result.
    Null keys match nothing. Both inputs are read twice: pass cut or scanned frames.
    """
    if total is None:
        total = lookup.agg(F.sum(weight)).first()[0] or 0
    bar = max(2.0, total / HOT_KEYS)
    hot = lookup.where(F.col(weight) >= bar).drop(weight)
    cold = lookup.where(F.col(weight) < bar).drop(weight)
    rows = rows.where(F.col(key).isNotNull())
    by_broadcast = rows.join(F.broadcast(hot), key)
    by_shuffle = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return by_broadcast.unionByName(by_shuffle)


def salted_agg(df: DataFrame, keys: list[str], first: dict[str, Column], then: dict[str, Column], salts: int = 32) -> DataFrame:
    """Two-step aggregate for states that Spark cannot combine before the shuffle.

    ``first`` is computed per key and salt, ``then`` per key over the columns of ``first``.
    """
    part = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    part = part.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in first.items()])
    return part.groupBy(*keys).agg(*[c.alias(n) for n, c in then.items()])
