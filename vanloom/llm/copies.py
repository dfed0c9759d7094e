"""Problem 4: duplicates hidden by formatting differences.

Two records are copies when their two texts, taken in either order, have the same letters, digits and
other non-punctuation characters in the same order. The canonical texts are hashed to 128 bits;
counts are combined before the shuffle, and a second, independent hash finds collisions.

Null, empty and punctuation-only texts are all the empty text; records with both texts empty are copies of each other.
A record repeated under the same id counts once per row. Splits, labels and extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanloom.operators.skew import lookup_join
from vanloom.session import cut


def canonical(text: Column) -> Column:
    """Lower case without white space, punctuation, invisible format characters; accents, digits and symbols that carry meaning stay."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\p{Z}\p{P}\p{C}\s`´^~|<>=+]+", "")


def hashed(records: DataFrame, key: str, fields: tuple[str, str]) -> DataFrame:
    """``record_id, h`` (128 bits, order of fields ignored) and ``probe`` (64 other bits)."""
    a, b = canonical(F.col(fields[0])), canonical(F.col(fields[1]))
    rows = records.select(F.col(key).alias("record_id"), a.alias("a"), b.alias("b"))
    rows = rows.select("record_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return rows.select("record_id", F.unhex(F.md5(F.concat_ws("\x1f", "lo", "hi"))).alias("h"), F.xxhash64("lo", "hi").alias("probe"))


def groups(h: DataFrame) -> DataFrame:
    """``h, probe, first_id, copies``: one row per distinct record. Colliding hashes differ in ``probe`` and stay apart."""
    return h.groupBy("h", "probe").agg(F.min("record_id").alias("first_id"), F.count("*").alias("copies"))


def collisions(h: DataFrame) -> DataFrame:
    """128-bit hashes shared by different records; empty unless the hash failed."""
    return h.groupBy("h").agg(F.min("probe").alias("p"), F.max("probe").alias("q")).where("p <> q").select("h")


def collapse(records: DataFrame, key: str = "article_id", fields: tuple[str, str] = ("Summarize", "Content")) -> DataFrame:
    """``first_id, copies``: one row per set of equal records."""
    return groups(hashed(records, key, fields)).select("first_id", "copies")


def copies(records: DataFrame, key: str = "article_id", fields: tuple[str, str] = ("Summarize", "Content")) -> DataFrame:
    """``first_id, copy_id`` of every record but the first of its set; texts are read and hashed once."""
    h = cut(hashed(records, key, fields))
    many = cut(groups(h).where("copies > 1").select(F.struct("h", "probe").alias("k"), "first_id", "copies"))
    total = h.count()
    rows = h.select(F.struct("h", "probe").alias("k"), F.col("record_id").alias("copy_id"))
    return lookup_join(rows, many, "k", "copies", total).where("copy_id <> first_id").select("first_id", "copy_id")
