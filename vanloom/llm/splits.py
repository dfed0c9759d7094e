"""Problem 1: splits that keep related records together.

Rows that share an id, directly or through other rows, form a component. A persisted table maps
every id ever seen to its component and split; an update contracts the old components together with the
ids of the new rows, lets old components keep their split, fills the deficits of the splits with
new components, and quarantines components in which a merge brought two splits together.

Nulls, empty ids and placeholders relate nothing: a row without any usable id is a component of its
own, numbered by its row. Repeated rows count as often as they occur. Empty tables give empty
results. Extra columns of the input are not read, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanloom.operators.graph import components
from vanloom.operators.skew import lookup_join
from vanloom.session import cut

#: Components with at least this share of all rows are placed one by one; there are at most 1/share.
LARGE_SHARE = 1e-4
PROPORTIONS = {"train": 0.7, "val": 0.1, "test": 0.2}


def id_key(raw: Column, kind: str) -> Column:
    """One spelling of an id: ``kind:split:number``, or null for ids that name nothing.

    Case, surrounding space, the separator and leading zeros do not matter; full-width digits and
    letters are read as ordinary ones.
    """
    narrow = F.translate(raw, "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)))
    text = F.lower(F.regexp_replace(narrow, r"[\s\p{Z}\p{Cf}_\-\.:/#‐-―]+", ""))
    letter = "a?" if kind == "ann" else ""
    pattern = rf"^(train|valid(?:ation)?|val|dev|test){letter}0*([0-9]+)$"
    split = F.regexp_extract(text, pattern, 1)
    split = F.when(split.startswith("val") | (split == "dev"), "val").otherwise(split)
    return F.when(text.rlike(pattern), F.concat_ws(":", F.lit(kind), split, F.regexp_extract(text, pattern, 2)))


@dataclass
class Related:
    """rows: row_id, split, key, other; keys: key, group_id, n_rows, n_splits; no rows for null ids."""

    rows: DataFrame
    keys: DataFrame


def relate(rows: DataFrame, row_id: str = "row_id", split: str = "split", before: DataFrame | None = None) -> Related:
    """Components of the rows of ``rows`` and of the key table ``before`` (key, component)."""
    named = rows.select(F.col(row_id).alias("row_id"), F.col(split).alias("split"), id_key(F.col("doc_id"), "doc").alias("doc"), id_key(F.col("ann_id"), "ann").alias("ann"))
    named = cut(named.select("row_id", "split", F.coalesce("doc", "ann").alias("key"), F.coalesce("ann", "doc").alias("other")).where("key is not null"))
    # Pre-aggregation: a key with a third of all rows is one row from here on.
    pairs = cut(named.groupBy("key", "other").agg(F.min("row_id").alias("first"), F.count("*").alias("n"), *[F.max(F.col("split") == s).alias(s) for s in PROPORTIONS]))
    links = pairs.select(F.col("key").alias("a"), F.col("other").alias("b"))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node"))
    if before is not None:
        old = before.select(F.col("key").alias("a"), F.concat(F.lit("old:"), F.col("component").cast("string")).alias("b"))
        links, nodes = links.unionByName(old), nodes.unionByName(old.select(F.explode(F.array("a", "b")).alias("node")))
    label = components(nodes, links)
    at = pairs.join(label, pairs["key"] == label["node"]).groupBy("root").agg(F.min("first").alias("group_id"), F.sum("n").alias("n_rows"), *[F.max(s).alias(s) for s in PROPORTIONS])
    at = at.select("root", "group_id", "n_rows", sum(F.coalesce(F.col(s).cast("int"), F.lit(0)) for s in PROPORTIONS).alias("n_splits"))
    per_key = pairs.groupBy("key").agg(F.sum("n").alias("key_rows"))
    keys = cut(label.join(at, "root", "left").join(per_key, label["node"] == per_key["key"], "left").select(F.col("node").alias("key"), "root", "group_id", "n_rows", "n_splits", F.coalesce("key_rows", F.lit(0)).alias("key_rows")))
    return Related(named, keys)


def split_leaks(rows: DataFrame) -> DataFrame:
    """``(row_id, group_id)`` of rows whose component lies in more than one present split."""
    found = relate(rows)
    at = found.keys.where("n_splits > 1").select("key", "group_id", "key_rows")
    return lookup_join(found.rows.select("row_id", "key"), at, "key", "key_rows").select("row_id", "group_id")


def _choose(units: DataFrame, have: dict[str, float], total: float, want: dict[str, float]) -> DataFrame:
    """Adds ``split`` to new components ``(group_id, n_rows)`` so that the splits' deficits are filled.

    Large components, at most 1/LARGE_SHARE of them, go one by one to the split with the largest deficit
    (driver, bounded). The rest are spread by a hash of the component in proportion to what is then
    missing; being small, their sum keeps to the proportions at any scale.
    """
    bar = max(1.0, total * LARGE_SHARE)
    need = {s: w * total - have.get(s, 0.0) for s, w in want.items()}
    large = sorted(units.where(F.col("n_rows") > bar).select("group_id", "n_rows").collect(), key=lambda r: (-r.n_rows, r.group_id))
    placed = []
    for r in large:
        s = max(need, key=lambda k: (need[k], k))
        need[s] -= r.n_rows
        placed.append((r.group_id, s))
    spark = units.sparkSession
    of_large = spark.createDataFrame(placed, "group_id bigint, split string")
    left = {s: max(0.0, n) for s, n in need.items()}
    share = sum(left.values()) or 1.0
    draw = F.pmod(F.xxhash64("group_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen, upto = F.lit(max(left, key=lambda k: left[k])), 0.0
    bounds = []
    for s, n in left.items():
        upto += n / share
        bounds.append((s, upto))
    for s, b in reversed(bounds):
        chosen = F.when(draw < b, s).otherwise(chosen)
    small = units.where(F.col("n_rows") <= bar).select("group_id", chosen.alias("split"))
    return small.unionByName(of_large)


@dataclass
class Assigned:
    """rows: row_id, component, split (null: quarantined); table: key, component, split, n_rows, status. A row without any id has the key ``row:ID``."""

    rows: DataFrame
    table: DataFrame


def save(table: DataFrame, path: str) -> None:
    """Writes the component table; the folder of an earlier update is never overwritten."""
    table.write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def assign(rows: DataFrame, before: DataFrame | None = None, proportions: dict[str, float] | None = None, row_id: str = "row_id") -> Assigned:
    """One incremental update.

    ``before`` is the table of the last update. Status of a component: ``kept`` (its split stays), ``new``,
    or ``quarantined`` (old components of different splits now hang together; its rows get no
    split until someone decides). A quarantined component stays so while it lives.
    """
    want = proportions or PROPORTIONS
    found = relate(rows.withColumn("_none", F.lit(None).cast("string")), row_id, "_none", before)
    comps = found.keys.groupBy("root").agg(F.min("group_id").alias("group_id"), F.max("n_rows").alias("n_rows"))
    if before is None:
        old_of = None
        merged = comps.select("root", F.col("group_id").alias("component"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(None).cast("string").alias("old_split"), F.lit(0).alias("n_old"))
    else:
        tags = before.groupBy("component").agg(F.first("split").alias("split"), F.max("n_rows").alias("old_rows"), F.max(F.col("status") == "quarantined").alias("bad"))
        tags = tags.withColumn("key", F.concat(F.lit("old:"), F.col("component").cast("string")))
        old_of = tags.join(found.keys.select("key", "root"), "key").groupBy("root").agg(F.min("component").alias("component"), F.sum("old_rows").alias("old_rows"), F.min("split").alias("old_split"), F.countDistinct("split").alias("n_split"), F.max("bad").alias("bad"))
        merged = comps.join(old_of, "root", "left").select("root", F.coalesce("component", "group_id").alias("component"), (F.coalesce("n_rows", F.lit(0)) + F.coalesce("old_rows", F.lit(0))).alias("n_rows"), "old_split", F.when(F.coalesce("bad", F.lit(False)), 2).otherwise(F.coalesce("n_split", F.lit(0))).alias("n_old"))
    merged = cut(merged.withColumn("status", F.when(F.col("n_old") > 1, "quarantined").when(F.col("n_old") == 1, "kept").otherwise("new")))
    # Rows without any id stand alone; they are new single-row components.
    lone = rows.select(F.col(row_id).alias("row_id"), id_key(F.col("doc_id"), "doc").alias("d"), id_key(F.col("ann_id"), "ann").alias("a")).where("d is null and a is null").select("row_id")
    seen = None
    if before is not None:
        # A row without an id that came before keeps its split, too.
        old_rows = before.where(F.col("key").startswith("row:")).select(F.substring("key", 5, 40).cast("bigint").alias("row_id"), F.col("split").alias("old"))
        lone = cut(lone.join(old_rows, "row_id", "left"))
        seen = lone.where("old is not null").select("row_id", F.col("row_id").alias("component"), F.col("old").alias("split"))
        lone = lone.where("old is null").select("row_id")
    have = {r.old_split: float(r.n) for r in merged.where("status = 'kept'").groupBy("old_split").agg(F.sum("n_rows").alias("n")).collect()}
    total = float((merged.where("status <> 'quarantined'").agg(F.sum("n_rows")).first()[0] or 0) + lone.count())
    fresh = merged.where("status = 'new'").select(F.col("component").alias("group_id"), "n_rows")
    units = fresh.unionByName(lone.select(F.col("row_id").alias("group_id"), F.lit(1).cast("bigint").alias("n_rows")))
    chosen = _choose(units, have, total, want)
    merged = merged.join(chosen, merged["component"] == chosen["group_id"], "left").select("root", "component", "n_rows", "status", F.when(F.col("status") == "kept", F.col("old_split")).when(F.col("status") == "new", F.col("split")).alias("split"))
    table = cut(found.keys.where(~F.col("key").startswith("old:")).select("key", "root", "key_rows").join(merged, "root").select("key", "component", "split", "n_rows", "status", "key_rows"))
    at = table.select("key", "component", "split", F.greatest("key_rows", F.lit(1)).alias("w"))
    out = lookup_join(found.rows.select("row_id", "key"), at, "key", "w").select("row_id", "component", "split")
    # Repeated rows without an id are one unit each time; they share the split of their number.
    alone = cut(lone.join(chosen.dropDuplicates(["group_id"]), lone["row_id"] == chosen["group_id"]).select("row_id", F.col("row_id").alias("component"), "split"))
    kept = alone.groupBy("row_id", "component", "split").agg(F.count("*").alias("n_rows")).select(F.concat(F.lit("row:"), F.col("row_id").cast("string")).alias("key"), "component", "split", "n_rows", F.lit("new").alias("status"))
    every = out.unionByName(alone)
    return Assigned(every if seen is None else every.unionByName(seen), table.drop("key_rows").unionByName(kept))
