"""Problem 6: a sample that matches target category proportions.

One pass gives every record a random priority (a hash of its id, so a retry gives the same) and keeps, per
category, the reservoir of its lowest priorities in mergeable form: counts of priorities in SLICES equal
slices. After the final counts each reservoir is trimmed to its feasible quota: whole slices below the
quota, and the lowest priorities of the one slice that crosses it. Nothing is drawn
twice and no category is gathered in one place.

Categories are the same if they read the same: case, spacing, punctuation, Unicode form, look-alike letters and the
place of the tone mark within a syllable do not matter. Null categories and records without a targeted
category are not drawn. Empty tables give empty samples; all targets are then out of reach.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanloom.llm.lookalike import unify
from vanloom.session import cut

SLICES = 1024
_TONES = "̣̀́̃̉"


def category_key(raw: str | None) -> str | None:
    """Letters and digits in lower case, each syllable's tone mark at its end; null for nothing."""
    if raw is None:
        return None
    out = []
    for word in "".join(c if c.isalnum() or unicodedata.category(c)[0] == "M" else " " for c in unify(unicodedata.normalize("NFC", raw)).casefold()).split():
        parts = unicodedata.normalize("NFD", word)
        out.append("".join(c for c in parts if c not in _TONES) + "".join(sorted(c for c in parts if c in _TONES)))
    return " ".join(out) or None


def category(column: Column) -> Column:
    @F.pandas_udf("string")
    def per_value(values: pd.Series) -> pd.Series:
        return values.map({v: category_key(v) for v in values.dropna().unique()})

    return per_value(column)


def prioritised(records: DataFrame, key: str = "article_id", fields: tuple[str, ...] = ("SubLabel", "Label"), seed: int = 42) -> DataFrame:
    """``field_name, cat, record_id, slice, priority`` per record and field; written once, thin."""
    priority = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), 11)
    rows = records.select(F.col(key).alias("record_id"), *[category(F.col(f)).alias(f"_{i}") for i, f in enumerate(fields)], priority.alias("priority"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"_{i}").alias("cat")) for i, f in enumerate(fields)]))
    rows = rows.select("record_id", "priority", pairs.alias("p")).select("p.field_name", "p.cat", "record_id", "priority")
    return cut(rows.withColumn("slice", F.expr(f"cast(priority div {2**53 // SLICES} as int)")))


def quotas(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with ``total`` records, ``wanted``, ``available`` and feasible ``quota``."""
    goal = targets.withColumn("cat", category(F.col("category")))
    # Categories that no target names are counted as one, so the result is no longer than the targets.
    named = goal.where("cat is not null").select("field_name", "cat").distinct().withColumn("named", F.lit(True))
    per = rows.join(F.broadcast(named), ["field_name", "cat"], "left").groupBy("field_name", F.when(F.col("named"), F.col("cat")).alias("cat")).agg(F.count("*").alias("available"))
    total = per.groupBy("field_name").agg(F.sum("available").alias("total"))
    goal = goal.join(F.broadcast(per.where("cat is not null")), ["field_name", "cat"], "left").join(F.broadcast(total), "field_name", "left")
    share = F.ceil(F.round(F.col("target_share") * F.col("sample_share") * F.coalesce("total", F.lit(0)), 6))
    goal = goal.withColumn("available", F.coalesce("available", F.lit(0))).withColumn("wanted", F.greatest(share, F.col("min_rows").cast("bigint")))
    return goal.withColumn("quota", F.least("available", "wanted"))


def unreachable(records: DataFrame, targets: DataFrame) -> DataFrame:
    """``target_set, category`` of targets for which there are too few records."""
    return quotas(prioritised(records), targets).where("available < wanted").select("target_set", "category")


def sample(records: DataFrame, targets: DataFrame, key: str = "article_id", seed: int = 42) -> DataFrame:
    """``target_set, category, record_id``: the drawn records; exactly ``quota`` of each category."""
    rows = prioritised(records, key, seed=seed)
    goal = cut(quotas(rows, targets).where("quota > 0").select("target_set", "field_name", "cat", "category", "quota"))
    # The mergeable reservoirs: SLICES counts per category, combined on the map side.
    held = rows.where("cat is not null").groupBy("field_name", "cat", "slice").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("target_set", "category").orderBy("slice")
    need = held.join(F.broadcast(goal), ["field_name", "cat"]).withColumn("below", F.sum("n").over(upto) - F.col("n"))
    need = cut(need.where("below < quota").select("field_name", "cat", "slice", "target_set", "category", F.when(F.col("below") + F.col("n") > F.col("quota"), F.col("quota") - F.col("below")).alias("rest")))
    drawn = rows.join(F.broadcast(need), ["field_name", "cat", "slice"])
    whole = drawn.where("rest is null").select("target_set", "category", "record_id")
    last = drawn.where("rest is not null").withColumn("k", F.row_number().over(Window.partitionBy("target_set", "category").orderBy("priority", "record_id")))
    return whole.unionByName(last.where("k <= rest").select("target_set", "category", "record_id"))


def sample_report(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: wanted, available and drawn records, the share reached, and whether the category was exhausted."""
    got = sample(records, targets).groupBy("target_set", "category").agg(F.count("*").alias("drawn"))
    goal = quotas(prioritised(records), targets).join(got, ["target_set", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    all_ = F.sum("drawn").over(Window.partitionBy("target_set"))
    return goal.select("target_set", "category", "target_share", "wanted", "available", "drawn", F.round(F.col("drawn") / all_, 6).alias("share_reached"), (F.col("available") < F.col("wanted")).alias("exhausted"))
