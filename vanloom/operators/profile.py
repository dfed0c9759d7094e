"""Corpus profiles: one scan and one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns whose incidence is reported.
ISSUES = {
    "space_before_punctuation": r"\s[.,;:!?]", "caption": r"(?:Ảnh|Đồ họa)\s*:", "url": r"(?:https?://|www\.)\S", "clip": r"(?:XEM CLIP|Xem clip|Clip)\s*:", "line_break": r"\n", "invisible": r"[​﻿­]", "replacement": r"�",
}
CLASSES = {"combining": r"[̀-ͯ]", "invisible": r"[​﻿­]", "replacement": r"�"}


def class_counts(rows: DataFrame, column: str) -> DataFrame:
    """Characters of each class in a column, one row."""
    n = lambda rx: F.length(F.col(column)) - F.length(F.regexp_replace(F.col(column), rx, ""))
    return rows.agg(*[F.coalesce(F.sum(n(rx)), F.lit(0)).alias(k) for k, rx in CLASSES.items()])


def issue_rates(rows: DataFrame, column: str) -> DataFrame:
    """``issue, pct``: share of non-null texts with each pattern, one scan."""
    rates = rows.where(F.col(column).isNotNull()).agg(*[F.round(100 * F.avg(F.col(column).rlike(rx).cast("int")), 4).alias(k) for k, rx in ISSUES.items()])
    return rates.unpivot([], list(ISSUES), "issue", "pct")


def column_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name, nulls, blanks, distinct_values``."""
    long = rows.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "v")
    return long.groupBy("column_name").agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.trim("v") == "").alias("blanks"), F.countDistinct("v").alias("distinct_values"))


def distribution(rows: DataFrame, column: str, by: str, values: list[str]) -> DataFrame:
    """Counts of each value per split, wide, with the share within the split."""
    wide = rows.groupBy(F.col(column).alias("value")).agg(*[F.count_if(F.col(by) == v).alias(f"n_{v}") for v in values])
    totals = wide.agg(*[F.sum(f"n_{v}").alias(f"all_{v}") for v in values])
    return wide.crossJoin(F.broadcast(totals)).select("value", *[F.col(f"n_{v}") for v in values], *[F.round(100 * F.col(f"n_{v}") / F.col(f"all_{v}"), 1).alias(f"pct_{v}") for v in values])


def hit_rates(rows: DataFrame, text: str, group: str, lexicon: dict[str, list[str]]) -> DataFrame:
    """Share of rows of a group that contain any phrase of a lexicon entry, as a substring in lower case."""
    low = F.lower(F.col(text))

    def any_(some: list[str]) -> Column:
        hit = F.lit(False)
        for p in some:
            hit = hit | low.contains(p)
        return hit

    return rows.where(F.col(text).isNotNull()).groupBy(group).agg(*[F.round(100 * F.avg(any_(some).cast("int")), 4).alias(k) for k, some in lexicon.items()])


def lift(rows: DataFrame, key: str, text: str, group: str, min_pct: float = 0.3) -> DataFrame:
    """``grp, word, pct, ref_pct, lift``: document frequency of words in a group against all rows. Words are counted once per row before the shuffle."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0)))
    base = rows.where(F.col(text).isNotNull() & F.col(group).isNotNull())
    seen = base.select(F.col(group).alias("grp"), F.explode(words).alias("word")).groupBy("grp", "word").agg(F.count("*").alias("n"))
    size = base.groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("size"))
    ref = seen.groupBy("word").agg(F.sum("n").alias("ref_n"))
    total = base.agg(F.count("*").alias("total"))
    out = seen.join(size, "grp").join(ref, "word").crossJoin(F.broadcast(total))
    pct, ref_pct = 100 * F.col("n") / F.col("size"), 100 * F.col("ref_n") / F.col("total")
    return out.select("grp", "word", F.round(pct, 4).alias("pct"), F.round(ref_pct, 4).alias("ref_pct"), F.round(pct / (ref_pct + 0.1), 4).alias("lift")).where(F.col("pct") >= min_pct)


def top_words(rows: DataFrame, text: str, group: str, k: int = 15, stop: tuple[str, ...] = ()) -> DataFrame:
    """``grp, word, n``: the most frequent words of each group, ties by word."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0)))
    per = rows.where(F.col(text).isNotNull()).select(F.col(group).alias("grp"), words.alias("word")).where((F.length("word") > 1) & ~F.col("word").isin(*stop)).groupBy("grp", "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("grp").orderBy(F.desc("n"), "word")
    return per.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).drop("rk")


def quartiles(rows: DataFrame, value: Column, by: str) -> DataFrame:
    """Five-number summary per group, exact."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return rows.groupBy(by).agg(p.alias("p")).select(by, *[F.col("p")[i].alias(n) for i, n in enumerate(("lowest", "q1", "median", "q3", "highest"))])
