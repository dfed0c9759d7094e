"""Profile and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vanloom.functions import text as T
from vanloom.operators import metrics, profile
from vanloom.operators import vocabulary as V
from vanloom.plans.registry import norm, query, words
from vanloom.session import table

_SPLITS = ("train", "val", "test")
_GROUPS = {"arrest": ["bắt giữ", "tạm giữ", "bắt quả tang"], "fraud": ["lừa đảo", "chiếm đoạt"], "drugs": ["ma túy", "heroin", "cần sa"]}


def _raw(s, d):
    return table(s, d, "raw_articles")


@query("SELECT coalesce(sum(length(\"Content\") - length(regexp_replace(\"Content\", '[\\x{300}-\\x{36f}]', '', 'g'))),0) AS combining, coalesce(sum(length(\"Content\") - length(regexp_replace(\"Content\", '[\\x{200b}\\x{feff}\\x{ad}]', '', 'g'))),0) AS invisible, coalesce(sum(length(\"Content\") - length(replace(\"Content\", chr(65533), ''))),0) AS replacement FROM raw_articles")
def agg02_class_counts(s, d):
    return profile.class_counts(_raw(s, d), "Content")


@query('SELECT "SubLabel" AS value, count(*) AS n FROM raw_articles GROUP BY 1')
def agg03_value_counts(s, d):
    return _raw(s, d).groupBy(F.col("SubLabel").alias("value")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT ann_id) AS annotations, count(DISTINCT annotator) AS annotators FROM to_annotate")
def agg04_distinct(s, d):
    return table(s, d, "to_annotate").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("ann_id").alias("annotations"), F.countDistinct("annotator").alias("annotators"))


@query(f"SELECT split, CAST(trunc(quantile_cont({words('\"Content\"')}, 0.5)) AS BIGINT) AS median_words FROM raw_articles GROUP BY split")
def agg05_medians(s, d):
    return _raw(s, d).groupBy("split").agg(F.percentile(T.n_words(F.col("Content")), F.lit(0.5)).cast("bigint").alias("median_words"))


@query(f"SELECT split, count(*) AS n, round(avg(w), 4) AS mean, round(stddev_samp(w), 4) AS std, min(w) AS lowest, max(w) AS highest, round(quantile_cont(w, 0.25), 4) AS p25, round(quantile_cont(w, 0.5), 4) AS p50, round(quantile_cont(w, 0.75), 4) AS p75, round(quantile_cont(w, 0.95), 4) AS p95, round(quantile_cont(w, 0.99), 4) AS p99 FROM (SELECT split, {words('\"Content\"')} AS w FROM raw_articles) GROUP BY split")
def agg06_describe(s, d):
    w = _raw(s, d).select("split", T.n_words(F.col("Content")).alias("w"))
    cuts = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    got = w.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("w"), 4).alias("mean"), F.round(F.stddev_samp("w"), 4).alias("std"), F.min("w").alias("lowest"), F.max("w").alias("highest"), F.percentile("w", F.array(*[F.lit(x) for x in cuts.values()])).alias("p"))
    return got.select("split", "n", "mean", "std", "lowest", "highest", *[F.round(F.col("p")[i], 4).alias(k) for i, k in enumerate(cuts)])


_COLS = ["Summarize", "Content", "Label", "SubLabel", "byline"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE \"{c}\" IS NULL) AS nulls, count(*) FILTER (WHERE trim(\"{c}\") = '') AS blanks, count(DISTINCT \"{c}\") AS distinct_values FROM raw_articles" for c in _COLS))
def agg07_column_profile(s, d):
    return profile.column_profile(_raw(s, d), _COLS)


@query("SELECT \"SubLabel\" AS value, " + ", ".join(f"count(*) FILTER (WHERE split = '{x}') AS n_{x}" for x in _SPLITS) + ", " + ", ".join(f"round(100.0 * count(*) FILTER (WHERE split = '{x}') / sum(count(*) FILTER (WHERE split = '{x}')) OVER (), 1) AS pct_{x}" for x in _SPLITS) + " FROM raw_articles GROUP BY 1")
def agg08_distribution(s, d):
    return profile.distribution(_raw(s, d), "SubLabel", "split", list(_SPLITS))


@query("SELECT \"SubLabel\" AS sublabel, count(*) FILTER (WHERE \"Label\" = 'Khác') AS other, count(*) FILTER (WHERE \"Label\" = 'Vi phạm pháp luật') AS violation, count(*) FILTER (WHERE \"Label\" IS NULL) AS missing FROM raw_articles GROUP BY 1")
def agg09_crosstab(s, d):
    return _raw(s, d).groupBy(F.col("SubLabel").alias("sublabel")).agg(F.count_if(F.col("Label") == "Khác").alias("other"), F.count_if(F.col("Label") == "Vi phạm pháp luật").alias("violation"), F.count_if(F.col("Label").isNull()).alias("missing"))


@query("SELECT count(*) FILTER (WHERE \"Label\" = 'Khác' AND \"SubLabel\" <> 'Khác (Không vi phạm)') AS other_with_offence, count(*) FILTER (WHERE \"Label\" = 'Vi phạm pháp luật' AND \"SubLabel\" = 'Khác (Không vi phạm)') AS violation_without FROM raw_articles")
def agg10_label_conflicts(s, d):
    no = F.col("SubLabel") == "Khác (Không vi phạm)"
    return _raw(s, d).agg(F.count_if((F.col("Label") == "Khác") & ~no).alias("other_with_offence"), F.count_if((F.col("Label") == "Vi phạm pháp luật") & no).alias("violation_without"))


def _issue_sql() -> str:
    rx = {**profile.ISSUES, "invisible": "[\\x{200b}\\x{feff}\\x{ad}]", "replacement": "\\x{fffd}"}
    return " UNION ALL ".join(f"SELECT '{k}' AS issue, round(100.0 * avg(CAST(regexp_matches(\"Content\", '{v}') AS INT)), 4) AS pct FROM raw_articles WHERE \"Content\" IS NOT NULL" for k, v in rx.items())


@query(_issue_sql())
def agg11_issue_rates(s, d):
    return profile.issue_rates(_raw(s, d), "Content")


@query()
def agg12_issue_examples(s, d):
    """First example of each issue, in row order, with 50 characters of context on each side."""
    rows = _raw(s, d).where("Content is not null").select("split", "row_idx", "Content")
    firsts = rows.agg(*[F.min_by(F.when(F.col("Content").rlike(rx), F.col("Content")), F.when(F.col("Content").rlike(rx), F.struct("split", "row_idx"))).alias(k) for k, rx in profile.ISSUES.items()])
    long = firsts.unpivot([], list(profile.ISSUES), "issue", "Content").where("Content is not null")
    hit = F.lit(None).cast("string")
    for k, rx in profile.ISSUES.items():
        hit = F.when(F.col("issue") == k, F.regexp_extract("Content", f"(?s).{{0,50}}(?:{rx}).{{0,50}}", 0)).otherwise(hit)
    return long.select("issue", hit.alias("context"))


@query("SELECT round(100.0 * avg(CAST(\"Content\" <> nfc_normalize(\"Content\") AS INT)), 4) AS pct_not_nfc FROM raw_articles WHERE \"Content\" IS NOT NULL")
def agg13_not_composed(s, d):
    return _raw(s, d).where("Content is not null").agg(F.round(100 * F.avg((F.col("Content") != T.composed(F.col("Content"))).cast("int")), 4).alias("pct_not_nfc"))


@query(f"SELECT split, count(k_full) - count(DISTINCT k_full) AS dup_full, count(k_head) - count(DISTINCT k_head) AS dup_head, count(k_sum) - count(DISTINCT k_sum) AS dup_summary FROM (SELECT split, {norm('\"Content\"')} AS k_full, substring({norm('\"Content\"')},1,200) AS k_head, {norm('\"Summarize\"')} AS k_sum FROM raw_articles) GROUP BY split")
def agg14_duplicate_counts(s, d):
    k = _raw(s, d).select("split", F.md5(T.norm_key(F.col("Content"))).alias("f"), F.md5(T.head_key(F.col("Content"))).alias("h"), F.md5(T.norm_key(F.col("Summarize"))).alias("m"))
    return k.groupBy("split").agg(*[(F.count(c) - F.countDistinct(c)).alias(n) for c, n in (("f", "dup_full"), ("h", "dup_head"), ("m", "dup_summary"))])


@query(f"SELECT split, count(*) FILTER (WHERE w < 30) AS short_texts, round(100.0 * avg(CAST(w > 256 AS INT)), 4) AS pct_long FROM (SELECT split, {words('\"Content\"')} AS w FROM raw_articles) GROUP BY split")
def agg15_short_and_long(s, d):
    w = _raw(s, d).select("split", T.n_words(F.col("Content")).alias("w"))
    return w.groupBy("split").agg(F.count_if(F.col("w") < 30).alias("short_texts"), F.round(100 * F.avg((F.col("w") > 256).cast("int")), 4).alias("pct_long"))


@query(f"SELECT least({words('\"Content\"')}, 1500) // 50 AS bin, count(*) AS n FROM raw_articles GROUP BY 1")
def agg16_histogram(s, d):
    return _raw(s, d).groupBy(F.floor(F.least(T.n_words(F.col("Content")), F.lit(1500)) / 50).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT grp, word, n FROM (SELECT grp, word, n, row_number() OVER (PARTITION BY grp ORDER BY n DESC, word) AS rk FROM (SELECT \"SubLabel\" AS grp, unnest(regexp_extract_all(lower(\"Content\"), '\\p{L}+')) AS word, count(*) AS n FROM articles WHERE \"Content\" IS NOT NULL GROUP BY 1, 2) WHERE length(word) > 1 AND word NOT IN ('và', 'của')) WHERE rk <= 15")
def agg17_top_words(s, d):
    return profile.top_words(table(s, d, "articles"), "Content", "SubLabel", 15, ("và", "của"))


@query("SELECT \"SubLabel\", " + ", ".join(f"round(100.0 * avg(CAST({' OR '.join(f'contains(lower(sentence), {chr(39)}{p}{chr(39)})' for p in some)} AS INT)), 4) AS {k}" for k, some in _GROUPS.items()) + " FROM sentences WHERE sentence IS NOT NULL GROUP BY 1")
def agg18_hit_rates(s, d):
    return profile.hit_rates(table(s, d, "sentences"), "sentence", "SubLabel", _GROUPS)


@query("WITH b AS (SELECT row_id, \"SubLabel\" AS grp, list_distinct(regexp_extract_all(lower(sentence), '\\p{L}+')) AS w FROM sentences WHERE sentence IS NOT NULL AND \"SubLabel\" IS NOT NULL), s AS (SELECT grp, word, count(*) AS n FROM (SELECT grp, unnest(w) AS word FROM b) GROUP BY ALL), z AS (SELECT grp, count(*) AS size FROM b GROUP BY grp), r AS (SELECT word, sum(n) AS rn FROM s GROUP BY word) SELECT * FROM (SELECT grp, word, round(100.0 * n / size, 4) AS pct, round(100.0 * rn / (SELECT count(*) FROM b), 4) AS ref_pct, round((100.0 * n / size) / (100.0 * rn / (SELECT count(*) FROM b) + 0.1), 4) AS lift FROM s JOIN z USING (grp) JOIN r USING (word)) WHERE pct >= 0.3")
def agg19_lift(s, d):
    return profile.lift(table(s, d, "sentences"), "row_id", "sentence", "SubLabel")


@query("SELECT split, raw, clean, sents FROM (SELECT split, count(*) AS raw FROM raw_articles GROUP BY split) JOIN (SELECT split, count(*) AS clean FROM articles GROUP BY split) USING (split) JOIN (SELECT split, count(*) AS sents FROM sentences JOIN articles USING (doc_id) GROUP BY split) USING (split)")
def agg20_funnel(s, d):
    a = table(s, d, "articles")
    n = lambda df, name: df.groupBy("split").agg(F.count("*").alias(name))
    return n(_raw(s, d), "raw").join(n(a, "clean"), "split").join(n(table(s, d, "sentences").join(a.select("doc_id", "split"), "doc_id"), "sents"), "split")


@query("SELECT split, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM raw_articles GROUP BY split")
def agg31_split_ratios(s, d):
    per = _raw(s, d).groupBy("split").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("split", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT split, count(*) AS sentences, count(DISTINCT doc_id) AS documents, count(*) FILTER (WHERE \"SubLabel\" = 'Ma túy') AS drugs, count(*) FILTER (WHERE double_annotate) AS twice FROM to_annotate GROUP BY split")
def agg33_sampling_report(s, d):
    return table(s, d, "to_annotate").groupBy("split").agg(F.count("*").alias("sentences"), F.countDistinct("doc_id").alias("documents"), F.count_if(F.col("SubLabel") == "Ma túy").alias("drugs"), F.count_if("double_annotate").alias("twice"))


@query(f"SELECT \"SubLabel\", CAST(min(w) AS DOUBLE) AS lowest, quantile_cont(w, 0.25) AS q1, quantile_cont(w, 0.5) AS median, quantile_cont(w, 0.75) AS q3, CAST(max(w) AS DOUBLE) AS highest FROM (SELECT \"SubLabel\", CAST({words('\"Content\"')} AS DOUBLE) AS w FROM articles) GROUP BY 1")
def agg34_quartiles(s, d):
    return profile.quartiles(table(s, d, "articles"), T.n_words(F.col("Content")), "SubLabel")


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label), r AS (SELECT label, n, pow((SELECT sum(n) FROM c) / CAST(n AS DOUBLE), 0.5) AS raw FROM c) SELECT label, n, round(raw / (SELECT avg(raw) FROM r), 6) AS weight FROM r")
def agg28_class_weights(s, d):
    return metrics.class_weights(table(s, d, "embeddings").where("label is not null").select("label"))


@query("SELECT role, label FROM (VALUES " + ", ".join(f"('{r}', '{x}')" for r, labels in V.ROLE_LABELS.items() for x in labels) + ") AS v(role, label)")
def rel_e_roles(s, d):
    return s.createDataFrame([(r, x) for r, labels in V.ROLE_LABELS.items() for x in labels], "role string, label string")


@query("SELECT \"SubLabel\", split, n FROM (SELECT \"SubLabel\", split, count(*) AS n, row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, \"SubLabel\") AS rk FROM raw_articles WHERE \"SubLabel\" IS NOT NULL GROUP BY 1, 2) WHERE rk <= 3")
def srt1_top_groups(s, d):
    from pyspark.sql import Window

    per = _raw(s, d).where("SubLabel is not null").groupBy("SubLabel", "split").agg(F.count("*").alias("n"))
    w = Window.partitionBy("split").orderBy(F.desc("n"), "SubLabel")
    return per.withColumn("rk", F.row_number().over(w)).where("rk <= 3").drop("rk")
