"""Queries pN_... of the training-data operators and, where SQL can state them, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vanloom.llm import abuse, copies, encoding, lookalike, mixing, overlap, packing, sampling, segment, splits
from vanloom.session import checkpoint_dir, spread, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_leaks(table(spark, d, "to_annotate"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign(table(spark, d, "to_annotate")).rows


def p1_updated(spark: SparkSession, d: str) -> DataFrame:
    """Two updates through the persisted component table: all rows are assigned, the table is written to the shared folder and read
    again, and the same rows come in once more. Every component keeps its split."""
    rows = table(spark, d, "to_annotate")
    path = f"{checkpoint_dir(spark)}/components-{uuid.uuid4().hex}"
    splits.save(splits.assign(rows).table, path)
    return splits.assign(rows, splits.load(spark, path)).rows


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_fields(table(spark, d, "raw_articles"))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repaired(table(spark, d, "raw_articles"), {"article_id": "bigint"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "raw_articles")).drop("match")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_articles")
    return overlap.report(rows)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "raw_articles"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(table(spark, d, "raw_articles"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.variants(table(spark, d, "raw_articles"), table(spark, d, "sentences")).drop("unified")


def _p6(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "raw_articles"), table(spark, d, "sample_targets")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.unreachable(*_p6(spark, d))


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(*_p6(spark, d))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_report(*_p6(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return segment.units(spread(table(spark, d, "articles").select("doc_id", "Content", "lang"))).select("doc_id", "sent_start", "sent_end")


def p8_bins(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "containers"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_bins(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    return mixing.mix_report(docs, targets, mixing.mix(docs, targets))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abusive(spread(table(spark, d, "documents").select("doc_id", "text")))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scored(table(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "abuse_score")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(table(spark, d, "documents"))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.all_forms(table(spark, d, "raw_articles"), table(spark, d, "sentences")).drop("changed")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_splits, p1_updated, p2_found, p2_restored, p3_found, p3_report, p4_found, p4_counts, p5_found, p6_found, p6_sample, p6_report, p7_found, p8_bins, p8_report, p9_mix, p9_report, p10_found, p10_scores, p10_rates, p5_unified)}
_PLAIN = "regexp_replace(lower(coalesce({}, '')), '[\\p{{Z}}\\p{{P}}\\p{{C}}\\s`´^~|<>=+]+', '', 'g')"
_COPY = f"""c AS (SELECT article_id, {_PLAIN.format('"Summarize"')} AS a, {_PLAIN.format('"Content"')} AS b FROM raw_articles),
 g AS (SELECT article_id, min(article_id) OVER (PARTITION BY least(a, b), greatest(a, b)) AS first_id FROM c)"""
_KIND = "nullif(trim(regexp_replace(replace(lower(nfc_normalize({})), 'tuý', 'túy'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '')"
_ID = "regexp_replace(lower(regexp_replace({}, '[\\s_\\-]+', '', 'g')), '^(train|val|test){}0*([0-9]+)$', '\\1:\\2')"
_OK = "regexp_matches(lower(regexp_replace({}, '[\\s_\\-]+', '', 'g')), '^(train|val|test){}[0-9]+$')"

#: SQL of the queries that SQL can state.
ORACLE: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE r AS (SELECT row_id, split, CASE WHEN {_OK.format('doc_id', '')} THEN 'd:' || {_ID.format('doc_id', '')} END AS d, CASE WHEN {_OK.format('ann_id', 'a?')} THEN 'a:' || {_ID.format('ann_id', 'a?')} END AS a FROM to_annotate),
 k AS (SELECT row_id, d AS k FROM r WHERE d IS NOT NULL UNION ALL SELECT row_id, a FROM r WHERE a IS NOT NULL),
 e AS (SELECT DISTINCT x.row_id AS u, y.row_id AS v FROM k x JOIN k y USING (k)),
 reach(u, v) AS (SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
 g AS (SELECT u AS row_id, min(v) AS group_id FROM reach GROUP BY u),
 m AS (SELECT group_id FROM g JOIN r USING (row_id) GROUP BY group_id HAVING count(DISTINCT split) > 1)
 SELECT row_id, group_id FROM g WHERE group_id IN (SELECT group_id FROM m)""",
    "p4_found": f"WITH {_COPY} SELECT first_id, article_id AS copy_id FROM g WHERE article_id <> first_id",
    "p4_counts": f"WITH {_COPY} SELECT first_id, count(*) AS copies FROM g GROUP BY first_id",
    "p6_found": f"""WITH n AS (SELECT 'SubLabel' AS field_name, {_KIND.format('"SubLabel"')} AS cat, count(*) AS n FROM raw_articles GROUP BY 2 UNION ALL SELECT 'Label', {_KIND.format('"Label"')}, count(*) FROM raw_articles GROUP BY 2)
 SELECT target_set, category FROM sample_targets t LEFT JOIN n ON n.field_name = t.field_name AND n.cat = {_KIND.format('t.category')}
 WHERE coalesce(n, 0) < greatest(min_rows, ceil(round(target_share * sample_share * (SELECT count(*) FROM raw_articles), 6)))""",
}
