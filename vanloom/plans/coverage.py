"""Further single-operator queries: set operations, joins by role, capped samples, reports, boundaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vanloom.functions import spans as S
from vanloom.functions import text as T
from vanloom.operators import dedup, events, sampling
from vanloom.operators import vocabulary as V
from vanloom.plans.registry import collapse, finditer, query, words
from vanloom.plans.spans_and_events import _GOLD, _HITS, _PREDS, WORDS, _anno, _gold, _gold_arrays, _hits, _pred, _sents
from vanloom.session import table

_KEY = "row_id, \"start\", \"end\", label"


@query("SELECT split, count(*) AS n FROM (SELECT split FROM raw_articles WHERE split = 'val' UNION ALL SELECT split FROM raw_articles WHERE split = 'test') GROUP BY split")
def set1_union(s, d):
    r = table(s, d, "raw_articles").select("split")
    return r.where("split = 'val'").unionByName(r.where("split = 'test'")).groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {_GOLD}, {_PREDS}, g AS (SELECT DISTINCT {_KEY} FROM gold), p AS (SELECT DISTINCT {_KEY} FROM pred) SELECT (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM p)) AS both, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p)) AS gold_only, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g)) AS pred_only")
def set2_operations(s, d):
    flags = _gold(s, d).select("row_id", "start", "end", "label").withColumn("g", F.lit(1)).withColumn("p", F.lit(0)).unionByName(_pred(s, d).select("row_id", "start", "end", "label").withColumn("g", F.lit(0)).withColumn("p", F.lit(1)))
    per = flags.groupBy("row_id", "start", "end", "label").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return per.agg(F.count_if(F.expr("g = 1 and p = 1")).alias("both"), F.count_if(F.expr("g = 1 and p = 0")).alias("gold_only"), F.count_if(F.expr("g = 0 and p = 1")).alias("pred_only"))


@query(f"WITH {_GOLD}, {_PREDS} SELECT status, count(*) AS n FROM (SELECT CASE WHEN g.row_id IS NULL THEN 'extra' WHEN p.row_id IS NULL THEN 'missing' ELSE 'both' END AS status FROM (SELECT DISTINCT row_id FROM gold) g FULL JOIN (SELECT DISTINCT row_id FROM pred) p USING (row_id)) GROUP BY status")
def jon04_gold_and_pred(s, d):
    g, p = _gold(s, d).select("row_id").distinct().withColumn("g", F.lit(1)), _pred(s, d).select("row_id").distinct().withColumn("p", F.lit(1))
    status = F.when(F.col("g").isNull(), "extra").when(F.col("p").isNull(), "missing").otherwise("both")
    return g.join(p, "row_id", "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_ROLES = "roles AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{x}')" for r, labels in V.ROLE_LABELS.items() for x in labels) + ") AS v(role, arg_label))"


@query(f"WITH {_HITS}, {_PREDS}, {_ROLES} SELECT r.role, count(*) AS n FROM hits h JOIN pred p USING (row_id) JOIN roles r ON r.arg_label = p.label GROUP BY r.role")
def jon06_admissible_roles(s, d):
    roles = F.array(*[F.lit(r) for r in V.ROLE_LABELS])
    both = _hits(s, d).select("row_id").join(_pred(s, d).select("row_id", F.col("label").alias("x")), "row_id")
    return both.select(F.explode(F.filter(roles, lambda r: events.admits(r, F.col("x")))).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY \"SubLabel\" ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS rk FROM sentences) WHERE rk <= 20")
def win06_capped(s, d):
    return sampling.at_most(table(s, d, "sentences").select("row_id", "SubLabel"), "SubLabel", 20, "row_id").select("row_id")


@query("SELECT row_id FROM sentences WHERE \"SubLabel\" = 'Khác (Không vi phạm)' ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id LIMIT 100")
def win07_reference_sample(s, d):
    rows = table(s, d, "sentences").where(F.col("SubLabel") == "Khác (Không vi phạm)").select("row_id")
    return rows.orderBy(sampling.draw("row_id"), "row_id").limit(100)


@query(f"WITH {_HITS} SELECT h.row_id, h.\"start\", length(substring(t.sentence, 1, h.\"start\")) - length(regexp_extract(substring(t.sentence, 1, h.\"start\"), '([^;.!?]*)$', 1)) AS a, h.\"start\" + length(regexp_extract(substring(t.sentence, h.\"start\" + 1), '^([^;.!?]*)', 1)) AS z FROM hits h JOIN to_annotate t USING (row_id)")
def txt19_clause_bounds(s, d):
    rows = _anno(s, d).select("row_id", "sentence", F.explode(S.phrases(F.col("sentence"), WORDS)).alias("h"))
    return rows.withColumn("c", events.clause_bounds(F.col("sentence"), F.col("h.start"))).select("row_id", F.col("h.start").alias("start"), "c.a", "c.z")


@query(f"WITH {_GOLD} SELECT label, count(*) AS n, count(DISTINCT row_id) AS rows FROM gold GROUP BY label")
def agg29_label_totals(s, d):
    return _gold(s, d).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("rows"))


@query(f"SELECT split, count(*) AS rows, count(DISTINCT lower({collapse('nfc_normalize(sentence)')})) AS distinct_sentences, count(*) - count(DISTINCT lower({collapse('nfc_normalize(sentence)')})) AS duplicates FROM to_annotate WHERE sentence IS NOT NULL GROUP BY split")
def agg30_preparation_report(s, d):
    k = _anno(s, d).select("split", F.md5(T.sentence_key(F.col("sentence"))).alias("k"))
    n, u = F.count("*"), F.countDistinct("k")
    return k.groupBy("split").agg(n.alias("rows"), u.alias("distinct_sentences"), (n - u).alias("duplicates"))


@query(f"SELECT a.split, count(DISTINCT s.doc_id) AS articles, count(*) AS sentences, count(*) FILTER (WHERE s.w < 5) AS short, count(*) FILTER (WHERE s.w > 100) AS long, CAST(trunc(quantile_cont(s.w, 0.5)) AS BIGINT) AS median_words FROM (SELECT doc_id, {words('sentence')} AS w FROM sentences) s JOIN articles a USING (doc_id) GROUP BY a.split")
def agg32_sentence_report(s, d):
    w = table(s, d, "sentences").select("doc_id", T.n_words(F.col("sentence")).alias("w")).join(table(s, d, "articles").select("doc_id", "split"), "doc_id")
    return w.groupBy("split").agg(F.countDistinct("doc_id").alias("articles"), F.count("*").alias("sentences"), F.count_if(F.col("w") < 5).alias("short"), F.count_if(F.col("w") > 100).alias("long"), F.percentile("w", F.lit(0.5)).cast("bigint").alias("median_words"))


_STRICT = "[\\p{L}\\p{N}_]"


@query(f"SELECT t.row_id, m.start AS \"start\" FROM to_annotate t, LATERAL {finditer('t.sentence', '(?i)bắt')} m WHERE t.sentence IS NOT NULL AND NOT regexp_matches(CASE WHEN m.start > 0 THEN substring(t.sentence, m.start, 1) ELSE '' END, '{_STRICT}') AND NOT regexp_matches(substring(t.sentence, m.\"end\" + 1, 1), '{_STRICT}')")
def spn02_strict_boundaries(s, d):
    t = F.col("sentence")
    return _anno(s, d).select("row_id", F.explode(S.whole(S.finditer(t, r"(?iu)\Qbắt\E", ""), t, r"\p{L}\p{N}_")).alias("x")).select("row_id", F.col("x.start").alias("start"))


@query(f"WITH {_GOLD} SELECT count(*) AS spans, count(*) FILTER (WHERE \"start\" < 0 OR \"end\" > length(sentence)) AS out_of_bounds, count(*) FILTER (WHERE label NOT IN ({', '.join(chr(39) + x + chr(39) for x in V.ENTITY_LABELS)})) AS unknown FROM gold")
def spn11_offset_check(s, d):
    g = _gold_arrays(s, d).select("sentence", F.explode("spans").alias("x"))
    return g.agg(F.count("*").alias("spans"), F.count_if((F.col("x.start") < 0) | (F.col("x.end") > F.length("sentence"))).alias("out_of_bounds"), F.count_if(~F.col("x.label").isin(*V.ENTITY_LABELS)).alias("unknown"))


@query("SELECT row_id, sum(CASE WHEN t[i] = 'ông' OR t[i] = 'bà' THEN 1 ELSE 0 END) AS titles FROM (SELECT row_id, regexp_extract_all(lower(sentence), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]') AS t FROM sentences WHERE sentence IS NOT NULL), unnest(range(1, len(t) + 1)) AS u(i) GROUP BY row_id")
def txt15_syllables(s, d):
    n = F.size(F.filter(T.syllables(F.lower("sentence")), lambda w: w.isin("ông", "bà")))
    return table(s, d, "sentences").where("sentence is not null").select("row_id", n.cast("bigint").alias("titles"))


@query()
def txt25_similarity(s, d):
    """Ratio of each sentence with the one before it in its document."""
    w = Window.partitionBy("doc_id").orderBy("row_id")
    rows = table(s, d, "sentences").select("row_id", "doc_id", "sentence").withColumn("before", F.lag("sentence").over(w))
    return rows.where("before is not null and sentence is not null").select("row_id", T.similarity("sentence", "before").alias("ratio"))


@query()
def jon13_fuzzy_leakage(s, d):
    """Annotation rows whose sentence nearly repeats an earlier one of another split, with the first such row of each."""
    rows = _anno(s, d).select("row_id", "split", "sentence")
    return dedup.near_across(rows).select(F.col("id").alias("row_id"), F.col("other").alias("kept_as"), "split", F.col("other_split").alias("kept_split"))


@query()
def trg_counts_by_engine(s, d):
    """Triggers per type for all three engines over the same sentences."""
    t = F.col("sentence")
    out = None
    for name, column in (("a", events.triggers_a(t)), ("b", events.triggers(t, None, "baseline")), ("c", events.triggers(t, None, "service"))):
        part = _sents(s, d).select(F.explode(column).alias("x")).groupBy(F.lit(name).alias("engine"), F.col("x.label").alias("event_type")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
