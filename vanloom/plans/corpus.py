"""Corpus queries: text scalars, cleaning, leak-safe deduplication, sampling, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vanloom.functions import text as T
from vanloom.functions.spans import alternation
from vanloom.functions.text import at
from vanloom.operators import dedup, sampling
from vanloom.operators import vocabulary as V
from vanloom.operators.ranks import global_rank, group_rank
from vanloom.plans.registry import _SPACE, collapse, norm, query, words
from vanloom.session import table

NO_VIOLATION = "Khác (Không vi phạm)"
VIOLATION = "Vi phạm pháp luật"
# Fixed value: groups outside the scope.
OUT_OF_SCOPE = ("Vi phạm Giao thông",)
_SPLITS = ("train", "val", "test")


def _raw(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_articles")


def _anno(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "to_annotate")


@query(f"SELECT article_id, {norm('\"Content\"')} AS norm_key FROM raw_articles")
def txt03_norm_key(s, d):
    return _raw(s, d).select("article_id", T.norm_key(F.col("Content")).alias("norm_key"))


@query(f"SELECT article_id, substring({norm('\"Content\"')}, 1, 200) AS head_key FROM raw_articles")
def txt04_head_key(s, d):
    return _raw(s, d).select("article_id", T.head_key(F.col("Content")).alias("head_key"))


@query(f"SELECT article_id, {words('\"Content\"')} AS n_words, {words('\"Summarize\"')} AS n_summary FROM raw_articles")
def txt09_word_counts(s, d):
    return _raw(s, d).select("article_id", T.n_words(F.col("Content")).alias("n_words"), T.n_words(F.col("Summarize")).alias("n_summary"))


@query("SELECT article_id, nfc_normalize(\"Content\") AS composed FROM raw_articles")
def txt02_composed(s, d):
    return _raw(s, d).select("article_id", T.composed(F.col("Content")).alias("composed"))


_CLEAN = f"regexp_replace(regexp_replace(nfc_normalize(regexp_replace(coalesce(\"Content\",''), '{_SPACE}+([\\x{{300}}-\\x{{36f}}])', '\\1', 'g')), '[\\x{{200b}}\\x{{feff}}\\x{{ad}}]', '', 'g'), '\\x{{fffd}}', ' ', 'g')"


@query(f"SELECT article_id, {collapse(_CLEAN)} AS cleaned FROM raw_articles")
def txt01_clean_text(s, d):
    return _raw(s, d).select("article_id", T.clean_text(F.col("Content")).alias("cleaned"))


@query("SELECT row_id, regexp_replace(regexp_replace(sentence, '\\s+([.,;:!?…%)\\]”’»])', '\\1', 'g'), '([(\\[“‘«])\\s+', '\\1', 'g') AS plain FROM sentences")
def txt06_detokenized(s, d):
    return table(s, d, "sentences").select("row_id", T.detokenize(F.col("sentence")).alias("plain"))




def _dots(column: str) -> str:
    return collapse(rf"regexp_replace(regexp_replace({column}, '\.(?:{_SPACE}+\.)+', '.', 'g'), '^{_SPACE}*\.{_SPACE}*', '')")


_NOT_SPACE = "[^" + _SPACE[1:]
_NAMES = f"[{T.CAPITAL}][{T.CAPITAL}.]*"
_NOISE = (
    (rf"\({_SPACE}*(?:Ảnh|Nguồn){_SPACE}*:[^()]{{0,60}}\)", " "),
    (rf"[-–]?{_SPACE}*(?:Ảnh|Đồ hoạ|Đồ họa){_SPACE}*:{_SPACE}*(?:{_NAMES}{_SPACE}*\.?{_SPACE}*){{1,4}}({_SPACE}|$)", r" . \1"),
    (rf"[-–]{_SPACE}*Ảnh{_SPACE}*:{_SPACE}*[^.]{{1,50}}?{_SPACE}\.({_SPACE}|$)", r" . \1"),
    (rf"(?:XEM CLIP|Xem [Cc]lip|Clip){_SPACE}*:{_SPACE}*", ""),
    (rf"https?://{_NOT_SPACE}+|www\.{_NOT_SPACE}+", " "),
)


def _without_noise(column: str) -> str:
    for pattern, new in _NOISE:
        column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
    return _dots(column)


_LINKS = f"regexp_replace(\"Content\", 'https?://{_NOT_SPACE}+|www\\.{_NOT_SPACE}+', ' ', 'g')"


@query(f"SELECT article_id, {_dots(_LINKS)} AS no_links FROM raw_articles")
def txt05_links_and_dots(s, d):
    return _raw(s, d).select("article_id", T.dots(F.regexp_replace("Content", T.NOISE[-1][0], " ")).alias("no_links"))


@query(f"SELECT article_id, {_without_noise('\"Content\"')} AS without_noise FROM raw_articles")
def txt05_remove_noise(s, d):
    return _raw(s, d).select("article_id", T.remove_noise(F.col("Content")).alias("without_noise"))


@query(f"SELECT row_id, lower({collapse('nfc_normalize(sentence)')}) AS key FROM sentences")
def txt11_sentence_key(s, d):
    return table(s, d, "sentences").select("row_id", T.sentence_key(F.col("sentence")).alias("key"))


@query("SELECT row_id, i AS token_index, t[i] AS token FROM (SELECT row_id, regexp_extract_all(sentence, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}_\\s]') AS t FROM sentences), unnest(range(1, len(t) + 1)) AS u(i)")
def txt14_tokens(s, d):
    rows = table(s, d, "sentences").select("row_id", F.posexplode(T.tokens(F.col("sentence"))).alias("i", "token"))
    return rows.select("row_id", (F.col("i") + 1).cast("bigint").alias("token_index"), "token")


@query()
def txt12_token_keys(s, d):
    tokens = table(s, d, "sentences").select("row_id", F.explode(T.tokens(F.col("sentence"))).alias("token"))
    return tokens.select("row_id", "token", T.token_key(F.col("token")).alias("key"))


@query()
def txt13_folded(s, d):
    return table(s, d, "sentences").where("sentence is not null").select("row_id", T.accent_fold(F.col("sentence")).alias("f")).select("row_id", "f.folded", F.size("f.offsets").alias("n"))


@query()
def txt08_sentences(s, d):
    """Split, fragments merged, lead equal to the summary dropped, ids before the length filter, 5 to 100 words."""
    rows = table(s, d, "articles").where("Content is not null")
    parts = rows.select("doc_id", "SubLabel", "Summarize", T.merge_fragments(T.rough_sentences(T.detokenize(F.col("Content")))).alias("sents"))
    lead = T.norm_key(at("sents", 1)) == T.norm_key(T.detokenize(F.col("Summarize")))
    sents = F.when((F.size("sents") > 0) & F.coalesce(lead, F.lit(False)), F.slice("sents", 2, F.greatest(F.size("sents") - 1, F.lit(0)))).otherwise(F.col("sents"))
    out = parts.select("doc_id", "SubLabel", F.posexplode(sents).alias("sent_id", "sentence"))
    return out.withColumn("n_words", T.n_words(F.col("sentence"))).where("n_words between 5 and 100")


@query("SELECT row_id, regexp_matches(sentence, '(?:^|[^\\p{L}])(?:\\p{Lu}{2,}|(?:\\p{L}\\.){2,})') AS has_abbreviation FROM sentences")
def txt26_abbreviations(s, d):
    return table(s, d, "sentences").select("row_id", F.col("sentence").rlike(T.ABBREVIATION).alias("has_abbreviation"))


@query("SELECT 'raw_articles' AS t, count(*) AS n FROM raw_articles UNION ALL SELECT 'articles', count(*) FROM articles UNION ALL SELECT 'sentences', count(*) FROM sentences UNION ALL SELECT 'to_annotate', count(*) FROM to_annotate")
def src03_row_counts(s, d):
    out = None
    for t in ("raw_articles", "articles", "sentences", "to_annotate"):
        part = table(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT article_id, split || '_' || lpad(CAST(row_number() OVER (PARTITION BY split ORDER BY row_idx) - 1 AS VARCHAR), 5, '0') AS new_id FROM raw_articles WHERE \"Content\" IS NOT NULL")
def prj01_doc_ids(s, d):
    rows = group_rank(_raw(s, d).where("Content is not null").select("article_id", "split", "row_idx"), "split", ["row_idx"], "rn")
    return rows.select("article_id", F.concat_ws("_", "split", F.lpad((F.col("rn") - 1).cast("string"), 5, "0")).alias("new_id"))


@query(f"SELECT article_id, CASE WHEN \"Label\" = 'Khác' AND \"SubLabel\" IS NOT NULL AND \"SubLabel\" <> '{NO_VIOLATION}' THEN '{VIOLATION}' ELSE \"Label\" END AS fixed_label, coalesce(\"Label\" = 'Khác' AND \"SubLabel\" <> '{NO_VIOLATION}', false) AS was_fixed FROM raw_articles")
def prj02_label_fix(s, d):
    bad = F.coalesce((F.col("Label") == "Khác") & (F.col("SubLabel") != NO_VIOLATION), F.lit(False))
    return _raw(s, d).select("article_id", F.when(bad, VIOLATION).otherwise(F.col("Label")).alias("fixed_label"), bad.alias("was_fixed"))


@query("SELECT row_id, split = 'train' AND row_number() OVER (PARTITION BY split ORDER BY row_id) <= 50 AS twice, '' AS note_cell FROM to_annotate")
def prj03_flags(s, d):
    # The 50 are taken by a top-k, which each task cuts to 50 by itself; they are joined by broadcast.
    first = _anno(s, d).where("split = 'train'").select("row_id").orderBy("row_id").limit(50).withColumn("hit", F.lit(True))
    return _anno(s, d).select("row_id").join(F.broadcast(first), "row_id", "left").select("row_id", F.coalesce("hit", F.lit(False)).alias("twice"), F.lit("").alias("note_cell"))


@query(f"SELECT split, count(*) FILTER (WHERE \"Content\" IS DISTINCT FROM {collapse('\"Content\"')}) AS changed FROM raw_articles GROUP BY split")
def prj05_changed_rows(s, d):
    after = T.collapse(F.col("Content"))
    return _raw(s, d).groupBy("split").agg(F.count_if(~F.col("Content").eqNullSafe(after)).alias("changed"))


@query(f"SELECT article_id FROM raw_articles WHERE \"SubLabel\" IS NULL OR \"SubLabel\" NOT IN ('{OUT_OF_SCOPE[0]}')")
def flt01_scope(s, d):
    return _raw(s, d).where(F.col("SubLabel").isNull() | ~F.col("SubLabel").isin(*OUT_OF_SCOPE)).select("article_id")


@query(f"SELECT split, n, first_ids FROM (SELECT split, count(*) AS n, string_agg(CASE WHEN rn <= 3 THEN CAST(article_id AS VARCHAR) END, ',' ORDER BY rn) AS first_ids FROM (SELECT split, article_id, row_number() OVER (PARTITION BY split ORDER BY row_idx) AS rn FROM raw_articles WHERE \"SubLabel\" IN ('{OUT_OF_SCOPE[0]}')) GROUP BY split)")
def flt02_scope_preview(s, d):
    out = _raw(s, d).where(F.col("SubLabel").isin(*OUT_OF_SCOPE)).select("split", "row_idx", "article_id")
    # Spark cuts each task to three rows per split before the shuffle (group limit).
    top = out.withColumn("rn", F.row_number().over(Window.partitionBy("split").orderBy("row_idx"))).where("rn <= 3")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "article_id"))), lambda x: x["article_id"].cast("string")), ",")
    return out.groupBy("split").agg(F.count("*").alias("n")).join(top.groupBy("split").agg(ids.alias("first_ids")), "split")


@query(f"SELECT count(*) FILTER (WHERE w < 5) AS short, count(*) FILTER (WHERE w > 100) AS long, count(*) FILTER (WHERE w BETWEEN 5 AND 100) AS kept FROM (SELECT {words('sentence')} AS w FROM sentences)")
def flt03_length_band(s, d):
    w = table(s, d, "sentences").select(T.n_words(F.col("sentence")).alias("w"))
    return w.agg(F.count_if(F.col("w") < 5).alias("short"), F.count_if(F.col("w") > 100).alias("long"), F.count_if(F.col("w").between(5, 100)).alias("kept"))


@query("SELECT row_id FROM to_annotate WHERE trim(coalesce(sentence,'')) <> '' AND coalesce(entities,'') <> 'PREDICTION_ERROR'")
def flt07_merge_filter(s, d):
    return _anno(s, d).where((F.trim(F.coalesce("sentence", F.lit(""))) != "") & (F.coalesce("entities", F.lit("")) != "PREDICTION_ERROR")).select("row_id")


@query(f"SELECT doc_id, CASE WHEN trim(coalesce(text,'')) = '' THEN 'EMPTY' ELSE 'OK' END AS status, {words('text')} > 256 AS too_long FROM documents")
def flt09_input_guard(s, d):
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    return table(s, d, "documents").select("doc_id", F.when(blank, "EMPTY").otherwise("OK").alias("status"), (T.n_words(F.col("text")) > 256).alias("too_long"))


_KEYS = f"""keys AS (SELECT article_id, split, row_idx, nullif({norm("coalesce(\"Content\",'')")}, '') AS k_full, nullif(substring({norm("coalesce(\"Content\",'')")},1,200), '') AS k_head, nullif({norm("coalesce(\"Summarize\",'')")}, '') AS k_sum FROM raw_articles)"""


@query(f"WITH {_KEYS} SELECT article_id FROM keys t WHERE split = 'train' AND (k_full IN (SELECT k_full FROM keys WHERE split <> 'train' AND k_full IS NOT NULL) OR k_head IN (SELECT k_head FROM keys WHERE split <> 'train' AND k_head IS NOT NULL) OR k_sum IN (SELECT k_sum FROM keys WHERE split <> 'train' AND k_sum IS NOT NULL))")
def jon01_leaked_rows(s, d):
    rows = dedup.keyed(_raw(s, d))
    hit = dedup.leaked(rows.where("split = 'train'"), rows.where("split <> 'train'"))
    return _raw(s, d).select("article_id", "split", "row_idx").join(hit, ["split", "row_idx"]).select("article_id")


@query("SELECT row_id FROM sentences WHERE doc_id NOT IN (SELECT doc_id FROM to_annotate WHERE doc_id IS NOT NULL)")
def jon02_unsampled_documents(s, d):
    return table(s, d, "sentences").join(_anno(s, d).select("doc_id").where("doc_id is not null"), "doc_id", "left_anti").select("row_id")


def _overlap_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS kind, a.split AS split_a, b.split AS split_b, count(*) AS shared FROM (SELECT DISTINCT split, {k} AS k FROM keys WHERE {k} IS NOT NULL) a JOIN (SELECT DISTINCT split, {k} AS k FROM keys WHERE {k} IS NOT NULL) b ON a.k = b.k AND a.split < b.split GROUP BY ALL" for k in ("k_full", "k_head", "k_sum"))


@query(f"WITH {_KEYS} {_overlap_sql()}")
def jon14_overlap_matrix(s, d):
    rows = dedup.exploded(dedup.keyed(_raw(s, d)))
    # Which splits a key occurs in is combined before the shuffle; pairs of splits are made in the row.
    per = rows.groupBy("kind", "key").agg(*[F.max(F.col("split") == x).alias(x) for x in _SPLITS])
    names = {"full": "k_full", "head": "k_head", "summary": "k_sum"}
    pairs = F.array(*[F.when(F.col(a) & F.col(b), F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"))) for a in _SPLITS for b in _SPLITS if a < b])
    kind = F.col("kind")
    for k, v in names.items():
        kind = F.when(F.col("kind") == k, v).otherwise(kind)
    return per.select(kind.alias("kind"), F.explode(F.array_compact(pairs)).alias("p")).groupBy("kind", "p.split_a", "p.split_b").agg(F.count("*").alias("shared"))


@query(f"""WITH {_KEYS},
 d AS (SELECT *, coalesce(row_number() OVER (PARTITION BY split, k_head ORDER BY row_idx) > 1 AND k_head IS NOT NULL, false) OR coalesce(row_number() OVER (PARTITION BY split, k_sum ORDER BY row_idx) > 1 AND k_sum IS NOT NULL, false) AS dup FROM keys),
 t AS (SELECT * FROM d WHERE split = 'test' AND NOT dup),
 v0 AS (SELECT d.*, coalesce(k_full IN (SELECT k_full FROM t WHERE k_full IS NOT NULL), false) OR coalesce(k_head IN (SELECT k_head FROM t WHERE k_head IS NOT NULL), false) OR coalesce(k_sum IN (SELECT k_sum FROM t WHERE k_sum IS NOT NULL), false) AS leak FROM d WHERE split = 'val'),
 h AS (SELECT k_full, k_head, k_sum FROM t UNION ALL SELECT k_full, k_head, k_sum FROM v0 WHERE NOT leak AND NOT dup),
 r0 AS (SELECT d.*, coalesce(k_full IN (SELECT k_full FROM h WHERE k_full IS NOT NULL), false) OR coalesce(k_head IN (SELECT k_head FROM h WHERE k_head IS NOT NULL), false) OR coalesce(k_sum IN (SELECT k_sum FROM h WHERE k_sum IS NOT NULL), false) AS leak FROM d WHERE split = 'train')
 SELECT split, row_idx, false AS leak, dup FROM d WHERE split = 'test' UNION ALL SELECT split, row_idx, leak, dup FROM v0 UNION ALL SELECT split, row_idx, leak, dup FROM r0""")
def ded01_leak_safe(s, d):
    return dedup.leak_safe(_raw(s, d))


from vanloom.plans.registry import ORACLE  # noqa: E402

_LEAK = ORACLE["ded01_leak_safe"]


@query(f"SELECT split, count(*) AS rows_in, CAST(sum(CAST(leak AS INT)) AS BIGINT) AS leaked, CAST(sum(CAST(dup AND NOT leak AS INT)) AS BIGINT) AS duplicates, CAST(sum(CAST(NOT dup AND NOT leak AS INT)) AS BIGINT) AS rows_out FROM ({_LEAK}) GROUP BY split")
def agg01_clean_report(s, d):
    f = dedup.leak_safe(_raw(s, d))
    return f.groupBy("split").agg(F.count("*").alias("rows_in"), F.count_if("leak").alias("leaked"), F.count_if(F.expr("dup and not leak")).alias("duplicates"), F.count_if(F.expr("not dup and not leak")).alias("rows_out"))


_LEAK_AFTER = _LEAK
for _c in ("Content", "Summarize"):
    _LEAK_AFTER = _LEAK_AFTER.replace(norm(f"coalesce(\"{_c}\",'')"), norm(f"coalesce({_without_noise(chr(34) + _c + chr(34))},'')"))
_BAD = f"coalesce(\"Label\" = 'Khác' AND \"SubLabel\" <> '{NO_VIOLATION}', false)"


@query(f"""WITH f AS ({_LEAK_AFTER}), r AS (SELECT split, count(*) AS rows_in, count(*) FILTER (WHERE "Content" IS DISTINCT FROM {_without_noise('"Content"')}) AS noise_docs_changed, count(*) FILTER (WHERE {_BAD}) AS sublabel_fixed FROM raw_articles GROUP BY split)
 SELECT r.*, count(*) FILTER (WHERE f.leak) AS leak_removed, count(*) FILTER (WHERE f.dup AND NOT f.leak) AS dup_removed, count(*) FILTER (WHERE NOT f.dup AND NOT f.leak) AS rows_out FROM r JOIN f USING (split) GROUP BY ALL""")
def agg01_run_report(s, d):
    """The whole cleaning step per split: noise removed, labels fixed, then leaks and repetitions of what is left of the texts."""
    rows = _raw(s, d).select("split", "row_idx", F.col("Content").alias("before"), T.remove_noise(F.col("Content")).alias("Content"), T.remove_noise(F.col("Summarize")).alias("Summarize"), "Label", "SubLabel")
    bad = F.coalesce((F.col("Label") == "Khác") & (F.col("SubLabel") != NO_VIOLATION), F.lit(False))
    first = rows.groupBy("split").agg(F.count("*").alias("rows_in"), F.count_if(~F.col("before").eqNullSafe(F.col("Content"))).alias("noise_docs_changed"), F.count_if(bad).alias("sublabel_fixed"))
    flags = dedup.leak_safe(rows.select("split", "row_idx", "Content", "Summarize"))
    last = flags.groupBy("split").agg(F.count_if("leak").alias("leak_removed"), F.count_if(F.expr("dup and not leak")).alias("dup_removed"), F.count_if(F.expr("not dup and not leak")).alias("rows_out"))
    return first.join(last, "split")


@query(f"WITH {_KEYS} SELECT article_id, coalesce(row_number() OVER (PARTITION BY split, k_full ORDER BY row_idx) > 1 AND k_full IS NOT NULL, false) AS repeated FROM keys")
def win01_keep_first(s, d):
    rows = dedup.keyed(_raw(s, d)).select("article_id", "split", "row_idx", "k_full")
    first = rows.where("k_full is not null").groupBy("split", "k_full").agg(F.min("row_idx").alias("first"))
    return rows.join(first, ["split", "k_full"], "left").select("article_id", F.coalesce(F.col("row_idx") > F.col("first"), F.lit(False)).alias("repeated"))


@query(f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY lower({collapse('nfc_normalize(sentence)')}) ORDER BY row_id) AS rn FROM sentences WHERE sentence IS NOT NULL) WHERE rn = 1")
def ded02_first_wins(s, d):
    rows = table(s, d, "sentences").where("sentence is not null").select("row_id", "sentence")
    return dedup.first_wins(rows, T.sentence_key(F.col("sentence")), ["row_id"]).select("row_id")


@query()
def ded03_fuzzy(s, d):
    return dedup.fuzzy(table(s, d, "sentences").select("row_id", "sentence")).select("row_id", "kept_as")


@query(f"SELECT key, n, variants FROM (SELECT lower({collapse('nfc_normalize(sentence)')}) AS key, count(*) AS n, count(DISTINCT coalesce(entities,'')) AS variants FROM to_annotate WHERE sentence IS NOT NULL GROUP BY 1) WHERE variants > 1")
def ded04_conflicts(s, d):
    return dedup.conflicts(_anno(s, d), "sentence", "entities")


@query(f"SELECT DISTINCT a.k AS sentence_key, a.split AS split_a, b.split AS split_b FROM (SELECT DISTINCT split, lower({collapse('nfc_normalize(sentence)')}) AS k FROM to_annotate WHERE sentence IS NOT NULL) a JOIN (SELECT DISTINCT split, lower({collapse('nfc_normalize(sentence)')}) AS k FROM to_annotate WHERE sentence IS NOT NULL) b ON a.k = b.k AND a.split < b.split")
def ded05_not_disjoint(s, d):
    k = _anno(s, d).where("sentence is not null").select("split", T.sentence_key(F.col("sentence")).alias("sentence_key"))
    per = k.groupBy("sentence_key").agg(F.array_sort(F.collect_set("split")).alias("s")).where("size(s) > 1")
    two = F.flatten(F.transform("s", lambda a: F.transform(F.filter(F.col("s"), lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return per.select("sentence_key", F.explode(two).alias("p")).select("sentence_key", "p.*")


@query("SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY doc_id ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS rk FROM sentences) WHERE rk <= 2")
def win02_two_per_document(s, d):
    return sampling.at_most(table(s, d, "sentences").select("row_id", "doc_id"), "doc_id", 2, "row_id").select("row_id")


_STRATA = """st AS (SELECT row_id, coalesce("SubLabel",'') AS g FROM sentences), k AS (SELECT count(DISTINCT g) AS n FROM st),
 got AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY g ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS rk FROM st) WHERE rk <= (SELECT 600 // n FROM k)),
 top AS (SELECT row_id, row_number() OVER (ORDER BY md5('43:' || CAST(row_id AS VARCHAR)), row_id) AS rk FROM st WHERE row_id NOT IN (SELECT row_id FROM got))"""


@query(f"WITH {_STRATA} SELECT row_id FROM got UNION ALL SELECT row_id FROM top WHERE rk <= 600 - (SELECT count(*) FROM got)")
def win03_stratified(s, d):
    rows = table(s, d, "sentences").select("row_id", F.coalesce("SubLabel", F.lit("")).alias("g"))
    return sampling.stratified(rows, "g", 600, "row_id").select("row_id")


def _stratified_sql(name: str, source: str, n: str) -> str:
    md5 = lambda seed: f"md5('{seed}:' || CAST(row_id AS VARCHAR)), row_id"
    return f"""{name}_first AS (SELECT row_id, doc_id, g FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {md5(42)}) AS rk FROM {source}) WHERE rk <= (SELECT {n} // greatest(count(DISTINCT g), 1) FROM {source})),
 {name} AS (SELECT row_id, doc_id, g FROM {name}_first UNION ALL SELECT row_id, doc_id, g FROM (SELECT *, row_number() OVER (ORDER BY {md5(43)}) AS rk FROM {source} WHERE row_id NOT IN (SELECT row_id FROM {name}_first)) WHERE rk <= {n} - (SELECT count(*) FROM {name}_first))"""


_KEYWORDS = alternation([p for some in V.TRIGGERS_A.values() for p in some])
_RE2_WORDS = _KEYWORDS.replace("(?iu)", "(?i)")


@query(f"""WITH st AS (SELECT row_id, doc_id, sentence, coalesce("SubLabel", '') AS g FROM sentences WHERE sentence IS NOT NULL), hits AS (SELECT * FROM st WHERE regexp_matches(sentence, '{_RE2_WORDS}')),
 {_stratified_sql("kw", "hits", "300")}, others AS (SELECT * FROM st WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM kw WHERE doc_id IS NOT NULL)),
 {_stratified_sql("more", "others", "(600 - (SELECT count(*) FROM kw))")} SELECT row_id, g FROM kw UNION ALL SELECT row_id, g FROM more""")
def win04_enriched(s, d):
    rows = table(s, d, "sentences").where("sentence is not null").select("row_id", "doc_id", "sentence", F.coalesce("SubLabel", F.lit("")).alias("g"))
    return sampling.enriched(rows, F.col("sentence").rlike(_KEYWORDS), "doc_id", "g", 600, "row_id").select("row_id", "g")


@query("SELECT row_id, row_number() OVER (ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS pos FROM to_annotate")
def win05_shuffle(s, d):
    return global_rank(_anno(s, d).select("row_id", sampling.draw("row_id").alias("m")), ["m", "row_id"], "pos").select("row_id", "pos")


@query("WITH n AS (SELECT count(*) AS n FROM sentences), z AS (SELECT n, greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)) AS v, greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) AS t FROM n) SELECT row_id, CASE WHEN rk <= n - v - t THEN 'train' WHEN rk <= n - t THEN 'val' ELSE 'test' END AS split FROM (SELECT row_id, row_number() OVER (ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS rk FROM sentences), z")
def win08_ratio_split(s, d):
    return sampling.ratio_split(table(s, d, "sentences").select("row_id"), "row_id")


@query("WITH g AS (SELECT row_id, coalesce(\"SubLabel\",'') AS g FROM to_annotate WHERE split = 'val'), k AS (SELECT count(DISTINCT g) AS n FROM g) SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY g ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS rk FROM g) WHERE rk <= (SELECT 150 // n FROM k)")
def win09_held_out(s, d):
    rows = _anno(s, d).where("split = 'val'").select("row_id", F.coalesce("SubLabel", F.lit("")).alias("g"))
    return sampling.held_out(rows, "g", 150, "row_id").select("row_id")


@query(f"SELECT row_id FROM to_annotate t WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM sentences s WHERE lower({collapse('nfc_normalize(s.sentence)')}) = lower({collapse('nfc_normalize(t.sentence)')}))")
def jon16_not_in_corpus(s, d):
    mine = _anno(s, d).where("split = 'train'").select("row_id", T.sentence_key(F.col("sentence")).alias("k"))
    return mine.join(table(s, d, "sentences").select(T.sentence_key(F.col("sentence")).alias("k")).where("k is not null").distinct(), "k", "left_anti").select("row_id")
