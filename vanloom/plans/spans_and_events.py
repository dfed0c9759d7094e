"""Span, annotation, metric, trigger, role and recogniser queries over the annotation rows and sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanloom.functions import spans as S
from vanloom.functions import text as T
from vanloom.operators import align, annotation, entities, events, lint, metrics, models
from vanloom.operators import vocabulary as V
from vanloom.plans.registry import finditer, query
from vanloom.session import spread, table
from vanloom.sources import io

CAPITALS = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)+"
# A stand-in predictor, two patterns with labels, so that scores can be stated in SQL.
PRED = {"TIME": r"\d{1,2}/\d{1,2}(?:/\d{4})?", "MONEY": r"\d+(?:[.,]\d+)*(?: (?:triệu|tỷ|tỉ))? (?:đồng|USD)"}
WORDS = {"KHOI_TO": ["khởi tố"], "THU_GIU": ["thu giữ"], "BAT_GIU": ["bắt quả tang", "bắt khẩn cấp"], "XET_XU": ["xét xử", "tuyên phạt"], "CUOP_TROM": ["đột nhập"], "MA_TUY": ["mua bán"]}


def _anno(s, d) -> DataFrame:
    return table(s, d, "to_annotate").where("sentence is not null")


def _sents(s, d) -> DataFrame:
    """Sentences for the dear row-local functions."""
    return spread(table(s, d, "sentences").where("sentence is not null").select("row_id", "sentence"))


def _gold_arrays(s, d) -> DataFrame:
    return _anno(s, d).select("row_id", "sentence", S.located(F.col("sentence"), S.parse_entities(F.col("entities"))).alias("spans"))


def _flat(df: DataFrame, column: str = "spans") -> DataFrame:
    return df.select("row_id", F.explode(column).alias("x")).select("row_id", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.text").alias("text"), F.col("x.label").alias("label"))


def _gold(s, d) -> DataFrame:
    return _flat(_gold_arrays(s, d))


def _pred(s, d) -> DataFrame:
    t = F.col("sentence")
    return _flat(_anno(s, d).select("row_id", F.concat(*[S.finditer(t, rx, k) for k, rx in PRED.items()]).alias("spans")))


def _hits(s, d) -> DataFrame:
    return _flat(_anno(s, d).select("row_id", S.phrases(F.col("sentence"), WORDS).alias("spans")))


_LABEL = "upper(trim(regexp_extract(it, '(?s)^.*\\|([^|]*)$', 1)))"
_ALIAS = f"CASE {_LABEL} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.ALIASES.items()) + f" ELSE {_LABEL} END"
_ITEMS = f"items AS (SELECT row_id, sentence, trim(regexp_extract(it, '(?s)^(.*)\\|[^|]*$', 1)) AS text, {_ALIAS} AS label FROM (SELECT row_id, sentence, trim(unnest(string_split(entities, ';'))) AS it FROM to_annotate WHERE sentence IS NOT NULL AND upper(trim(entities)) <> 'NONE') WHERE contains(it, '|'))"
_GOLD = f"{_ITEMS}, gold AS (SELECT row_id, sentence, instr(sentence, text) - 1 AS \"start\", instr(sentence, text) - 1 + length(text) AS \"end\", text, label FROM items WHERE text <> '' AND instr(sentence, text) > 0)"


def _found(patterns: dict[str, str], source: str = "to_annotate") -> str:
    return " UNION ALL ".join(f"SELECT t.row_id, m.start AS \"start\", m.\"end\", m.text, '{k}' AS label FROM {source} t, LATERAL {finditer('t.sentence', rx)} m WHERE t.sentence IS NOT NULL" for k, rx in patterns.items())


_PREDS = f"pred AS ({_found(PRED)})"
_HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT t.row_id, m.start AS \"start\", m.\"end\", m.text, '{k}' AS label FROM to_annotate t, LATERAL {finditer('t.sentence', '(?i)' + p)} m WHERE t.sentence IS NOT NULL AND NOT regexp_matches(CASE WHEN m.start > 0 THEN substring(t.sentence, m.start, 1) ELSE '' END, '\\p{{L}}') AND NOT regexp_matches(substring(t.sentence, m.\"end\" + 1, 1), '\\p{{L}}')"
    for k, some in WORDS.items() for p in some
) + ")"


@query(f"SELECT t.row_id, m.start AS \"start\", m.\"end\", m.text FROM sentences t, LATERAL {finditer('t.sentence', CAPITALS)} m WHERE t.sentence IS NOT NULL")
def spn00_finditer(s, d):
    return _flat(table(s, d, "sentences").where("sentence is not null").select("row_id", S.finditer(F.col("sentence"), CAPITALS, "").alias("spans"))).drop("label")


@query(f"WITH {_HITS} SELECT * FROM hits")
def spn01_phrases(s, d):
    return _hits(s, d)


@query("SELECT row_id, i - 1 AS pos FROM (SELECT row_id, regexp_extract_all(lower(sentence), '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}_\\s]') AS t FROM to_annotate WHERE sentence IS NOT NULL), unnest(range(1, len(t) + 1)) AS u(i) WHERE t[i] = 'triệu' AND t[i+1] = 'đồng'")
def spn03_token_phrase(s, d):
    return _anno(s, d).select("row_id", F.explode(S.token_phrase(T.tokens(F.lower("sentence")), ["triệu", "đồng"])).alias("pos")).select("row_id", F.col("pos").cast("bigint").alias("pos"))


@query()
def spn04_greedy(s, d):
    t = F.col("sentence")
    return _flat(_anno(s, d).select("row_id", S.greedy(F.concat(S.phrases(t, V.TRIGGERS_A), S.finditer(t, CAPITALS, "NAME"))).alias("spans")))


@query(f"WITH {_HITS}, {_PREDS} SELECT h.* FROM hits h WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.row_id = h.row_id AND p.\"start\" < h.\"end\" + 12 AND h.\"start\" < p.\"end\")")
def spn09_unblocked(s, d):
    t = F.col("sentence")
    wide = F.transform(F.concat(*[S.finditer(t, rx, k) for k, rx in PRED.items()]), lambda x: F.struct((x["start"] - 12).alias("start"), x["end"].alias("end")))
    return _flat(_anno(s, d).select("row_id", S.unblocked(S.phrases(t, WORDS), wide).alias("spans")))


@query(f"WITH {_GOLD} SELECT count(*) AS spans, count(*) FILTER (WHERE substring(sentence, \"start\" + 1, \"end\" - \"start\") = text) AS exact FROM gold")
def spn19_integrity(s, d):
    g = _gold_arrays(s, d).select("sentence", F.explode("spans").alias("x"))
    return g.agg(F.count("*").alias("spans"), F.count_if(S.exact_text(F.col("sentence"), F.col("x"))).alias("exact"))


@query(f"WITH {_ITEMS} SELECT row_id, text, label FROM items")
def txt20_parsed(s, d):
    return _anno(s, d).select("row_id", F.explode(S.parse_entities(F.col("entities"))).alias("e")).select("row_id", "e.*")


@query("SELECT row_id, label, count(*) AS n FROM (SELECT row_id, upper(trim(regexp_extract(it, '(?s)^.*\\|([^|]*)$', 1))) AS label FROM (SELECT row_id, trim(unnest(string_split(entities, ';'))) AS it FROM to_annotate) WHERE contains(it, '|')) GROUP BY ALL")
def txt21_lenient(s, d):
    items = F.filter(F.transform(F.split(F.coalesce("entities", F.lit("")), ";"), F.trim), lambda x: x.contains("|"))
    return table(s, d, "to_annotate").select("row_id", F.explode(items).alias("it")).groupBy("row_id", F.upper(F.trim(F.regexp_extract("it", r"(?s)^.*\|([^|]*)$", 1))).alias("label")).agg(F.count("*").alias("n"))


@query(f"WITH {_GOLD} SELECT t.row_id, coalesce(c.cell, 'NONE') AS cell FROM to_annotate t LEFT JOIN (SELECT row_id, string_agg(text || '|' || label, '; ' ORDER BY \"start\", \"end\", text, label) AS cell FROM gold GROUP BY row_id) c USING (row_id) WHERE t.sentence IS NOT NULL")
def snk04_entity_cells(s, d):
    return _gold_arrays(s, d).select("row_id", S.format_entities(F.col("spans")).alias("cell"))


_TOKENS = f"toks AS (SELECT t.row_id, m.k AS token_index, m.text AS token, m.start AS \"start\", m.\"end\" FROM to_annotate t, LATERAL {finditer('t.sentence', '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}_\\s]')} m WHERE t.sentence IS NOT NULL)"
_BIO = f"WITH {_GOLD}, {_TOKENS}, one AS (SELECT t.*, (SELECT min(struct_pack(s := g.\"start\", e := g.\"end\", x := g.text, l := g.label)) FROM gold g WHERE g.row_id = t.row_id AND g.\"start\" <= t.\"start\" AND t.\"end\" <= g.\"end\") AS g FROM toks t)"


@query(f"{_BIO} SELECT row_id AS sentence_id, token_index, token, CASE WHEN g IS NULL THEN 'O' WHEN g.s = \"start\" THEN 'B-' || g.l ELSE 'I-' || g.l END AS label, \"start\", \"end\" FROM one")
def snk05_bio_rows(s, d):
    t = F.col("sentence")
    toks = _gold_arrays(s, d).withColumn("t", S.finditer(t, r"[\p{L}\p{N}]+|[^\p{L}\p{N}_\s]", ""))
    rec = toks.select("row_id", F.transform("t", lambda x: x["text"]).alias("tokens"), F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("token_offsets"), S.bio_encode(F.col("t"), F.col("spans")).alias("labels"))
    return io.bio_rows(rec, "row_id")


_DECODED = f"""{_BIO}, lab AS (SELECT row_id, token_index, "start", "end", CASE WHEN g IS NULL THEN 'O' WHEN g.s = "start" THEN 'B' ELSE 'I' END AS kind, g.l AS label FROM one),
 runs AS (SELECT *, sum(CASE WHEN kind = 'B' OR kind = 'I' AND (before IS NULL OR before <> label) THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY token_index) AS run FROM (SELECT *, lag(CASE WHEN kind = 'O' THEN NULL ELSE label END) OVER (PARTITION BY row_id ORDER BY token_index) AS before FROM lab))
 SELECT r.row_id, CAST(min(r."start") AS INT) AS "start", CAST(max(r."end") AS INT) AS "end", substring(t.sentence, min(r."start") + 1, max(r."end") - min(r."start")) AS text, r.label FROM runs r JOIN to_annotate t USING (row_id) WHERE kind <> 'O' GROUP BY r.row_id, r.run, r.label, t.sentence"""


@query(_DECODED)
def spn15_bio_decoded(s, d):
    t = F.col("sentence")
    toks = _gold_arrays(s, d).withColumn("t", S.finditer(t, r"[\p{L}\p{N}]+|[^\p{L}\p{N}_\s]", "")).withColumn("l", S.bio_encode(F.col("t"), F.col("spans")))
    return _flat(toks.select("row_id", S.bio_decode(F.col("t"), F.col("l"), t).alias("spans")))


_CUT_WORDS = f"""WITH {_GOLD}, w AS (SELECT t.row_id, m.start AS a, m."end" AS z FROM to_annotate t, LATERAL {finditer('t.sentence', '\\S+')} m WHERE t.sentence IS NOT NULL),
 cuts AS (SELECT row_id, "start" AS c FROM gold UNION SELECT row_id, "end" FROM gold),
 edges AS (SELECT w.row_id, w.a, w.z, list_sort(list_distinct(list_concat([w.a, w.z], coalesce(list(c.c) FILTER (WHERE c.c > w.a AND c.c < w.z), [])))) AS e FROM w LEFT JOIN cuts c USING (row_id) GROUP BY w.row_id, w.a, w.z)
 SELECT row_id, e[i] AS "start", e[i + 1] AS "end" FROM edges, unnest(range(1, len(e))) AS u(i)"""


@query(_CUT_WORDS)
def txt16_cut_words(s, d):
    t = F.col("sentence")
    cut = S.cut_at(S.finditer(t, r"\S+", ""), F.flatten(F.transform("spans", lambda x: F.array(x["start"], x["end"]))))
    return _gold_arrays(s, d).select("row_id", F.explode(cut).alias("w")).select("row_id", "w.*")


_SNIP = "CASE WHEN \"start\" - 40 > 0 THEN '…' ELSE '' END || trim(substring(sentence, greatest(\"start\" - 40, 0) + 1, least(\"end\" + 120, length(sentence)) - greatest(\"start\" - 40, 0))) || CASE WHEN \"end\" + 120 < length(sentence) THEN '…' ELSE '' END"


@query(f"WITH {_GOLD} SELECT row_id, \"start\", text, {_SNIP} AS snippet FROM gold WHERE label = 'TIME'")
def txt23_timeline(s, d):
    g = _gold_arrays(s, d).select("row_id", "sentence", F.explode(F.filter("spans", lambda x: x["label"] == "TIME")).alias("x"))
    return g.select("row_id", F.col("x.start").alias("start"), F.col("x.text").alias("text"), S.snippet(F.col("sentence"), F.col("x")).alias("snippet"))


@query()
def txt24_highlighted(s, d):
    return _gold_arrays(s, d).select("row_id", S.highlight(F.col("sentence"), F.col("spans")).alias("marked"))


# Joins between spans


@query(f"WITH {_GOLD}, {_PREDS} SELECT g.row_id, count(*) AS pairs FROM gold g JOIN pred p ON g.row_id = p.row_id AND g.\"start\" < p.\"end\" AND p.\"start\" < g.\"end\" GROUP BY g.row_id")
def jon07_span_overlap(s, d):
    g = _gold(s, d).select("row_id", F.col("start").alias("gs"), F.col("end").alias("ge"))
    return g.join(_pred(s, d), "row_id").where((F.col("gs") < F.col("end")) & (F.col("start") < F.col("ge"))).groupBy("row_id").agg(F.count("*").alias("pairs"))


@query(f"WITH {_HITS}, {_PREDS}, c AS (SELECT h.*, length(substring(t.sentence, 1, h.\"start\")) - length(regexp_extract(substring(t.sentence, 1, h.\"start\"), '([^;.!?]*)$', 1)) AS a, h.\"start\" + length(regexp_extract(substring(t.sentence, h.\"start\" + 1), '^([^;.!?]*)', 1)) AS z FROM hits h JOIN to_annotate t USING (row_id)) SELECT c.row_id, c.\"start\", p.\"start\" AS arg_start, p.label AS arg_label FROM c JOIN pred p ON p.row_id = c.row_id AND p.\"start\" >= c.a AND p.\"end\" <= c.z")
def jon08_same_clause(s, d):
    t = F.col("sentence")
    rows = _anno(s, d).select("row_id", "sentence", F.explode(S.phrases(t, WORDS)).alias("h"), F.concat(*[S.finditer(t, rx, k) for k, rx in PRED.items()]).alias("p"))
    c = events.clause_bounds(t, F.col("h.start"))
    rows = rows.withColumn("c", c).select("row_id", F.col("h.start").alias("start"), F.explode(F.filter("p", lambda e: (e["start"] >= F.col("c.a")) & (e["end"] <= F.col("c.z")))).alias("e"))
    return rows.select("row_id", "start", F.col("e.start").alias("arg_start"), F.col("e.label").alias("arg_label"))


@query(f"WITH {_HITS}, {_PREDS} SELECT h.row_id, h.\"start\", h.label, max(p.\"end\") AS nearest_end FROM hits h LEFT JOIN pred p ON p.row_id = h.row_id AND p.\"end\" <= h.\"start\" GROUP BY ALL")
def jon09_nearest_preceding(s, d):
    t = F.col("sentence")
    ends = F.transform(F.concat(*[S.finditer(t, rx, k) for k, rx in PRED.items()]), lambda x: F.struct(x["end"].alias("end"), x["start"].alias("start")))
    rows = _anno(s, d).select("row_id", F.explode(S.phrases(t, WORDS)).alias("h"), F.array_sort(ends).alias("p"))
    near = S.nearest_before(F.col("p"), F.col("h.start"))
    return rows.select("row_id", F.col("h.start").alias("start"), F.col("h.label").alias("label"), near["end"].alias("nearest_end")).distinct()


@query(f"WITH {_HITS}, {_PREDS} SELECT h.row_id, h.\"start\", h.label, count(p.row_id) AS near FROM hits h LEFT JOIN pred p ON p.row_id = h.row_id AND abs(p.\"start\" - h.\"start\") < 150 GROUP BY ALL")
def jon10_band(s, d):
    h, p = _hits(s, d), _pred(s, d).select("row_id", F.col("start").alias("ps"))
    hit = h.join(p, "row_id").where(F.abs(F.col("ps") - F.col("start")) < 150).groupBy("row_id", "start", "label").agg(F.count("*").alias("near"))
    return h.select("row_id", "start", "label").distinct().join(hit, ["row_id", "start", "label"], "left").na.fill(0, ["near"])


@query(f"WITH {_HITS}, {_PREDS} SELECT h.row_id, h.label, p.label AS arg_label, count(*) AS pairs FROM hits h JOIN pred p ON p.row_id = h.row_id AND NOT (p.\"start\" < h.\"end\" AND h.\"start\" < p.\"end\") GROUP BY ALL")
def jon11_pairs(s, d):
    h, p = _hits(s, d), _pred(s, d).select("row_id", F.col("start").alias("ps"), F.col("end").alias("pe"), F.col("label").alias("arg_label"))
    return h.join(p, "row_id").where(~((F.col("ps") < F.col("end")) & (F.col("start") < F.col("pe")))).groupBy("row_id", "label", "arg_label").agg(F.count("*").alias("pairs"))


@query(f"WITH {_PREDS} SELECT row_id, \"start\", \"end\", nxt - \"end\" AS gap FROM (SELECT *, lead(\"start\") OVER (PARTITION BY row_id ORDER BY \"start\", \"end\", label) AS nxt FROM pred) WHERE nxt IS NOT NULL")
def jon15_adjacent(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("row_id").orderBy("start", "end", "label")
    return _pred(s, d).withColumn("nxt", F.lead("start").over(w)).where("nxt is not null").select("row_id", "start", "end", (F.col("nxt") - F.col("end")).alias("gap"))


# Scores

_FLAGS = "flags AS (SELECT row_id, \"start\", \"end\", label, max(g) AS g, max(p) AS p FROM (SELECT row_id, \"start\", \"end\", label, 1 AS g, 0 AS p FROM gold UNION ALL SELECT row_id, \"start\", \"end\", label, 0, 1 FROM pred) GROUP BY ALL)"
_CNT = "CAST(coalesce(sum(g*p),0) AS BIGINT) AS tp, CAST(coalesce(sum((1-g)*p),0) AS BIGINT) AS fp, CAST(coalesce(sum(g*(1-p)),0) AS BIGINT) AS fn"
_SCORE = "*, round(CASE WHEN tp+fp > 0 THEN tp/CAST(tp+fp AS DOUBLE) ELSE 0 END, 6) AS precision, round(CASE WHEN tp+fn > 0 THEN tp/CAST(tp+fn AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0*tp/(2*tp+fp+fn) ELSE 0 END, 6) AS f1, tp+fn AS support"
_K = ["row_id", "start", "end", "label"]


@query(f"WITH {_GOLD}, {_PREDS}, {_FLAGS}, c AS (SELECT {_CNT} FROM flags) SELECT {_SCORE} FROM c")
def agg22_micro(s, d):
    return metrics.span_scores(_gold(s, d), _pred(s, d), _K, [])


@query(f"WITH {_GOLD}, {_PREDS}, {_FLAGS}, c AS (SELECT label, {_CNT} FROM flags GROUP BY label) SELECT {_SCORE} FROM c")
def agg23_by_label(s, d):
    return metrics.span_scores(_gold(s, d), _pred(s, d), _K, ["label"])


@query(f"WITH {_GOLD}, {_PREDS}, {_FLAGS}, dim AS (SELECT unnest([{', '.join(chr(39) + x + chr(39) for x in V.ENTITY_LABELS)}]) AS label), c AS (SELECT dim.label, {_CNT} FROM dim LEFT JOIN flags USING (label) GROUP BY dim.label UNION ALL SELECT 'ALL', {_CNT} FROM flags) SELECT {_SCORE} FROM c")
def agg24_label_table(s, d):
    return metrics.label_scores(_gold(s, d), _pred(s, d), _K, list(V.ENTITY_LABELS))


_KINDS = """hit AS (SELECT g.row_id, g.label gl, p.label pl FROM flags g JOIN flags p ON g.row_id = p.row_id AND g.g = 1 AND g.p = 0 AND p.g = 0 AND p.p = 1 AND g."start" < p."end" AND p."start" < g."end"),
 said AS (SELECT row_id, text FROM gold UNION ALL SELECT row_id, text FROM pred),
 k AS (SELECT row_id, 'entity_missing' AS category FROM flags WHERE g = 1 AND p = 0
 UNION ALL SELECT row_id, 'entity_extra' FROM flags WHERE g = 0 AND p = 1
 UNION ALL SELECT row_id, 'entity_type_mismatch' FROM hit WHERE gl <> pl
 UNION ALL SELECT row_id, 'entity_boundary_mismatch' FROM hit WHERE gl = pl
 UNION ALL SELECT row_id, 'organization_predicted_as_location' FROM hit WHERE gl = 'ORGANIZATION' AND pl = 'LOCATION'
 UNION ALL SELECT row_id, 'location_predicted_as_person' FROM hit WHERE gl = 'LOCATION' AND pl = 'PERSON'
 UNION ALL SELECT row_id, 'person_misrecognized' FROM hit WHERE gl = 'PERSON' OR pl = 'PERSON'
 UNION ALL SELECT row_id, 'multiple_entities' FROM gold GROUP BY row_id HAVING count(*) > 1
 UNION ALL SELECT row_id, 'abbreviation' FROM said WHERE regexp_matches(text, '(?:^|[^\\p{L}\\p{N}_])[A-ZĐ]{2,}(?:$|[^\\p{L}\\p{N}_])|(?:[A-Za-zÀ-ỹĐđ]\\.){2,}')
 UNION ALL SELECT row_id, 'punctuation' FROM said WHERE regexp_matches(text, '[.,;:/()-]')
 UNION ALL SELECT row_id, 'repeated_prediction' FROM pred GROUP BY row_id, label, "start", "end" HAVING count(*) > 1)"""
# A second stand-in predictor with wrong types and bounds, so that every category has rows.
WRONG = {"TIME": r"ngày \d{1,2}/\d{1,2}", "MONEY": r"\d+(?:[.,]\d+)*(?: (?:triệu|tỷ|tỉ))? (?:đồng|USD)", "LOCATION": r"(?:Công an|Tòa án|TAND|UBND)(?: \p{L}+){1,2}", "PERSON": r"\p{Lu}\p{L}+ \p{Lu}\p{L}+"}


@query(f"WITH {_GOLD}, pred AS ({_found(WRONG)}), {_FLAGS}, {_KINDS} SELECT DISTINCT row_id, category FROM k")
def agg27_error_categories(s, d):
    t = F.col("sentence")
    rows = _gold_arrays(s, d).select("row_id", metrics.error_kinds(t, F.col("spans"), F.concat(*[S.finditer(t, rx, k) for k, rx in WRONG.items()])).alias("k"))
    return rows.select("row_id", F.explode("k").alias("category"))


def _records(s, d, engine: str) -> DataFrame:
    t = F.col("sentence")
    base = _anno(s, d).select(F.col("row_id").cast("string").alias("ann_id"), "sentence", F.transform(S.located(t, S.parse_entities(F.col("entities"))), lambda e, i: F.struct(F.concat(F.lit("e"), i.cast("string")).alias("id"), e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["text"].alias("text"), e["label"].alias("label"))).alias("entities"))
    base = base.withColumn("triggers", events.triggers(t, F.col("entities"), engine))
    return base.withColumn("relations", events.link(t, F.col("triggers"), F.col("entities")))


# Stand-ins for two trigger finders and a linker, so that event scores can be stated in SQL: some triggers are missed, some extra, some of another type.
OTHER = {"KHOI_TO": ["khởi tố", "truy tố"], "BAT_GIU": ["thu giữ"], "XET_XU": ["xét xử"], "CUOP_TROM": ["trộm cắp", "đột nhập"]}
ROLES = {"PERSON": "DOI_TUONG", "LOCATION": "DIA_DIEM", "TIME": "THOI_GIAN"}
_REACH = {"gold": 60, "pred": 40}


def _stand_in(s, d, words: dict[str, list[str]], reach: int) -> DataFrame:
    """Event records: phrases as triggers, entities that begin within ``reach`` characters of a trigger as its arguments."""
    t = F.col("sentence")

    def numbered(spans, letter: str):
        return F.transform(spans, lambda x, i: F.struct(F.concat(F.lit(letter), i.cast("string")).alias("id"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["text"].alias("text"), x["label"].alias("label")))

    rows = _anno(s, d).select(F.col("row_id").alias("ann_id"), "sentence", numbered(S.located(t, S.parse_entities(F.col("entities"))), "e").alias("entities"), numbered(S.phrases(t, words), "t").alias("triggers"))
    role = lambda e: F.when(e["label"] == "PERSON", ROLES["PERSON"]).when(e["label"] == "LOCATION", ROLES["LOCATION"]).when(e["label"] == "TIME", ROLES["TIME"])
    near = lambda x: F.transform(F.filter("entities", lambda e: (F.abs(e["start"] - x["start"]) < reach) & role(e).isNotNull()), lambda e: F.struct(x["id"].alias("trigger_id"), e["id"].alias("arg_id"), role(e).alias("role")))
    return rows.withColumn("relations", F.flatten(F.transform("triggers", near)))


def _trigger_sql(name: str, words: dict[str, list[str]]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT t.row_id, m.start AS s, m.\"end\" AS e, '{k}' AS label FROM to_annotate t, LATERAL {finditer('t.sentence', '(?i)' + p)} m WHERE t.sentence IS NOT NULL AND NOT regexp_matches(CASE WHEN m.start > 0 THEN substring(t.sentence, m.start, 1) ELSE '' END, '\\p{{L}}') AND NOT regexp_matches(substring(t.sentence, m.\"end\" + 1, 1), '\\p{{L}}')"
        for k, some in words.items() for p in some
    )
    return f"{name} AS (SELECT DISTINCT * FROM ({parts}))"


_ROLE = "CASE g.label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLES.items()) + " END"


def _side_sql(n: str) -> str:
    return f"""{n}_rel AS (SELECT DISTINCT t.row_id, t.s, t.e, t.label, g."start" AS a, g."end" AS z, {_ROLE} AS role FROM {n}_trig t JOIN gold g ON g.row_id = t.row_id AND abs(g."start" - t.s) < {_REACH[n]} AND {_ROLE} IS NOT NULL),
 {n}_all AS (SELECT DISTINCT 'trigger_identification' AS metric, concat_ws(':', row_id, s, e) AS k FROM {n}_trig UNION ALL SELECT DISTINCT 'trigger_classification', concat_ws(':', row_id, s, e, label) FROM {n}_trig
 UNION ALL SELECT DISTINCT 'argument_identification', concat_ws(':', row_id, a, z, role) FROM {n}_rel UNION ALL SELECT DISTINCT 'relation', concat_ws(':', row_id, s, e, label, a, z, role) FROM {n}_rel
 UNION ALL SELECT DISTINCT 'event', concat_ws(':', t.row_id, t.s, t.e, t.label, coalesce((SELECT string_agg(concat_ws('-', r.a, r.z, r.role), ',' ORDER BY r.a, r.z, r.role) FROM {n}_rel r WHERE r.row_id = t.row_id AND r.s = t.s AND r.e = t.e AND r.label = t.label), '')) FROM {n}_trig t)"""


_EVENTS = f"WITH {_GOLD}, {_trigger_sql('gold_trig', WORDS)}, {_trigger_sql('pred_trig', OTHER)}, {_side_sql('gold')}, {_side_sql('pred')}"


@query(f"{_EVENTS}, f AS (SELECT metric, k, max(g) AS g, max(p) AS p FROM (SELECT metric, k, 1 AS g, 0 AS p FROM gold_all UNION ALL SELECT metric, k, 0, 1 FROM pred_all) GROUP BY ALL), c AS (SELECT metric, {_CNT} FROM f GROUP BY metric) SELECT {_SCORE} FROM c")
def agg25_event_scores(s, d):
    """The five event metrics of one stand-in against another."""
    return metrics.event_scores(_stand_in(s, d, WORDS, _REACH["gold"]), _stand_in(s, d, OTHER, _REACH["pred"]))


_ONE = 'SELECT row_id, s, e, max(label) AS label FROM {} GROUP BY row_id, s, e'


@query(f"{_EVENTS}, b AS (SELECT g.label AS gold, p.label AS pred FROM ({_ONE.format('gold_trig')}) g FULL JOIN ({_ONE.format('pred_trig')}) p ON g.row_id = p.row_id AND g.s = p.s AND g.e = p.e) SELECT CASE WHEN pred IS NULL THEN 'missed' WHEN gold IS NULL THEN 'extra' ELSE 'wrong_type' END AS kind, gold, pred, count(*) AS n FROM b WHERE gold IS DISTINCT FROM pred GROUP BY ALL")
def agg26_trigger_errors(s, d):
    return metrics.trigger_errors(_stand_in(s, d, WORDS, _REACH["gold"]), _stand_in(s, d, OTHER, _REACH["pred"])).groupBy("kind", "gold", "pred").agg(F.count("*").alias("n"))


@query()
def agg25_engine_scores(s, d):
    """The five event metrics of the baseline against the service engine."""
    return metrics.event_scores(_records(s, d, "baseline"), _records(s, d, "service"))


@query(f"WITH {_GOLD} SELECT t.split, count(*) AS sentences, count(g.n) AS with_entities, CAST(coalesce(sum(g.n), 0) AS BIGINT) AS entities FROM to_annotate t LEFT JOIN (SELECT row_id, count(*) AS n FROM gold GROUP BY row_id) g USING (row_id) WHERE t.sentence IS NOT NULL GROUP BY t.split")
def agg21_annotation_stats(s, d):
    n = F.size(S.located(F.col("sentence"), S.parse_entities(F.col("entities"))))
    return _anno(s, d).select("split", n.alias("n")).groupBy("split").agg(F.count("*").alias("sentences"), F.count_if(F.col("n") > 0).alias("with_entities"), F.sum("n").alias("entities"))


# Triggers, roles, recognisers


@query()
def trg_a_preannotation(s, d):
    return _flat(_sents(s, d).select("row_id", events.triggers_a(F.col("sentence")).alias("spans")))


@query("SELECT row_id, regexp_matches(lower(sentence), 'khởi tố|thu giữ|bắt quả tang') AS has_keyword FROM sentences")
def flt06_keyword_presence(s, d):
    return table(s, d, "sentences").select("row_id", F.lower("sentence").rlike("khởi tố|thu giữ|bắt quả tang").alias("has_keyword"))


@query()
def trg_b_baseline(s, d):
    return _flat(_sents(s, d).select("row_id", events.triggers(F.col("sentence"), None, "baseline").alias("spans")))


@query()
def trg_c_service(s, d):
    return _flat(_sents(s, d).select("row_id", events.triggers(F.col("sentence"), None, "service").alias("spans")))


@query()
def rel_a_linked(s, d):
    return _records(s, d, "baseline").select("ann_id", F.explode("relations").alias("r")).select("ann_id", "r.*")


@query()
def rel_b_events(s, d):
    t = F.col("sentence")
    rows = _gold_arrays(s, d).withColumn("triggers", events.triggers(t, None, "service"))
    ev = rows.select("row_id", F.explode(events.service_events(t, F.col("triggers"), F.col("spans"))).alias("e"))
    return ev.select("row_id", F.col("e.event_type").alias("event_type"), F.col("e.trigger.start").alias("start"), F.size("e.arguments").alias("arguments"))


@query()
def rel_c_scored_roles(s, d):
    """Role choice over masked scores; the stand-in scorer prefers roles by the entity's distance."""
    rec = _records(s, d, "baseline")
    flat = rec.select("ann_id", F.explode("triggers").alias("t"), "entities").select("ann_id", "t", F.explode("entities").alias("e"))
    score = F.array(F.lit(0.1), *[F.lit(1.0 / (i + 1)) - F.abs(F.col("e.start") - F.col("t.start")) / 200 for i in range(len(V.ROLE_LABELS))])
    return flat.select("ann_id", F.col("t.id").alias("trigger_id"), F.col("e.id").alias("arg_id"), events.choose_role(score, F.col("e.label"), list(V.ROLE_LABELS)).alias("role")).where("role <> 'NONE'")


@query()
def ner_a_preannotation(s, d):
    return _flat(_sents(s, d).select("row_id", entities.entities(F.col("sentence"), "preannotation").alias("spans")))


@query()
def ner_b_rules(s, d):
    return _flat(_sents(s, d).select("row_id", entities.entities(F.col("sentence")).alias("spans")))


@query()
def ner_b_provenance(s, d):
    rows = _sents(s, d).select("row_id", F.explode(entities.explained(F.col("sentence"))).alias("c"))
    return rows.groupBy("c.rule", "c.label").agg(F.count("*").alias("candidates"), F.count_if("c.selected").alias("selected"))


@query()
def spn14_aligned(s, d):
    rec = spread(_anno(s, d).select("row_id", "sentence", "entities")).select("row_id", align.aligned(F.col("sentence"), S.parse_entities(F.col("entities"))).alias("r"))
    return rec.select("row_id", F.size("r.tokens").alias("tokens"), F.size("r.entities").alias("entities"), F.col("r.removed").alias("removed"), F.col("r.error").alias("error"))


@query()
def spn21_checked(s, d):
    """Annotation rows that do not fit, mentions found from left to right; the labels of every second row's first item are taken away, so that there are some."""
    broken = F.when(F.col("row_id") % 2 == 0, F.regexp_replace("entities", r"\|\p{L}+", "")).otherwise(F.col("entities"))
    rows = spread(_anno(s, d).select("row_id", "sentence", broken.alias("entities")))
    return rows.select("row_id", align.checked(F.col("sentence"), F.col("entities")).alias("error")).where("error is not null")


@query()
def lint_issues(s, d):
    return lint.lint(annotation.from_cells(_anno(s, d)), "row_id")


@query()
def lint_counts(s, d):
    return lint.lint(annotation.from_cells(_anno(s, d)), "row_id").groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("rows"))


# Stand-in records for the lint: entities one character longer than annotated, so that signs after them are inside, and some single verbs as triggers.
LINT_WORDS = {**WORDS, "BAO_LUC": ["giết", "bắt", "đâm"]}
_LINT_REACH = 60
_EXACT_CODES = ("SPAN_DAU_CHAM", "ORG_CHUNG_CHUNG", "LOC_VIET_TAT", "TRIGGER_THIEU_CHU", "TRIGGER_SAI_LOAI", "CO_THE_THIEU_TRIGGER", "PERSON_CHUA_NOI", "ORG_CHUA_NOI_CO_QUAN", "TRIGGER_CHUA_NOI", "TIME_BI_TACH", "TRIGGER_BI_TACH")


def _lint_records(s, d) -> DataFrame:
    t = F.col("sentence")
    wider = lambda e: F.struct(e["id"].alias("id"), e["start"].alias("start"), F.least(e["end"] + 1, F.length(t)).alias("end"), F.trim(t.substr(e["start"] + 1, e["end"] + 1 - e["start"])).alias("text"), e["label"].alias("label"))
    turned = lambda r: F.struct(r["trigger_id"].alias("from_id"), r["arg_id"].alias("to_id"), r["role"].alias("role"))
    return _stand_in(s, d, LINT_WORDS, _LINT_REACH).select(F.col("ann_id").alias("row_id"), "sentence", F.transform("entities", wider).alias("entities"), "triggers", F.transform("relations", turned).alias("relations"))


def _lint_sql() -> str:
    quoted = lambda some: ", ".join(f"'{x}'" for x in some)
    near = f"abs(g.\"start\" - t.s) < {_LINT_REACH} AND {_ROLE} IS NOT NULL"
    missed = " UNION ALL ".join(f"SELECT x.row_id, m.start AS s, m.\"end\" AS e, m.text FROM to_annotate x, LATERAL {finditer('x.sentence', '(?i)' + phrase)} m WHERE x.sentence IS NOT NULL" for phrase in lint.OFTEN_MISSED)
    return f"""WITH {_GOLD}, {_trigger_sql('trig', LINT_WORDS)}, seen AS ({missed}),
 ent AS (SELECT g.row_id, g."start", g.sentence, g.label, least(g."end" + 1, length(g.sentence)) AS z, trim(substring(g.sentence, g."start" + 1, g."end" + 1 - g."start"), ' ') AS text FROM gold g),
 word AS (SELECT t.*, substring(x.sentence, t.s + 1, t.e - t.s) AS text, x.sentence FROM trig t JOIN to_annotate x USING (row_id)),
 eo AS (SELECT *, lead("start") OVER w AS ns, lead(text) OVER w AS nt, lead(label) OVER w AS nl FROM ent WINDOW w AS (PARTITION BY row_id ORDER BY "start", z, text, label)),
 tt AS (SELECT *, lead(s) OVER w AS ns, lead(text) OVER w AS nt, lead(label) OVER w AS nl FROM word WINDOW w AS (PARTITION BY row_id ORDER BY s, e, text, label))
 SELECT DISTINCT row_id, code, detail FROM (
 SELECT row_id, 'SPAN_DAU_CHAM' AS code, text AS detail FROM ent WHERE text LIKE '%.'
 UNION ALL SELECT row_id, 'ORG_CHUNG_CHUNG', text FROM ent WHERE label = 'ORGANIZATION' AND lower(text) IN ({quoted(lint.GENERIC_ORGS)})
 UNION ALL SELECT row_id, 'LOC_VIET_TAT', text FROM ent WHERE label = 'LOCATION' AND regexp_matches(text, '^[A-Z]{{1,5}}$')
 UNION ALL SELECT row_id, 'TRIGGER_THIEU_CHU', text FROM word WHERE lower(text) = 'giết' AND substring(sentence, e + 1, 4) = ' hại'
 UNION ALL SELECT row_id, 'TRIGGER_SAI_LOAI', text FROM word WHERE lower(text) = 'bắt' AND substring(sentence, e + 1, 4) = ' cóc'
 UNION ALL SELECT row_id, 'CO_THE_THIEU_TRIGGER', text FROM seen n WHERE NOT EXISTS (SELECT 1 FROM trig t WHERE t.row_id = n.row_id AND t.s <= n.s AND n.e <= t.e)
 UNION ALL SELECT g.row_id, 'PERSON_CHUA_NOI', g.text FROM ent g WHERE label = 'PERSON' AND g.row_id IN (SELECT row_id FROM trig) AND NOT EXISTS (SELECT 1 FROM trig t WHERE t.row_id = g.row_id AND {near})
 UNION ALL SELECT row_id, 'ORG_CHUA_NOI_CO_QUAN', text FROM ent WHERE label = 'ORGANIZATION' AND row_id IN (SELECT row_id FROM trig WHERE label IN ({quoted(V.PROCEDURAL_EVENTS)}))
 UNION ALL SELECT t.row_id, 'TRIGGER_CHUA_NOI', t.text FROM word t WHERE t.row_id IN (SELECT row_id FROM ent) AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.row_id = t.row_id AND {near})
 UNION ALL SELECT row_id, 'TIME_BI_TACH', text || ' + ' || nt FROM eo WHERE label = 'TIME' AND nl = 'TIME' AND trim(CASE WHEN ns > z THEN substring(sentence, z + 1, ns - z) ELSE '' END, ' ') = ''
 UNION ALL SELECT row_id, 'TRIGGER_BI_TACH', text || ' + ' || nt FROM tt WHERE label = nl AND trim(CASE WHEN ns > e THEN substring(sentence, e + 1, ns - e) ELSE '' END, ' ') = '')"""


@query(_lint_sql())
def lint_exact_codes(s, d):
    """Eleven of the codes over stand-in records, stated in SQL."""
    return lint.lint(_lint_records(s, d), "row_id").where(F.col("code").isin(*_EXACT_CODES))


@query()
def spn20_violations(s, d):
    return lint.violations(annotation.from_cells(_anno(s, d)), "row_id")


@query()
def rel_f_records(s, d):
    """Rows to labelling tasks with rule predictions, and tasks back to event records."""
    t = F.col("sentence")
    rows = _anno(s, d).withColumn("_e", entities.entities(t, "preannotation"))
    tasks = annotation.prelabelled(rows, F.col("_e"), events.triggers_a(t, F.col("_e")))
    rec = annotation.records(tasks)
    return rec.groupBy("source").agg(F.count("*").alias("records"), F.sum(F.size("entities")).alias("entities"), F.sum(F.size("triggers")).alias("triggers"))


@query()
def mdl06_pipeline(s, d):
    out = models.pipeline(spread(table(s, d, "sentences").select("row_id", "sentence")))
    return out.select("row_id", "status", F.size("entities").alias("entities"), F.size("triggers").alias("triggers"), F.size("events").alias("events"))


@query()
def spn22_marked_pairs(s, d):
    t = F.col("sentence")
    rec = _records(s, d, "baseline").select("ann_id", "sentence", F.explode("triggers").alias("t"), "entities")
    pairs = rec.select("ann_id", "sentence", "t", F.explode(F.filter("entities", lambda e: ~S.overlaps(e, F.col("t")))).alias("e"))
    return pairs.select("ann_id", F.col("t.id").alias("trigger_id"), F.col("e.id").alias("arg_id"), S.marked_pair(t, F.col("t"), F.col("e")).alias("marked"))
