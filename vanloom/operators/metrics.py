"""Exact-match scores from span and event tables: one shuffle on the record key, ratios guarded against empty sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanloom.functions.text import WORD, at


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and support to tp, fp, fn; each is 0 where its denominator is."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f = F.when(F.col("tp") > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return counts.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def matched(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct tuples of both sides with ``g`` and ``p`` flags; null keys compare equal."""
    both = gold.select(*keys).withColumn("g", F.lit(1)).withColumn("p", F.lit(0)).unionByName(pred.select(*keys).withColumn("g", F.lit(0)).withColumn("p", F.lit(1)))
    return both.groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))


def counts(flags: DataFrame, by: list[str]) -> DataFrame:
    tp, fp, fn = F.col("g") * F.col("p"), (1 - F.col("g")) * F.col("p"), F.col("g") * (1 - F.col("p"))
    return flags.groupBy(*by).agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))


def span_scores(gold: DataFrame, pred: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Micro scores per value of ``by`` (columns of ``keys``; empty: one row)."""
    return with_scores(counts(matched(gold, pred, keys), by))


def label_scores(gold: DataFrame, pred: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """A row for every label, found or not, and one for all."""
    flags = matched(gold, pred, keys)
    per = counts(flags, ["label"])
    spark = gold.sparkSession
    dim = spark.createDataFrame([(x,) for x in (*labels, "ALL")], "label string")
    zero = dict.fromkeys(("tp", "fp", "fn"), 0)
    both = per.where(F.col("label") != "ALL").unionByName(counts(flags.withColumn("label", F.lit("ALL")), ["label"]))
    return with_scores(F.broadcast(dim).join(both, "label", "left").na.fill(zero))


def event_views(records: DataFrame) -> dict[str, DataFrame]:
    """The five tuple tables of event records (ann_id, entities, triggers, relations); ids play no part in them."""
    t = records.select("ann_id", F.explode("triggers").alias("t"), "entities", "relations")
    trig = t.select("ann_id", F.col("t.start").alias("s"), F.col("t.end").alias("e"), F.col("t.label").alias("label"))
    mine = F.filter("relations", lambda r: r["trigger_id"] == F.col("t.id"))

    def arg(r: Column) -> Column:
        x = at(F.filter(F.col("entities"), lambda e: e["id"] == r["arg_id"]), -1)
        return F.struct(x["start"].alias("s"), x["end"].alias("e"), r["role"].alias("role"))

    args = F.array_sort(F.array_distinct(F.filter(F.transform(mine, arg), lambda a: a["s"].isNotNull())))
    ev = t.select("ann_id", F.col("t.start").alias("s"), F.col("t.end").alias("e"), F.col("t.label").alias("label"), args.alias("args"))
    rel = ev.select("ann_id", "s", "e", "label", F.explode("args").alias("a")).select("ann_id", "s", "e", "label", F.col("a.s").alias("as"), F.col("a.e").alias("ae"), F.col("a.role").alias("role"))
    return {
        "trigger_identification": trig.select("ann_id", "s", "e"),
        "trigger_classification": trig,
        "argument_identification": rel.select("ann_id", "as", "ae", "role"),
        "relation": rel,
        "event": ev.withColumn("args", F.to_json("args")),
    }


def one_prediction(gold: DataFrame, pred: DataFrame, order: str | None = None) -> DataFrame:
    """The predictions of the gold records, one each: of several the last by ``order`` (by position where None). A gold record without a
    prediction is an error that names it; predictions of unknown records are dropped."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    last = pred.withColumn("_at", at).groupBy("ann_id").agg(F.max_by(F.struct(*[c for c in pred.columns if c != "ann_id"]), "_at").alias("_r"))
    both = gold.select("ann_id").distinct().join(last, "ann_id", "left")
    missing = F.raise_error(F.concat(F.lit("no prediction for record "), F.col("ann_id").cast("string")))
    return both.where(F.when(F.col("_r").isNull(), missing).otherwise(F.lit(True))).select("ann_id", "_r.*")


def event_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Scores of the five event metrics; predictions of unknown records are dropped, missing ones count as empty."""
    pred = pred.join(gold.select("ann_id").distinct(), "ann_id", "left_semi")
    g, p = event_views(gold), event_views(pred)
    out = None
    for name in g:
        part = counts(matched(g[name], p[name], g[name].columns).withColumn("metric", F.lit(name)), ["metric"])
        out = part if out is None else out.unionByName(part)
    return with_scores(out)


def trigger_errors(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``ann_id, s, e, kind``: missed, extra and wrongly typed triggers."""
    g = event_views(gold)["trigger_classification"].groupBy("ann_id", "s", "e").agg(F.max("label").alias("gold"))
    p = event_views(pred)["trigger_classification"].groupBy("ann_id", "s", "e").agg(F.max("label").alias("pred"))
    both = g.join(p, ["ann_id", "s", "e"], "full")
    kind = F.when(F.col("pred").isNull(), "missed").when(F.col("gold").isNull(), "extra").when(F.col("gold") != F.col("pred"), "wrong_type")
    return both.withColumn("kind", kind).where("kind is not null")


def trigger_examples(gold: DataFrame, pred: DataFrame, limit: int = 20) -> DataFrame:
    """``ann_id, kind, text, gold, pred, sentence`` of the first ``limit`` trigger errors by record and place."""
    text = gold.groupBy("ann_id").agg(F.max("sentence").alias("sentence"))
    first = trigger_errors(gold, pred).orderBy("ann_id", "s", "e").limit(limit)
    said = F.substring(F.col("sentence"), F.col("s") + 1, F.col("e") - F.col("s")).alias("text")
    return first.join(text, "ann_id").select("ann_id", "kind", said, "gold", "pred", "sentence")


# Names of the event metrics in reports.
EVENT_METRICS = {
    "trigger_identification": "Trigger Identification",
    "trigger_classification": "Trigger F1 (vị trí + loại)",
    "argument_identification": "Argument F1",
    "relation": "Relation F1 (+ vai trò)",
    "event": "Event Exact Match",
}


def evaluation(gold: DataFrame, pred: DataFrame) -> dict:
    """All event scores as one dictionary, ready for JSON: the five metrics, triggers by type, relations by role, and the numbers of gold records
    and of predictions without one. The driver gets one row per metric, type and role."""
    known = gold.select("ann_id").distinct()
    out: dict = {"n_sentences": known.count(), "ignored_extra_predictions": pred.select("ann_id").distinct().join(known, "ann_id", "left_anti").count()}
    numbers = ("tp", "fp", "fn", "precision", "recall", "f1", "support")
    for r in event_scores(gold, pred).collect():
        out[r.metric] = {k: r[k] for k in numbers}
    g, p = event_views(gold), event_views(pred.join(known, "ann_id", "left_semi"))
    for name, view, by in (("trigger_by_type", "trigger_classification", "label"), ("relation_by_role", "relation", "role")):
        rows = with_scores(counts(matched(g[view], p[view], g[view].columns), [by])).orderBy(by).collect()
        out[name] = {r[by]: {k: r[k] for k in numbers} for r in rows}
    return out


def format_report(result: dict, title: str = "") -> str:
    """The text report of an ``evaluation``."""
    lines = [f"===== {title} ({result['n_sentences']} câu) =====" if title else "", f"{'Chỉ số':30s} {'P':>7s} {'R':>7s} {'F1':>7s} {'TP':>5s} {'FP':>5s} {'FN':>5s}"]
    for key, name in EVENT_METRICS.items():
        m = result.get(key) or dict.fromkeys(("tp", "fp", "fn", "precision", "recall", "f1"), 0)
        lines.append(f"{name:30s} {m['precision']:7.4f} {m['recall']:7.4f} {m['f1']:7.4f} {m['tp']:5d} {m['fp']:5d} {m['fn']:5d}")
    for key, name in (("trigger_by_type", "Trigger theo loại"), ("relation_by_role", "Relation theo vai trò")):
        lines += ["", f"{name}:"] + [f"  {k:28s} {m['precision']:7.4f} {m['recall']:7.4f} {m['f1']:7.4f}   gold={m['support']}" for k, m in result[key].items()]
    return "\n".join(lines)


def class_weights(labels: DataFrame, power: float = 0.5) -> DataFrame:
    """``label, n, weight``: (total / n) ^ power, normalised to mean 1 over the labels that occur; ``labels`` has a column label."""
    per = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    raw = per.crossJoin(F.broadcast(total)).withColumn("raw", F.pow(F.col("total") / F.col("n"), F.lit(power)))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("label", "n", F.round(F.col("raw") / F.col("mean"), 6).alias("weight"))


# Names of the sentence error categories, abbreviations and the marks looked for in entity texts.
CATEGORIES = ("entity_missing", "entity_extra", "entity_type_mismatch", "entity_boundary_mismatch", "organization_predicted_as_location", "location_predicted_as_person", "person_misrecognized", "multiple_entities", "abbreviation", "punctuation", "repeated_prediction")
SHORT_FORM = rf"(?<![{WORD}])[A-ZĐ]{{2,}}(?![{WORD}])|(?:[A-Za-zÀ-ỹĐđ]\.){{2,}}"
MARKS = r"[.,;:/()\-]"


def error_kinds(sentence: Column, gold: Column, pred: Column) -> Column:
    """Sorted categories of one sentence from its gold and predicted spans (arrays with start, end, label); row-local.

    A span without an exact partner is missing or extra whether or not it overlaps another. Pairs of such spans that overlap give the
    categories of confusion. Several entities, abbreviations and marks in entity texts are counted without an error, too. Null arrays are empty.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string>>")
    span = lambda x: F.struct(x["start"].cast("bigint").alias("start"), x["end"].cast("bigint").alias("end"), x["label"].alias("label"))
    g, p = (F.coalesce(F.transform(c, span), none) for c in (gold, pred))
    left, over = F.array_except(g, p), F.array_except(p, g)

    def confused(which) -> Column:
        return F.exists(left, lambda a: F.exists(over, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]) & which(a["label"], b["label"])))

    def said(pattern: str) -> Column:
        return F.exists(F.concat(g, p), lambda x: F.substring(sentence, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")).rlike(pattern))

    found = {
        "entity_missing": F.size(left) > 0,
        "entity_extra": F.size(over) > 0,
        "entity_type_mismatch": confused(lambda a, b: a != b),
        "entity_boundary_mismatch": confused(lambda a, b: a == b),
        "organization_predicted_as_location": confused(lambda a, b: (a == "ORGANIZATION") & (b == "LOCATION")),
        "location_predicted_as_person": confused(lambda a, b: (a == "LOCATION") & (b == "PERSON")),
        "person_misrecognized": confused(lambda a, b: (a == "PERSON") | (b == "PERSON")),
        "multiple_entities": F.size(g) > 1,
        "abbreviation": said(SHORT_FORM),
        "punctuation": said(MARKS),
        "repeated_prediction": F.size(p) > F.size(F.array_distinct(p)),
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(c, k) for k, c in found.items()])))


def sentence_errors(gold: DataFrame, pred: DataFrame, text: DataFrame, key: str = "row_id") -> DataFrame:
    """``key, category`` of each sentence of ``text`` (key, sentence); gold, pred: key, start, end, label. One shuffle on the key."""
    side = lambda df, name: df.groupBy(key).agg(F.collect_list(F.struct("start", "end", "label")).alias(name))
    rows = text.join(side(gold, "_g"), key, "left").join(side(pred, "_p"), key, "left")
    return rows.select(key, F.explode(error_kinds(F.col("sentence"), F.col("_g"), F.col("_p"))).alias("category"))
