"""Labelling tasks to event records and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanloom.functions.text import at

RESULT = "struct<id:string,type:string,from_name:string,to_name:string,from_id:string,to_id:string,labels:array<string>,value:struct<start:int,end:int,text:string,labels:array<string>>>"
TASK = (
    "inner_id int, data struct<ann_id:string,doc_id:string,sent_id:int,SubLabel:string,sentence:string,double_annotate:boolean>, "
    f"annotations array<struct<was_cancelled:boolean,result:array<{RESULT}>>>, predictions array<struct<model_version:string,result:array<{RESULT}>>>"
)


def chosen(tasks: DataFrame) -> DataFrame:
    """Adds ``result`` and ``source``: the last annotation not cancelled (gold, even if empty), else the last prediction (silver), else none."""
    live = F.filter(F.coalesce("annotations", F.array().cast(f"array<struct<was_cancelled:boolean,result:array<{RESULT}>>>")), lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    preds = F.coalesce("predictions", F.array().cast(f"array<struct<model_version:string,result:array<{RESULT}>>>"))
    none = F.array().cast(f"array<{RESULT}>")
    source = F.when(F.size(live) > 0, "gold").when(F.size(preds) > 0, "silver").otherwise("none")
    result = F.when(F.size(live) > 0, at(live, -1)["result"]).when(F.size(preds) > 0, at(preds, -1)["result"])
    return tasks.withColumn("source", source).withColumn("result", F.coalesce(result, none))


def records(tasks: DataFrame) -> DataFrame:
    """Event records: spans sorted by place, the first label of each, relations turned to run from trigger to entity; others are dropped."""
    t = chosen(tasks)

    def spans(kind: str) -> Column:
        some = F.filter("result", lambda r: (r["type"] == "labels") & (r["from_name"] == kind))
        flat = F.transform(some, lambda r: F.struct(r["value"]["start"].alias("start"), r["value"]["end"].alias("end"), r["id"].alias("id"), r["value"]["text"].alias("text"), at(r["value"]["labels"], 1).alias("label")))
        return F.transform(F.array_sort(flat), lambda s: F.struct(s["id"].alias("id"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["label"].alias("label")))

    t = t.select("data.*", "source", "result", spans("entity").alias("entities"), spans("trigger").alias("triggers"))
    has = lambda spans, i: F.exists(F.col(spans), lambda s: s["id"] == i)
    rels = F.filter("result", lambda r: r["type"] == "relation")
    turned = F.transform(rels, lambda r: F.struct(F.when(has("triggers", r["from_id"]), r["from_id"]).otherwise(r["to_id"]).alias("trigger_id"), F.when(has("triggers", r["from_id"]), r["to_id"]).otherwise(r["from_id"]).alias("arg_id"), at(r["labels"], 1).alias("role")))
    good = F.filter(turned, lambda r: has("triggers", r["trigger_id"]) & has("entities", r["arg_id"]) & r["role"].isNotNull())
    return t.select("ann_id", "doc_id", "SubLabel", "source", "sentence", "entities", "triggers", good.alias("relations"))


def prelabelled(rows: DataFrame, entities: Column, triggers: Column, version: str = "rules") -> DataFrame:
    """Tasks with a prediction made of entities (ids e0, …) and triggers (t0, …)."""

    def result(spans: Column, kind: str) -> Column:
        none = F.lit(None).cast("string")
        return F.transform(spans, lambda s, i: F.struct(F.concat(F.lit(kind[0]), i.cast("string")).alias("id"), F.lit("labels").alias("type"), F.lit(kind).alias("from_name"), F.lit("text").alias("to_name"), none.alias("from_id"), none.alias("to_id"), F.lit(None).cast("array<string>").alias("labels"), F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["text"].alias("text"), F.array(s["label"]).alias("labels")).alias("value")))

    data = F.struct("ann_id", "doc_id", "sent_id", "SubLabel", "sentence", "double_annotate")
    pred = F.array(F.struct(F.lit(version).alias("model_version"), F.concat(result(entities, "entity"), result(triggers, "trigger")).alias("result")))
    return rows.select(data.alias("data"), F.lit(None).cast(f"array<struct<was_cancelled:boolean,result:array<{RESULT}>>>").alias("annotations"), pred.alias("predictions"))


def from_cells(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Annotation rows (``entities`` and ``triggers`` as TEXT|LABEL lists) to records with located spans and ids e0, …, t0, …

    ``arguments`` is read as TRIGGER>ROLE>ENTITY items; those whose ends are not found are dropped.
    """
    from vanloom.functions import spans as S

    def numbered(field: str, letter: str) -> Column:
        return F.transform(S.located(F.col("sentence"), S.parse_entities(F.col(field))), lambda s, i: F.struct(F.concat(F.lit(letter), i.cast("string")).alias("id"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["label"].alias("label")))

    t = rows.where("sentence is not null").select(key, "sentence", "arguments", numbered("entities", "e").alias("entities"), numbered("triggers", "t").alias("triggers"))
    parts = F.transform(F.filter(F.split(F.coalesce("arguments", F.lit("")), ";"), lambda x: F.size(F.split(x, ">")) == 3), lambda x: F.transform(F.split(x, ">"), F.trim))
    find = lambda spans, text: at(F.filter(F.col(spans), lambda s: s["text"] == text), 1)["id"]
    rels = F.transform(parts, lambda p: F.struct(find("triggers", p[0]).alias("from_id"), find("entities", p[2]).alias("to_id"), p[1].alias("role")))
    return t.select(key, "sentence", "entities", "triggers", F.filter(rels, lambda r: r["from_id"].isNotNull() & r["to_id"].isNotNull()).alias("relations"))
