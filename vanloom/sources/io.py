"""Readers and writers of the corpus formats, all with explicit schemas and distributed."""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanloom.functions import spans as S
from vanloom.operators import vocabulary as V
from vanloom.operators.annotation import TASK

BOM = "﻿"
# What the raw scan reads as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
SPAN = "struct<id:string,start:int,end:int,text:string,label:string>"
EVENT_RECORD = f"ann_id string, doc_id string, SubLabel string, source string, sentence string, entities array<{SPAN}>, triggers array<{SPAN}>, relations array<struct<trigger_id:string,arg_id:string,role:string>>"
NER_RECORD = "sentence string, tokens array<string>, token_offsets array<array<int>>, labels array<string>, entities array<struct<text:string,label:string,start:int,end:int>>, overlapping_entities_removed int"


def read_csv(spark: SparkSession, path: str, schema: str, missing: bool = False) -> DataFrame:
    """CSV with header, quoted line breaks and an optional byte-order mark.

    Cells keep their text, "NA" included; with ``missing`` the usual markers of missing values
    become empty texts instead. A null cell is an empty text either way.
    """
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    texts = [c for c, t in df.dtypes if t == "string"]
    first = df.columns[0]
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in texts})
    if first in texts:
        df = df.withColumn(first, F.regexp_replace(first, f"^{BOM}", ""))
    return df.withColumns({c: F.when(F.col(c).isin(*MISSING), "").otherwise(F.col(c)) for c in texts}) if missing else df


def write_csv(df: DataFrame, path: str, bom: bool = False, mode: str = "overwrite") -> None:
    """CSV with header; with ``bom``, each file begins with a byte-order mark, as spreadsheets want it. Mode "errorifexists" guards raw folders."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of labelling tasks; a file is one value."""
    return spark.read.schema(TASK).option("multiLine", True).json(path)


def write_tasks(tasks: DataFrame, path: str) -> None:
    """One task a line, which every JSON reader of tasks takes; null fields are kept."""
    tasks.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_task_array(tasks: DataFrame, path: str, per_file: int = 10_000) -> None:
    """JSON arrays of tasks, which the labelling tool loads as they are: ``per_file`` tasks at most in each file."""

    def arrays(batches):
        held: list[str] = []
        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(x)
                if len(held) == per_file:
                    yield pa.RecordBatch.from_arrays([pa.array(["[" + ",\n".join(held) + "]"])], names=["value"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["[" + ",\n".join(held) + "]"])], names=["value"])

    rows = tasks.select(F.to_json(F.struct(*tasks.columns), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(arrays, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_dataset(records: DataFrame, path: str, name: str) -> None:
    """A data set of event records in both forms: JSON lines under ``name``.jsonl, and ``name``_ner.csv with ``sentence, entities``
    (TEXT|LABEL items; an empty cell for none) and a byte-order mark."""
    write_jsonl(records, os.path.join(path, f"{name}.jsonl"))
    cell = F.array_join(F.transform("entities", lambda e: F.concat(e["text"], F.lit("|"), e["label"])), "; ")
    write_csv(records.select("sentence", F.coalesce(cell, F.lit("")).alias("entities")), os.path.join(path, f"{name}_ner.csv"), bom=True)


def pseudo_labels(rows: DataFrame, entities: Column, key: str = "record_id") -> DataFrame:
    """``record_id, sentence, entities, label_status`` of predicted entities; records without an id are called unknown_id."""
    item = F.transform(entities, lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end")))
    name = F.coalesce(F.col(key).cast("string"), F.lit("unknown_id")) if key in rows.columns else F.lit("unknown_id")
    return rows.select(name.alias("record_id"), "sentence", item.alias("entities"), F.lit("PSEUDO_LABEL").alias("label_status"))


def read_jsonl(spark: SparkSession, path: str, schema: str = EVENT_RECORD, strict: bool = True) -> DataFrame:
    """JSON lines. Blank lines are skipped. A malformed line fails the read, or without ``strict`` comes back in ``_corrupt_record``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    got = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), F.input_file_name().alias("file"))
    flat = got.select("r.*", "file")
    if strict:
        return flat.where(F.when(F.col("_corrupt_record").isNotNull(), F.raise_error(F.concat(F.lit("malformed JSON in "), F.col("file"), F.lit(": "), F.col("_corrupt_record")))).otherwise(F.lit(True))).drop("_corrupt_record", "file")
    return flat


def read_ner(spark: SparkSession, path: str) -> DataFrame:
    """Token records with the legacy date labels rewritten to TIME. A missing file is Spark's error, an empty one a ValueError."""
    old = lambda x: F.regexp_replace(x, "DATE[/_]TIME", "TIME")
    df = read_jsonl(spark, path, NER_RECORD)
    if df.isEmpty():
        raise ValueError(f"no records in {path}")
    return df.withColumn("labels", F.transform("labels", old))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def annotated(df: DataFrame) -> DataFrame:
    """``sentence, entities`` rows with parsed entities and ``error`` for rows the format does not allow: empty sentence or field, item without a label, unknown label."""
    raw = F.trim(F.coalesce("entities", F.lit("")))
    items = S.parse_entities(F.col("entities"))
    loose = F.exists(F.filter(F.transform(F.split(raw, ";"), F.trim), lambda x: x != ""), lambda x: ~x.contains("|"))
    error = (
        F.when(F.trim(F.coalesce("sentence", F.lit(""))) == "", "empty sentence")
        .when(raw == "", "empty entities")
        .when((F.upper(raw) != "NONE") & loose, "item without label")
        .when(F.exists(items, lambda e: ~e["label"].isin(*V.ENTITY_LABELS) | (e["text"] == "")), "unknown label")
    )
    return df.withColumn("mentions", items).withColumn("error", error)


def write_annotated(df: DataFrame, path: str, spans: str = "entities") -> None:
    """``sentence, entities`` CSV, entities by place, NONE for none."""
    write_csv(df.select("sentence", S.format_entities(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["label"].alias("label")))).alias("entities")), path)


def bio_rows(df: DataFrame, key: str) -> DataFrame:
    """``sentence_id, token_index`` (from 1), ``token, label, start, end``."""
    z = F.arrays_zip("tokens", "labels", "token_offsets")
    return df.select(F.col(key).alias("sentence_id"), F.posexplode(z).alias("i", "t")).select("sentence_id", (F.col("i") + 1).alias("token_index"), F.col("t.tokens").alias("token"), F.col("t.labels").alias("label"), F.col("t.token_offsets.start").alias("start"), F.col("t.token_offsets.end").alias("end"))


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split; validation is called valid."""
    df.withColumn("split", F.when(F.col("split").isin("val", "validation"), "valid").otherwise(F.col("split"))).write.mode("overwrite").partitionBy("split").parquet(path)


def write_sheets(frames: dict[str, DataFrame], path: str) -> None:
    """Several tables as the sheets of one report: a folder each."""
    for name, df in frames.items():
        write_csv(df, os.path.join(path, f"sheet={name}"))


def read_sheets(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The named sheets of a report that ``write_sheets`` wrote."""
    return {name: read_csv(spark, os.path.join(path, f"sheet={name}"), schema) for name, schema in schemas.items()}


def rules(path: str) -> dict[str, list[str]]:
    """Rule phrases by label from a small JSON file, a byte-order mark allowed; a missing file gives none. Labels are normalised, unknown ones refused."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8-sig") as f:
        raw = json.load(f)
    out: dict[str, list[str]] = {}
    for label, phrases in raw.items():
        name = S.ALIASES.get(label.strip().upper(), label.strip().upper())
        if name not in V.ENTITY_LABELS or not isinstance(phrases, list) or not all(isinstance(p, str) for p in phrases):
            raise ValueError(f"bad rules for {label!r}")
        out.setdefault(name, []).extend(phrases)
    return out


def argument_schema(path: str | None = None) -> dict[str, tuple[str, ...]]:
    """Role -> admissible labels, from JSON where given, checked to have exactly the known roles and labels."""
    if path is None:
        return dict(V.ROLE_LABELS)
    with open(path, encoding="utf-8-sig") as f:
        raw = json.load(f)
    if set(raw.get("ner_labels", [])) != set(V.ENTITY_LABELS) or set(raw.get("argument_mapping", {})) != set(V.ROLE_LABELS):
        raise ValueError("the schema must have exactly the known labels and roles")
    return {k: tuple(v) for k, v in raw["argument_mapping"].items()}


def roles_for(label: str, schema: dict[str, tuple[str, ...]] | None = None) -> set[str]:
    """Roles that admit a label."""
    return {r for r, labels in (schema or V.ROLE_LABELS).items() if label in labels}


def input_file(folder: str, name: str | None = None, suffix: str = ".csv") -> str:
    """A file inside ``folder``: the named one, or the only one with the suffix. Paths that leave the folder are refused."""
    base = os.path.realpath(folder)
    if name is None:
        some = sorted(f for f in os.listdir(base) if f.endswith(suffix))
        if len(some) != 1:
            raise ValueError(f"{len(some)} {suffix} files in {folder}; name one")
        name = some[0]
    full = os.path.realpath(os.path.join(base, name))
    if not full.startswith(base + os.sep) or not full.endswith(suffix):
        raise ValueError(f"{name!r} is not a {suffix} file inside {folder}")
    return full
