"""Command line: ``spark-submit -m vanloom.jobs COMMAND …`` or ``python -m vanloom.jobs COMMAND …``.

Every command reads and writes folders or files that Spark reaches, runs distributed, and prints one JSON object with its counts. Taggers
are named as ``package.module:function``, a function that loads the model once per worker (see ``operators.models``);
without one the rules answer. Exit code 2: a blank text, a missing file, or input that the command refuses.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanloom.functions import spans as S
from vanloom.operators import align, dedup, entities, metrics, models, sampling
from vanloom.operators import vocabulary as V
from vanloom.sources import io

ANNOTATED = "sentence string, entities string"
K = ["row_id", "start", "end", "label"]


class Refused(ValueError):
    """Input that a command does not accept."""


def loader(name: str | None):
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _exists(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise Refused(f"no such file: {path}")
    return path


def aligned_records(spark: SparkSession, path: str) -> DataFrame:
    """Annotated CSV to token records with ``row_id``; a row that does not fit is an error that names its sentence."""
    rows = io.read_csv(spark, _exists(spark, path), ANNOTATED).withColumn("row_id", F.monotonically_increasing_id())
    rows = io.annotated(rows)
    got = rows.select("row_id", F.col("error").alias("_e"), align.aligned(F.col("sentence"), F.col("mentions")).alias("r")).select("row_id", F.coalesce("_e", "r.error").alias("error"), "r.sentence", "r.tokens", "r.token_offsets", "r.labels", "r.entities", F.col("r.removed").alias("overlapping_entities_removed"))
    bad = got.where("error is not null").select("sentence", "error").limit(5).collect()
    if bad:
        raise Refused("; ".join(f"{r.error}: {r.sentence!r}" for r in bad))
    return got.drop("error")


def unique_records(records: DataFrame) -> DataFrame:
    """Records without near copies of earlier ones; equal sentences with different annotations are refused."""
    notes = records.select(F.md5(dedup.sentence_key(F.col("sentence"))).alias("k"), dedup.annotation_key(F.col("entities")).alias("note"), "sentence")
    notes = notes.groupBy("k").agg(F.count_distinct("note").alias("n"), F.min("sentence").alias("sentence"))
    odd = notes.where("n > 1").select("sentence").limit(5).collect()
    if odd:
        raise Refused("same sentence, different annotations: " + "; ".join(r.sentence for r in odd))
    return dedup.fuzzy(records.select("row_id", "sentence")).where("kept_as is null").select("row_id").join(records, "row_id")


def _plain(records: DataFrame) -> DataFrame:
    """Records as they are written: offsets as pairs, no row number."""
    return records.drop("row_id").withColumn("token_offsets", F.transform("token_offsets", lambda o: F.array(o["start"], o["end"])))


def _write_splits(parts: dict[str, DataFrame], out: str) -> dict:
    counts = {}
    for name, df in parts.items():
        io.write_jsonl(_plain(df.drop("split")), os.path.join(out, f"{name}.jsonl"))
        io.bio_rows(df, "row_id").write.mode("overwrite").parquet(os.path.join(out, f"{name}_bio"))
        counts[name] = df.count()
    return counts


def _disjoint(parts: dict[str, DataFrame]) -> None:
    """Refuses sentences that occur, or nearly occur, twice in a split or in two splits."""
    every = None
    for name, df in parts.items():
        one = df.select("sentence").withColumn("split", F.lit(name))
        every = one if every is None else every.unionByName(one)
    every = every.withColumn("row_id", F.monotonically_increasing_id())
    exact, close = dedup.near(every.select("row_id", "sentence"), "sentence", "row_id", 0.85)
    pair = close.select("x", "y").unionByName(exact.where("id <> first").select(F.col("first").alias("x"), F.col("id").alias("y"))).limit(1).join(every.select(F.col("row_id").alias("x"), F.col("split").alias("a"), "sentence"), "x").join(every.select(F.col("row_id").alias("y"), F.col("split").alias("b")), "y").first()
    if pair:
        raise Refused(f"sentence occurs more than once in {pair.a}: {pair.sentence!r}" if pair.a == pair.b else f"sentence occurs in {pair.a} and {pair.b}: {pair.sentence!r}")


def prepare(spark: SparkSession, a: argparse.Namespace) -> dict:
    if not (a.test_ratio > 0 and a.validation_ratio > 0 and a.test_ratio + a.validation_ratio < 1):
        raise Refused("test and validation ratio must be positive, and under 1 together")
    read = dedup.cut(aligned_records(spark, a.input))
    pool = dedup.cut(unique_records(read))
    unique, kept = pool.count(), None
    if a.train_only:
        known = unique_records(aligned_records(spark, a.train_only))
        rest, problems = dedup.reconciled(pool, known)
        first = problems.select("problem", "sentence").first()
        if first:
            raise Refused(f"training-only sentence, {first.problem}: {first.sentence!r}")
        kept = pool.join(rest.select("row_id"), "row_id", "left_anti")
        pool = rest
    if pool.count() < 3:
        raise Refused("at least 3 sentences are needed besides those for training only")
    cut = sampling.ratio_split(pool, "row_id", a.validation_ratio, a.test_ratio, a.seed)
    parts = {n: cut.where(F.col("split") == s).drop("split") for n, s in (("train", "train"), ("validation", "val"), ("test", "test"))}
    if kept is not None:
        parts["train"] = parts["train"].unionByName(kept)
    counts = _write_splits(parts, a.output)
    total = read.agg(F.count("*").alias("n"), F.coalesce(F.sum("overlapping_entities_removed"), F.lit(0)).alias("o")).first()
    return {"total": unique, **counts, "duplicates_removed": total.n - unique, "overlapping_entities_removed": total.o}


def prepare_splits(spark: SparkSession, a: argparse.Namespace) -> dict:
    parts = {n: dedup.cut(aligned_records(spark, p)) for n, p in (("train", a.train), ("validation", a.validation), ("test", a.test))}
    _disjoint(parts)
    return _write_splits(parts, a.output)


def _spans(df: DataFrame, column: str = "entities") -> DataFrame:
    return df.select("row_id", F.explode(column).alias("x")).select("row_id", "x.start", "x.end", "x.label")


def _predicted(records: DataFrame, tagger: str | None) -> DataFrame:
    return records.withColumn("found", models.predicted_entities(F.col("sentence"), loader(tagger)))


def _score(records: DataFrame, tagger: str | None) -> dict:
    rows = metrics.label_scores(_spans(records), _spans(_predicted(records, tagger), "found"), K, list(V.ENTITY_LABELS)).collect()
    return {r.label: {k: r[k] for k in ("precision", "recall", "f1", "support")} for r in rows}


def _test(spark: SparkSession, path: str) -> DataFrame:
    return dedup.cut(io.read_ner(spark, _exists(spark, path)).withColumn("row_id", F.monotonically_increasing_id()))


def baseline(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = _test(spark, a.input)
    return {"test_examples": rows.count(), "baseline": _score(rows, None)}


def evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = _test(spark, a.input)
    return {"test_examples": rows.count(), "baseline": _score(rows, None), "model": _score(rows, a.tagger)}


def predict(spark: SparkSession, a: argparse.Namespace) -> dict:
    if not (a.text or "").strip():
        raise Refused("blank text")
    return {"entities": loader(a.tagger)()([a.text])[0] if a.tagger else entities.recognised(a.text)}


def batch_predict(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = io.read_jsonl(spark, _exists(spark, a.input), "record_id string, sentence string")
    io.write_jsonl(io.pseudo_labels(rows, models.predicted_entities(F.col("sentence"), loader(a.tagger))), a.output)
    return {"records": rows.count(), "output": a.output}


def analyze(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = _predicted(_test(spark, a.input), a.tagger)
    kinds = dedup.cut(rows.select("row_id", "sentence", metrics.error_kinds(F.col("sentence"), F.col("entities"), F.col("found")).alias("categories"), "entities", F.col("found").alias("predicted")))
    counts = {r.c: r.n for r in kinds.select(F.explode("categories").alias("c")).groupBy("c").agg(F.count("*").alias("n")).orderBy("c").collect()}
    if a.output:
        io.write_jsonl(kinds.drop("row_id"), a.output)
    return {"sentence_count": kinds.count(), "category_counts": counts}


def label(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = models.labelled(io.read_csv(spark, _exists(spark, a.input), "sentence string"), loader(a.tagger))
    io.write_csv(rows, a.output, bom=True)
    done = io.read_csv(spark, a.output, ANNOTATED).agg(F.count("*").alias("n"), F.count_if(F.col("entities") == "PREDICTION_ERROR").alias("bad"), F.count_if(F.col("entities") == "NONE").alias("none")).first()
    return {"rows": done.n, "errors": done.bad, "without_entities": done.none}


def build(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = dedup.cut(unique_records(dedup.cut(aligned_records(spark, a.input))))
    io.write_jsonl(_plain(rows), a.output)
    return {"sentences": rows.count(), "fields": rows.drop("row_id").columns}


def check(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = io.read_csv(spark, _exists(spark, a.input), ANNOTATED)
    bad = rows.withColumn("error", align.checked(F.col("sentence"), F.col("entities"))).where("error is not null")
    if a.output:
        io.write_csv(bad, a.output)
    return {"rows": rows.count(), "errors": bad.count()}


def events(spark: SparkSession, a: argparse.Namespace) -> dict:
    gold = dedup.cut(io.read_jsonl(spark, _exists(spark, a.gold)))
    pred = models.event_records(gold) if a.baseline else io.read_jsonl(spark, _exists(spark, a.pred))
    pred = dedup.cut(pred.select("ann_id", "sentence", "entities", "triggers", "relations"))
    if a.save_pred:
        io.write_jsonl(pred, a.save_pred)
    result = metrics.evaluation(gold, pred)
    print(metrics.format_report(result, f"{'rules' if a.baseline else os.path.basename(a.pred)} vs {os.path.basename(a.gold)}"))
    for r in metrics.trigger_examples(gold, pred, a.errors).collect() if a.errors else []:
        print(f"  [{r.ann_id}] {r.kind:10s} {r.text!r} ({r.gold or r.pred}) | {r.sentence}")
    if a.save_json:
        spark.createDataFrame([(json.dumps(result, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(a.save_json)
    return {"n_sentences": result["n_sentences"], "ignored_extra_predictions": result["ignored_extra_predictions"]}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vanloom.jobs", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(run, *options: str, tagger: bool = False, name: str | None = None, **defaults):
        p = commands.add_parser(name or run.__name__.replace("_", "-"))
        for o in options:
            p.add_argument(f"--{o}", required=True)
        for o, v in defaults.items():
            if isinstance(v, bool):
                p.add_argument(f"--{o.replace('_', '-')}", action="store_true")
            else:
                p.add_argument(f"--{o.replace('_', '-')}", default=v, type=type(v) if v is not None else str)
        if tagger:
            p.add_argument("--tagger", help="package.module:function that loads the tagger")
        p.set_defaults(run=run)

    add(prepare, "input", "output", seed=42, test_ratio=0.15, validation_ratio=0.15, train_only=None)
    add(prepare_splits, "output", train="train.csv", validation="valid.csv", test="test.csv")
    add(baseline, "input")
    add(evaluate, "input", tagger=True)
    add(predict, tagger=True, text=None)
    add(batch_predict, "input", "output", tagger=True)
    add(analyze, "input", tagger=True, output=None)
    add(label, "input", "output", tagger=True)
    add(build, "input", "output")
    add(check, "input", output=None)
    add(events, "gold", pred=None, baseline=False, save_pred=None, save_json=None, errors=0)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "events" and bool(a.pred) == a.baseline:
        parser().error("give --pred or --baseline")
    try:
        result = a.run(spark or SparkSession.builder.appName(f"vanloom {a.command}").getOrCreate(), a)
    except Refused as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    print(json.dumps(result, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
