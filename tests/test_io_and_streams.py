import json

import pytest
from pyspark.sql import functions as F

from vanloom.operators import models
from vanloom.sources import io
from vanloom.streaming import pipeline


def test_csv_keeps_text_and_strips_the_mark(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿Summarize,Content\nNA,"dòng 1\ndòng ""2"""\n,x\n', encoding="utf-8")
    rows = io.read_csv(spark, str(p), "Summarize string, Content string").collect()
    assert [tuple(r) for r in rows] == [("NA", 'dòng 1\ndòng "2"'), ("", "x")]
    assert io.read_csv(spark, str(p), "Summarize string, Content string", missing=True).first().Summarize == ""


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"ann_id": "1", "sentence": "x"}\n\n{"ann_id": "2"}\n', encoding="utf-8")
    assert io.read_jsonl(spark, str(p)).count() == 2
    p.write_text('{"ann_id": "1"}\nnot json\n', encoding="utf-8")
    assert io.read_jsonl(spark, str(p), strict=False).where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception, match="malformed JSON"):
        io.read_jsonl(spark, str(p)).collect()


def test_legacy_labels(spark, tmp_path):
    p = tmp_path / "n.jsonl"
    p.write_text('{"sentence": "x", "labels": ["B-DATE/TIME", "I-DATE_TIME", "O"]}\n', encoding="utf-8")
    assert io.read_ner(spark, str(p)).first().labels == ["B-TIME", "I-TIME", "O"]


def test_annotation_errors(spark):
    rows = [("x", "NONE"), ("x", ""), ("", "NONE"), ("x", "Nam|PER"), ("x", "Nam"), ("x", "Nam|FOO"), (None, None)]
    got = [r.error for r in io.annotated(spark.createDataFrame(rows, "sentence string, entities string")).collect()]
    assert got == [None, "empty entities", "empty sentence", None, "item without label", "unknown label", "empty sentence"]


def test_annotated_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Nam ở Huế", [(6, 9, "Huế", "LOCATION"), (0, 3, "Nam", "PERSON")]), ("trống", [])], "sentence string, entities array<struct<start:int,end:int,text:string,label:string>>")
    io.write_annotated(df, str(tmp_path / "o"))
    back = {r.sentence: r.entities for r in io.read_csv(spark, str(tmp_path / "o"), "sentence string, entities string").collect()}
    assert back == {"Nam ở Huế": "Nam|PERSON; Huế|LOCATION", "trống": "NONE"}


def test_rules_and_schema(tmp_path):
    p = tmp_path / "r.json"
    p.write_text("﻿" + json.dumps({"loc": ["Huế"], "PERSON": ["Nam"]}), encoding="utf-8")
    assert io.rules(str(p)) == {"LOCATION": ["Huế"], "PERSON": ["Nam"]} and io.rules(str(tmp_path / "none")) == {}
    p.write_text(json.dumps({"FOO": []}))
    with pytest.raises(ValueError):
        io.rules(str(p))
    p.write_text(json.dumps({"ner_labels": [], "argument_mapping": {}}))
    with pytest.raises(ValueError):
        io.argument_schema(str(p))


def test_inputs_stay_in_their_folder(tmp_path):
    (tmp_path / "a.csv").write_text("x")
    assert io.input_file(str(tmp_path)).endswith("a.csv")
    for bad in ("../a.csv", "/etc/passwd", "a.txt"):
        with pytest.raises(ValueError):
            io.input_file(str(tmp_path), bad)
    (tmp_path / "b.csv").write_text("x")
    with pytest.raises(ValueError):
        io.input_file(str(tmp_path))


def test_pipeline_status(spark):
    df = spark.createDataFrame([("Công an bắt giữ Nam",), ("  ",), (None,)], "sentence string")
    assert [r.status for r in models.pipeline(df).collect()] == ["OK", "EMPTY", "EMPTY"]
    assert [r.status for r in models.pipeline(df, source="model").collect()] == ["NO_MODEL", "EMPTY", "EMPTY"]


def test_plugged_in_model(spark):
    def load():
        return lambda texts: [[{"start": 0, "end": 1, "text": t[:1], "label": "PERSON"}] if t else [] for t in texts]

    df = spark.createDataFrame([("Nam",), (None,)], "sentence string")
    got = [r.r for r in df.select(models.predicted_entities(F.col("sentence"), load).alias("r")).collect()]
    assert got[0][0].text == "N" and got[1] == []


def test_pieces():
    two = lambda w: [1] * len(w)
    assert models.first_piece_labels(["ab", "c"], ["B-X", "O"], two, True) == ([1, 1, 1], ["B-X", None, "O"])
    assert len(models.first_piece_labels(["ab", "c"], ["B-X", "O"], two, True, limit=2)[0]) == 2
    with pytest.raises(ValueError):
        models.first_piece_labels(["abc"], ["O"], two, False, limit=2)


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"sentence": "Công an bắt giữ Nam", "posted_at": "2024-01-01T00:00:00"}, {"sentence": "công an, bắt giữ NAM!", "posted_at": "2024-01-01T00:10:00"}, {"sentence": "Mưa to", "posted_at": "2024-01-02T00:00:00"}]
    (src / "a.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    stream = pipeline.first_within(pipeline.sentence_stream(spark, str(src)), "posted_at")
    q = pipeline.annotate(stream).select("sentence", F.size("triggers").alias("n")).writeStream.format("memory").queryName("s1").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.sentence, r.n) for r in spark.table("s1").collect()}
    assert len(got) == 2 and ("Mưa to", 0) in got
    batch = pipeline.annotate(spark.createDataFrame([(r["sentence"],) for r in rows], "sentence string"))
    assert got <= {(r.sentence, r.n) for r in batch.select("sentence", F.size("triggers").alias("n")).collect()}
