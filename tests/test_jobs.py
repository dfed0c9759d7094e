"""Command-line jobs, sinks and plug-ins, on files."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from vanloom import jobs
from vanloom.operators import align, dedup, metrics, models
from vanloom.sources import io

ROWS = [
    ("Công an TP. Huế bắt Trần Văn An ngày 3/5.", "Trần Văn An|PERSON; ngày 3/5|TIME"),
    ("Bị cáo Lê Thị Bình nộp lại 20 triệu đồng.", "Lê Thị Bình|PERSON; 20 triệu đồng|MONEY"),
    ("Hội đồng xét xử nghị án kéo dài đến chiều.", "NONE"),
    ("Nguyễn Văn Cường bị khởi tố về tội trộm cắp tài sản.", "Nguyễn Văn Cường|PERSON; trộm cắp tài sản|CRIME"),
    ("Tổ công tác thu giữ 5 gói ma túy đá tại bến xe.", "ma túy đá|DRUG"),
    ("Vụ việc đang được làm rõ, người dân không nên hoang mang.", "NONE"),
]


def csv(spark, path, rows):
    io.write_csv(spark.createDataFrame(rows, "sentence string, entities string").coalesce(1), str(path), bom=True)
    return str(path)


def run(capsys, spark, *argv):
    code = jobs.main(list(argv), spark)
    out = capsys.readouterr()
    return code, json.loads(out.out[out.out.index("{") :]) if code == 0 else out.err


def test_prepare_and_scores(spark, tmp_path, capsys):
    source = csv(spark, tmp_path / "all.csv", [*ROWS, ROWS[0]])
    code, got = run(capsys, spark, "prepare", "--input", source, "--output", str(tmp_path / "out"))
    assert code == 0 and got["total"] == 6 and got["duplicates_removed"] == 1 and got["train"] + got["validation"] + got["test"] == 6
    assert got["validation"] >= 1 and got["test"] >= 1
    code, got = run(capsys, spark, "baseline", "--input", str(tmp_path / "out" / "train.jsonl"))
    assert code == 0 and got["test_examples"] >= 1 and set(got["baseline"]) >= {"PERSON", "ALL"}
    code, got = run(capsys, spark, "analyze", "--input", str(tmp_path / "out" / "train.jsonl"))
    assert code == 0 and got["sentence_count"] >= 1


def test_training_only_rows_stay_in_training(spark, tmp_path, capsys):
    source, known = csv(spark, tmp_path / "all.csv", ROWS), csv(spark, tmp_path / "known.csv", ROWS[:2])
    code, got = run(capsys, spark, "prepare", "--input", source, "--output", str(tmp_path / "o"), "--train-only", known)
    train = {r.sentence for r in io.read_ner(spark, str(tmp_path / "o" / "train.jsonl")).collect()}
    assert code == 0 and {ROWS[0][0], ROWS[1][0]} <= train
    other = csv(spark, tmp_path / "other.csv", [(ROWS[0][0], "Huế|LOCATION")])
    code, err = run(capsys, spark, "prepare", "--input", source, "--output", str(tmp_path / "o"), "--train-only", other)
    assert code == 2 and "different annotation" in err


def test_refusals(spark, tmp_path, capsys):
    assert run(capsys, spark, "predict", "--text", "  ")[0] == 2
    assert run(capsys, spark, "baseline", "--input", str(tmp_path / "none.jsonl"))[0] == 2
    two = csv(spark, tmp_path / "two.csv", [(ROWS[0][0], "NONE"), ROWS[0], ROWS[1], ROWS[2]])
    code, err = run(capsys, spark, "prepare", "--input", two, "--output", str(tmp_path / "o"))
    assert code == 2 and "different annotations" in err
    a, b, c = (csv(spark, tmp_path / n, r) for n, r in (("a.csv", ROWS[:2]), ("b.csv", ROWS[2:3]), ("c.csv", [ROWS[4], (ROWS[0][0] + "!", "NONE")])))
    code, err = run(capsys, spark, "prepare-splits", "--train", a, "--validation", b, "--test", c, "--output", str(tmp_path / "o"))
    assert code == 2 and "train and test" in err
    code, got = run(capsys, spark, "prepare-splits", "--train", a, "--validation", b, "--test", csv(spark, tmp_path / "d.csv", ROWS[4:5]), "--output", str(tmp_path / "o"))
    assert code == 0 and got == {"train": 2, "validation": 1, "test": 1}


def failing():
    def tag(sentences):
        if any("hoang mang" in s for s in sentences):
            raise RuntimeError("no")
        return [[{"start": 0, "end": 3, "text": s[:3], "label": "PERSON"}] if s[0] == "N" else [] for s in sentences]

    return tag


def test_labelling_job(spark, tmp_path, capsys):
    rows = spark.createDataFrame([*[(r[0],) for r in ROWS], ("  ",), (None,)], "sentence string")
    got = {r.sentence: r.entities for r in models.labelled(rows, failing).collect()}
    assert got[ROWS[5][0]] == "PREDICTION_ERROR" and got[ROWS[3][0]] == "Ngu|PERSON" and got[ROWS[0][0]] == "NONE" and got[""] == got["  "] == "NONE"
    io.write_csv(rows.coalesce(1), str(tmp_path / "in.csv"))
    code, out = run(capsys, spark, "label", "--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / "out.csv"))
    assert code == 0 and out["errors"] == 0 and out["without_entities"] >= 2


def test_batch_predict_and_build(spark, tmp_path, capsys):
    io.write_jsonl(spark.createDataFrame([("r1", ROWS[0][0]), (None, ROWS[1][0])], "record_id string, sentence string"), str(tmp_path / "in"))
    code, got = run(capsys, spark, "batch-predict", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"))
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert code == 0 and got["records"] == 2 and {r.record_id for r in rows} == {"r1", "unknown_id"} and {r.label_status for r in rows} == {"PSEUDO_LABEL"}
    code, got = run(capsys, spark, "build", "--input", csv(spark, tmp_path / "x.csv", ROWS), "--output", str(tmp_path / "x.jsonl"))
    assert code == 0 and got["sentences"] == 6 and "token_offsets" in got["fields"]


def test_check_finds_mentions_from_left_to_right(spark, tmp_path, capsys):
    assert align.check("An gặp An", "An|PERSON; An|PERSON") is None
    assert align.check("An gặp Bình", "Bình|PERSON; An|PERSON") is None
    assert "not found" in align.check("An gặp Bình", "Chi|PERSON")
    assert align.check("", "NONE") == "empty sentence" and align.check("a", None) == "empty entities"
    assert "unknown label" in align.check("An", "An|ANIMAL") and "without label" in align.check("An", "An")
    code, got = run(capsys, spark, "check", "--input", csv(spark, tmp_path / "a.csv", [*ROWS, ("An", "Bình|PERSON")]))
    assert code == 0 and got == {"rows": 7, "errors": 1}


def records(spark):
    span = "array<struct<id:string,start:int,end:int,text:string,label:string>>"
    rows = [("a", "Công an khởi tố An", [("e0", 16, 18, "An", "PERSON")], [("t0", 8, 15, "khởi tố", "KHOI_TO")], [("t0", "e0", "DOI_TUONG")])]
    return spark.createDataFrame(rows, f"ann_id string, sentence string, entities {span}, triggers {span}, relations array<struct<trigger_id:string,arg_id:string,role:string>>")


def test_event_evaluation_and_sources(spark, tmp_path, capsys):
    gold = records(spark)
    same = metrics.evaluation(gold, gold)
    assert same["event"]["f1"] == same["trigger_by_type"]["KHOI_TO"]["f1"] == same["relation_by_role"]["DOI_TUONG"]["f1"] == 1.0
    assert "Event Exact Match" in metrics.format_report(same, "x")
    none = metrics.evaluation(gold, gold.where("false"))
    assert none["event"]["f1"] == 0.0 and none["n_sentences"] == 1
    moved = gold.withColumn("triggers", F.slice("triggers", 1, 0))
    assert [(r.kind, r.text) for r in metrics.trigger_examples(gold, moved).collect()] == [("missed", "khởi tố")]
    kept = models.event_records(gold, "gold", "gold").first()
    assert kept.triggers[0].label == "KHOI_TO" and kept.relations[0].role == "DOI_TUONG"
    other = models.event_records(gold, "gold", "rules", entities=gold.select("ann_id", F.slice("entities", 1, 0).alias("entities"))).first()
    assert other.entities == [] and other.relations == []
    tagger = lambda: lambda sentences: [[{"start": 0, "end": 7, "text": s[:7], "label": "BAT_GIU"}] for s in sentences]
    bym = models.event_records(gold, "model", "model", load_triggers=tagger, score=lambda t, trig, e: F.array(F.lit(0.0), *[F.lit(1.0)] * 20)).first()
    assert bym.triggers[0].id == "t0" and bym.triggers[0].label == "BAT_GIU" and bym.relations
    with pytest.raises(ValueError):
        models.event_records(gold, "model")
    io.write_jsonl(gold.withColumn("doc_id", F.lit("d")), str(tmp_path / "gold"))
    code, got = run(capsys, spark, "events", "--gold", str(tmp_path / "gold"), "--baseline", "--save-json", str(tmp_path / "r"), "--save-pred", str(tmp_path / "p"), "--errors", "3")
    assert code == 0 and got["n_sentences"] == 1
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "r")).collect()))["n_sentences"] == 1


def test_data_set_files_and_task_arrays(spark, tmp_path):
    both = records(spark).unionByName(records(spark).withColumn("entities", F.slice("entities", 1, 0)).withColumn("ann_id", F.lit("b")))
    io.write_dataset(both.coalesce(1), str(tmp_path), "train")
    raw = open(glob.glob(str(tmp_path / "train_ner.csv" / "part*"))[0], encoding="utf-8").read()
    assert raw.startswith("\ufeffsentence,entities") and "An|PERSON" in raw
    cells = {r.entities for r in io.read_csv(spark, str(tmp_path / "train_ner.csv"), "sentence string, entities string").collect()}
    assert cells == {"An|PERSON", ""}
    io.write_task_array(both.coalesce(1).select("ann_id", "sentence"), str(tmp_path / "tasks"), per_file=1)
    parts = [json.load(open(p, encoding="utf-8")) for p in glob.glob(str(tmp_path / "tasks" / "part*"))]
    assert sorted(t["ann_id"] for p in parts for t in p) == ["a", "b"] and all(isinstance(p, list) and len(p) == 1 for p in parts)
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_csv(both.select("ann_id"), str(tmp_path / "train_ner.csv"), mode="errorifexists")


def test_annotation_key_is_a_multiset(spark):
    e = "array<struct<text:string,label:string>>"
    df = spark.createDataFrame([(1, [("An", "PERSON"), ("Huế", "LOCATION")]), (2, [("huế", "LOCATION"), ("an", "PERSON")]), (3, [("An", "PERSON"), ("An", "PERSON")]), (4, [("An", "PERSON")]), (5, None)], f"i int, e {e}")
    k = {r.i: r.k for r in df.select("i", dedup.annotation_key(F.col("e")).alias("k")).collect()}
    assert k[1] == k[2] and len({k[1], k[3], k[4], k[5]}) == 4


def test_one_prediction_per_record(spark):
    gold = spark.createDataFrame([("a",), ("b",), ("a",)], "ann_id string")
    pred = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x"), ("z", 1, "extra")], "ann_id string, k int, v string")
    assert {(r.ann_id, r.v) for r in metrics.one_prediction(gold, pred, "k").collect()} == {("a", "new"), ("b", "x")}
    with pytest.raises(Exception, match="no prediction for record b"):
        metrics.one_prediction(gold, pred.where("ann_id <> 'b'"), "k").collect()


def test_sheets_and_empty_files(spark, tmp_path):
    io.write_sheets({"one": spark.createDataFrame([(1, "a")], "i int, t string"), "two": spark.createDataFrame([("b",)], "t string")}, str(tmp_path / "s"))
    got = io.read_sheets(spark, str(tmp_path / "s"), {"one": "i int, t string", "two": "t string"})
    assert got["one"].first().t == "a" and got["two"].first().t == "b"
    (tmp_path / "empty.jsonl").write_text("")
    with pytest.raises(ValueError, match="no records"):
        io.read_ner(spark, str(tmp_path / "empty.jsonl"))


def test_numbered_triggers_of_labels(spark):
    from vanloom.functions import spans as S

    df = spark.createDataFrame([("bắt giữ rồi khởi tố", ["B-BAT_GIU", "I-BAT_GIU", "O", "B-KHOI_TO", "I-KHOI_TO"])], "t string, l array<string>")
    got = df.select(S.bio_triggers(S.finditer(F.col("t"), r"\S+", ""), F.col("l"), F.col("t")).alias("x")).first().x
    assert [(x.id, x.text, x.label) for x in got] == [("t0", "bắt giữ", "BAT_GIU"), ("t1", "khởi tố", "KHOI_TO")]
