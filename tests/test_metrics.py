import pytest
from pyspark.sql import functions as F

from vanloom.operators import metrics
from vanloom.sources.io import EVENT_RECORD


def record(spark, label="BAT_GIU", role="DOI_TUONG", ids=("t0", "e0"), key="a1"):
    row = (key, None, None, None, "Bắt giữ Nam", [(ids[1], 8, 11, "Nam", "PERSON")], [(ids[0], 0, 7, "Bắt giữ", label)], [(ids[0], ids[1], role)])
    return spark.createDataFrame([row], EVENT_RECORD)


def scores(gold, pred):
    return {r.metric: r for r in metrics.event_scores(gold, pred).collect()}


def test_gold_against_itself(spark):
    assert all(r.f1 == 1.0 for r in scores(record(spark), record(spark)).values())


def test_wrong_role_costs_relation_and_event_only(spark):
    got = scores(record(spark), record(spark, role="NAN_NHAN"))
    assert got["trigger_classification"].f1 == 1.0 and got["trigger_identification"].f1 == 1.0
    assert got["relation"].tp == 0 and got["event"].tp == 0


def test_wrong_type(spark):
    got = scores(record(spark), record(spark, label="THU_GIU"))
    assert got["trigger_identification"].f1 == 1.0 and got["trigger_classification"].f1 == 0.0 and got["relation"].tp == 0


def test_ids_play_no_part(spark):
    assert scores(record(spark), record(spark, ids=("x", "y")))["event"].f1 == 1.0


def test_unknown_predictions_are_dropped(spark):
    got = scores(record(spark), record(spark).unionByName(record(spark, key="zz")))
    assert got["event"].fp == 0


SPAN = "row_id int, start int, end int, label string"


def test_precision_and_recall(spark):
    gold = spark.createDataFrame([(1, 0, 3, "PERSON")], SPAN)
    pred = spark.createDataFrame([(1, 0, 3, "PERSON"), (1, 5, 8, "PERSON")], SPAN)
    r = metrics.span_scores(gold, pred, ["row_id", "start", "end", "label"], []).first()
    assert (r.precision, r.recall) == (0.5, 1.0)


def test_same_offsets_in_two_sentences_stay_apart(spark):
    gold = spark.createDataFrame([(1, 0, 3, "PERSON"), (2, 0, 3, "PERSON")], SPAN)
    r = metrics.span_scores(gold, gold.where("row_id = 1"), ["row_id", "start", "end", "label"], []).first()
    assert (r.precision, r.recall) == (1.0, 0.5)


def test_every_label_has_a_row_even_on_empty_input(spark):
    none = spark.createDataFrame([], SPAN)
    got = metrics.label_scores(none, none, ["row_id", "start", "end", "label"], ["A", "B"]).collect()
    assert {r.label for r in got} == {"A", "B", "ALL"} and all(r.f1 == 0 for r in got)


def test_rare_labels_weigh_more(spark):
    rows = spark.createDataFrame([("O",)] * 90 + [("B-DRUG",)] * 10, "label string")
    w = {r.label: r.weight for r in metrics.class_weights(rows).collect()}
    assert w["B-DRUG"] > w["O"] and sum(w.values()) / 2 == pytest.approx(1.0, abs=1e-5)


def test_error_categories(spark):
    gold = spark.createDataFrame([(1, 0, 3, "ORGANIZATION"), (1, 5, 9, "PERSON"), (2, 0, 2, "TIME")], SPAN)
    pred = spark.createDataFrame([(1, 0, 3, "LOCATION"), (1, 6, 9, "PERSON")], SPAN)
    text = spark.createDataFrame([(1, "a"), (2, "TP. x")], "row_id int, sentence string")
    got = {(r.row_id, r.category) for r in metrics.sentence_errors(gold, pred, text).collect()}
    assert {(1, "entity_type_mismatch"), (1, "organization_predicted_as_location"), (1, "entity_boundary_mismatch"), (1, "multiple_entities"), (2, "entity_missing"), (2, "abbreviation")} <= got
    # A span without an exact partner is missing or extra, also where it overlaps another one.
    assert {(1, "entity_missing"), (1, "entity_extra"), (1, "person_misrecognized")} <= got and (2, "entity_extra") not in got


def test_error_categories_of_one_span_cut_short(spark):
    gold, pred = spark.createDataFrame([(1, 0, 5, "PERSON")], SPAN), spark.createDataFrame([(1, 0, 3, "PERSON")], SPAN)
    got = {r.category for r in metrics.sentence_errors(gold, pred, spark.createDataFrame([(1, "An Văn"), (2, None)], "row_id int, sentence string")).collect()}
    assert got == {"entity_missing", "entity_extra", "entity_boundary_mismatch", "person_misrecognized"}


def test_trigger_errors(spark):
    got = metrics.trigger_errors(record(spark), record(spark, label="KHOI_TO")).select("kind").collect()
    assert [r.kind for r in got] == ["wrong_type"]
    missing = record(spark).withColumn("triggers", F.slice("triggers", 1, 0))
    assert [r.kind for r in metrics.trigger_errors(record(spark), missing).collect()] == ["missed"]
