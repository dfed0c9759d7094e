import pytest
from pyspark.sql import functions as F

from vanloom.operators import align, annotation, dedup, entities, events, graph, lint, ranks, sampling, skew
from vanloom.operators import vocabulary as V


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 41), 100, 101, 102, 200, None]], "node int")
    got = {r.node: r.root for r in graph.components(nodes, spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100, 200: 200}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "node int"), spark.createDataFrame([], "a int, b int")).count() == 0


def test_lookup_join_hot_and_cold_keys(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, -1)], "k int, v int")
    table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).withColumn("tag", F.col("k") * 10)
    got = skew.lookup_join(rows, table, "k", "n")
    assert got.count() == 300 and got.where("tag <> k * 10").count() == 0


def test_global_rank(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "x int")
    got = ranks.global_rank(rows, ["x"], "pos", parts=8).collect()
    assert sorted((r.pos, r.x) for r in got) == [(i + 1, i) for i in range(1000)]


def articles(spark, rows):
    return spark.createDataFrame(rows, "split string, row_idx bigint, Summarize string, Content string, extra string")


def test_leak_safe_order_and_flags(spark):
    rows = [("test", 0, "s0", "một hai ba", ""), ("test", 1, "s0", "khác hẳn", ""), ("val", 0, "v", "MỘT, hai ba", ""), ("val", 1, "s0", "x y z", ""), ("train", 0, "t", "x y z", ""), ("train", 1, "", None, ""), ("train", 2, None, "", "")]
    got = {(r.split, r.row_idx): (r.leak, r.dup) for r in dedup.leak_safe(articles(spark, rows)).collect()}
    assert got["test", 1] == (False, True) and got["val", 0] == (True, False) and got["val", 1] == (True, False)
    assert got["train", 0] == (False, False) and got["train", 1] == got["train", 2] == (False, False)


def test_fuzzy_keeps_first_and_is_not_transitive(spark):
    base = "Công an tỉnh Đồng Nai bắt giữ ba đối tượng trộm cắp tài sản ở Biên Hòa sáng nay"
    rows = [(1, base), (2, base + "."), (3, base.upper()), (4, "Hoàn toàn khác, không liên quan gì đến vụ việc trên đây"), (5, None), (6, "ngắn"), (7, "ngắn")]
    got = {r.row_id: r.kept_as for r in dedup.fuzzy(spark.createDataFrame(rows, "row_id bigint, sentence string")).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: None, 5: None, 6: None, 7: 6}


def test_conflicts(spark):
    rows = [("A b", "x|PERSON"), ("a  B", "x|LOCATION"), ("c", "NONE"), ("c", "NONE"), (None, "z")]
    got = dedup.conflicts(spark.createDataFrame(rows, "sentence string, entities string"), "sentence", "entities").collect()
    assert [(r.key, r.n, r.variants) for r in got] == [("a b", 2, 2)]


def test_split_sizes():
    assert sampling.split_sizes(100, 0.1, 0.2) == (70, 10, 20)
    assert sampling.split_sizes(3, 0.1, 0.2) == (1, 1, 1)
    assert sampling.split_sizes(4, 0.9, 0.9)[0] >= 1
    with pytest.raises(ValueError):
        sampling.split_sizes(2, 0.1, 0.1)


def test_sampling_contracts(spark):
    rows = spark.createDataFrame([(i, f"d{i // 4}", "abc"[i % 3] if i < 30 else "a") for i in range(120)], "id int, doc string, g string")
    assert sampling.at_most(rows, "doc", 2, "id").groupBy("doc").count().agg(F.max("count")).first()[0] == 2
    got = sampling.stratified(rows, "g", 60, "id")
    assert got.count() == got.select("id").distinct().count() == 60
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()}["b"] == 10
    again = sampling.stratified(rows.repartition(7), "g", 60, "id")
    assert {r.id for r in got.collect()} == {r.id for r in again.collect()}
    parts = {r.split: r["count"] for r in sampling.ratio_split(rows, "id").groupBy("split").count().collect()}
    assert parts == {"train": 84, "val": 12, "test": 24}


def test_alignment_cases():
    a = align.align("Ông  Nam và Nam", [("Nam", "PERSON", None, None)])
    assert a["labels"] == ["O", "B-PERSON", "O", "B-PERSON"] and a["error"] is None
    a = align.align("gặp Nam-Hà", [("Nam", "PERSON", None, None)], lambda t: ["gặp", "Nam-Hà"])
    assert a["labels"] == ["O", "B-PERSON", "O"]
    a = align.align("Công an Hà Nội", [("Công an Hà Nội", "ORGANIZATION", None, None), ("Hà Nội", "LOCATION", None, None)])
    assert a["removed"] == 1 and [e["label"] for e in a["entities"]] == ["ORGANIZATION"]
    a = align.align("ma tuý đá", [("ma tuý", "DRUG", None, None)], lambda t: ["ma_túy", "đá"])
    assert a["labels"] == ["B-DRUG", "O"] and a["error"] is None
    assert align.align("abc", [("xyz", "PERSON", None, None)])["error"]
    assert align.align("abc", [("abc", "NOPE", None, None)])["error"]
    assert align.align("abc", [("ab", "PERSON", 1, 3)])["error"]


def test_alignment_of_null_rows(spark):
    df = spark.createDataFrame([(None, []), ("Nam", [("Nam", "PERSON")])], "t string, m array<struct<text:string,label:string>>")
    got = [r.r.error for r in df.select(align.aligned(F.col("t"), F.col("m")).alias("r")).collect()]
    assert got == ["empty sentence", None]


SENTENCE = "Công an tỉnh Đồng Nai bắt giữ Nguyễn Văn Nam về tội Trộm cắp tài sản ngày 3/4/2020."


def test_recognisers():
    a = entities.PreAnnotation()(SENTENCE)
    assert (0, 21, "Công an tỉnh Đồng Nai", "ORGANIZATION") in a and ("Trộm cắp tài sản ngày 3/4/2020" in a[1][2] or any(x[3] == "CRIME" for x in a))
    b = entities.RuleRecogniser({"PRODUCT": ["xe máy"]})("Nguyễn Văn Nam ở Hà Nội mua xe máy giá 20 triệu đồng, dao động 5%")
    assert [(x[2], x[3]) for x in b] == [("Nguyễn Văn Nam", "PERSON"), ("Hà Nội", "LOCATION"), ("xe máy", "PRODUCT"), ("20 triệu đồng", "MONEY")]
    spans = sorted((x[0], x[1]) for x in entities.RuleRecogniser()(SENTENCE * 3))
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_trigger_engines(spark):
    b, c = events.BaselineTriggers(), events.ServiceTriggers()
    assert [x[2] for x in b("Công an bắt giữ Nam và thu giữ 2 kg ma túy", [])] == ["BAT_GIU", "THU_GIU"]
    assert b("Nam có ý định cướp ngân hàng", []) == [] and b("bắt đầu", []) == []
    assert [x[2] for x in b("Nam khống chế, bắt giữ tên cướp", [])] == ["BAT_GIU"]
    assert c("Nam không đánh ai", None) == [] and [x[2] for x in c("Nam đâm Hải", None)] == ["BAO_LUC"]
    assert c("Lập biên bản vì đánh nhau", None) == [] and c("mua bán xe máy", None) == []
    assert [x[2] for x in c("mua bán ma túy", None)] == ["MA_TUY"]
    df = spark.createDataFrame([("Nam bị bắt khẩn cấp, bắt đầu khai",), (None,), ("",)], "t string")
    got = [r.r for r in df.select(events.triggers_a(F.col("t")).alias("r")).collect()]
    assert [(x.text, x.label) for x in got[0]] == [("bắt khẩn cấp", "BAT_GIU")] and not got[1] and not got[2]


def linked(spark, sentence, ents, trigs):
    span = "array<struct<id:string,start:int,end:int,text:string,label:string>>"

    def at(items):
        return [(i, sentence.index(t), sentence.index(t) + len(t), t, lab) for i, t, lab in items]

    df = spark.createDataFrame([(sentence, at(ents), at(trigs))], f"s string, e {span}, t {span}")
    return {(r.trigger_id, r.arg_id): r.role for r in df.select(events.link(F.col("s"), F.col("t"), F.col("e")).alias("r")).first().r}


def test_role_rules(spark):
    s = "Công an Hà Nội và Công an Hải Phòng bắt giữ Nam (trú Nghệ An) tại Huế ngày 1/2"
    e = [("o1", "Công an Hà Nội", "ORGANIZATION"), ("o2", "Công an Hải Phòng", "ORGANIZATION"), ("p", "Nam", "PERSON"), ("h", "Nghệ An", "LOCATION"), ("l", "Huế", "LOCATION"), ("d", "1/2", "TIME")]
    assert linked(spark, s, e, [("t0", "bắt giữ", "BAT_GIU")]) == {("t0", "o2"): "CO_QUAN", ("t0", "p"): "DOI_TUONG", ("t0", "l"): "DIA_DIEM", ("t0", "d"): "THOI_GIAN"}
    s = "Nam đâm Hải bằng dao; tòa tuyên phạt Nam 5 năm tù"
    e = [("a", "Hải", "PERSON"), ("k", "dao", "PRODUCT"), ("y", "5 năm tù", "TIME")]
    assert linked(spark, s, e, [("t0", "đâm", "BAO_LUC"), ("t1", "tuyên phạt", "XET_XU")]) == {("t0", "a"): "NAN_NHAN", ("t0", "k"): "HUNG_KHI", ("t1", "y"): "MUC_AN"}


def test_roles_for_organization():
    from vanloom.sources.io import roles_for

    assert roles_for("ORGANIZATION") == {"DOI_TUONG", "NAN_NHAN", "CO_QUAN"}


def test_masked_role_choice(spark):
    names = list(V.ROLE_LABELS)
    df = spark.createDataFrame([([0.0] + [5.0 if r == "TOI_DANH" else 1.0 if r == "DOI_TUONG" else -1.0 for r in names], "PERSON"), ([9.0] + [1.0] * len(names), "PERSON")], "x array<double>, l string")
    assert [r.r for r in df.select(events.choose_role(F.col("x"), F.col("l"), names).alias("r")).collect()] == ["DOI_TUONG", "NONE"]


REC = "row_id int, sentence string, entities array<struct<id:string,start:int,end:int,text:string,label:string>>, triggers array<struct<id:string,start:int,end:int,text:string,label:string>>, relations array<struct<from_id:string,to_id:string,role:string>>"


def test_lint_codes(spark):
    s = "TP. Nam bắt cóc Hải. Công an giết hại ở trường THCS Lê Lợi Huế"

    def sp(i, t, lab):
        return (i, s.index(t), s.index(t) + len(t), t, lab)

    rows = [(1, s, [sp("e0", "Nam", "PERSON"), sp("e1", "Công an", "ORGANIZATION"), sp("e2", "Hải.", "PERSON"), sp("e3", "trường THCS Lê Lợi Huế", "LOCATION")], [sp("t0", "bắt", "BAT_GIU"), sp("t1", "giết", "BAO_LUC")], [("t0", "e0", "TOI_DANH"), ("e1", "t1", "CO_QUAN"), ("t1", "e2", None)]), (2, "x", None, None, None)]
    got = {r.code for r in lint.lint(spark.createDataFrame(rows, REC), "row_id").where("row_id = 1").collect()}
    assert {"SPAN_DAU_CHAM", "ORG_CHUNG_CHUNG", "PERSON_LA_DIA_DANH", "TRIGGER_SAI_LOAI", "TRIGGER_THIEU_CHU", "CO_THE_THIEU_TRIGGER", "QH_SAI_KIEU", "QH_NGUOC_CHIEU", "QH_CHUA_CHON_VAI_TRO", "LOC_DINH_TEN_NGUOI", "ORG_CHUA_NOI_CO_QUAN", "CO_THE_THIEU_CO_QUAN"} <= got


def test_violations(spark):
    rows = [(1, "abc", [("e0", 0, 2, "xx", "PERSON")], [("t0", 0, 1, "a", "NOPE")], [("t0", "e9", "DOI_TUONG"), ("t0", "e0", "TOI_DANH"), ("t0", "e0", "X")])]
    got = sorted(r.code for r in lint.violations(spark.createDataFrame(rows, REC), "row_id").collect())
    assert got == ["dangling_id", "offset_mismatch", "role_label_mismatch", "unknown_event_type", "unknown_role"]


def test_tasks_to_records(spark):
    def lab(i, kind, a, z, t, x):
        return (i, "labels", kind, "text", None, None, None, (a, z, t, [x]))

    data = ("a1", "d1", 0, "Ma túy", "bắt Nam", False)
    gold = [lab("x", "trigger", 0, 3, "bắt", "BAT_GIU"), lab("y", "entity", 4, 7, "Nam", "PERSON"), (None, "relation", None, None, "y", "x", ["DOI_TUONG"], None)]
    tasks = [(1, data, [(True, []), (False, gold)], [("m", [])]), (2, data, [(True, gold)], [("m", gold)]), (3, data, None, None), (4, data, [(False, [])], [("m", gold)])]
    got = annotation.records(spark.createDataFrame(tasks, annotation.TASK)).collect()
    assert [r.source for r in got] == ["gold", "silver", "none", "gold"]
    assert got[0].relations == [("x", "y", "DOI_TUONG")] and got[3].entities == []


def test_ranks_and_cuts_without_a_sort(spark):
    from vanloom.operators import ranks, sampling

    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    got = {r.id: r.k for r in ranks.group_rank(rows, "g", ["id"], "k").collect()}
    assert all(got[i] == i // 3 + 1 for i in range(5000))
    d = sampling.draw("id")
    want = sorted(r.d for r in rows.select(d.alias("d")).collect())
    assert [ranks.nth(rows, d, k)[0] for k in (0, 17, 4999)] == [want[0], want[17], want[4999]] and ranks.nth(rows, d, 5000) is None
    for n in (0, 1, 1234, 5000, 6000):
        assert sorted(r.d for r in ranks.lowest(rows, d, n).select(d.alias("d")).collect()) == want[:n]
    many = rows.unionByName(rows).unionByName(rows)
    assert ranks.lowest(many, d, 100).count() == 100 and ranks.global_rank(rows.where("false"), ["id"], "k").count() == 0
    assert ranks.group_rank(spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, i int"), "g", ["i"], "k").count() == 3


def test_components_by_rounds_and_in_one_task(spark, monkeypatch):
    from vanloom.operators import graph

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, None), (200, 200)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200, None]], "node bigint")
    links = spark.createDataFrame(edges, "a bigint, b bigint")
    want = {(i, 0) for i in range(41)} | {(100, 100), (101, 100), (200, 200)}
    assert {tuple(r) for r in graph.components(nodes, links).collect()} == want
    monkeypatch.setattr(graph, "SMALL", 0)
    assert {tuple(r) for r in graph.components(nodes, links).collect()} == want
    assert {tuple(r) for r in graph.components(nodes, links.where("false")).collect()} == {(r[0], r[0]) for r in want}
