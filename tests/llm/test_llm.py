import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vanloom.llm import abuse, charmodel, copies, encoding, lookalike, mixing, overlap, packing, sampling, segment, splits, tokens

# 1


def rows1(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "row_id bigint, doc_id string, ann_id string, split string, key string, group_id string")


def test_p1_spellings_chains_and_lonely_rows(spark):
    rows = [(1, "train_00001", "train_a0001", "train"), (2, " TRAIN-1", "val_a0002", "val"), (3, None, "Val_a0000002", "val"), (4, "N/A", "none", "test"), (5, None, None, "test"), (6, "train_00002", "-", "train"), (6, "train 2", "", "train")]
    got = {(r.row_id, r.group_id) for r in splits.split_leaks(rows1(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}
    assert splits.split_leaks(rows1(spark, [])).count() == 0


def test_p1_hot_group_and_long_chain(spark):
    rows = [(i, "train_1", None, "train" if i % 2 else "val") for i in range(1, 200)] + [(1000 + i, f"test_{i}", f"test_a{i + 1}" if i % 2 else f"test_a{i}", "test") for i in range(40)]
    got = splits.split_leaks(rows1(spark, rows)).collect()
    assert len(got) == 199 and {r.group_id for r in got} == {1}


def test_p1_assignment_keeps_fills_and_quarantines(spark):
    first = rows1(spark, [(i, f"train_{i}", None, "train") for i in range(1, 301)])
    a = splits.assign(first)
    share = {r.split: r["count"] for r in a.rows.groupBy("split").count().collect()}
    assert sum(share.values()) == 300 and abs(share["train"] - 210) <= 25
    of = {r.key: r.split for r in a.table.collect()}
    k1 = next(k for k, v in of.items() if v == "train")
    k2 = next(k for k, v in of.items() if v == "test")
    n1, n2 = (int(k.split(":")[2]) for k in (k1, k2))
    b = splits.assign(rows1(spark, [(900, f"train_{n1}", "test_a7", "train"), (901, f"train_{n2}", "test_a7", "val"), (902, "val_999", None, "val"), (903, None, None, "val")]), a.table)
    got = {r.row_id: r.split for r in b.rows.collect()}
    assert got[900] is None and got[901] is None and got[902] and got[903]
    status = {r.key: r.status for r in b.table.collect()}
    assert status[k1] == "quarantined" and status["doc:val:999"] == "new" and sum(s == "kept" for s in status.values()) == 298


# 2


CLEAN = ["Công an tỉnh đã bắt giữ nhiều đối tượng trộm cắp tài sản ở phường Bình Hòa.", "Hội đồng xét xử tuyên phạt bị cáo mười năm tù về tội lừa đảo chiếm đoạt tài sản.", "Người dân phản ánh việc đổ thải xuống kênh vào sáng sớm, gây bức xúc."]


@pytest.fixture(scope="module")
def model():
    c = charmodel.Counts()
    rng = random.Random(1)
    words = " ".join(CLEAN).split()
    c.add(CLEAN * 30 + [" ".join(rng.sample(words, 12)) for _ in range(400)])
    c.flush()
    return charmodel.CharModel(c.total)


@pytest.mark.parametrize("chain", ["western", "latin-1", "cp1258", "cp1250", "mac_roman", "tcvn3"])
def test_p2_round_trip(model, chain):
    for t in CLEAN:
        bad = encoding.garble(t, chain)
        if chain == "western" or "�" in bad:
            got = encoding.repair(bad, model)
            assert got.chain
        else:
            got = encoding.repair(bad, model)
            assert got.text == t or chain == "tcvn3" and got.chain, (bad, got)


def test_p2_clean_and_lost(model):
    for t in [*CLEAN, "", None, "Đại biểu Ângela Çorlu (§ 14, bản quyền © Nam), 39 m² giá £200", "Ở đâu?Đồn công an", "http://a.b/c?id=1", "Kê\xadnh và\xa0xã", "« Je n'ai rien vu », a répondu Mme Lê"]:
        assert encoding.repair(t, model).chain == "", t
    assert encoding.repair("C? quan gi?m ??nh", model).lost and encoding.repair("h�ng", model).lost
    twice = encoding.garble(encoding.garble(CLEAN[0], "latin-1"), "latin-1")
    assert encoding.repair(twice, model).text == CLEAN[0]


def test_p2_margin_is_validated(model):
    margin, f1 = encoding.validated_margin([" ".join(CLEAN + CLEAN[::-1])] * 3, model)
    assert f1 > 0.8 and margin <= 2.0


def test_p2_tables(spark):
    rows = [(i, CLEAN[i % 3], CLEAN[(i + 1) % 3], "m") for i in range(60)] + [(100, encoding.garble(CLEAN[0], "latin-1"), None, "m"), (101, None, "", "m"), (100, encoding.garble(CLEAN[0], "latin-1"), None, "m")]
    df = spark.createDataFrame(rows, "article_id bigint, Content string, Summarize string, text string")
    assert [(r.article_id, r.field_name) for r in encoding.garbled_fields(df).collect()] == [(100, "Content")] * 2
    assert encoding.garbled_fields(df.limit(0)).count() == 0


# 3


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_p3_common_subsequence_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint32), rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint32)
        assert overlap.common(a, b) == brute_lcs(a.tolist(), b.tolist())


def test_p3_fingerprints():
    a, b, c, d, e = overlap.fingerprints(["Xin chào, Nam!", "xin  CHÀO nam", "xinchào nam", "", "東京都"])
    assert a[:2] == b[:2] == c[:2] and len(a[2]) == 3 and len(c[2]) == 2 and d[:2] == (0, 0) and len(e[2]) == 3


def test_p3_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"tu{i}" for i in range(800)]
    rows, texts = [], []
    for i in range(120):
        if texts and rng.random() < 0.4:
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, len(w) // 20, len(w) // 12])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            t = " ".join(w)
        else:
            t = " ".join(rng.choices(vocab, k=rng.choice([6, 30, 90, 200])))
        texts.append(t)
        rows.append((i, rng.choice(["train", "val", "test"]), f"s{i % 50}" if i % 9 == 0 else None, t.upper() if i % 2 else t, "o"))
    rows += [(900, "val", "", None, "o"), (901, "train", None, "", "o"), (902, None, "s0", texts[0], "o")]
    df = spark.createDataFrame(rows, "article_id bigint, split string, Summarize string, Content string, outlet string")
    got = {(r.article_id_a, r.article_id_b) for r in overlap.overlaps(df).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == "train" and b[1] in ("val", "test"):
                x, y = (a[3] or "").lower().split(), (b[3] or "").lower().split()
                if (a[2] and a[2] == b[2]) or (x and y and brute_lcs(x, y) >= 0.8 * max(len(x), len(y))):
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert got == want
    assert overlap.overlaps(df.limit(0)).count() == 0


# 4


def test_p4_copies(spark):
    rows = [(1, "Tóm tắt", "Nội dung, dài."), (2, "NỘI DUNG DÀI", "tóm  tắt!"), (3, "Tom tat", "Nội dung dài"), (4, None, None), (5, "", "…"), (1, "Tóm tắt", "Nội dung, dài."), (6, "x", None), (7, None, "X")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "article_id bigint, Summarize string, Content string, h string")
    assert {(r.first_id, r.copy_id) for r in copies.copies(df).collect()} == {(1, 2), (4, 5), (6, 7)}
    assert {r.first_id: r.copies for r in copies.collapse(df).collect()} == {1: 3, 3: 1, 4: 2, 6: 2}
    assert copies.collisions(copies.hashed(df, "article_id", ("Summarize", "Content"))).count() == 0
    assert copies.copies(df.limit(0)).count() == 0


# 5


def test_p5_unify():
    u = lookalike.unify
    assert u("Тhắng lіên") == "Thắng liên" and u("ðồng Ɖội") == "đồng Đội" and u("ｈàｎg １２") == "hàng 12"
    assert u("a​b\xa0c　d\xad") == "ab c d" and u("Nguyễn") == "Nguyễn" and u("a ́") == "á"
    for same in ("Москва Ελλάδα α-4", "👮‍♂️ 39 m² ½ № 5", "（全）、。？", "ज़मीन की", None, "", "tab\tline\n"):
        assert u(same) == same
    assert lookalike.compare_key("ＨÀ  Nội") == lookalike.compare_key("hà\xa0nội")


def test_p5_tables(spark):
    a = spark.createDataFrame([(1, "sạch sẽ", ""), (2, "nhà​", None), (3, None, "x"), (4, encoding.garble(CLEAN[0], "latin-1"), "")] + [(10 + i, CLEAN[i % 3], "") for i in range(60)], "article_id bigint, Content string, Summarize string")
    b = spark.createDataFrame([(1, "Тhắng"), (2, None), (2, "ok"), (1, "Тhắng")], "row_id bigint, sentence string")
    got = sorted((r.table_name, r.record_id) for r in lookalike.variants(a, b).collect())
    assert got == [("raw_articles", 2), ("sentences", 1), ("sentences", 1)]


# 6


def test_p6_keys():
    k = sampling.category_key
    assert len({k(x) for x in ("Ma túy", "MA TUÝ", " ma  túy", "Ma túy")}) == 1 and k(None) is None and k(" - ") is None and k("Ma tuy") != k("Ma túy")


def test_p6_quotas(spark):
    rows = [(i, "A" if i < 700 else "b " if i < 950 else "C" if i < 990 else None, "L") for i in range(1000)]
    df = spark.createDataFrame(rows, "article_id bigint, SubLabel string, Label string")
    t = spark.createDataFrame([("s", "SubLabel", "a", 0.5, 1, 0.4), ("s", "SubLabel", "B", 0.3, 1, 0.4), ("s", "SubLabel", "c", 0.2, 1, 0.4), ("s", "SubLabel", "D", 0.0, 5, 0.4)], "target_set string, field_name string, category string, target_share double, min_rows int, sample_share double")
    got = sampling.sample(df, t)
    assert {r.category: r["count"] for r in got.groupBy("category").count().collect()} == {"a": 200, "B": 120, "c": 40}
    assert {r.record_id for r in got.collect()} == {r.record_id for r in sampling.sample(df.repartition(5), t).collect()}
    assert {r.category for r in sampling.unreachable(df, t).collect()} == {"c", "D"}
    assert sampling.sample(df.limit(0), t).count() == 0 and sampling.unreachable(df.limit(0), t).count() == 4


# 7


@pytest.mark.parametrize(
    ("lang", "text", "want"),
    [
        ("vi", "Vụ ở Q. Nam Trạch, TP. Hà Nội. Nhóm của chị H. Theo TS. Nam, 13.623 USD.Hết!", ["Vụ ở Q. Nam Trạch, TP. Hà Nội.", "Nhóm của chị H.", "Theo TS. Nam, 13.623 USD.", "Hết!"]),
        ("vi", "Tít không dấu\nNam nói: “Mưa to! Không thấy gì nữa”. Rồi đi... im bặt. Đ.P.T. khai , v.v . Xong .", ["Tít không dấu", "Nam nói: “Mưa to! Không thấy gì nữa”.", "Rồi đi... im bặt.", "Đ.P.T. khai , v.v .", "Xong ."]),
        ("en", '"Stop!" shouted Mr. Nam near No. 5. He left at 9 p.m. because. Next.', ['"Stop!" shouted Mr. Nam near No. 5.', "He left at 9 p.m. because.", "Next."]),
        ("fr", "« Je sais. Demandez », a dit M. Nam, art. 27 du code. Fin.", ["« Je sais. Demandez », a dit M. Nam, art. 27 du code.", "Fin."]),
        ("zh", "他问：“为什么？”案件已移交。“我不认识。不是我！”他说。", ["他问：“为什么？”", "案件已移交。", "“我不认识。不是我！”他说。"]),
        ("ja", "「見ていない。聞いてくれ」と話した。次。", ["「見ていない。聞いてくれ」と話した。", "次。"]),
        ("hi", "डॉ. अ ने कहा। “नहीं देखी। पूछिए”, उसने कहा।", ["डॉ. अ ने कहा।", "“नहीं देखी। पूछिए”, उसने कहा।"]),
        ("th", "วันที่ 15 มีนาคม พยานเห็น 23 คน\nจบ", ["วันที่ 15 มีนาคม", "พยานเห็น 23 คน", "จบ"]),
        (None, "", []),
        ("vi", None, []),
    ],
)
def test_p7_sentences(lang, text, want):
    assert [text[a:z] for a, z in segment.sentences(text, lang)] == want


def test_p7_covers_long_text():
    text = "Một câu dài. " * 20000
    got = segment.sentences(text, "vi")
    assert len(got) == 20000 and got[-1][1] == len(text.rstrip())


# 8


def test_p8_fullest_equals_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 30), 6), reverse=True)
        counts = [rng.randint(0, 3) for _ in lengths]
        room = rng.randint(0, 60)
        got = sum(lengths[i] * n for i, n in packing.fullest(lengths, counts, room))
        sums = {0}
        for x, n in zip(lengths, counts, strict=True):
            sums = {s + k * x for s in sums for k in range(n + 1)}
        assert got == max(s for s in sums if s <= room)
        assert all(n <= counts[i] for i, n in packing.fullest(lengths, counts, room))


def test_p8_pack_is_whole_and_tight():
    sizes = np.random.default_rng(1).integers(1, 256, 3000)
    bins = packing.pack(sizes, 256)
    used = np.bincount(bins, weights=sizes)
    assert (bins >= 0).all() and used.max() <= 256 and len(used) <= 1.01 * sizes.sum() / 256 + 1


def test_p8_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 200), (2, None), (3, ""), (4, "xin chào"), (4, "xin chào")], "doc_id bigint, text string")
    box = spark.createDataFrame([("s", 64), ("bad", 0), (None, None)], "container_name string, capacity_tokens int")
    got = packing.fill(docs, box).collect()
    n = tokens.count("a b c " * 200)
    mine = sorted((r.token_start, r.token_end) for r in got if r.doc_id == 1)
    assert mine[0][0] == 0 and mine[-1][1] == n and all(a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False)) and all(e - s == 64 for s, e in mine[:-1])
    assert [r.bin for r in got if r.doc_id in (2, 3)] == [None, None] and len([r for r in got if r.doc_id == 4]) == 2
    assert packing.fill(docs.limit(0), box).count() == 0


# 9


def test_p9_pivotal_keeps_mass_and_expectation():
    size, p = [3, 5, 2, 7, 4], [0.3, 0.6, 0.5, 0.25, 0.9]
    mean = np.zeros(5)
    for seed in range(3000):
        out, left, q = mixing.pivotal(p, size, random.Random(seed))
        mass = sum(s * o for s, o in zip(size, out, strict=True)) + (size[left] * q if left is not None else 0)
        assert mass == pytest.approx(sum(s * x for s, x in zip(size, p, strict=True)))
        got = np.array(out, dtype=float)
        if left is not None:
            got[left] = q
        mean += got
    assert np.allclose(mean / 3000, p, atol=0.04)


def test_p9_mix(spark):
    docs = spark.createDataFrame([(i, "xin chào các bạn " * (1 + i % 5), "big" if i < 300 else "small" if i < 320 else None) for i in range(330)] + [(999, None, "big")], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("m", "big", 0.5, 2), ("m", "small", 0.5, 3), ("m", "none", 0.1, 3)], "mix_name string, source string, target_weight double, max_repeats int")
    got = mixing.mix(docs, t)
    rep = {r.source: r for r in mixing.mix_report(docs, t, got).collect()}
    assert rep["small"].most_copies == 3 and abs(rep["big"].actual_share - 0.5) < 0.05 and rep["none"].tokens == 0
    assert {(r.doc_id, r.copies) for r in got.collect()} == {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(6), t).collect()}
    assert mixing.mix(docs.limit(0), t).count() == 0


# 10


BAD = ["Mày ngu như bò, óc bã đậu vừa thôi", "M*t X nhìn như cái b@, x#u người xấu nết", "Th1 ng00i", "May ngu nhu bo, ban thiu vua thoi", "Đ_ị_t mẹ thằng đó, đồ k h ố n n ạ n", "Thứ s-ú-c v_ậ_t như mày", "Go to hell, you fuckinggg bastard", "vсl thằng óс сhó", "All Foo people are vermin, throw them out", "Nude pics, wet pussy, no blur"]
GOOD = ["Hạt óc chó giá 20 đồng", "Tôi giết thời gian ở đây", "Thịt lợn, đầu lợn tăng giá", "Bị cáo lĩnh án về tội Hiếp dâm, phiên xử kín", "Nam bị phạt vì đăng lời lẽ xúc phạm", "She killed it on stage", "Nói chuyện giáo dục giới tính", "V.C.L. nói mưa to", "", "Con chó nhà Nam sủa cả đêm"]


def test_p10_clauses():
    g = abuse.default_grammar()
    assert [t for t in BAD if g.score(t) < abuse.THRESHOLD] == ["Th1 ng00i"]
    assert [t for t in GOOD if g.score(t) >= abuse.THRESHOLD] == [] and g.score(None) == 0


def test_p10_sieve_loses_nothing():
    g, s = abuse.default_grammar(), abuse.default_sieve()
    texts = [f"{a} {b}" for a in GOOD for b in BAD] + GOOD + BAD
    full = [g.score(t) >= abuse.THRESHOLD for t in texts]
    assert [x >= abuse.THRESHOLD for x in abuse.score_all(pa.array([*texts, None], pa.string()), g, s)] == [*full, False]


def test_p10_tables(spark):
    docs = spark.createDataFrame([(1, BAD[0], "a"), (2, GOOD[0], "a"), (3, None, None), (1, BAD[0], "a")], "doc_id bigint, text string, source string")
    assert [r.doc_id for r in abuse.abusive(docs).collect()] == [1, 1]
    assert {r.source: (r.documents, r.abusive) for r in abuse.rates(docs).collect()} == {"a": (3, 2), None: (1, 0)}
    assert abuse.abusive(docs.limit(0)).count() == 0
