import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vanloom.functions import spans as S
from vanloom.functions import text as T


def one(spark, value, column):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(column.alias("r")).first().r


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab😀 Đđ.\n", max_size=30))
def test_finditer_equals_python(spark, text):
    got = one(spark, text, S.finditer(F.col("t"), "[ab😀]+", "x"))
    assert [(r.start, r.end, r.text) for r in got] == [(*m.span(), m.group()) for m in re.finditer("[ab😀]+", text)]


def test_phrases_are_whole(spark):
    got = one(spark, "Bắt đầu bắt giữ, bắtđầu", S.phrases(F.col("t"), {"X": ["bắt"]}))
    assert [r.start for r in got] == [0, 8]


def test_greedy_keeps_longest_and_never_overlaps(spark):
    got = one(spark, "bắt khẩn cấp", S.greedy(S.phrases(F.col("t"), {"A": ["bắt"], "B": ["bắt khẩn cấp"]})))
    assert [(r.label, r.start, r.end) for r in got] == [("B", 0, 12)]


def test_parse_and_format(spark):
    items = one(spark, "Nam|per; 3/4|DATE/TIME ; junk", S.parse_entities(F.col("t")))
    assert [(i.text, i.label) for i in items] == [("Nam", "PERSON"), ("3/4", "TIME")]
    for empty in ("NONE", "none", "", None):
        assert one(spark, empty, S.parse_entities(F.col("t"))) == []
    assert one(spark, "x", S.format_entities(S.finditer(F.col("t"), "y", "L"))) == "NONE"


def test_bio_round_trip(spark):
    t = F.col("t")
    toks, spans = S.finditer(t, r"\S+", ""), S.finditer(t, "Nguyễn Nam|Hà Nội", "NAME")
    back = one(spark, "Ông Nguyễn Nam ở Hà Nội", S.bio_decode(toks, S.bio_encode(toks, spans), t))
    assert [(b.start, b.end, b.text, b.label) for b in back] == [(4, 14, "Nguyễn Nam", "NAME"), (17, 23, "Hà Nội", "NAME")]


def test_bio_stray_inside_tag_opens_a_span(spark):
    t = F.col("t")
    back = one(spark, "a b c", S.bio_decode(S.finditer(t, r"\S+", ""), F.array(F.lit("I-X"), F.lit("O"), F.lit("I-X")), t))
    assert [(b.start, b.end) for b in back] == [(0, 1), (4, 5)]


def test_cut_words_and_highlight(spark):
    t = F.col("t")
    cut = one(spark, "ab cd", S.cut_at(S.finditer(t, r"\S+", ""), F.array(F.lit(1), F.lit(4), F.lit(0))))
    assert [(c.start, c.end) for c in cut] == [(0, 1), (1, 2), (3, 4), (4, 5)]
    assert one(spark, "xin Nam đi", S.highlight(t, S.finditer(t, "Nam", "P"))) == "xin [Nam|P] đi"


def test_text_scalars(spark):
    t = F.col("t")
    assert one(spark, None, T.clean_text(t)) == ""
    assert one(spark, "a ́​  b�c", T.clean_text(t)) == "á b c"
    assert one(spark, "  Đỗ, Ý_1 — 2! ", T.norm_key(t)) == "đỗ ý_1 2"
    assert [one(spark, x, T.n_words(t)) for x in (None, "", "  ", "a  b\nc")] == [0, 0, 0, 3]
    assert one(spark, "Ở ( đây ) , rồi .", T.detokenize(t)) == "Ở (đây), rồi."
    assert one(spark, "Tin (Ảnh: Nam) xem https://a.b/c . . . hết", T.remove_noise(t)) == "Tin xem . hết"


def test_fragments_join_the_sentence_before(spark):
    got = one(spark, "Một câu dài hẳn hoi.|nhưng còn nữa.|Hết.|Câu mới rất dài đây.", T.merge_fragments(F.split("t", r"\|")))
    assert got == ["Một câu dài hẳn hoi. nhưng còn nữa. Hết.", "Câu mới rất dài đây."]


def test_similarity_and_fold(spark):
    import difflib

    a, b = "bắt giữ Nam", "bắt giữ Năm"
    df = spark.createDataFrame([(a, b), (None, b)], "a string, b string")
    got = [r.r for r in df.select(T.similarity("a", "b").alias("r")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio(), None]
    assert one(spark, "Đỗ", T.accent_fold(F.col("t"))).folded in ("đo", "do")


def test_noise_as_the_reference_defines_it(spark):
    t = F.col("t")
    text = "Anh nói ... rồi đi. ( Nguồn : VN ) Tin ( Clip dài ) này. - Ảnh : Đ . BÌNH . Hết"
    assert one(spark, text, T.remove_noise(t)) == "Anh nói ... rồi đi. Tin ( Clip dài ) này. Hết"
    assert one(spark, "Bắt giữ - Ảnh : Công an cung cấp . Tin", T.remove_noise(t)) == "Bắt giữ . Tin"
    assert one(spark, "Đồ hoạ : QUANG N.ẨN Tin Xem Clip : hay", T.remove_noise(t)) == ". Tin hay"[2:]
    assert one(spark, None, T.remove_noise(t)) is None and one(spark, "", T.remove_noise(t)) == ""
