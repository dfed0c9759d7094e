"""Negation and reported speech, boundaries of further scripts, repeated ids, mixed chains, two updates of the component table."""

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import CLEAN, model  # noqa: F401
from vanloom.llm import abuse, encoding, mixing, segment


@pytest.mark.parametrize("text", ["You are not an idiot.", "I would never kill you, friend.", "Không ai được nói mày là đồ chó.", "Hắn nói: mày là thằng ngu", "Ce n'est pas un connard", "Er ist kein Arschloch", "He said: you are an idiot"])
def test_p10_negated_and_reported(text):
    assert abuse.default_grammar().score(text) < abuse.THRESHOLD


@pytest.mark.parametrize("text", ["You are a complete cretin and a degenerate.", "You people are cockroaches, go die.", "Du bist ein Arschloch", "tu es une merde, sale pute", "mày là thằng ngu", "You are an idiot, not a friend", "Never mind, you are an idiot"])
def test_p10_said(text):
    assert abuse.default_grammar().score(text) >= abuse.THRESHOLD


def test_p10_two_negations_cancel():
    kept, _ = abuse.negation([(0, 1, "negate", 0.0), (1, 2, "negate", 0.0), (2, 3, "insult", 0.6)])
    assert [k[2] for k in kept] == ["insult"]
    kept, _ = abuse.negation([(0, 1, "negate", 0.0), (1, 2, "insult", 0.6), (9, 10, "insult", 0.6)])
    assert kept == [(9, 10, "insult", 0.6)]


def parts(text, code=None):
    return [text[a:z] for a, z in segment.sentences(text, code)]


@pytest.mark.parametrize(
    ("code", "text", "n"),
    [
        ("de", "Das kostet z. B. 5 Euro. Am 5. Mai kam Dr. Müller an. Er ging.", 3),
        ("my", "ကျွန်တော် သွားတယ်။ သူ လာတယ်။", 2),
        ("km", "ខ្ញុំទៅផ្សារ។ គាត់មកដល់។", 2),
        ("am", "እኔ ሄድኩ። እሱ መጣ።", 2),
        ("ar", "ذهب الرجل إلى السوق. هل عاد؟ نعم عاد بمبلغ 3.5 دينار.", 3),
        (None, "እኔ ሄድኩ። እሱ መጣ።", 2),
    ],
)
def test_p7_further_scripts(code, text, n):
    assert len(parts(text, code)) == n


def test_p7_brackets_of_any_length():
    for k in (10, 60, 400):
        text = "Tòa tuyên án (" + "theo điều một. Nêu rõ lý do. " * k + "hết) hôm nay. Ông An về."
        assert len(parts(text, "vi")) == 2
    # An open bracket without its end is no bracket.
    assert len(parts("Một (hai. Ba bốn. Năm sáu.", "vi")) == 3


def test_p7_time_grows_with_the_text():
    import time

    def took(k):
        text = "Ông An nói: “Tôi về. Anh ở lại.” Bà Bình đi. " * k
        start = time.perf_counter()
        segment.sentences(text, "vi")
        return time.perf_counter() - start

    took(10)
    assert took(8000) < 40 * max(took(800), 0.01)


def test_p9_repeated_ids_count_as_documents(spark):
    docs = spark.createDataFrame([(1, "một hai ba bốn", "a")] * 3 + [(2, "năm sáu bảy tám", "b")] * 3 + [(3, None, "b"), (4, "x", None)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.5, 2), ("m", "c", 0.2, 1)], "mix_name string, source string, target_weight double, max_repeats int")
    sized = docs.withColumn("n_tokens", F.lit(4)).where("text is not null and source is not null")
    goal = {r.source: (r.available, r.documents) for r in mixing.plan(sized.select("source", "n_tokens"), targets).collect()}
    assert goal == {"a": (12, 3), "b": (12, 3), "c": (0, 0)}
    got = mixing.mix(docs, targets.where("source <> 'c'")).collect()
    assert {(r.source, r.doc_id) for r in got} <= {("a", 1), ("b", 2)} and all(1 <= r.copies <= 2 for r in got) and len(got) <= 6


def test_p1_two_updates_keep_all_splits(spark, tmp_path):
    from vanloom.llm import splits

    rows = [(i, f"train_{i // 3}", f"train_a{i // 5}" if i % 7 else None, "train") for i in range(60)] + [(100 + i, None, "", "val") for i in range(8)] + [(100, None, "-", "val")]
    schema = "row_id bigint, doc_id string, ann_id string, split string"
    df = spark.createDataFrame(rows, schema)
    first = splits.assign(df)
    splits.save(first.table, str(tmp_path / "t"))
    before = splits.load(spark, str(tmp_path / "t"))
    a = sorted((r.row_id, r.split) for r in first.rows.collect())
    assert len(a) == len(rows) and len(set(a)) == len(rows) - 1
    again = splits.assign(spark.createDataFrame([*rows, (500, "train_999", None, "train"), (501, None, None, "val")], schema), before)
    b = sorted((r.row_id, r.split) for r in again.rows.collect())
    assert [x for x in b if x[0] < 500] == a and len(b) == len(a) + 2 and all(s for _, s in b)
    assert {r.key for r in before.where("key like 'row:%'").collect()} == {f"row:{100 + i}" for i in range(8)}
    with pytest.raises(Exception, match="(?i)exist"):
        splits.save(first.table, str(tmp_path / "t"))


def test_p2_chains_of_different_steps(model):  # noqa: F811
    for first, then in (("western", "mac_roman"), ("western", "cp1250"), ("mac_roman", "western")):
        once = encoding.garble(CLEAN[0], first)
        twice = encoding.garble(once, then)
        if "\ufffd" not in twice:
            assert encoding.repair(twice, model).text == CLEAN[0], (first, then)
    # The legacy code page, read again as Latin-1.
    old = encoding.garble(CLEAN[1], "tcvn3")
    got = encoding.repair(encoding.garble(old, "latin-1"), model)
    assert got.text == "".join(encoding.TCVN.get(c, c) for c in old) and got.chain == "utf-8>western+tcvn3>western"


def test_p5_forms_and_keys(spark):
    from vanloom.llm import lookalike

    assert lookalike.unify("ﬁle ｶﾀｶﾅ") == "file カタカナ" and lookalike.unify("lωng ьút m² Ⅳ ½ №") == "lwng bút m² Ⅳ ½ №"
    assert lookalike.unify("ωμέγα мьсль") == "ωμέγα мьсль"
    keys = [lookalike.compare_key(t) for t in ("Ｔòa  ÁN m² STRASSE", "tòa án M2 straße", "to\u0300a\u00a0a\u0301n m\u00b2 strasse\u200b")]
    assert len(set(keys)) == 1 and lookalike.compare_key(None) is None and lookalike.compare_key("") == ""
    a = spark.createDataFrame([(1, "Ｔòa án", "x"), (2, "Tòa án", "x"), (3, None, None), (4, encoding.garble("Tòa án nhân dân\u200b", "western"), "x")], "article_id bigint, Content string, unified string")
    s = spark.createDataFrame([(7, "nhân\u00a0dân"), (8, "")], "row_id bigint, sentence string")
    got = {(r.table_name, r.record_id): r.compare_key for r in lookalike.one_form(a, s).collect()}
    assert got[("raw_articles", 1)] == "tòa án" and got[("sentences", 7)] == "nhân dân" and ("raw_articles", 2) not in got and ("sentences", 8) not in got


def test_p5_every_text_comes_out_and_garbled_ones_are_restored(spark):
    from vanloom.llm import lookalike

    garbled = encoding.garble(CLEAN[0] + "\u200b", "western")
    a = spark.createDataFrame([(1, "Ｔòa án"), (2, "Tòa án"), (3, None), (4, garbled), (5, CLEAN[0]), (6, "")] + [(10 + i, CLEAN[i % 3]) for i in range(60)], "article_id bigint, Content string")
    s = spark.createDataFrame([(7, "tòa\u00a0án"), (8, "")], "row_id bigint, sentence string")
    got = {(r.table_name, r.record_id): r for r in lookalike.all_forms(a, s).collect()}
    key = lambda t, i: got[(t, i)].compare_key
    assert len(got) == 67 and ("raw_articles", 3) not in got and got[("raw_articles", 6)].unified == ""
    assert key("raw_articles", 1) == key("raw_articles", 2) == key("sentences", 7) == "tòa án"
    assert got[("raw_articles", 4)].unified == CLEAN[0] and key("raw_articles", 4) == key("raw_articles", 5)
    assert {r.record_id for r in lookalike.one_form(a, s).collect()} == {1, 4, 7}


def test_p8_tokens_need_no_other_package():
    from vanloom.llm import tokens

    P = pytest.importorskip("public_tokenizers")
    assert tokens.PATTERN == P.PATTERN
