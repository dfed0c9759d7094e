"""Annotation lint: one row per record and distinct (code, detail). Every check is a select over the record's arrays.

Records: key, sentence, entities and triggers (array<struct<id,start,end,text,label>>), relations
(array<struct<from_id,to_id,role>>). Null arrays count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanloom.functions import spans as S
from vanloom.functions.text import at
from vanloom.operators import vocabulary as V

# Words and phrases the checks look for.
GENERIC_ORGS = ("công an", "cảnh sát", "tòa", "toà")
NOT_PERSONS = ("Song", "Tòa", "Toà", "HĐXX", "Ví", "Tuy", "Nhưng", "Theo")
UNITS = "TP\\.?|tỉnh|huyện|quận|xã|phường|thị xã|thị trấn|thành phố"
TITLES = "anh|chị|ông|bà|bị can|bị cáo|đối tượng|nghi phạm|nạn nhân"
NOT_EVENT = "ý định|âm mưu|quyết tâm|kế hoạch|nghi ngờ|chưa|không|đánh|truy|nhằm|để|loại hình|tội phạm"
HOME = r"(?:quê|ngụ|trú|cư trú|thường trú|sinh sống|SN \d{4},? ở|tuổi,? ở)[^()]{0,40}$"
OFTEN_MISSED = {"xử phạt": "XET_XU", "tấn công": "BAO_LUC", "bắt cóc": "BAO_LUC", "giết hại": "BAO_LUC", "lừa đảo chiếm đoạt": "LUA_DAO", "khống chế bắt giữ": "BAT_GIU"}


def issues(rec: DataFrame) -> Column:
    """array<struct<code,detail>> of one record."""
    text = F.col("sentence")
    empty = F.array().cast("array<struct<id:string,start:int,end:int,text:string,label:string>>")
    ents, trigs = F.coalesce("entities", empty), F.coalesce("triggers", empty)
    rels = F.coalesce("relations", F.array().cast("array<struct<from_id:string,to_id:string,role:string>>"))
    none = F.array().cast("array<struct<code:string,detail:string>>")

    def before(s: Column, n: int) -> Column:
        return F.when(s["start"] > 0, text.substr(F.greatest(s["start"] - n, F.lit(0)) + 1, F.least(s["start"], F.lit(n)))).otherwise("")

    def per(spans: Column, code: str, test, detail=lambda s: s["text"]) -> Column:
        return F.transform(F.filter(spans, test), lambda s: F.struct(F.lit(code).alias("code"), detail(s).alias("detail")))

    def adjacent(spans: Column, code: str, ok) -> Column:
        o = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["label"].alias("label"))))
        two = F.zip_with(F.slice(o, 1, F.greatest(F.size(o) - 1, F.lit(0))), F.slice(o, 2, F.size(o)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        gap = lambda p: F.trim(F.when(p["b"]["start"] > p["a"]["end"], text.substr(p["a"]["end"] + 1, p["b"]["start"] - p["a"]["end"])).otherwise(""))
        hit = F.filter(two, lambda p: p["b"].isNotNull() & ok(p["a"], p["b"]) & (gap(p) == ""))
        return F.when(F.size(o) < 2, none).otherwise(F.transform(hit, lambda p: F.struct(F.lit(code).alias("code"), F.concat_ws(" + ", p["a"]["text"], p["b"]["text"]).alias("detail"))))

    is_ = lambda x: lambda s: s["label"] == x
    low = lambda s: F.lower(F.trim(s["text"]))
    after = lambda s, n: text.substr(s["end"] + 1, F.lit(n))
    proc = F.exists(trigs, lambda t: t["label"].isin(*V.PROCEDURAL_EVENTS))
    spans = F.concat(ents, trigs)
    by_id = lambda i: at(F.filter(spans, lambda s: s["id"] == i), 1)
    is_trigger = lambda i: F.exists(trigs, lambda t: t["id"] == i)
    known = F.filter(rels, lambda r: F.exists(spans, lambda s: s["id"] == r["from_id"]) & F.exists(spans, lambda s: s["id"] == r["to_id"]))
    arrow = lambda r: F.concat_ws(" -> ", by_id(r["from_id"])["text"], by_id(r["to_id"])["text"])
    role_ok = lambda r: F.coalesce(r["role"].isin(*V.ROLE_LABELS), F.lit(False))
    from vanloom.operators.events import admits

    named = F.filter(known, lambda r: is_trigger(r["from_id"]) & role_ok(r))
    checks = [
        per(ents, "SPAN_DAU_CHAM", lambda s: s["text"].endswith(".")),
        per(ents, "ORG_CHUNG_CHUNG", lambda s: is_("ORGANIZATION")(s) & low(s).isin(*GENERIC_ORGS)),
        per(ents, "PERSON_SAI", lambda s: is_("PERSON")(s) & (s["text"].isin(*NOT_PERSONS) | s["text"].rlike(r"^\p{Ll}"))),
        per(ents, "PERSON_LA_DIA_DANH", lambda s: is_("PERSON")(s) & before(s, 30).rlike(rf"(?iu)(?:{UNITS})\s*$")),
        per(ents, "LOC_LA_NGUOI", lambda s: is_("LOCATION")(s) & before(s, 15).rlike(rf"(?iu)(?:{TITLES})\s*$")),
        per(ents, "DRUG_TRONG_TEN_DON_VI", lambda s: is_("DRUG")(s) & before(s, 20).rlike(r"(?iu)(?:phòng,? chống|chống|tội phạm về)\s*$")),
        per(ents, "LOC_DINH_TEN_NGUOI", lambda s: is_("LOCATION")(s) & (F.size(F.split(F.trim(s["text"]), r"\s+")) >= 4) & s["text"].rlike(r"(?<!\p{L})(?:THCS|THPT|trường)(?!\p{L})")),
        per(ents, "LOC_VIET_TAT", lambda s: is_("LOCATION")(s) & s["text"].rlike("^[A-Z]{1,5}$")),
        adjacent(ents, "TIME_BI_TACH", lambda a, b: (a["label"] == "TIME") & (b["label"] == "TIME")),
        adjacent(trigs, "TRIGGER_BI_TACH", lambda a, b: a["label"] == b["label"]),
        per(trigs, "TRIGGER_THIEU_CHU", lambda s: (low(s) == "giết") & (after(s, 4) == " hại")),
        per(trigs, "TRIGGER_SAI_LOAI", lambda s: (low(s) == "bắt") & (after(s, 4) == " cóc")),
        per(trigs, "CO_THE_KHONG_PHAI_SU_KIEN", lambda s: before(s, 20).rlike(rf"(?iu)(?:{NOT_EVENT})\s+$")),
        *[per(F.filter(S.finditer(text, f"(?iu)\\Q{p}\\E", label), lambda h: ~F.exists(trigs, lambda t: (t["start"] <= h["start"]) & (h["end"] <= t["end"]))), "CO_THE_THIEU_TRIGGER", lambda h: F.lit(True)) for p, label in OFTEN_MISSED.items()],
        per(F.filter(known, lambda r: ~is_trigger(r["from_id"])), "QH_NGUOC_CHIEU", lambda r: F.lit(True), arrow),
        per(F.filter(known, lambda r: is_trigger(r["from_id"]) & ~role_ok(r)), "QH_CHUA_CHON_VAI_TRO", lambda r: F.lit(True), arrow),
        per(named, "QH_SAI_KIEU", lambda r: ~admits(r["role"], by_id(r["to_id"])["label"]), arrow),
        per(named, "DIA_DIEM_LA_QUE_NOI_O", lambda r: (r["role"] == "DIA_DIEM") & before(by_id(r["to_id"]), 45).rlike(f"(?iu){HOME}"), arrow),
        F.when(F.size(trigs) > 0, per(ents, "PERSON_CHUA_NOI", lambda s: is_("PERSON")(s) & ~F.exists(rels, lambda r: r["to_id"] == s["id"]))).otherwise(none),
        F.when(proc, per(ents, "ORG_CHUA_NOI_CO_QUAN", lambda s: is_("ORGANIZATION")(s) & ~F.exists(rels, lambda r: r["to_id"] == s["id"]))).otherwise(none),
        F.when(F.size(ents) > 0, per(trigs, "TRIGGER_CHUA_NOI", lambda s: ~F.exists(rels, lambda r: r["from_id"] == s["id"]))).otherwise(none),
        F.when(F.exists(ents, is_("ORGANIZATION")), per(trigs, "CO_THE_THIEU_CO_QUAN", lambda s: s["label"].isin(*V.PROCEDURAL_EVENTS) & F.exists(rels, lambda r: r["from_id"] == s["id"]) & ~F.exists(rels, lambda r: (r["from_id"] == s["id"]) & (r["role"] == "CO_QUAN")))).otherwise(none),
    ]
    return F.array_distinct(F.concat(*checks))


def lint(rec: DataFrame, key: str) -> DataFrame:
    """``key, code, detail``."""
    return rec.select(key, F.explode(issues(rec)).alias("i")).select(key, "i.code", "i.detail")


def violations(rec: DataFrame, key: str) -> DataFrame:
    """``key, code, detail`` of structural errors: text and offsets, unknown types, dangling ids, unknown or inadmissible roles."""
    text = F.col("sentence")
    ents, trigs, rels = F.col("entities"), F.col("triggers"), F.col("relations")
    by = lambda spans, i: at(F.filter(spans, lambda s: s["id"] == i), -1)
    from vanloom.operators.events import admits

    bad = lambda spans, code, test: F.transform(F.filter(spans, test), lambda s: F.struct(F.lit(code).alias("code"), s["id"].alias("detail")))
    rel = lambda code, test: F.transform(F.filter(rels, test), lambda r: F.struct(F.lit(code).alias("code"), F.concat_ws("->", r["from_id"], r["to_id"]).alias("detail")))
    out = F.concat(
        bad(F.concat(ents, trigs), "offset_mismatch", lambda s: ~F.coalesce(S.exact_text(text, s), F.lit(False))),
        bad(trigs, "unknown_event_type", lambda s: ~s["label"].isin(*V.CRIME_EVENTS, *V.PROCEDURAL_EVENTS)),
        rel("dangling_id", lambda r: by(trigs, r["from_id"]).isNull() | by(ents, r["to_id"]).isNull()),
        rel("unknown_role", lambda r: ~F.coalesce(r["role"].isin(*V.ROLE_LABELS), F.lit(False))),
        rel("role_label_mismatch", lambda r: r["role"].isin(*V.ROLE_LABELS) & by(ents, r["to_id"]).isNotNull() & ~admits(r["role"], by(ents, r["to_id"])["label"])),
    )
    return rec.select(key, F.explode(F.array_distinct(out)).alias("i")).select(key, "i.code", "i.detail")
