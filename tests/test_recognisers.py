"""The rule recogniser, one literal case for each rule."""

import pytest

from vanloom.operators.entities import RuleRecogniser, recognised


def found(text, label=None):
    return [x["text"] for x in recognised(text) if label in (None, x["label"])]


@pytest.mark.parametrize(
    ("text", "label", "want"),
    [
        # Organisations: unit words inside the name, "and" within it, none across to another agency, numbers, the comma of a department.
        ("Sở Giao thông vận tải tỉnh Bình Dương và Công an quận 10 thông báo", "ORGANIZATION", ["Sở Giao thông vận tải tỉnh Bình Dương", "Công an quận 10"]),
        ("Công ty Cổ phần Thương mại và Dịch vụ An Phát khai trương", "ORGANIZATION", ["Công ty Cổ phần Thương mại và Dịch vụ An Phát"]),
        ("Cục Cảnh sát phòng, chống tội phạm công nghệ cao vào cuộc", "ORGANIZATION", ["Cục Cảnh sát phòng, chống tội phạm công nghệ cao"]),
        ("Viện Kiểm sát nhân dân tối cao, TAND tỉnh Đồng Nai", "ORGANIZATION", ["Viện Kiểm sát nhân dân tối cao", "TAND tỉnh Đồng Nai"]),
        ("Phòng Cảnh sát hình sự Công an TP. Hà Nội bắt", "ORGANIZATION", ["Phòng Cảnh sát hình sự Công an TP. Hà Nội"]),
        # Not: an agency without a name, an office before it, trailing words and numbers that end no name, "ca" in small letters.
        ("công an bắt giữ một người", "ORGANIZATION", []),
        ("Chánh TAND huyện, phó Công an xã", "ORGANIZATION", []),
        ("Công ty ABC tỉnh bị phạt", "ORGANIZATION", ["Công ty ABC"]),
        ("Công ty ABC 2020 bị phạt", "ORGANIZATION", ["Công ty ABC"]),
        ("làm ca Đêm", "ORGANIZATION", []),
        ("Quốc hội họp, chính phủ trình", "ORGANIZATION", ["Quốc hội"]),
        # Places: after prepositions and units, with numbers and hyphens; not before agencies; gazetteer but for nationalities.
        ("sống ở Sa Pa theo diện", "LOCATION", ["Sa Pa"]),
        ("tại Công an thị trấn Sa Pa", "LOCATION", []),
        ("ngụ phường 12 gần TP. Vũng Tàu", "LOCATION", ["phường 12", "TP. Vũng Tàu"]),
        ("tại khu Bà Rịa-Vũng Tàu", "LOCATION", []),
        ("thuộc Ninh Phước-Bến Sơn", "LOCATION", ["Ninh Phước-Bến Sơn"]),
        ("người Trung Quốc đến Việt Nam", "LOCATION", ["Việt Nam"]),
        # Persons: titles, roles, surnames; a stop word ends the name, initials with a dot belong to it.
        ("ông Trần Bình và bà Lê T. Hoa", "PERSON", ["Trần Bình", "Lê T. Hoa"]),
        ("nạn nhân Phạm Thị Lan khai", "PERSON", ["Phạm Thị Lan"]),
        ("Nguyễn Văn An Tại đó", "PERSON", ["Nguyễn Văn An"]),
        ("đường Nguyễn Huệ", "PERSON", []),
        ("gặp Robert Smith", "PERSON", []),
        # Products, drugs, crimes, times, money.
        ("xe ga hiệu Ari Blade và một khẩu súng, giá dao động", "PRODUCT", ["xe ga hiệu Ari Blade", "súng"]),
        ("mua ma túy đá", "DRUG", ["ma túy đá"]),
        ("về tội trộm cắp tài sản", "CRIME", ["trộm cắp tài sản"]),
        ("sinh 1999, xảy ra 2020", "TIME", ["2020"]),
        ("ngày 12/5/2021 và 20 triệu đồng", "MONEY", ["20 triệu đồng"]),
    ],
)
def test_rules(text, label, want):
    assert found(text, label) == want


def test_dictionary_beats_rules_and_longer_phrases_win():
    rules = RuleRecogniser({"DRUG": ["Sa Pa"], "PRODUCT": ["Sa Pa mới"]})
    assert [(t, lab) for _, _, t, lab in rules("ở Sa Pa mới")] == [("Sa Pa mới", "PRODUCT")]
    assert found("") == [] and found("…") == []
