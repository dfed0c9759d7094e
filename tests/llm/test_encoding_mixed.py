"""Problem 2: stretches of one text that were damaged in different ways."""

import pytest

from tests.llm.test_llm import CLEAN, model  # noqa: F401
from vanloom.llm import encoding


@pytest.mark.parametrize("other", ["cp1258", "mac_roman", "tcvn3"])
def test_p2_two_chains_in_one_text(model, other):  # noqa: F811
    between = " Theo thong tin ban dau cua co quan chuc nang hom nay. "
    # Words of which the wrong codec has no character for a byte are lost for good.
    second = " ".join(w for w in CLEAN[1].split() if "\ufffd" not in encoding.garble(w, other))
    bad = encoding.garble(CLEAN[0], "western") + between + encoding.garble(second, other)
    got = encoding.repair(bad, model)
    assert "utf-8>western" in got.chain and encoding.garble(second, other) not in got.text
    if other == "tcvn3":
        assert "tcvn3>western" in got.chain and got.text.startswith(CLEAN[0] + between)
    else:
        assert got.text == CLEAN[0] + between + second


def test_p2_readings_that_look_worse_at_first_are_followed(model):  # noqa: F811
    bad = CLEAN[0]
    for chain in ("mac_roman", "cp437", "western", "western"):
        bad = encoding.garble(bad, chain)
    assert encoding.repair(bad, model).text == CLEAN[0]


def test_p2_chains_of_any_length(model):  # noqa: F811
    bad = CLEAN[1]
    for _ in range(5):
        bad = encoding.garble(bad, "western")
    assert encoding.repair(bad, model).text == CLEAN[1]


def test_p2_no_string_is_scored_twice(model):  # noqa: F811
    scored = []

    class Watched:
        def mean(self, text):
            scored.append(text)
            return model.mean(text)

    bad = CLEAN[0]
    for chain in ("mac_roman", "western"):
        bad = encoding.garble(bad, chain)
    bad += " Theo thong tin ban dau cua co quan chuc nang hom nay. " + encoding.garble(CLEAN[1], "tcvn3")
    assert encoding.repair(bad, Watched()) == encoding.repair(bad, model)
    assert len(scored) == len(set(scored)) > 10
